"""Fill-in-the-middle rows, cut by rank and select over token boundaries.

The last byte of every token is a set bit of one packed vector a batch. A
directory holds the bits set before each block of ``BLOCK`` words, so that
``Bits.rank`` (bits set before a byte) and ``Bits.select`` (byte of the k-th set
bit) read one entry of it and the words of one block. The total between a text's
ends gives its number of tokens, select on two ranks its two cuts, and rank over
a second vector, of the bytes that begin a code point, the lengths in characters.
Only these five numbers a row come from Python; Spark cuts, arranges and hashes.

Defined cases. A null or empty text has no token and stays as it is (plain), as
does one that holds a marker. A null id draws like an empty one. Repeated rows and
ids draw alike. Texts of any length are cut whole. An empty table gives no row;
extra columns are ignored, but for those named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: 64-bit words of one block of the directory.
BLOCK = 8
#: What marks the prefix, the suffix and the middle of an output.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes that one pair of vectors covers; a longer text has a pair of its own.
SPAN = 8 << 20


class Bits:
    """A packed bit vector with a block popcount directory."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(-(-len(packed) // (8 * BLOCK)) * BLOCK + BLOCK, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        in_word = np.bitwise_count(self.words).astype(np.int64)
        self.directory = np.concatenate([[0], np.cumsum(in_word.reshape(-1, BLOCK).sum(1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK
        inside = self.words[block[:, None] * BLOCK + np.arange(BLOCK)]
        whole = np.where(np.arange(BLOCK) < (word % BLOCK)[:, None], np.bitwise_count(inside), 0).sum(1, dtype=np.int64)
        part = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.directory[block] + whole + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit, from 1 on."""
        block = np.searchsorted(self.directory, k, side="left") - 1
        left = k - self.directory[block]
        inside = self.words[block[:, None] * BLOCK + np.arange(BLOCK)]
        passed = np.cumsum(np.bitwise_count(inside).astype(np.int64), axis=1)
        nth = (passed < left[:, None]).sum(1)
        left = left - np.where(nth > 0, np.take_along_axis(passed, np.maximum(nth - 1, 0)[:, None], 1)[:, 0], 0)
        word = self.words[block * BLOCK + nth]
        set_bits = np.cumsum((word[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), axis=1)
        return (block * BLOCK + nth) * 64 + (set_bits < left[:, None].astype(np.uint64)).sum(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each byte ends a token: a word's last byte, or a text's last byte.
    ``starts``: where each text begins, and the end of all."""
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    filled = starts[1:] > starts[:-1]
    ends[starts[1:][filled] - 1] = True
    return ends


def cuts(texts: pa.BinaryArray, first: pa.Array, second: pa.Array) -> pa.StructArray:
    """``n, left, right, prefix_chars, middle_chars`` of each text: its tokens, the
    bytes before its two cuts, and the lengths between them in code points."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    out = np.zeros((5, len(texts)), np.int64)
    past = np.cumsum(length)
    at = 0
    while at < len(texts):  # as many texts as fill a span, one at least
        to = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + SPAN, side="right")))
        data = np.frombuffer(b"".join(t for t in texts.slice(at, to - at).to_pylist() if t), np.uint8)
        starts = np.concatenate([[0], np.cumsum(length[at:to])])
        ends, chars = Bits(boundaries(data, starts)), Bits((data & 0xC0) != 0x80)
        before = ends.rank(starts)
        n = before[1:] - before[:-1]
        low, high = np.minimum(a[at:to] % (n + 1), b[at:to] % (n + 1)), np.maximum(a[at:to] % (n + 1), b[at:to] % (n + 1))
        cut = [np.where(k > 0, ends.select(np.maximum(before[:-1] + k, 1)) + 1, starts[:-1]) if len(data) else starts[:-1] for k in (low, high)]
        ranks = [chars.rank(x) for x in (starts[:-1], *cut)]
        out[:, at:to] = n, cut[0] - starts[:-1], cut[1] - starts[:-1], ranks[1] - ranks[0], ranks[2] - ranks[1]
        at = to
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "left", "right", "prefix_chars", "middle_chars"])


def draw(key: Column, seed: int, which: int) -> Column:
    """The ``which``-th unsigned 32-bit number of a row."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hashed, 8 * which - 7, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, share: int = 50, spm: int = 80, seed: int = 42, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row; ``share``
    of a hundred rows are rearranged, ``spm`` of a hundred of these suffix first."""

    @F.arrow_udf("n long, left long, right long, prefix_chars long, middle_chars long")
    def cut_batches(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            yield cuts(texts, first, second)

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), *[c for c in carry if c not in ("doc_id", "text")])
    at = rows.withColumn("cut", cut_batches(F.col("text").cast("binary"), draw(F.col("doc_id"), seed, 1), draw(F.col("doc_id"), seed, 2)))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.pmod(draw(F.col("doc_id"), seed, 3), F.lit(100)) >= share)
    form = F.when(plain, "plain").when(F.pmod(draw(F.col("doc_id"), seed, 4), F.lit(100)) < spm, "spm").otherwise("psm")
    whole, left, right = F.col("text").cast("binary"), F.col("cut.left").cast("int"), F.col("cut.right").cast("int")
    piece = lambda since, until: F.substring(whole, since + 1, until - since).cast("string")
    prefix, middle, suffix = piece(F.lit(0), left), piece(left, right), piece(right, F.octet_length("text"))
    p, s, m = map(F.lit, MARKERS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    told = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c)
    return at.withColumn("form", form).select("doc_id", "cut.n", "form", told("prefix_chars"), told("middle_chars"), output.alias("output"), *[c for c in carry if c not in ("doc_id", "text")])


def restored(form: Column, output: Column) -> Column:
    """The exact text of an output and its form. A rearranged text holds no marker,
    and no two markers overlap, so each stands once in its output."""
    p, s, m = MARKERS
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    before, after = lambda x, mark: F.substring_index(x, mark, 1), lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(after(before(head, s), p), middle, after(head, s))
    spm = F.concat(after(head, p), middle, after(before(head, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
