"""Order-preserving packing by dynamic programming.

The token stream of a partition (its documents by ``doc_id``, each followed by
the end id) is cut into windows of at most ``length`` tokens. Cuts are allowed
at document ends (free), at sentence ends and, where neither occurs for
``LONGEST_GAP`` tokens, in between (each at a penalty). The cost of a window
[i, j) is its padding, ``length - (j - i)`` (none if ``j - i`` is a power of
two), and the penalty of its end, so

    best[j] = penalty[j] + min(min over i >= j - length of (best[i] + i) + length - j,
                               min over k of best[j - 2^k])

whose first minimum a monotone queue gives in constant time per cut. Windows
never cross partitions; within one, tokens pass in blocks of ``BLOCK`` tokens
and what follows the last settled cut opens the next block, so memory is
bounded by one block and one document.

Defined cases. A null or empty text is packed as its end id alone. Repeated
rows are packed once each, ties of ``doc_id`` in any order; null ids come
first. Extra columns are ignored. An empty table gives no pieces. The names of
special tokens in a text become these tokens, as the tokenizer has it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
BLOCK = 1 << 18
LONGEST_GAP = 256
SENTENCE_PENALTY = 1
INSIDE_PENALTY = 4
#: Entries of a worker's word cache; it starts anew when full.
CACHE_ENTRIES = 1 << 20
PUNCTUATION = ".,;:!?%*#&$|"
#: Separators that Python counts as white space and the tokenizer doesn't.
_CONTROL = "\x1c\x1d\x1e\x1f"
_BREAK = re.compile(r"[^\S\x1c-\x1f]+")


#: Packs n ids.
_FOUR = [struct.Struct(f"<{n}I") for n in range(32)]


class WordCache(dict):
    """White-space separated word -> its ids as bytes. The tokenizer drops
    white space and splits there, so a text's ids are its words' ids in turn;
    a word of plain Latin letters is one piece and goes to the model directly,
    any other through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}  # lower-cased words without their punctuation
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if core.isalpha() and (core.isascii() or max(core) < "Ā"):
            low = core.lower()
            ids = self.cores.get(low)
            if ids is None:
                ids = self._piece(low)
                if len(self.cores) >= CACHE_ENTRIES // 2:
                    self.cores.clear()
                self.cores[low] = ids
            if core != word:
                ids += self._other(word[len(core) :])
        else:
            ids = self._other(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = ids
        return ids

    def _piece(self, core: str) -> bytes:
        letters = self.letters
        found = self.model.tokenize("".join([letters[b] for b in core.encode()]))
        return _FOUR[len(found)].pack(*[t.id for t in found]) if len(found) < len(_FOUR) else np.array([t.id for t in found], "<u4").tobytes()

    def _other(self, word: str) -> bytes:
        ids = self.pieces.get(word)
        if ids is None:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.pieces) < CACHE_ENTRIES // 8:
                self.pieces[word] = ids
        return ids

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """Ids as little-endian 32-bit words, and the token counts up to each sentence end."""
        words = [w for w in _BREAK.split(text) if w] if any(c in text for c in _CONTROL) else text.split()
        parts = [self[w] for w in words]
        ends = [i for i, w in enumerate(words) if w[-1] in ".!?"]
        counts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        return b"".join(parts), counts[ends] >> 2 if ends else counts[:0]


_caches: dict[str, WordCache] = {}


def cut_positions(places: np.ndarray, penalties: np.ndarray, length: int, last: bool) -> list[int]:
    """Indexes into ``places`` (ascending token offsets, the first 0) of the
    chosen cuts. ``last``: the stream ends at the last place; otherwise the
    cheapest place within the last window ends the settled part."""
    at, n = places.tolist(), len(places)
    cost, back, pen = [0] * n, [0] * n, penalties.tolist()
    jumps: list[list[int] | tuple] = [()] * n
    for k in range(length.bit_length()):
        step = 1 << k
        source = np.searchsorted(places, places - step)
        hit = np.flatnonzero((places >= step) & (places[source] == places - step))
        for j, i in zip(hit.tolist(), source[hit].tolist(), strict=True):
            if jumps[j]:
                jumps[j].append(i)
            else:
                jumps[j] = [i]
    # the queue: place, key and index of each candidate, keys ascending from ``head`` on
    starts, keys, index, head = [0], [0], [0], 0
    for j in range(1, n):
        here = at[j]
        while starts[head] < here - length:
            head += 1
        best, source = keys[head] + length - here, index[head]
        for i in jumps[j]:
            if cost[i] < best:
                best, source = cost[i], i
        best += pen[j]
        cost[j], back[j] = best, source
        key = best + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop(), starts.pop(), index.pop()
        keys.append(key), starts.append(here), index.append(j)
    end = n - 1
    if not last:
        near = [j for j in range(1, n) if at[j] >= at[-1] - length]
        end = min(near, key=lambda j: (cost[j], -j))
    cuts = []
    while end:
        cuts.append(end)
        end = back[end]
    return cuts[::-1]


def allowed_cuts(sizes: list[int], sentences: list[np.ndarray], length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places where a block of documents may be cut, and what each costs."""
    ends = np.cumsum([0, *sizes])
    inner = np.concatenate([np.zeros(0, np.int64), *[s + o for s, o in zip(sentences, ends[:-1], strict=True)]])
    known = np.unique(np.concatenate([ends, inner]))
    gaps, longest = np.diff(known), min(LONGEST_GAP, length)
    wide = np.flatnonzero(gaps > longest)
    extra = [np.arange(known[i] + longest, known[i + 1], longest) for i in wide]
    if last:  # the rest of the stream can be cut into powers of two
        rest, tail = int(ends[-1] % length), []
        for k in range(length.bit_length()):
            if rest >> k & 1:
                tail.append((tail[-1] if tail else int(ends[-1])) - (1 << k))
        extra.append(np.array([t for t in tail if t > 0], np.int64))
    places = np.unique(np.concatenate([known, *extra]))
    penalties = np.full(len(places), INSIDE_PENALTY)
    penalties[np.isin(places, inner)] = SENTENCE_PENALTY
    penalties[np.isin(places, ends)] = 0
    return places, penalties


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, text: str = "text", ordered: bool = False) -> DataFrame:
    """Pieces of sequences, one row each (``SCHEMA``). ``tokenizer`` is the
    path of a `tokenizers` file whose pre-tokenizer splits at white space.
    With ``ordered``, documents keep the order of their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _caches.get(tokenizer) or _caches.setdefault(tokenizer, WordCache(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        # of the open block: (doc_id, ids, tokens of the document before the block) and its sentence ends
        held: list[tuple[int | None, bytes, int]] = []
        sentences: list[np.ndarray] = []
        size = 0

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal sequence, size
            sizes = [(len(b) >> 2) - s for _, b, s in held]
            places, penalties = allowed_cuts(sizes, sentences, length, last)
            rows, doc, done, before = [], 0, 0, 0
            for cut in places[cut_positions(places, penalties, length, last)].tolist():
                offset = 0
                while before < cut:
                    name, ids, skipped = held[doc]
                    take = min(cut - before, sizes[doc] - done)
                    start = skipped + done
                    rows.append((name, start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), len(ids) >> 2, sequence, offset))
                    offset, before, done = offset + take, before + take, done + take
                    if done == sizes[doc]:
                        doc, done = doc + 1, 0
                sequence += 1
            left = [(name, ids, skipped + (done if i == 0 else 0)) for i, (name, ids, skipped) in enumerate(held[doc:])]
            ends = [s[s > done] - done if i == 0 else s for i, s in enumerate(sentences[doc:])]
            held[:], sentences[:], size = left, ends, size - before
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for name, t in zip(b.column(0), b.column(1), strict=True):
                ids, ends = cache.encode(t.as_py() or "")
                held.append((name.as_py(), ids + end, 0))
                sentences.append(ends)
                size += (len(ids) >> 2) + 1
                if size >= BLOCK:
                    yield settle(False)
        if held:
            yield settle(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return (rows if ordered else rows.sortWithinPartitions("doc_id")).mapInArrow(run, SCHEMA)
