"""Exact passage removal on words by prefix-partitioned suffix trees.

Suffixes that cannot repeat are sieved out first (``windows.py``), and runs of
suffixes whose whole texts are equal are merged to one chain. The rest are cut at
``width`` words and written as a path of ``DIGITS`` symbols, each of a few words.

Suffixes are dealt to groups by prefix (``grouped``). A group starts as a bin of
one-symbol prefixes; where a bin counts more than ``GROUP`` suffixes, the prefixes
in it grow by a symbol and are binned again, and so on, so prefixes are as
long as it takes for every group to fit the memory of a task. A group that is
still larger at full depth holds equal suffixes and is read as a stream. A task
sorts its group and builds its subtree (``internal_nodes``): suffixes in order are
leaves, a node is a longest run of leaves with a common prefix. The deep nodes,
``width`` words down, are the repeats: all but their earliest leaf occur earlier.
Equal suffixes of one batch are merged before they are dealt, so a passage in a
third of all documents is a row a batch.

Defined cases. Null and empty texts have no word. A repeated row (same id and
text) starts where its twin does, so neither removes the other. Texts of one
id count as documents ordered by hash. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WORD_BREAKS, cut
from .windows import BASES, RUN, RUN_SCHEMA, Rows, Sums, covered, keyed, mix, repeated, with_runs

#: Digits of a suffix.
DIGITS = 5


#: Suffixes that a group holds at most, unless they are equal.
GROUP = 100_000


def grouped(leaves: DataFrame, digits: list[str], most: int = GROUP) -> DataFrame:
    """``leaves`` with ``part``, the group of each: a bin of prefixes, as many symbols
    long as it takes to have no more than ``most`` leaves. The driver sees one count a level."""
    bins = max(1, -(-2 * leaves.count() // most))
    bin_of = lambda depth: F.pmod(F.xxhash64(*digits[:depth]), F.lit(bins))
    out = leaves.withColumn("part", F.xxhash64(F.lit(1), bin_of(1)))
    for depth in range(2, len(digits) + 1):
        # at most one large group for ``most`` leaves; Spark takes the join that its size allows
        large = cut(out.groupBy("part").agg(F.count("*").alias("held")).where(F.col("held") > most).select("part", F.lit(True).alias("grows")), "suffix-tree-large")
        if not large.head(1):
            break
        deeper = F.xxhash64(F.lit(depth), "part", bin_of(depth))
        out = out.join(large, "part", "left").select(*leaves.columns, F.when(F.col("grows"), deeper).otherwise(F.col("part")).alias("part"))
    return out


def internal_nodes(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``depth, first, last`` of the internal nodes of the tree whose leaves, in order,
    are the columns of ``path``: runs of leaves that share ``depth`` symbols and no more."""
    n = path.shape[1]
    shared = np.zeros(n + 1, np.int64)  # with the leaf before
    shared[1:n] = np.logical_and.accumulate(path[:, 1:] == path[:, :-1]).sum(0)
    depths, firsts, lasts = [], [], []
    for depth in range(1, len(path) + 1):
        inside = shared >= depth
        first = np.flatnonzero(~inside[:-1] & inside[1:])
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        # a run that shares more is the node of a greater depth
        lowest = np.minimum.reduceat(shared[: n + 1], np.stack([first + 1, last + 1], axis=1).ravel())[::2] if len(first) else first
        own = lowest == depth
        depths.append(np.full(own.sum(), depth)), firsts.append(first[own]), lasts.append(last[own])
    return np.concatenate(depths), np.concatenate(firsts), np.concatenate(lasts)


def repeats(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Leaves of the deep nodes of each group but their earliest, from leaves sorted by
    group and path: ``doc, tag, run, digits, part``."""

    def read(held: list[pa.RecordBatch], before: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        path = np.stack([b.column(3 + i).to_numpy() for i in range(b.num_columns - 4)])
        depth, first, last = internal_nodes(path)
        deep = depth == len(path)
        size = last[deep] - first[deep]
        leaf = np.repeat(first[deep] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        if before is not None and (path[:, 0] == before).all():  # goes on with the path that the part before ended with
            leaf = np.concatenate([[0], leaf])
        return b.take(pa.array(leaf)).select(["doc", "tag", "run"]), path[:, -1].copy()

    held, size, part, before = [], 0, None, None
    for b in batches:
        parts = b.column(b.num_columns - 1).to_numpy()
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low == high:
                continue
            # small groups are read together, as a path lies in one group; a group of equal suffixes in pieces
            if (parts[low] != part and size > most // 4) or size > most:
                found, before = read(held, before)
                yield found
                held, size = [], 0
            part = parts[low]
            held.append(b.slice(low, high - low))
            size += high - low
    if held:
        yield read(held, before)[0]


def word_tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.encode("utf-8", "surrogatepass").split()
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return one, mix(one + np.uint64(1))


def opened(width: int, texts: DataFrame) -> DataFrame:
    """The suffixes in the given runs that also occur earlier."""
    part = -(-width // DIGITS)
    digits = [f"d{i}" for i in range(DIGITS)]
    names = (*RUN, *digits)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(names)
        for batch in batches:
            for doc, tag, text, found in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3), strict=True):
                a, b = word_tokens(text.as_py())
                spans = found.values.to_numpy()
                first, sizes = spans >> 32, (spans & 0xFFFFFFFF) - (spans >> 32) + 1
                start = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                one, two = Sums(a, BASES[0]), Sums(b, BASES[1])
                cuts = [start + min(width, i * part) for i in range(DIGITS + 1)]
                values = [(one.of(lo, hi) + two.of(lo, hi) * np.uint64(3)).view(np.int64) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                out.add(one.of(start, start + width).view(np.int64), two.of(start, start + width).view(np.int64), np.full(len(start), doc), np.full(len(start), tag), start << 32 | start, *values)
                if out.held >= Rows.SIZE:
                    yield out.batch()
        if out.held:
            yield out.batch()

    # a suffix that was merged away is a copy and needs no company
    rows = cut(texts.mapInArrow(suffixes, RUN_SCHEMA + "".join(f", {d} long" for d in digits)).select("later", "doc", "tag", "run", *digits), "suffix-tree-suffixes")
    leaves = grouped(rows.where("not later").drop("later"), digits)
    found = leaves.repartition("part").sortWithinPartitions("part", *digits, "doc", "tag", "run").mapInArrow(partial(repeats, most=GROUP), "doc long, tag long, run long")
    return rows.where("later").select("doc", "tag", "run").unionByName(found)


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = 6, text: str = "text", keep_spaces: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` and the columns of ``carry``: kept
    words joined by one space or, with ``keep_spaces``, each with the white
    space that followed it."""
    rows = keyed(docs, text, carry)
    found = repeated(rows.select("doc", "tag", "text"), word_tokens, width, gram, partial(opened, width), "suffix-tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sizes, removed, kept = [], [], []
                for t, r in zip(b.column(1), b.column(2), strict=True):
                    raw = t.as_py().encode("utf-8", "surrogatepass")
                    words = raw.split()
                    gone = covered(r.values.to_numpy(), width, len(words)) if r.is_valid else np.zeros(len(words), bool)
                    sizes.append(len(words))
                    removed.append(int(gone.sum()))
                    if not keep_spaces:
                        left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    elif removed[-1]:
                        left = _without(raw, gone)
                    else:
                        left = raw
                    kept.append(left.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *b.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *carry])

    joined = with_runs(rows, found, "left").select(F.nullif("doc", F.lit(-(2**63))).alias("doc_id"), "text", "runs", *[f"carried_{c}" for c in carry])
    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"), *[F.col(f"carried_{c}").alias(c) for c in carry]).schema
    return joined.mapInArrow(run, schema)


def _without(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the gone words and the white space after them."""
    solid = ~np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" " + WORD_BREAKS.encode(), np.uint8))
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    bounds = np.concatenate([starts, [len(raw)]])
    return b"".join([raw[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~gone)]).strip()
