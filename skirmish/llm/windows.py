"""Repeated fixed-length windows of token sequences, for the two substring
operators.

A window is ``width`` consecutive tokens of one document; it repeats if the
same tokens also start earlier (smaller ``doc_id``, or the same document and an
earlier start). Suffixes are not shipped one by one. Each window is filed under
its anchor, the ``gram`` consecutive tokens inside it with the smallest hash:
equal windows have equal anchors, and the run of neighbouring windows that
share an anchor is one row, about ``2 / (width - gram + 2)`` rows a token.

Rows are dealt by anchor and sorted (``settle``). An anchor that occurs once
holds no repeat. Rows with equal text (``context``) repeat whole, all but the
first; the first of each context can still hold windows that are new, and is
opened further where its anchor has several contexts. Before rows are dealt,
each batch keeps one row per context and marks the others as copies, so what
any number of documents share is one row a batch.

Hashes are polynomials over odd bases modulo 2^64, finished with a mixer; a
window is compared by two of them (128 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

Tokens = Callable[[str], tuple[np.ndarray, np.ndarray]]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverse's powers modulo 2^64, at least n of each."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        held = _powers[base] = (both[0], both[1])
    return held


class Sums:
    """Prefix sums of a token sequence under one base: the hash of any range in O(1)."""

    def __init__(self, tokens: np.ndarray, base: int):
        up, self.down = powers(base, len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def fixed(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_argmin(v: np.ndarray, span: int) -> np.ndarray:
    """Index of the (leftmost) minimum of every ``span`` neighbours, by doubling."""
    index, have = np.arange(len(v), dtype=np.int32), 1
    while have < span:
        step = min(have, span - have)
        a, b = v[:-step], v[step:]
        right = b < a
        v, index = np.where(right, b, a), np.where(right, index[step:], index[:-step])
        have += step
    return index


def anchored_runs(a: np.ndarray, b: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """``anchor, context, first, last``: window starts first..last share an anchor."""
    one, two = Sums(a, BASES[0]), Sums(b, BASES[1])
    grams = one.fixed(gram)
    at = sliding_argmin(grams, width - gram + 1)
    turn = np.flatnonzero(at[1:] != at[:-1])
    first = np.concatenate([[0], turn + 1])
    last = np.concatenate([turn, [len(at) - 1]])
    return grams[at[first]], two.of(first, last + width), first, last


def keyed(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc, tag, text``: what orders documents. Rows of one ``doc_id`` with
    different texts are told apart by ``tag``; null ids come before all."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])


def combined(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (``anchor, context, doc, tag, run, ..``) have an earlier row of
    their context in the batch, and which only repeat a row (of a repeated text)."""
    anchor, context, doc, tag, run = columns[:5]
    order = np.lexsort((run, tag, doc, context, anchor))
    later = np.zeros(len(run), bool)
    a, c = anchor[order], context[order]
    later[order[1:]] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    twin = np.zeros(len(run), bool)
    twin[order[1:]] = later[order[1:]] & np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (doc, tag, run)])
    return later, twin


def joined(later: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Copies of one document whose runs follow each other, as one row each."""
    doc, tag, run = columns[2:5]
    copies = np.flatnonzero(later)
    copies = copies[np.lexsort((run[copies], tag[copies], doc[copies]))]
    if len(copies) < 2:
        return later, columns
    d, t, r = doc[copies], tag[copies], run[copies]
    opens = np.ones(len(copies), bool)
    opens[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | ((r[1:] >> 32) > (r[:-1] & 0xFFFFFFFF) + 1)
    heads, lasts = np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:] - 1, len(copies) - 1)
    run = run.copy()
    run[copies[heads]] = (r[heads] >> 32 << 32) | (r[lasts] & 0xFFFFFFFF)
    stays = ~later
    stays[copies[heads]] = True
    return later[stays], [(run if i == 4 else c)[stays] for i, c in enumerate(columns)]


class Rows:
    """Gathers rows column by column and gives them out in batches."""

    SIZE = 300_000

    def __init__(self, names: tuple[str, ...]):
        self.names, self.columns, self.held = names, [[] for _ in names], 0

    def add(self, *columns: np.ndarray) -> None:
        for held, c in zip(self.columns, columns, strict=True):
            held.append(c)
        self.held += len(columns[0])

    def batch(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in self.columns]
        later, twin = combined(columns)
        later, columns = later[~twin], [c[~twin] for c in columns]
        later, columns = joined(later, columns)
        # a copy needs no company: it is dealt by a key of its own, so that a hot anchor is not
        columns[0] = np.where(later, mix((columns[2] * 31 + columns[4]).view(np.uint64)).view(np.int64), columns[0])
        columns[1] = np.where(later, 0, columns[1])
        self.columns, self.held = [[] for _ in self.names], 0
        return pa.RecordBatch.from_arrays([pa.array(later), *[pa.array(c) for c in columns]], names=["later", *self.names])


RUN = ("anchor", "context", "doc", "tag", "run")
RUN_SCHEMA = "later boolean, anchor long, context long, doc long, tag long, run long"


def runs(rows: DataFrame, tokens: Tokens, width: int, gram: int) -> DataFrame:
    """Every window of every text, as runs that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(RUN)
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                a, b = tokens(text.as_py())
                if len(a) < width:
                    continue
                anchor, context, first, last = anchored_runs(a, b, width, gram)
                out.add(anchor.view(np.int64), context.view(np.int64), np.full(len(first), doc), np.full(len(first), tag), first << 32 | last)
                if out.held >= Rows.SIZE:
                    yield out.batch()
        if out.held:
            yield out.batch()

    return rows.mapInArrow(run, RUN_SCHEMA)


def settle(rows: DataFrame, more: str = "") -> DataFrame:
    """``copy, doc, tag, run`` and the columns of ``more``: copies (true), and
    firsts of contexts whose anchor has another context too (false). Other
    rows hold no repeat and are left out. The scan keeps one row of state."""
    extra = [c.split()[0] for c in more.split(", ")] if more else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_before = context_before = pending = row_before = None
        for b in batches:
            if not b.num_rows:
                continue
            # a repeated text has each of its rows again; these are no copies
            row = np.stack([b.column(i).to_numpy() for i in range(1, 6)])
            twin = ~b.column(0).to_numpy(zero_copy_only=False)
            twin[1:] &= (row[:, 1:] == row[:, :-1]).all(0) & twin[:-1]
            twin[0] &= row_before is not None and (row[:, 0] == row_before).all()
            row_before = None if b.column(0)[-1].as_py() else row[:, -1].copy()
            if twin.any():
                b = b.filter(pa.array(~twin))
            later = b.column(0).to_numpy(zero_copy_only=False)
            anchor, context = b.column(1).to_numpy(), b.column(2).to_numpy()
            n = len(anchor)
            if not n:
                continue
            near = np.zeros(n, bool)
            near[1:] = (anchor[1:] == anchor[:-1]) & ~later[1:]
            near[0] = anchor_before is not None and anchor[0] == anchor_before and not later[0]
            equal = near.copy()
            equal[1:] &= context[1:] == context[:-1]
            equal[0] &= context[0] == context_before
            second = near & ~equal  # another context of an anchor seen before
            group = np.cumsum(~near)
            several = np.bincount(group, weights=second, minlength=group[-1] + 1) > 0
            opens = second | (~near & ~later & several[group])
            copies = equal | later
            out = [b] if pending is None or not several[0] else [pending, b]
            if pending is not None and several[0]:
                opens, copies = np.concatenate([[True], opens]), np.concatenate([[False], copies])
            if group[0] != group[-1] or not near[0] or several[0]:
                pending = None
            if not later[-1]:
                start = int(np.flatnonzero(group == group[-1])[0])
                if not near[start] and not several[group[-1]]:
                    pending = b.slice(start, 1)
                anchor_before, context_before = anchor[-1], context[-1]
            else:
                anchor_before = pending = None
            table = pa.Table.from_batches(out)
            keep = pa.array(np.flatnonzero(opens | copies))
            table = table.append_column("copy", pa.array(copies)).take(keep).select(["copy", "doc", "tag", "run", *extra])
            yield from table.combine_chunks().to_batches()

    dealt = rows.repartition("anchor").sortWithinPartitions("later", "anchor", "context", "doc", "tag", "run")
    return dealt.mapInArrow(scan, "copy boolean, doc long, tag long, run long" + (f", {more}" if more else ""))


def with_runs(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``doc, tag, text, runs``: the texts with what was found in them (a list
    no longer than the text)."""
    per_doc = found.groupBy("doc", "tag").agg(F.collect_list("run").alias("runs"))
    return rows.join(per_doc, ["doc", "tag"], how).select("doc", "tag", "text", "runs", *[c for c in rows.columns if c.startswith("carried_")])


def repeated(rows: DataFrame, tokens: Tokens, width: int, gram: int, opened: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``doc, tag, run``: the repeated windows, as runs of starts. ``opened``
    takes texts with the runs to look into and returns the windows among them
    that also occur earlier."""
    first = cut(settle(runs(rows, tokens, width, gram)), name)
    copies = first.where("copy").select("doc", "tag", "run")
    # a repeated row would find itself in its twin
    return copies.unionByName(opened(with_runs(rows.select("doc", "tag", "text"), first.where("not copy")).dropDuplicates(["doc", "tag"])))


def covered(run_list: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a window whose start is in one of the runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, run_list >> 32, 1)
    np.add.at(step, (run_list & 0xFFFFFFFF) + width, -1)
    return np.cumsum(step[:n]) > 0
