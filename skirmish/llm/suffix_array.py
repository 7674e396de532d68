"""Exact substring removal on bytes by depth-limited radix sort.

Suffixes are ordered only through ``width`` bytes, by most-significant-digit
passes, each a shuffle in which groups of one suffix end. The first digit of a
window is its anchor (``windows.py``), the second the core around it that
neighbouring windows share, the third the bytes beside that core; the groups
that agree in every digit are exactly the repeated windows. Digits longer than
eight bytes are compared by two 64-bit hashes. All but the earliest member of
such a group are removed, byte by covered byte.

Defined cases. A null or empty text is zero bytes. A repeated row (same id and
text) starts where its twin does, so neither removes the other. Texts of one
id count as documents ordered by hash. Extra columns are ignored. Matches never
cross documents; removed bytes may leave ``kept`` invalid as UTF-8, so it is
binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .windows import BASES, RUN, RUN_SCHEMA, Rows, Sums, covered, keyed, mix, repeated, settle, with_runs

_TABLES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(step)) for step in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9))


def byte_tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return _TABLES[0][raw], _TABLES[1][raw]


#: Odd factors of the bytes beside a core.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Windows of one anchor that are compared together: their common core, then eight bytes to either side.
TOGETHER = 9


def opened(width: int, gram: int, texts: DataFrame) -> DataFrame:
    """The second and third digit: runs are cut into groups of ``TOGETHER``
    windows by their distance from the anchor. A group's core, which all its
    windows hold, is the second digit; the bytes left and right of it are the
    third, and tell the windows apart."""
    core = width - TOGETHER + 1
    names = (*RUN, "left", "right", "reach", "core")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(names)
        for batch in batches:
            for doc, tag, text, found in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                a, b = byte_tokens(text.as_py())
                one, two = Sums(a, BASES[0]), Sums(b, BASES[1])
                grams = one.fixed(gram)
                rows = []
                for run in found.values.to_pylist():
                    first, last = run >> 32, run & 0xFFFFFFFF
                    anchor = last + int(np.argmin(grams[last : first + width - gram + 1]))
                    for j in range((anchor - last) // TOGETHER, (anchor - first) // TOGETHER + 1):
                        low, high = max(0, anchor - last - j * TOGETHER), min(TOGETHER - 1, anchor - first - j * TOGETHER)
                        start = anchor - j * TOGETHER
                        end = start + core
                        left = int.from_bytes(raw[start - high : start][::-1], "little")  # nearest byte lowest
                        right = int.from_bytes(raw[end : end + TOGETHER - 1 - low], "little")
                        rows.append((start, left, right, low << 8 | high, (start - high) << 32 | start - low))
                if not rows:
                    continue
                start, left, right, reach, run = (np.array(c, np.uint64) for c in zip(*rows, strict=True))
                start = start.astype(np.int64)
                key, second = one.of(start, start + core), two.of(start, start + core)
                context = mix(mix(mix(left * np.uint64(3) + reach) + right) + second)
                out.add(key.view(np.int64), context.view(np.int64), np.full(len(run), doc), np.full(len(run), tag), run.astype(np.int64), left.view(np.int64), right.view(np.int64), reach.astype(np.int64), second.view(np.int64))
                if out.held >= Rows.SIZE:
                    yield out.batch()
        if out.held:
            yield out.batch()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(RUN)
        for b in batches:
            doc, tag, run, key, left, right, reach, second = (b.column(i).to_numpy() for i in range(1, 9))
            left, right = left.view(np.uint64), right.view(np.uint64)
            for t in range(TOGETHER):
                on = np.flatnonzero((reach >> 8 <= t) & (t <= (reach & 255)))
                kept = [v[on] & np.uint64((1 << 8 * size) - 1) for v, size in ((left, t), (right, TOGETHER - 1 - t))]
                at = (run[on] & 0xFFFFFFFF) + (reach[on] >> 8) - t
                # the sides enter both halves of the 128 bits in different ways
                high, low = (mix(mix(mix(v[on].view(np.uint64) + np.uint64(t)) + kept[0] * f) + kept[1] * g).view(np.int64) for v, f, g in ((key, ODD[0], ODD[1]), (second, ODD[2], ODD[3])))
                out.add(high, low, doc[on], tag[on], at << 32 | at)
            if out.held >= Rows.SIZE:
                yield out.batch()
        if out.held:
            yield out.batch()

    more = "anchor long, left long, right long, reach long, core long"
    second = cut(settle(texts.mapInArrow(groups, f"{RUN_SCHEMA}, left long, right long, reach long, core long"), more), "suffix-array-groups")
    third = settle(second.where("not copy").mapInArrow(windows, RUN_SCHEMA)).where("copy")
    return second.where("copy").select("doc", "tag", "run").unionByName(third.select("doc", "tag", "run"))


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = 24, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: spans are the maximal
    removed byte ranges [start, end)."""
    rows = keyed(docs, text)
    found = repeated(rows, byte_tokens, width, gram, partial(opened, width, gram), "suffix-array")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sizes, removed, spans, kept = [], [], [], []
                for t, r in zip(b.column(1), b.column(2), strict=True):
                    raw = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                    sizes.append(len(raw))
                    if not r.is_valid:
                        removed.append(0), spans.append([]), kept.append(raw.tobytes())
                        continue
                    gone = covered(r.values.to_numpy(), width, len(raw))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    removed.append(int(gone.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    kept.append(raw[~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    joined = with_runs(rows, found, "left").select(F.nullif("doc", F.lit(-(2**63))).alias("doc_id"), "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
