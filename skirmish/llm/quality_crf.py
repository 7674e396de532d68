"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of the lines before and after it; a
two-state chain (bad, good) with learned transitions gives, by forward-backward,
the probability that it is good. A document's score is a logistic function of
the mean of these, weighted by line length.

The chain is fitted on at most ``SAMPLE`` labelled documents (whose lines all
take the document's label), drawn by hash from the rows that may be learned
from, and on at most ``LINES`` consecutive lines of each, from a place drawn by
hash; of rows that share an id one enters. The logistic link is fitted on the
same lines, so what reaches the driver has a bound. Labels, language,
source and id are no inputs of a score.

Defined cases. Null and empty texts, and texts of white space, have no line:
their score is 0. A repeated row is scored again, to the same value. Very long
lines and texts are read whole. Without labelled rows of both classes every
line is neutral and the score is the smoothed share of label 1 (0.5 with no
label). Extra columns are kept; ``score`` takes the place of any such column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents that the chain is fitted on, at most.
SAMPLE = 2000
#: Consecutive lines of one document that the chain is fitted on, at most.
LINES = 1000
#: Steps of the fit, and weight of its squared penalty.
STEPS, PENALTY = 150, 1e-4
#: Lines of a document that enter one training chain; longer documents give several chains.
CHAIN = 64

_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 1
_BANG = np.zeros(256, np.int64)
_BANG[list(b"!?")] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[ord("0") : ord("9") + 1] = 1
_STOP = np.zeros(256, np.int64)
_STOP[list(b".,;:")] = 1
OWN = 14
WIDTH = 3 * OWN + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths of the lines that are not blank."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0)
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    sizes = np.array([len(x) for x in raw], float)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    share = [np.add.reduceat(t[data], starts) / sizes for t in (_UPPER, _SYMBOL, _BANG, _DIGIT, _STOP)]
    # capitals of the accented Latin range: C3 80 to C3 9E
    share[0] = share[0] + np.add.reduceat(np.concatenate([[0], (data[:-1] == 0xC3) & (data[1:] < 0x9F)]).astype(np.int64), starts) / sizes
    words = [x.split() for x in lines]
    counts = np.array([len(w) for w in words], float)
    distinct = np.array([len(set(w)) for w in words]) / counts
    twice = np.array([sum(a == b for a, b in zip(w, w[1:])) for w in words]) / counts  # noqa: B905
    pairs = np.array([len(set(zip(w, w[1:]))) / max(1, len(w) - 1) for w in words])  # noqa: B905
    seen: dict[str, int] = {}
    before = np.array([seen.setdefault(x, i) < i for i, x in enumerate(lines)], float)
    again = np.array([seen_count > 1 for seen_count in map(_counter(lines).__getitem__, lines)], float)
    ends = np.array([x.rstrip()[-1] in ".!?" for x in lines], float)
    own = np.stack([np.log1p(sizes) / 6, np.log1p(counts) / 4, sizes / counts / 10, *[np.sqrt(s) for s in share], distinct, np.sqrt(twice), pairs, before, again, ends], axis=1)
    pad = np.zeros((1, OWN))
    first, last = np.zeros((len(lines), 1)), np.zeros((len(lines), 1))
    first[0], last[-1] = 1, 1
    return np.concatenate([own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad]), first, last, np.ones((len(lines), 1))], axis=1), sizes


def _counter(lines: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for x in lines:
        counts[x] = counts.get(x, 0) + 1
    return counts


def _pass(unary: np.ndarray, t: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log messages (chains x lines x 2) from the left and from the right."""
    chains, n, _ = unary.shape
    left, right = np.zeros((chains, n, 2)), np.zeros((chains, n, 2))
    for i in range(1, n):
        left[:, i] = np.logaddexp(*np.moveaxis((left[:, i - 1] + unary[:, i - 1])[:, :, None] + t, 1, 0))
    for i in range(n - 2, -1, -1):
        step = np.logaddexp(*np.moveaxis((right[:, i + 1] + unary[:, i + 1])[:, None, :] + t, 2, 0))
        right[:, i] = np.where(mask[:, i + 1, None], step, 0)
    return left, right


def fit(chains: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the good state and transitions (2 x 2), by gradient ascent
    (Adam) on the conditional likelihood, both classes weighted alike."""
    n = max(map(len, chains))
    x, mask = np.zeros((len(chains), n, WIDTH)), np.zeros((len(chains), n), bool)
    for i, c in enumerate(chains):
        x[i, : len(c)], mask[i, : len(c)] = c, True
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    truth = labels[:, None] * mask
    w, t = np.zeros(WIDTH), np.zeros((2, 2))
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    both = mask[:, 1:] & mask[:, :-1]
    lines = np.maximum(1, mask.sum(1))
    for step in range(1, STEPS + 1):
        w, t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        unary = np.stack([np.zeros((len(chains), n)), x @ w], axis=2)
        left, right = _pass(unary, t, mask)
        belief = left + unary + right
        good = 1 / (1 + np.exp(np.clip(belief[:, :, 0] - belief[:, :, 1], -60, 60)))
        scale = weight / lines
        gw = np.einsum("c,cn,cnd->d", scale, (truth - good) * mask, x)
        pair = (left + unary)[:, :-1, :, None] + t + (right + unary)[:, 1:, None, :]
        pair = np.exp(pair - pair.max((2, 3), keepdims=True))
        pair = pair / pair.sum((2, 3), keepdims=True) * both[:, :, None, None]
        seen = np.zeros((2, 2))
        for label in (0, 1):
            seen[label, label] = (scale[labels == label] * both[labels == label].sum(1)).sum()
        g = np.concatenate([gw, (seen - np.einsum("c,cnij->ij", scale, pair)).ravel()]) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def marginals(features: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Probability of the good state for each line of one document."""
    u = (features @ w).tolist()
    n = len(u)
    ahead, behind = [0.0] * n, [0.0] * n
    (bb, bg), (gb, gg) = t.tolist()
    exp, log1p = np.exp, np.log1p

    def step(a: float, to_bad: tuple[float, float], to_good: tuple[float, float]) -> float:
        a = max(-500.0, min(500.0, a))
        top = max(to_good[0], to_good[1] + a)
        low = max(to_bad[0], to_bad[1] + a)
        return float(top + log1p(exp(min(to_good[0], to_good[1] + a) - top)) - low - log1p(exp(min(to_bad[0], to_bad[1] + a) - low)))

    for i in range(1, n):
        ahead[i] = step(ahead[i - 1] + u[i - 1], (bb, gb), (bg, gg))
    for i in range(n - 2, -1, -1):
        behind[i] = step(behind[i + 1] + u[i + 1], (bb, bg), (gb, gg))
    return 1 / (1 + np.exp(-np.clip(np.array(u) + ahead + behind, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> dict:
    """The model, as plain numbers. Only rows outside the held-out fold enter."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    every_row = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = every_row.groupBy("doc_id").agg(F.min_by(F.struct("quality", "text"), F.xxhash64("text")).alias("r")).select("doc_id", "r.quality", "r.text")

    def bounded(doc_id: int, features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = zlib.crc32(str(doc_id).encode()) % (len(sizes) - LINES + 1) if len(sizes) > LINES else 0
        return features[at : at + LINES], sizes[at : at + LINES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(int(q), *bounded(i, *line_features(t))) for i, q, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), pa.array([f[2].astype("<f4").tobytes() for f in found], pa.binary())],
                names=["doc_id", "quality", "features", "sizes"],
            )

    got = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id long, quality int, features binary, sizes binary").collect()
    got = sorted((r for r in got if r.features), key=lambda r: (r.doc_id, r.features))
    if len({r.quality for r in got}) < 2:
        good = sum(r.quality for r in got)
        return {"w": np.zeros(WIDTH), "t": np.zeros((2, 2)), "slope": 0.0, "bias": float(np.log((good + 1) / (len(got) - good + 1)))}
    every = [np.frombuffer(r.features, "<f4").reshape(-1, WIDTH).astype(float) for r in got]
    truth = np.array([r.quality for r in got])
    chains = [(f[i : i + CHAIN], q) for f, q in zip(every, truth, strict=True) for i in range(0, len(f), CHAIN)]
    w, t = fit([c for c, _ in chains], np.array([q for _, q in chains]))
    means = np.array([np.average(marginals(f, w, t), weights=np.frombuffer(r.sizes, "<f4")) for f, r in zip(every, got, strict=True)])
    slope, bias = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic fit, lightly held back
        p = 1 / (1 + np.exp(-np.clip(slope * means + bias, -60, 60)))
        h = p * (1 - p)
        g = np.array([((truth - p) * means).sum() - 0.01 * slope, (truth - p).sum() - 0.01 * bias])
        hess = np.array([[(h * means * means).sum() + 0.01, (h * means).sum()], [(h * means).sum(), h.sum() + 0.01]])
        slope, bias = np.array([slope, bias]) + np.linalg.solve(hess, g)
    return {"w": w, "t": t, "slope": float(slope), "bias": float(bias)}


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, in place of any column of that name."""
    w, t, slope, bias = model["w"], model["t"], model["slope"], model["bias"]

    def one(text: str | None) -> float:
        features, sizes = line_features(text)
        if not len(sizes):
            return 0.0
        return float(1 / (1 + np.exp(-(slope * np.average(marginals(features, w, t), weights=sizes) + bias))))

    kept = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([one(x.as_py()) for x in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], scores], names=[*b.schema.names[1:], "score"])

    source = docs.select(F.col(text).alias("__scored_text"), *[docs[c] for c in kept])
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema
    return source.mapInArrow(run, schema)
