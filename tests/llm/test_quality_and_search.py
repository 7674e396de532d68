import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from skirmish.llm import hamming_topk, quality_crf
from skirmish.llm.queries import QUERIES
from tests.llm.conftest import SF


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    w, t = r.normal(size=quality_crf.WIDTH), r.normal(size=(2, 2))
    x = r.normal(size=(6, quality_crf.WIDTH)) / 3
    u, total, good = x @ w, 0.0, np.zeros(6)
    for code in range(64):
        y = [code >> i & 1 for i in range(6)]
        p = np.exp(sum(u[i] * y[i] for i in range(6)) + sum(t[y[i], y[i + 1]] for i in range(5)))
        total, good = total + p, good + p * np.array(y)
    assert np.allclose(quality_crf.marginals(x, w, t), good / total)


def test_query_ranks_the_held_out_fold(spark):
    big = SF.replace("0.001", "0.01")
    got = QUERIES["op5_quality_crf"](spark, big).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect() if r.quality is not None}
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum((s >= 0.7) == y for s, y in held) / len(held) > 0.85


def test_scores_do_not_depend_on_other_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_crf.learned(docs, labels)
    a = {r.text: r.score for r in quality_crf.scored(docs, model).collect()}
    other = docs.select((F.col("doc_id") + 5).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"))
    assert a == {r.text: r.score for r in quality_crf.scored(other, model).collect()}
    flipped = labels.withColumn("quality", F.when(quality_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_crf.learned(docs, flipped)
    assert np.array_equal(model["w"], again["w"]) and model["slope"] == again["slope"]


def test_odd_texts(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = quality_crf.learned(odd, known)
        got = quality_crf.scored(odd, model)
        assert got.columns == [c for c in odd.columns if c != "score"] + ["score"]
        rows = got.collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality_crf.scored(nothing, quality_crf.learned(nothing, labels)).count() == 0


def nearest(rows, asked, k):
    code = {i: [x is not None and x >= 0 for x in v] for i, v in rows if i is not None and v is not None}
    out = {}
    for q in asked:
        best = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:k]
        out[q] = [(i, d) for d, i in best]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_top_k_equals_brute_force(spark):
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(40)] for _ in range(5)]
    rows = [(i, [x * r.choice([1, 1, 1, -1]) for x in r.choice(centres)] if i % 3 else centres[0]) for i in range(600)]
    rows += [(7, rows[7][1]), (None, centres[1]), (900, None), (901, [None] * 40)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    asked = frame.where("vec_id % 50 = 0 or vec_id = 901")
    want = nearest(rows, [*range(0, 600, 50), 901], 6)
    assert found(hamming_topk.top_k(frame, asked, k=6)) == {q: v for q, v in want.items() if q != 900}


def test_top_k_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(i, [1.0, -1.0, float(i - 2)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {q: len(v) for q, v in found(hamming_topk.top_k(frame, frame, k=10)).items()} == {i: 3 for i in range(4)}
    assert hamming_topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert hamming_topk.top_k(frame, frame.limit(0)).count() == 0


def test_an_empty_first_vector_does_not_empty_the_table(spark):
    from skirmish.llm.hamming_topk import top_k

    rows = spark.createDataFrame([(0, []), *[(i, [1.0 if i >> b & 1 else -1.0 for b in range(8)]) for i in range(1, 40)]], "vec_id long, embedding array<double>").coalesce(1)
    got = top_k(rows, rows.where("vec_id = 7"), k=3).orderBy("rank").collect()
    want = sorted((bin(i ^ 7).count("1"), i) for i in range(1, 40) if i != 7)[:3]
    assert [(r.distance, r.neighbour_id) for r in got] == want
