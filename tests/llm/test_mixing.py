import math
from collections import Counter, defaultdict

import pytest

from skirmish.llm import mixing
from skirmish.llm.queries import QUERIES
from tests.llm.conftest import SF


def corpus(spark, sizes, words=20):
    rows = [(i, " ".join(["w"] * (1 + (i * 7) % (2 * words - 1))), s) for s, n in sizes.items() for i in range(hash_base(s), hash_base(s) + n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), {(i, s): len(t.split()) for i, t, s in rows}


def hash_base(source):
    return 1_000_000 * (ord(source[0]) if source else 1)


def shares(rows, size):
    got = Counter()
    for r in rows:
        got[r.source] += size[r.doc_id, r.source]
    return got


def exact(tokens, x):
    v = {s: t**x for s, t in tokens.items()}
    return {s: y / sum(v.values()) for s, y in v.items()}


SIZES = {"a": 3000, "b": 400, "c": 90, None: 250}


def test_repetition_limit(spark):
    frame, size = corpus(spark, SIZES)
    total = sum(size.values())
    tokens = Counter()
    for (_, s), n in size.items():
        tokens[s] += n
    rows = mixing.mix(frame, repetition=3.0).collect()
    got = shares(rows, size)
    low, high = 0.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        worst = max(total * p / tokens[s] for s, p in exact(tokens, x).items())
        low, high = (x, high) if worst > 3 else (low, x)
    for s, p in exact(tokens, high).items():
        assert abs(got[s] - total * p) <= 40, s  # within one document
    seen = Counter((r.doc_id, r.epoch) for r in rows)
    assert set(seen.values()) == {1}
    by_epoch = defaultdict(set)
    for r in rows:
        by_epoch[r.source, r.epoch].add(r.doc_id)
    for (s, e), ids in by_epoch.items():
        if (s, e + 1) in by_epoch:
            assert len(ids) == SIZES[s]  # every epoch but the last is whole
    blocks = defaultdict(Counter)
    for r in rows:
        blocks[r.block][r.source] += size[r.doc_id, r.source]
    assert len(blocks) == 64
    assert all(abs(b["a"] / sum(b.values()) - got["a"] / sum(got.values())) < 0.2 for b in blocks.values())


def test_target_entropy(spark):
    frame, size = corpus(spark, SIZES)
    got = shares(mixing.mix(frame, entropy=1.1).collect(), size)
    p = [n / sum(got.values()) for n in got.values()]
    assert abs(-sum(x * math.log(x) for x in p) - 1.1) < 0.01
    half = shares(mixing.mix(frame, budget=5000, entropy=1.1).collect(), size)
    assert abs(sum(half.values()) - 5000) <= 4 * 40


def test_needs_one_target(spark):
    frame, _ = corpus(spark, {"a": 2})
    with pytest.raises(ValueError):
        mixing.mix(frame)


def test_query(spark):
    rows = {r.doc_id: (r.source, len((r.text or "").split())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_mixing"](spark, SF).collect()
    tokens, read = Counter(), Counter()
    for s, n in rows.values():
        tokens[s] += n
    for r in got:
        assert rows[r.doc_id][0] == r.source
        read[r.source] += rows[r.doc_id][1]
    longest = max(n for _, n in rows.values())
    assert set(read) == {s for s, n in tokens.items() if n}
    assert all(read[s] <= 2 * tokens[s] + longest for s in read)
    assert abs(sum(read.values()) - sum(tokens.values())) <= len(tokens) * longest
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op1_mixing"](spark, SF).collect()))  # the same each time


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = mixing.mix(odd, repetition=2.0)
    assert set(odd.columns) <= set(got.columns) and got.count() >= 1
    assert mixing.mix(nothing, repetition=2.0).count() == 0
    assert mixing.mix(odd.where("doc_id in (1, 2, 3)"), repetition=2.0).count() == 0
