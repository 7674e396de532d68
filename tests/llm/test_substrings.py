import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from skirmish.llm import suffix_array, suffix_tree
from skirmish.llm.queries import QUERIES
from tests.llm.conftest import SF, table


def brute(rows, split, width):
    """Covered tokens of each (id, text): windows whose sequence starts earlier too."""
    first = {}
    tokens = {(-1 if i is None else i, t or ""): split(t or "") for i, t in rows}
    for key in sorted(tokens):
        x = tokens[key]
        for s in range(len(x) - width + 1):
            first.setdefault(tuple(x[s : s + width]), (key, s))
    out = {}
    for key, x in tokens.items():
        gone = [False] * len(x)
        for s in range(len(x) - width + 1):
            if first[tuple(x[s : s + width])] < (key, s):
                gone[s : s + width] = [True] * width
        out[key] = (x, gone)
    return out


def words(t):
    return t.encode().split()


def repetitive(seed, n, kinds, size):
    r = random.Random(seed)
    common = [" ".join(r.choice(kinds) for _ in range(r.randint(5, 60))) for _ in range(4)]
    return [(i, " ".join(r.choice([r.choice(common), r.choice(kinds), " ".join(r.choice(kinds) for _ in range(8))]) for _ in range(r.randint(0, size)))) for i in range(n)]


@pytest.mark.parametrize("seed, kinds", [(1, "a"), (2, "ab"), (3, "abcdefghij"), (4, ["uno", "dos", "tres", "cuatro"] * 4 + [str(x) for x in range(99)])])
def test_word_windows_equal_brute_force(spark, seed, kinds):
    rows = repetitive(seed, 60, list(kinds), 14)
    want = brute(rows, words, 20)
    got = {r.doc_id: r for r in suffix_tree.remove_repeats(table(spark, rows)).collect()}
    for (i, _), (x, gone) in want.items():
        assert (got[i].n_words, got[i].n_removed) == (len(x), sum(gone)), i
        assert got[i].kept == b" ".join(w for w, g in zip(x, gone) if not g).decode(), i


@pytest.mark.parametrize("seed, kinds", [(1, "a"), (2, "ab"), (3, "abcdefé"), (4, ["uno", "dos", "tres", "cuatro"] * 4 + [str(x) for x in range(99)])])
def test_byte_windows_equal_brute_force(spark, seed, kinds):
    rows = repetitive(seed, 50, list(kinds), 18)
    want = brute(rows, lambda t: list(t.encode()), 100)
    got = {r.doc_id: r for r in suffix_array.remove_repeats(table(spark, rows)).collect()}
    for (i, _), (x, gone) in want.items():
        runs = [(a, b) for a in range(len(x)) if gone[a] and (a == 0 or not gone[a - 1]) for b in [next((j for j in range(a, len(x)) if not gone[j]), len(x))]]
        assert [(s.start, s.end) for s in got[i].spans] == runs, i
        assert bytes(got[i].kept) == bytes(b for b, g in zip(x, gone) if not g), i
        assert (got[i].n_bytes, got[i].n_removed) == (len(x), sum(gone))


@pytest.mark.parametrize("name, split, width, join", [("op7_suffix_tree", words, 20, lambda k: b" ".join(k)), ("op8_suffix_array", lambda t: list(t.encode()), 100, bytes)])
def test_queries_equal_brute_force(spark, name, split, width, join):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, split, width)
    got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, _), (x, gone) in want.items():
        assert got[i].n_removed == sum(gone), i
        assert got[i].kept_sha256 == hashlib.sha256(join([w for w, g in zip(x, gone) if not g])).hexdigest(), i


@pytest.mark.parametrize("module, width, split", [(suffix_tree, 20, words), (suffix_array, 100, lambda t: list(t.encode()))])
def test_odd_rows(spark, odd, odd_rows, nothing, module, width, split):
    got = module.remove_repeats(odd).collect()
    assert len(got) == len(odd_rows)
    want = brute(odd_rows, split, width)
    size = {(r.doc_id, r[1]): r.n_removed for r in got}
    for (i, _), (x, gone) in want.items():
        if i != 9:  # two texts of one id
            assert size[(None if i == -1 else i, len(x))] == sum(gone), i
    assert module.remove_repeats(nothing).count() == 0


def test_kept_spaces(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: r.kept for r in suffix_tree.remove_repeats(table(spark, [(1, f"one\n\n{passage}\ttwo"), (2, f"three\n{passage}\n\nfour  five")]), keep_spaces=True).collect()}
    assert got == {1: f"one\n\n{passage}\ttwo", 2: "three\nfour  five"}


def test_repeated_rows_do_not_remove_each_other(spark):
    alone, shared = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = " ".join(f"a{i}" for i in range(20, 45)) + " " + " ".join(f"c{i}" for i in range(60))
    rows = [(2, alone), (2, alone), (None, shared), (None, shared), (5, near), (5, near), (7, shared)]
    for spread in (1, 7):  # twins in one batch and in different ones
        frame = table(spark, rows).repartition(spread)
        for removed, split, width in ((suffix_tree.remove_repeats, words, 20), (suffix_array.remove_repeats, lambda t: list(t.encode()), 100)):
            want = brute(rows, split, width)
            got = removed(frame).collect()
            assert len(got) == len(rows)
            for r in got:
                key = next(k for k in want if k[0] == (-1 if r.doc_id is None else r.doc_id))
                assert r.n_removed == sum(want[key][1]), r.doc_id


def test_large_groups_are_split_by_longer_prefixes(spark):
    digits = [f"d{i}" for i in range(5)]
    r = random.Random(3)
    # half of all paths begin alike for two symbols, a tenth for three, and one path is there 90 times
    paths = [(7, 7, r.randrange(50), r.randrange(9), i) for i in range(500)] + [(7, 7, 7, i, i) for i in range(100)] + [(1, 2, 3, 4, 5)] * 90 + [tuple(r.randrange(999) for _ in digits) for _ in range(300)]
    rows = spark.createDataFrame([(i, 0, i, *p) for i, p in enumerate(paths)], "doc long, tag long, run long, " + ", ".join(f"{d} long" for d in digits))
    grouped = suffix_tree.grouped(rows, digits, most=40)
    sizes = grouped.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct(*digits).alias("paths")).collect()
    assert sum(s.n for s in sizes) == len(paths)
    assert all(s.n <= 40 or s.n >= 90 for s in sizes)  # only equal suffixes (and a few of their bin) stay together
    assert grouped.groupBy(*digits).agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_nodes_equal_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        leaves = sorted(tuple(r.randint(0, 1) for _ in range(4)) for _ in range(r.randint(1, 30)))
        want = {}
        for a in leaves:
            for depth in range(1, 5):
                same = [i for i, b in enumerate(leaves) if b[:depth] == a[:depth]]
                if len(same) > 1:
                    want[same[0], same[-1]] = max(depth, want.get((same[0], same[-1]), 0))
        depth, first, last = suffix_tree.internal_nodes(np.array(leaves).T)
        assert dict(zip(zip(first.tolist(), last.tolist()), depth.tolist())) == want


def test_a_group_in_pieces_and_groups_read_together():
    r = random.Random(1)
    rows = sorted((part, *[r.randint(0, 1) if part else 5 for _ in range(3)], i) for i, part in enumerate([0] * 50 + [r.randrange(1, 9) for _ in range(200)]))
    seen, want = set(), set()
    for part, *path, i in rows:
        want |= {i} if (part, *path) in seen else set()
        seen.add((part, *path))
    columns = [np.array(c) for c in zip(*[(i, 0, i, *path, part) for part, *path, i in rows])]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "tag", "run", "d0", "d1", "d2", "part"])
    for size in (1, 7, 300):
        for most in (3, 20, 1000):
            got = suffix_tree.repeats((whole.slice(at, size) for at in range(0, len(rows), size)), most)
            assert {x for b in got for x in b.column(0).to_pylist()} == want
