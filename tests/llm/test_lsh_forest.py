"""LSH forest classes against all pairs of sets."""

import random
import re
from itertools import combinations

from skirmish.llm import lsh_forest, queries

from .conftest import SF, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def classes(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [pairs_of(t) for _, t in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    distinct = {}
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            j = distinct.setdefault(frozenset(s), i)
            head[top(i)] = top(j)
    for (x, i), (y, j) in combinations(distinct.items(), 2):
        if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            head[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low[top(i)] if d is not None else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op11_lsh_forest(spark, SF)) == classes(docs)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**9)}"
    return " ".join(words)


def test_groups_of_edits_far_apart_from_each_other(spark, monkeypatch):
    """150 edits of each text, linked with it but hardly with each other, beyond one region."""
    r = random.Random(2)
    rows = []
    for g in range(4):
        words = [f"{g}x{r.randrange(5000)}" for _ in range(220)]
        rows += [(1000 * g + 900, " ".join(words))] + [(1000 * g + i, edited(r, words, 5 + i % 20)) for i in range(150)]
    rows += [(9000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    want = classes(rows)
    assert len({c for _, _, c, _ in want}) < 400
    assert got(lsh_forest.near_duplicates(table(spark, rows))) == want


def test_close_to_the_threshold(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        words = [f"{i}y{k}" for k in range(r.randrange(9, 120))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: int(len(words) * r.choice((0.79, 0.8, 0.81, 0.82, 0.9)))]))]
    assert got(lsh_forest.near_duplicates(table(spark, rows))) == classes(rows)


def test_odd_rows(spark, odd, odd_rows, nothing):
    assert got(lsh_forest.near_duplicates(odd)) == classes(odd_rows)
    assert got(lsh_forest.near_duplicates(nothing)) == []


def test_pairs_of_one_class_are_left_out_before_they_meet_it(spark):
    r = random.Random(8)
    met = [(r.randrange(60), [r.randrange(60) for _ in range(r.randrange(6))]) for _ in range(200)]
    met = [(a, [b for b in others if b != a]) for a, others in met]
    part = {i: i % 5 for i in range(40)}
    label = spark.createDataFrame(list(part.items()), "id long, component long")
    got = lsh_forest.unlinked(spark.createDataFrame(met, "rep long, next array<long>"), label)
    want = {(min(a, b), max(a, b)) for a, others in met for b in others if part.get(a, a) != part.get(b, b)}
    found = [(x.a, x.b) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)
    # a join takes a row a set, so it makes no more
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(lines) if "Join LeftOuter" in line]
    assert len(joins) == 2 and all("Aggregate [" in next(x for x in lines[i + 1 :] if "Project" not in x and "Filter" not in x) for i in joins)
