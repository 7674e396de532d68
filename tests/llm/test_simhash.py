import random

import numpy as np
import xxhash

from skirmish.llm import common, simhash
from skirmish.llm.common import components, cut
from skirmish.llm.queries import QUERIES
from tests.llm.conftest import SF, table


def grouped(ids, linked):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text, k=3):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    want = grouped(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = QUERIES["op9_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert len(set(want.values())) < len(ids)


def test_links_lose_nothing_in_large_buckets(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 400:  # many share all bits of a segment, so their bucket is spread
        x = r.choice([centre, *values])
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    values = sorted(values)
    frame = spark.createDataFrame([([int(np.uint64(v).view(np.int64))], i) for i, v in enumerate(values)], "fp array<long>, rep long")
    got = {(x.a, x.b) for x in simhash.links(frame, 3).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3}


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(500, x) for x in range(501, 560)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((i or -1) for i, _ in odd_rows)
    label = {r.doc_id: r for r in got}
    assert label[1].fingerprint == label[2].fingerprint == label[3].fingerprint == "0" * 16
    assert label[2].component_id == label[3].component_id == 1
    assert label[6].component_id == 5
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.similar_classes(nothing).count() == 0
    assert simhash.similar_classes(odd).count() == len(odd_rows)


def test_similar_classes_find_near_copies(spark):
    r = random.Random(6)
    base = [" ".join(r.choice("lorem ipsum dolor sit amet".split()) + str(r.randrange(400)) for _ in range(r.randint(60, 400))) for _ in range(40)]
    rows, ids = [], iter(range(10_000))
    for b in base:
        rows.append((next(ids), b))
        for _ in range(r.randint(1, 4)):
            w = b.split()
            for _ in range(max(1, len(w) // 80)):
                w[r.randrange(len(w))] = "changed"
            rows.append((next(ids), " ".join(w)))
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)])) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = grouped(list(sets), near)
    got = {x.doc_id: x.component_id for x in simhash.similar_classes(table(spark, rows)).collect()}
    assert got == want


def test_similar_classes_lose_no_pair_with_a_passage_more_or_less(spark):
    r = random.Random(11)
    rows, want, ids = [], {}, iter(range(10_000))
    for _ in range(150):
        base = [f"w{r.randrange(10**9)}" for _ in range(200)]
        cutoff = r.randint(4, 39)
        at = r.randrange(200 - cutoff)
        more, less = next(ids), next(ids)
        rows += [(more, " ".join(base)), (less, " ".join(base[:at] + base[at + cutoff :]))]
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)])) for i, t in rows}
    want = grouped(list(sets), [(a, a + 1) for a in range(0, 300, 2) if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])])
    got = {x.doc_id: x.component_id for x in simhash.similar_classes(table(spark, rows)).collect()}
    assert len(set(want.values())) < 200
    assert got == want


def test_similar_classes_lose_no_pair_in_large_buckets(spark):
    r = random.Random(12)
    common, rows = [f"c{i}" for i in range(150)], []
    for k in range(120):  # all share most of their text, and only pairs are near
        own = [f"k{k}x{i}" for i in range(50)]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + own[: r.randint(14, 24)]))]
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)])) for i, t in rows}
    want = grouped(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {x.doc_id: x.component_id for x in simhash.similar_classes(table(spark, rows)).collect()}
    assert got == want


def joins_of(monkeypatch, run):
    """The plans with joins among those of all that ``run`` writes and gives."""
    plans = []

    def seen(df, name, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, **how)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr(common, "cut", seen)
    plans.append(run()._jdf.queryExecution().executedPlan().toString())
    return [p for p in plans if "Join" in p]


def few(spark):
    return spark.createDataFrame([(i, f"a b c d e f g {i % 7}") for i in range(40)], "doc_id long, text string")


def test_nothing_exploded_is_broadcast(spark, monkeypatch):
    """Tables of a few megabytes on disk, and what is exploded from them, are not gathered on the driver."""
    joined = joins_of(monkeypatch, lambda: simhash.near_duplicates(few(spark)))
    assert len(joined) >= 3 and not any("Broadcast" in p for p in joined)


def test_similar_classes_broadcast_nothing(spark, monkeypatch):
    joined = joins_of(monkeypatch, lambda: simhash.similar_classes(few(spark)))
    assert len(joined) >= 8 and not any("Broadcast" in p for p in joined)
