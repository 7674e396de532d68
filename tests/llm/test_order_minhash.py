import collections
import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from skirmish.llm import order_minhash
from skirmish.llm.queries import QUERIES
from tests.llm.conftest import SF, table


def prints(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.s for r in frame.select("i", order_minhash.signature(F.col("text"), **options).alias("s")).orderBy("i").collect()]


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def chained(values):
    """The 64-bit hash of several values, each seeded by the one before; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_signature(text, k=2, tuple_size=2, sketches=64, place_bits=26):
    words = re.split("[\x20\x09-\x0d]", text)
    keep = ~((1 << place_bits) - 1)
    seen, ranked = collections.Counter(), []
    for at in range(max(1, len(words) - k + 1)):
        kmer = chained(words[at : at + k]) >> place_bits
        rank = chained([struct.pack("<q", kmer), struct.pack("<i", seen[kmer])])
        seen[kmer] += 1
        ranked.append(((rank & keep) >> place_bits, at))
    ranked.sort()
    step, out = 1 << (64 - place_bits), []
    for j in range(sketches):
        point = (j - sketches // 2) * step // sketches
        first = next((i for i, (rank, _) in enumerate(ranked) if rank >= point), 0)
        taken = [ranked[(first + i) % len(ranked)] for i in range(min(tuple_size, len(ranked)))]
        out.append((chained([struct.pack("<q", rank) for rank, _ in sorted(taken, key=lambda r: (r[1], r[0]))]) & 0xFFFF) - 0x8000)
    return out


def test_signatures_equal_a_plain_version(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts += ["", "one", "a a a a a", "a b a b a b", "x  y\tz\n", "é " * 30]
    assert prints(spark, texts) == [plain_signature(t) for t in texts]


def test_query_contract(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op4_order_minhash"](spark, SF).collect()}
    assert len(got) == len(rows)
    same = {}
    for at, (i, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(at + 1) % len(rows)][1][:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        words = lambda f: [f[j : j + 4] for j in range(0, len(f), 4)]
        assert got[i].near_edited == likeness(words(got[i].fingerprint), words(got[i].edited_fingerprint))
        assert got[i].near_next == likeness(words(got[i].fingerprint), words(got[rows[(at + 1) % len(rows)][0]].fingerprint))
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)


def test_order_and_occurrence_count(spark):
    words = [f"w{i}" for i in range(400)]
    text, swapped, other = " ".join(words), " ".join(words[200:] + words[:200]), " ".join(f"v{i}" for i in range(400))
    small = " ".join(words[:100] + ["new"] + words[101:])
    a, b, c, d = prints(spark, [text, swapped, other, small])
    assert likeness(a, d) > 0.9 > likeness(a, b) > likeness(a, c) == 0 or likeness(a, c) < 0.1
    assert likeness(a, b) < 0.75  # the k-mers are all but the same; only their order differs
    once, twice = prints(spark, [" ".join(words[:50]), " ".join(words[:50] * 2)])
    assert likeness(once, twice) < 1


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = order_minhash.compare_edits(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[5].fingerprint == by[6].fingerprint
    assert by[None].near_next == 1
    assert order_minhash.compare_edits(nothing).count() == 0


def test_next_ids(spark):
    frame = table(spark, [(i * 7 % 101, "x") for i in range(101)] + [(None, "y"), (3, "z")])
    got = {r.doc_id: r.next_id for r in order_minhash.next_ids(frame).collect()}
    assert got == {i: (i + 1) % 101 for i in range(101)}


def test_edits_do_not_depend_on_the_parts_and_texts_are_dealt_once(spark, odd, odd_rows, monkeypatch):
    docs = odd.unionByName(table(spark, [(i * i * 7 - 400, f"text {i} " * (i % 9)) for i in range(40)] + [(2**62 + 1, "far"), (2**62, "further")]))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    first = {}
    for i, t in rows:
        if i is not None:
            first[i] = max(first.get(i, t), t, key=lambda x: chained([x]))
    ids = sorted(first)
    follows = {i: first[ids[(at + 1) % len(ids)]] for at, i in enumerate(ids)}
    edit = lambda i, t: t[: len(t) - len(t) // 2] + (t if i is None else follows[i])[: len(t) // 2]
    expected = sorted((str(i), len(t), hashlib.sha256(edit(i, t).encode()).hexdigest()) for i, t in rows)
    answers = []
    for chars in (8_000_000, 500, 1):
        monkeypatch.setattr(order_minhash, "PART_CHARS", chars, raising=False)
        found = order_minhash.compare_edits(docs)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        got = found.collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == expected
        answers.append(sorted(map(repr, got)))
    assert answers[0] == answers[1] == answers[2]
    known = docs.select("doc_id", "text").where("doc_id is not null").na.fill("")
    firsts = order_minhash.openers(known)
    assert len(firsts) > 20
    for r in known.select("doc_id", order_minhash._part(F.col("doc_id"), firsts).alias("part")).collect():
        assert r.part == sum(x <= r.doc_id for x in firsts)
