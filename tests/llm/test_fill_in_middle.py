"""Fill-in-the-middle rows against a plain version, and rank and select against counting."""

import hashlib
import random
import re

import numpy as np

from skirmish.llm import fill_in_middle, queries

from .conftest import SF, table

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text))
    return (doc_id, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text))


def test_rank_and_select_count():
    r = np.random.default_rng(3)
    for share in (0.0, 0.01, 0.5, 1.0):
        flags = r.random(3001) < share
        bits = fill_in_middle.Bits(flags)
        assert bits.rank(np.arange(3002)).tolist() == [0, *np.cumsum(flags).tolist()]
        total = int(flags.sum())
        if total:
            assert bits.select(np.arange(1, total + 1)).tolist() == np.flatnonzero(flags).tolist()


def test_query_equals_plain_version(spark):
    got = queries.op13_fill_in_middle(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(x) for x in got.collect()) == sorted(plainly(*d) for d in docs)


def test_odd_rows_and_markers(spark, odd_rows, monkeypatch):
    r = random.Random(8)
    made = ["".join(r.choice(["<P", ">", "<", "S>", " ", "\n", "é", "ab", "🙂", "\x1c", " "]) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    rows = odd_rows + list(enumerate(made, 100)) + [(7000, "a <P> b"), (7001, "  lead"), (7002, "trail \t"), (7003, "   ")]
    for span in (fill_in_middle.SPAN, 50):
        monkeypatch.setattr(fill_in_middle, "SPAN", span)
        batch = fill_in_middle.pa.array([(t or "").encode() for _, t in rows])
        first, second = (fill_in_middle.pa.array([r.randrange(1 << 32) for _ in rows]) for _ in range(2))
        found = fill_in_middle.cuts(batch, first, second).to_pylist()
        for (_, t), a, b, f in zip(rows, first.to_pylist(), second.to_pylist(), found, strict=True):
            tokens = TOKEN.findall(t or "")
            x, y = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
            left, middle = "".join(tokens[:x]), "".join(tokens[x:y])
            assert f == {"n": len(tokens), "left": len(left.encode()), "right": len((left + middle).encode()), "prefix_chars": len(left), "middle_chars": len(middle)}
    out = fill_in_middle.arranged(table(spark, rows), carry=("lang",))
    got = [(x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, sha(x.output)) for x in out.collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted((plainly(*d)[:6] for d in rows), key=key)
    assert "lang" in out.columns
    back = out.select("doc_id", fill_in_middle.restored(out.form, out.output).alias("text")).collect()
    assert sorted((repr(x.doc_id), x.text) for x in back) == sorted((repr(i), t or "") for i, t in rows)


def test_no_rows(spark, nothing):
    assert fill_in_middle.arranged(nothing).count() == 0
