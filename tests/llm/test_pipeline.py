import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skirmish.llm.quality_crf import learned, scored
from tests.llm.conftest import SF
from tests.llm.test_packing import holds, whole
from tests.llm.test_simhash import grouped

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.cut(stage(spark, docs, SF), f"test-{name}")
    return out


def texts(frame):
    return {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(stages[n].columns == DOCUMENT for n in ("quality", "near_duplicates", "passages", "mixing"))


def test_quality_keeps_what_scores_high(spark, stages):
    docs = stages["input"]
    model = learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(texts(stages["quality"])) == sorted(r.doc_id for r in scored(docs, model).where(F.col("score") >= corpus_pipeline.QUALITY).collect())


def test_one_of_each_near_group_stays(stages):
    before = texts(stages["quality"])
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in before.items()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(texts(stages["near_duplicates"])) == sorted(set(grouped(sorted(sets), near).values()))


def test_no_passage_repeats(stages):
    seen, width = {}, corpus_pipeline.PASSAGE
    before, after = texts(stages["near_duplicates"]), texts(stages["passages"])
    for i in sorted(before):
        words = before[i].encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if seen.setdefault(w, (i, s)) != (i, s):
                gone[s : s + width] = [True] * width
        left = [w for w, g in zip(words, gone, strict=True) if not g]
        assert left == after.get(i, "").encode().split()
        if not any(gone):
            assert after[i] == before[i]


def test_mix_and_packing(stages):
    rows, mixed = texts(stages["passages"]), stages["mixing"].collect()
    assert all(rows[r.doc_id] == r.text for r in mixed)
    t = whole()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in rows.items()}
    pieces = stages["packing"].collect()
    assert sum(p.length for p in pieces) == sum(len(ids[r.doc_id]) for r in mixed)
    once = corpus_pipeline.packing(stages["mixing"].sparkSession, stages["passages"], SF).collect()
    holds(once, ids)


def test_odd_and_empty_documents(spark, odd_rows, tmp_path):
    rows = [(i, t, None, None, None) for i, t in odd_rows]
    for at, some in (("odd", rows), ("none", [])):
        folder = str(tmp_path / at)
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).columns[0] == "doc_id"
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.read.parquet(f"{folder}/documents.parquet")
            assert stage(spark, docs, folder).columns == DOCUMENT
            stage(spark, docs, folder).count()


assert public_tokenizers.path("word_bpe_49k.json")


def test_unlike_texts_of_one_id_both_stay(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(9, one, None, None, None), (9, two, None, None, None), (9, two, None, None, None), (12, two + " end", None, None, None), (None, one, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, one), (9, one), (9, two)]


def test_columns_of_the_operators_names_pass(spark, tmp_path):
    clash = "kept string, n_removed long, n_words long, score double, block int, epoch int, position long, same string, rep long, carried_kept string, tag long, part string"
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{passage} {' '.join(f'x{i}_{j}' for j in range(200))}", "en", None, 7, "k", 1, 2, 0.5, 3, 4, 5, "s", 6, "c", 8, "p") for i in range(4)] + [(None, None, *[None] * 15), (5, "", *[None] * 15)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    folder = str(tmp_path / "clash")
    spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        for r in got.collect():
            if r.doc_id is not None and r.doc_id < 4:
                assert tuple(r)[5:] == rows[0][5:], name
    assert corpus_pipeline.passages(spark, docs, folder).where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.packing(spark, docs, folder).select("doc_id").distinct().count() == 6
