"""A corpus pipeline: five stages over the documents of ``sf_dir``.

Each stage takes all that the one before it kept, as a written table. All but
the last return the columns of ``documents``; the last returns the pieces of
packed sequences. No stage can be expressed whole in SQL, so ``ORACLE_SQL`` is
None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.llm.common import by_key, cut
from skirmish.llm.mixing import mix
from skirmish.llm.packing import pack
from skirmish.llm.quality_crf import learned, scored
from skirmish.llm.simhash import similar_classes
from skirmish.llm.suffix_tree import remove_repeats

#: Score from which a document is kept.
QUALITY = 0.7
#: Words of a passage that counts as repeated.
PASSAGE = 50
#: Times that the mix may read a source.
REPETITION = 2.0


def _hidden(docs: DataFrame) -> DataFrame:
    """The documents with names that no operator gives to a column of its own."""
    return docs.select("doc_id", "text", *[F.col(c).alias(f"__own_{c}") for c in docs.columns if c not in ("doc_id", "text")])


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, in their order, from ``_hidden`` ones."""
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"__own_{c}").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    Null, empty and blank texts score 0 and go. Very long texts are scored whole.
    Repeated rows score alike, so all stay or all go; null ids are scored, never
    learned from. An empty table, or labels of one class, leave the smoothed share
    of label 1 as every score. Columns that clash with names of the operator pass."""
    hidden = _hidden(docs)
    model = learned(hidden, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _shown(scored(hidden, model).where(F.col("score") >= QUALITY), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of the smallest id) of each class of near copies.

    Null and empty texts are alike: one of them stays. Of repeated rows one stays,
    of equal texts the one of the smallest id; unlike texts of one id are documents
    of their own. Rows of a null id link nothing and all stay. Very long texts are
    compared by all their shingles. An empty table gives none. Columns that clash
    with names of the operator pass."""
    kept = similar_classes(docs).where("first and doc_id is not null").select("doc_id", "same").distinct()
    hidden = _hidden(docs)
    named = hidden.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("same", F.md5(F.coalesce("text", F.lit(""))))
    return _shown(named.join(by_key(kept), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"]), docs).unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; one that had nothing else goes.

    Null and empty texts have no passage and stay, as empty texts. A repeated row
    starts where its twin does, so both keep the passage; rows of a null id come
    before all others. Very long texts are read whole. An empty table gives none.
    ``n_chars`` is that of what is left. Columns that clash with names of the
    operator pass."""
    hidden = _hidden(docs)
    carry = tuple(c for c in hidden.columns if c not in ("doc_id", "text"))
    left = remove_repeats(hidden, width=PASSAGE, gram=12, keep_spaces=True, carry=carry).where("kept <> '' or n_removed = 0")
    left = left.select("doc_id", F.col("kept").alias("text"), *carry)
    return _shown(left.withColumn("__own_n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources as evenly mixed as the repetition limit allows, in the order of
    their blocks.

    A document comes once for each epoch that reads it. Null and empty texts count
    no token and come with the epochs of their source; a null source is a source of
    its own. Repeated rows count each; ties of rank fall back on the id. An empty
    table, or one without words, gives none. Columns that clash with names of the
    operator pass."""
    hidden = _hidden(docs)
    mixed = mix(hidden, repetition=REPETITION, source="__own_source")
    return _shown(mixed.repartitionByRange("block", "position").sortWithinPartitions("block", "position"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, the documents in the order in which they come.

    A null or empty text is packed as its end id alone. Repeated rows are packed
    once each; null ids give pieces of a null id. Very long texts are cut over
    sequences. An empty table gives no piece. Other columns are ignored."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), ordered=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
