"""The queries opN_<name> and their SQL, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated 20-word passages."""
    from .suffix_tree import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated 100-byte strings."""
    from .suffix_array import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op7_suffix_tree": op7_suffix_tree,
    "op8_suffix_array": op8_suffix_array,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
}
ORACLE: dict[str, str] = {}


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edit."""
    from .order_minhash import compare_edits

    return compare_edits(_table(spark, sf_dir, "documents"))


QUERIES["op4_order_minhash"] = op4_order_minhash


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Rules of op6.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    from .url_rules import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES["op3_html_text"] = op3_html_text
QUERIES["op6_url_rules"] = op6_url_rules


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    from .quality_crf import held_out, learned, scored

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, _table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    slim = scored(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return slim.select("doc_id", "held_out", "score", predicted.alias("predicted"))


QUERIES["op5_quality_crf"] = op5_quality_crf


#: Times that op1 may read a source, within a budget of all words.
REPETITION = 2.0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed as evenly as two epochs of any of them allow."""
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), repetition=REPETITION).select("doc_id", "source", "epoch", "block", "position")


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest codes of every hundredth vector."""
    from .hamming_topk import top_k

    rows = _table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


QUERIES["op1_mixing"] = op1_mixing
QUERIES["op2_hamming_topk"] = op2_hamming_topk
ORACLE["op2_hamming_topk"] = """
WITH q AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
         list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST((q.embedding[i] >= 0) <> (e.embedding[i] >= 0) AS INTEGER))) AS distance
  FROM q JOIN embeddings e ON e.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a plain or a fill-in-the-middle row, with the text rebuilt from it."""
    from .fill_in_middle import arranged, restored

    rows = arranged(_table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back)


QUERIES["op13_fill_in_middle"] = op13_fill_in_middle


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of word pairs are alike to 0.8."""
    from .lsh_forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op11_lsh_forest"] = op11_lsh_forest


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    import public_tokenizers

    from .token_alignment import align

    rows = align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


QUERIES["op12_token_alignment"] = op12_token_alignment
