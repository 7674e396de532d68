"""Helpers shared by the corpus operators of this subpackage.

``cut`` ends a lineage with a written table in the folder named by
``spark.checkpoint.dir``; ``components`` labels connected components of an
edge table without gathering edges or members on the driver.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters that end a word in the contracts: [\x20\x09-\x0D].
WORD_BREAKS = "\t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one where none is set and
    all runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="skirmish-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str, free: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lost
    executors then cost no recomputation of what stands above. With ``free``,
    Spark is told to drop the shuffle files of what was written, which it else
    keeps until the driver happens to collect its garbage; worth it where whole
    texts or an index were shuffled. ``codec`` compresses the files otherwise than
    the session says."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by key that is never broadcast. Spark takes a table for
    as large as its compressed files, and for no larger once arrays in it are exploded, so
    it would gather millions of rows on the driver for a few megabytes that it expects."""
    return df.hint("merge")


def with_columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra or clashing columns of the input go."""
    return docs.select(*names)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``: the smallest id reachable, for
    every id on an edge. Alternates large-star and small-star steps (Kiveris et
    al. 2014), so a chain of n ends in about log n rounds; each round is a
    written table, and the driver sees only one row of totals per round."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node moves to the smallest of node and neighbours
        large = both.where("b > a").join(by_key(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(by_key(low), "a").select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small, name)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == before:
            break
        before = total
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return members.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
