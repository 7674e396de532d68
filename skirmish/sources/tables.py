"""Tables that change: keyed writes as rewrites, versions, JSON, and page feeds.

Parquet has no row updates, so each change gives the new table as a DataFrame;
``commit`` makes several of them current at once.
"""

from __future__ import annotations

import gc
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows."""
    return old.unionByName(new, allowMissingColumns=True)


def inserted_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows only where no row has their keys; of new rows with equal keys one."""
    return inserted(old, new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def updated(old: DataFrame, changes: DataFrame, keys: list[str], nulls: bool = False) -> DataFrame:
    """``old`` with the values of ``changes`` (one row a key): those that aren't null, or
    with ``nulls`` all. Rows without a change stay; changes without a row are dropped."""
    values = [c for c in changes.columns if c not in keys]
    named = changes.select(*keys, F.lit(True).alias("__changed"), *[F.col(c).alias(f"__new_{c}") for c in values])
    new = lambda c: F.when(F.col("__changed"), F.col(f"__new_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"__new_{c}", c)
    return old.join(named, keys, "left").select(*[new(c).alias(c) if c in values else F.col(c) for c in old.columns])


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose keys are in ``gone``."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of each parent in ``new`` replaced: a reload gives the same table."""
    return inserted(deleted(old, new, parent), new)


def emptied(old: DataFrame) -> DataFrame:
    return old.where(F.lit(False))


def last_of_id(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each id, the last in ``order``."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return feed.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def merged_registry(old: DataFrame, feed: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The registry with a feed of ``status`` and other columns merged in, and the
    rows held back: an event that goes from ongoing to completed stays ongoing
    until its games are read, and is completed by a later ``updated``."""
    both = feed.join(old.select(key, F.col("status").alias("__was")), key, "left")
    held = (F.col("__was") == "ongoing") & (F.col("status") == "completed")
    now = both.withColumn("status", F.when(held, "ongoing").otherwise(F.col("status"))).drop("__was")
    return inserted(updated(old, now, [key]), deleted(now, old, [key])), both.where(held).select(key, "status")


class Conflict(RuntimeError):
    """Another writer has committed since the state that a commit was based on."""


def _manifests(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def version(spark: SparkSession, root: str) -> int:
    """Number of the last commit; 0 before the first."""
    fs, path = _manifests(spark, root)
    if not fs.exists(path):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=0)


def commit(tables: dict[str, DataFrame], root: str, base: int | None = None) -> int:
    """Write several tables, then make all of them current at once: the next manifest,
    which one writer alone can create, names a folder for each table, unchanged ones
    included. A job that dies before leaves the old set; one whose ``base`` is no longer
    the last commit fails (``Conflict``). Tables may be derived from those they replace."""
    spark = next(iter(tables.values())).sparkSession
    last = version(spark, root)
    if base is not None and base != last:
        raise Conflict(f"{root} is at {last}, not at {base}")
    folders = {} if not last else dict(_folders(spark, root, last))
    for name, table in tables.items():
        folders[name] = f"{name}-{uuid.uuid4().hex}"
        table.write.parquet(f"{root}/{folders[name]}")
    fs, path = _manifests(spark, root)
    jvm = spark._jvm
    # written aside and renamed, so that no reader sees half a manifest
    aside = jvm.org.apache.hadoop.fs.Path(path, f"part-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(path, str(last + 1))
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise Conflict(f"{root} has a commit {last + 1} already")
    return last + 1


def _folders(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    return json.loads(spark.read.text(f"{root}/manifests/{number}", wholetext=True).first()[0])


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last commit."""
    return {name: spark.read.parquet(f"{root}/{folder}") for name, folder in _folders(spark, root, version(spark, root)).items()}


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files that each hold one document over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a
    temporary one where all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(at or tempfile.mkdtemp(prefix='skirmish-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, name: str) -> DataFrame:
    """The table as written once in a shared folder. Spark is told to drop the shuffle
    files of what was written, which it else keeps until the driver collects its garbage."""
    spark, schema = table.sparkSession, table.schema
    path = shared_folder(spark, name)
    table.write.parquet(path)
    del table
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def links(pages: DataFrame, pattern: str = r"^/\d+/", backfill: bool = True) -> DataFrame:
    """``page_id, at, href, status, age``: links whose address fits, in page order.
    A link whose text says "completed" is completed. Without ``backfill`` links
    that are months or years old ("3mo", "1yr") are left out."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("at", "link"))
    href = F.regexp_extract("link", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("link", r"(?s)<[^>]*>", " "), r"\s+", " "))
    age = F.nullif(F.regexp_extract(text, r"\b(\d+(?:mo|yr))\b", 1), F.lit(""))
    out = rows.select("page_id", F.col("at").cast("long").alias("at"), href.alias("href"), F.when(F.lower(text).contains("completed"), "completed").otherwise("open").alias("status"), age.alias("age"))
    out = out.where(F.col("href").rlike(pattern))
    return out if backfill else out.where("age is null")


def cells(pages: DataFrame) -> DataFrame:
    """``page_id, nth_row, nth_cell, value`` of every table cell, in page order."""
    trs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(trs).alias("nth_row", "tr"))
    tds = rows.select("page_id", "nth_row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("nth_cell", "td"))
    value = F.trim(F.regexp_replace(F.regexp_replace("td", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return tds.select("page_id", F.col("nth_row").cast("long").alias("nth_row"), F.col("nth_cell").cast("long").alias("nth_cell"), value.alias("value"))
