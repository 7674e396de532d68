"""Exact top-k by Hamming distance: multi-index hashing, grown by radius.

A vector's code is the signs of its components. Codes are cut into segments
of about log2(n) bits and indexed by each segment's value. Round r probes the
segment values within r bits of the query's; after it, every code within
``segments * (r + 1) - 1`` bits of a query has been met in some segment
(pigeonhole), so a query ends as soon as its k-th verified distance is no more
than that, ties included.

The index holds distinct codes in buckets of at most ``BUCKET`` (a larger bucket
is several rows), and a code stands for its ``k + 1`` smallest ids, which is all
that a top-k by (distance, id) can use.

Defined cases. A null id or vector, or a vector of another length than the
commonest (of ties the greatest), is not indexed and asks nothing; null components count as negative.
Repeated ids are one row. A query is no neighbour of itself. Fewer than k other rows give as many. Extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

BUCKET = 512


def code_words(vector: Column, bits: int) -> Column:
    """Sign bits as an array of 32-bit words (in longs)."""
    word = lambda at: F.aggregate(F.sequence(F.lit(at), F.lit(min(at + 32, bits) - 1)), F.lit(0).cast("long"), lambda s, i: s * 2 + F.coalesce((F.get(vector, i) >= 0).cast("long"), F.lit(0)))
    return F.array(*[word(at) for at in range(0, bits, 32)])


def segment_value(words: Column, low: int, size: int) -> Column:
    """Bits low .. low + size - 1 of the words, as a long."""
    value = F.lit(0).cast("long")
    at = low
    while at < low + size:
        take = min(low + size - at, 32 - at % 32)
        value = F.shiftleft(value, take) + F.shiftright(words[at // 32], at % 32).bitwiseAND((1 << take) - 1)
        at += take
    return value


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, neighbour_id, distance`` for each row of ``queries``."""
    sized = rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull())
    one = sized.groupBy(F.size(vector).alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).head(1)
    bits = one[0].n if one else 1

    def coded(df: DataFrame) -> DataFrame:
        good = df.where(F.col(id_column).isNotNull() & (F.size(vector) == bits))
        return good.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(code_words(F.col(vector), bits)).alias("code"))

    codes = cut(coded(rows), "topk-codes")
    asked = cut(coded(queries).select(F.col("id").alias("query_id"), F.col("code").alias("query")), "topk-queries")
    few = Window.partitionBy("code").orderBy("id")
    ids = codes.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    distinct = cut(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-distinct")
    n = distinct.count()
    segments = max(1, min(bits, round(bits / max(4.0, (max(n, 2) - 1).bit_length()))))
    edges = [round(i * bits / segments) for i in range(segments + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(segments)]

    keyed = distinct.select("code", F.posexplode(F.array(*[segment_value(F.col("code"), *p) for p in parts])).alias("segment", "value"))
    spread = keyed.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(max(1, n // BUCKET))))
    counts = keyed.groupBy("segment", "value").agg(F.count("*").alias("held"))
    split = spread.join(counts, ["segment", "value"]).withColumn("part", F.pmod(F.col("part"), F.ceil(F.col("held") / BUCKET)))
    index = cut(split.groupBy("segment", "value", "part").agg(F.collect_list("code").alias("codes")), "topk-index")

    bit_distance = lambda a, b: sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(-(-bits // 32))), F.lit(0))
    # rows with one code ask once, for k + 1, as each of them may be its own neighbour
    open_queries, best, radius = cut(asked.select("query").distinct(), "topk-open"), None, 0
    while True:
        probes = None
        for s, (low, size) in enumerate(parts):
            masks = [sum(1 << i for i in c) for c in combinations(range(size), radius)] if radius <= size else []
            if masks:
                p = open_queries.select("query", F.lit(s).alias("segment"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks]) if len(masks) <= 64 else F.from_json(F.lit(str(masks)), "array<bigint>")).alias("mask"))
                p = p.select("query", "segment", segment_value(F.col("query"), low, size).bitwiseXOR(F.col("mask")).alias("value"))
                probes = p if probes is None else probes.unionByName(p)
        if probes is not None:
            # probes grow with the radius, which no estimate of their size knows: never broadcast them
            hit = index.join(probes.hint("merge"), ["segment", "value"])
            # verify inside the bucket; only its own k + 1 nearest codes can matter
            near = F.slice(F.sort_array(F.transform("codes", lambda c: F.struct(bit_distance(c, F.col("query")).alias("distance"), c.alias("code")))), 1, k + 1)
            # a tie at the cut may hide a smaller id behind a greater code: all codes at that distance stay
            limit = F.element_at(near, -1)["distance"]
            kept = F.filter(F.transform("codes", lambda c: F.struct(bit_distance(c, F.col("query")).alias("distance"), c.alias("code"))), lambda x: x["distance"] <= limit)
            new = hit.select("query", F.inline(kept)).distinct()
            met = cut((new if best is None else new.unionByName(best)).distinct(), "topk-met")
            with_ids = met.join(distinct, "code").select("query", "distance", F.explode("ids").alias("id"))
            first = Window.partitionBy("query").orderBy("distance", "id")
            ranked = cut(with_ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1), "topk-ranked")
            worst = ranked.groupBy("query").agg(F.max("distance").alias("kth"), F.count("*").alias("have"))
            best = met.join(worst, "query", "left").where(F.col("kth").isNull() | (F.col("have") <= k) | (F.col("distance") <= F.col("kth"))).select("query", "distance", "code")
        if radius >= max(size for _, size in parts):
            break
        covered = segments * (radius + 1) - 1
        done = worst.where((F.col("have") > k) & (F.col("kth") <= covered)).select("query")
        open_queries = cut(open_queries.join(done, "query", "left_anti"), "topk-open")
        if not open_queries.head(1):
            break
        radius += 1
    answers = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    listed = asked.join(answers, "query").select("query_id", F.posexplode(others).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.distance").alias("distance"))
