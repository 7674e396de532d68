"""Near-duplicate classes by an LSH forest over MinHash signatures.

Every set of shingles gets ``TREES`` labels of ``DEPTH`` MinHash values. In each
tree the sets are sorted by label, so that those sharing the longest prefix are
neighbours. A set meets the ``REGION - 1`` sets after it that share ``LEAST``
values with it: where a prefix is common, these share a longer one, so each
region is read at the depth at which it holds ``REGION`` sets at most. Where even
whole labels are shared by more (groups of edits of one text), all members meet
the region's centre and its first set, and members not linked by then meet each
other too, so no region is cut off. Candidates are ruled out by one-bit MinHash
words, sizes and parity sketches before whole sets are compared.

Two sets of a Jaccard similarity of 0.8 miss each other in all trees of depth d
with a chance of ``(1 - 0.8**d) ** TREES``: 5e-6 at the full depth of 6, less above.

Defined cases. Without words (or text) a set is empty and linked with nothing;
with fewer words than a shingle has, the whole sequence is one. Equal sets are
one set (copies cost a row), so a group of any size costs no pairs. Unlike texts of one id
are documents of their own. A null id links nothing, has a null class and is kept.
Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import by_key, components, cut
from .simhash import parity, possible, possible_pairs, shingle_hashes, shingle_sets, similar_pairs

TREES, DEPTH, LEAST, REGION = 40, 6, 3, 16
#: One-bit MinHash values of a set, and how many may differ between candidates: at a
#: similarity of 0.8, 12.8 differ, with a deviation of 3.4.
BITS, APART = 128, 38

_DRAWS = np.random.default_rng(11)
_FACTOR = _DRAWS.integers(0, 1 << 32, TREES * DEPTH + BITS, dtype=np.uint32) | np.uint32(1)
_OFFSET = _DRAWS.integers(0, 1 << 32, TREES * DEPTH + BITS, dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set, each mixed to 32 bits."""
    low = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, (short[at : at + 512, None] * _FACTOR + _OFFSET).min(0), out=low)
    return low * np.uint32(0x9E3779B1)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, size, same, high, low, bits, odd``: of each text's set of shingles its
    size, a digest, the upper four and lower two values of its labels, 16 bits each,
    its one-bit values and its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sizes, same, high, low, bits, odd = [], [], [], [], [], []
                for t in b.column(1):
                    x = np.unique(shingle_hashes(t.as_py(), shingle, 42))
                    s = signature(x)
                    label = (s[: TREES * DEPTH] >> np.uint32(16)).astype(np.uint64).reshape(TREES, DEPTH)
                    sizes.append(len(x))
                    same.append(md5(x.tobytes(), usedforsecurity=False).digest())
                    high.append((label[:, :4] << np.arange(48, -1, -16, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))
                    low.append((label[:, 4:] << np.arange(16, -1, -16, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))
                    bits.append(np.packbits((s[TREES * DEPTH :] >> np.uint32(31)).astype(np.uint8)).view(np.int64))
                    odd.append(np.frombuffer(parity(x), np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes, pa.int32()), pa.array(same, pa.binary()), pa.array(high, longs), pa.array(low, longs), pa.array(bits, longs), pa.array(odd, longs)],
                    names=["doc_id", "size", "same", "high", "low", "bits", "odd"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, size int, same binary, high array<long>, low array<long>, bits array<long>, odd array<long>")


def near(x, y, similarity: float) -> Column:
    """Sizes that allow the similarity, and one-bit values that make it likely."""
    apart = F.bit_count(x["s1"].bitwiseXOR(y["s1"])) + F.bit_count(x["s2"].bitwiseXOR(y["s2"]))
    return (F.least(x["size"], y["size"]) >= similarity * F.greatest(x["size"], y["size"]) - 1e-6) & (apart <= APART)


def forest(classes: DataFrame, similarity: float) -> DataFrame:
    """``rep, size, s1, s2, region, large, next``: for each set and tree the sets after it
    in the tree's order that may be similar, nearest first, and the region of its
    whole label. Sets that meet none in a region that is not large are left out."""
    rows = classes.select("rep", "size", F.col("bits")[0].alias("s1"), F.col("bits")[1].alias("s2"), F.posexplode(F.arrays_zip("high", "low")).alias("tree", "label"))
    rows = rows.select("rep", "size", "s1", "s2", "tree", F.shiftrightunsigned("label.high", 16).alias("top"), F.struct(F.col("label.high").bitwiseAND(0xFFFF).alias("v"), F.col("label.low").alias("w")).alias("rest"))
    sorted_rows = rows.repartition("tree", "top").sortWithinPartitions("tree", "top", "rest", "rep")
    whole = Window.partitionBy("tree", "top", "rest")
    order = Window.partitionBy("tree", "top").orderBy("rest", "rep")
    me = F.struct("rep", "size", "s1", "s2")
    met = sorted_rows.withColumn("large", F.count("*").over(whole) > REGION).withColumn("after", F.collect_list(me).over(order.rowsBetween(1, REGION - 1)))
    apart = lambda y: F.bit_count(F.col("s1").bitwiseXOR(y["s1"])) + F.bit_count(F.col("s2").bitwiseXOR(y["s2"]))
    own = {"s1": F.col("s1"), "s2": F.col("s2"), "size": F.col("size")}
    close = F.array_sort(F.transform(F.filter("after", lambda y: near(own, y, similarity)), lambda y: F.struct(apart(y).alias("apart"), y["rep"].alias("rep"))))
    found = met.select("rep", "size", "s1", "s2", F.xxhash64("tree", "top", "rest").alias("region"), "large", F.transform(close, lambda y: y["rep"]).alias("next"))
    return found.where(F.col("large") | (F.size("next") > 0))


def _sorted(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def stars(large: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each member of a region with its centre, the member nearest to the
    majority of the region's one-bit values, and with its first one."""
    bit = [F.sum(F.shiftrightunsigned("s1", i).bitwiseAND(1)) for i in range(64)]
    common = large.groupBy("region").agg(F.count("*").alias("n"), *[b.alias(f"b{i}") for i, b in enumerate(bit)])
    word = reduce(lambda x, y: x.bitwiseOR(y), (F.when(2 * F.col(f"b{i}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)))
    member = F.struct("rep", "size", "s1", "s2")
    ends = large.join(common.select("region", word.alias("word")), "region").groupBy("region").agg(
        F.min_by(member, F.struct(F.bit_count(F.col("s1").bitwiseXOR(F.col("word"))), "rep")).alias("centre"), F.min(member).alias("first"))
    ends = ends.select("region", F.explode(F.array("centre", "first")).alias("end"))
    own = {c: F.col(c) for c in ("s1", "s2", "size")}
    return large.join(ends, "region").where(F.col("rep") != F.col("end.rep")).where(near(own, F.col("end"), similarity)).select(*_sorted("rep", "end.rep"))


def unlinked(met: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of each ``rep`` and the sets in its ``next`` that are not in one class of
    ``label`` (``id, component``). Sets meet their classes, not pairs: the pairs of a set,
    ``TREES * REGION`` at most, are an array in its row."""
    own = met.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("others"))
    own = own.join(by_key(label), F.col("rep") == F.col("id"), "left").select("others", F.struct("rep", F.coalesce("component", "rep").alias("part")).alias("of"))
    held = own.select(F.explode("others").alias("other"), "of").groupBy("other").agg(F.collect_list("of").alias("reps"))
    held = held.join(by_key(label), F.col("other") == F.col("id"), "left").withColumn("part", F.coalesce("component", "other"))
    return held.select("other", F.explode(F.filter("reps", lambda x: x["part"] != F.col("part"))).alias("x")).select(*_sorted("other", "x.rep")).distinct()


def linked(classes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """``id, component`` of all sets on a link. ``classes``: ``rep, size, high, low,
    bits, odd``, one row a set; ``sets_of(reps)`` gives their sets."""
    met = cut(forest(classes, similarity), "forest-neighbours", free=True)
    large = met.where("large").select("rep", "size", "s1", "s2", "region")
    slim = classes.select("rep", "size", "odd")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = cut(possible_pairs(pairs, slim, similarity), "forest-pairs")
        wanted = likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        # a share of exactly the similarity counts, whatever its product rounds to
        return cut(similar_pairs(likely, sets_of(wanted), similarity - 1e-9), "forest-links", free=True)

    nearest = met.where(F.size("next") > 0).select(*_sorted("rep", F.col("next")[0]))
    tried = cut(nearest.unionByName(stars(large, similarity)).distinct(), "forest-tried")
    found = confirmed(tried)
    # what is in one class by now needs no further link
    label = components(found, "forest-components")
    # large regions are joined by themselves
    others = unlinked(met.where("not large").select("rep", F.slice("next", 2, REGION).alias("next")), label)
    named = large.join(label, F.col("rep") == F.col("id"), "left").select("region", "rep", "size", "s1", "s2", F.coalesce("component", "rep").alias("part"))
    mixed = named.groupBy("region").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("region")
    mixed = cut(named.join(mixed, "region", "left_semi").join(classes.select("rep", "odd"), "rep"), "forest-mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    fields = lambda t: {c: F.col(f"{t}.{c}") for c in ("s1", "s2", "size", "odd")}
    met_by = (F.col("x.region") == F.col("y.region")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.part") != F.col("y.part"))
    crossed = x.join(y, met_by & near(fields("x"), fields("y"), similarity) & possible(fields("x"), fields("y"), similarity))
    others = others.unionByName(crossed.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))).distinct().join(tried, ["a", "b"], "left_anti")
    return components(found.unionByName(confirmed(others)), "forest-components")


def near_duplicates(docs: DataFrame, shingle: int = 2, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    drawn = cut(sketches(docs, shingle), "forest-sketches")
    of = drawn.where("size > 0 and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("id_of"), *[F.first(c).alias(c) for c in ("size", "high", "low", "bits", "odd")])
    classes = cut(of.withColumn("rep", F.monotonically_increasing_id()), "forest-classes", free=True)

    def sets_of(reps: DataFrame) -> DataFrame:
        wanted = classes.join(reps, "rep", "left_semi").select("rep", F.col("id_of").alias("doc_id"), "same")
        # of several texts of one id, the one whose set it is
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sets = shingle_sets(texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text"), shingle).withColumnRenamed("id", "doc_id")
        named = sets.withColumn("same", F.unhex(F.md5("shingles"))).join(wanted, ["doc_id", "same"])
        return cut(named.select(F.col("rep").alias("id"), "shingles").dropDuplicates(["id"]), "forest-sets", free=True)

    label = linked(classes, sets_of, similarity)
    members = classes.join(label, classes.rep == label.id, "left").select("same", "id_of", F.coalesce("component", "rep").alias("part"))
    heads = members.groupBy("part").agg(F.min("id_of").alias("component_id"))
    named = members.join(heads, "part").select("same", "component_id")
    rows = drawn.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "same").join(named, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
