"""SimHash near-duplicate classes through deletion-variant signatures.

A fingerprint of ``bits`` bits is cut into ``segments`` pieces. Two
fingerprints within ``2 * segments - 1`` bits agree, in at least one piece, on
all bits but at most one; so every piece is indexed once per position with that
bit masked, and equal (piece, position, masked value) keys are joined and the
whole distance verified. That is exact for every radius up to
``2 * segments - 1``.

``similar_classes`` links by the similarity of shingle sets. It takes the pairs of
the variant index first and verifies them by their sets; as no fixed radius covers
all sets of a given similarity, a prefix filter over the shingles gives the rest.

Defined cases. A null or empty text has no shingle: its fingerprint is zero and
is linked like any other. Repeated rows and equal fingerprints share one class
representative (the smallest ``doc_id``), so a group of any size costs one row.
Null ids sort below all others and are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import by_key, components, cut

#: Rows of one signature bucket that are compared directly; a larger bucket is first cut by the bits outside its segment (``links``).
DIRECT_BUCKET = 64


def shingle_hashes(text: str | None, k: int, seed: int) -> np.ndarray:
    """XXH64 of every k-word shingle of the A-Z-lowered text, repeats included;
    a text of fewer words has its whole sequence as one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return np.fromiter((digest(line[starts[i] : ends[i + k - 1] - 1], seed) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is set where more than half of the hashes set it."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), text: str = "text") -> DataFrame:
    """``doc_id, fp``: one 64-bit word per seed, as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, texts = b.column(0)[at : at + 1000], b.column(1)[at : at + 1000]
                fps = []
                for t in texts:
                    h = shingle_hashes(t.as_py(), shingle, seeds[0])
                    fps.append([int(np.uint64(majority(h if i == 0 else _again(h, s))).view(np.int64)) for i, s in enumerate(seeds)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp array<long>")


def _again(h: np.ndarray, seed: int) -> np.ndarray:
    """A further hash of each hash (splitmix64 finaliser), for fingerprints longer than one word."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _variants(classes: DataFrame, width: int, per_word: int) -> DataFrame:
    """``key, rep, seg``: one row per segment of ``width`` bits and masked position;
    ``key`` is a hash, whose rare collisions only add candidates that are
    verified away."""
    mask = (1 << width) - 1
    pieces = F.flatten(F.transform("fp", lambda w: F.array(*[F.shiftrightunsigned(w, width * i).bitwiseAND(mask) for i in range(per_word)])))
    base = classes.select("rep", F.posexplode(pieces).alias("seg", "w"))
    masks = F.array(*[F.lit(mask & ~(1 << i)).cast("long") for i in range(width)])
    wild = base.select("rep", "seg", "w", F.posexplode(masks).alias("at", "m"))
    return wild.select(F.xxhash64(F.col("seg") * width + F.col("at"), F.col("w").bitwiseAND(F.col("m"))).alias("key"), "rep", "seg")


def distance(a: str, b: str, words: int):
    """Differing bits of two fingerprint columns."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)), F.lit(0))


def links(classes: DataFrame, radius: int, per_word: int = 2) -> DataFrame:
    """Pairs ``a < b`` of class representatives whose 64-bit fingerprints differ
    in at most ``radius`` bits, found through the variant index.

    Keys that one class alone has are dropped before the join. A key with more
    than ``DIRECT_BUCKET`` classes says nothing about the bits outside its
    segment, so these are cut into as many segments again and joined on the
    key and a one-wildcard variant of them: they differ in at most ``radius``
    bits too, so no link is lost."""
    width = 64 // per_word
    index = _variants(classes, width, per_word)
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = cut(index.join(by_key(sizes), "key").join(by_key(classes), "rep"), "simhash-buckets")

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        left, right = rows.select(*on, F.col("rep").alias("a"), F.col("fp").alias("fa")), rows.select(*on, F.col("rep").alias("b"), F.col("fp").alias("fb"))
        return left.join(by_key(right), on).where("a < b").where(distance("fa", "fb", 1) <= radius).select("a", "b")

    small, large = found.where(F.col("n") <= DIRECT_BUCKET), found.where(F.col("n") > DIRECT_BUCKET)
    near = pairs(small, ["key"])
    outside = 64 - width
    if outside:  # one segment alone holds two fingerprints a key at most
        bits = lambda low, size: F.shiftrightunsigned(F.col("fp")[0], low).bitwiseAND((1 << size) - 1)
        # of the bits outside segment s: those below it, and above them those that stood over it
        rest = F.array(*[F.shiftleft(bits(width * (s + 1), 64 - width * (s + 1)) if s + 1 < 64 / width else F.lit(0).cast("long"), width * s).bitwiseOR(bits(0, width * s)) for s in range(per_word)])
        edges = [i * outside // per_word for i in range(per_word + 1)]
        cuts = [(low, high - low) for low, high in zip(edges[:-1], edges[1:], strict=True)]
        piece = lambda r, low, n: F.shiftrightunsigned(r, low).bitwiseAND((1 << n) - 1)
        variants = lambda r: F.array(*[F.xxhash64(F.lit(low + i), piece(r, low, n).bitwiseAND(((1 << n) - 1) & ~(1 << i))) for low, n in cuts for i in range(n)])
        spread = large.select("key", "rep", "fp", F.get(rest, F.col("seg")).alias("rest")).select("key", "rep", "fp", F.explode(variants(F.col("rest"))).alias("variant"))
        near = near.unionByName(pairs(spread, ["key", "variant"]))
    return near.distinct()


def classes_of(prints: DataFrame) -> DataFrame:
    """One row per distinct fingerprint, with its smallest id."""
    return prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    prints = cut(fingerprints(docs, shingle, (seed,)), "simhash-prints")
    classes = cut(classes_of(prints), "simhash-classes")
    linked = components(links(classes, radius, max(1, (radius + 2) // 2)), "simhash-links")
    labelled = classes.join(by_key(linked), classes.rep == linked.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(by_key(labelled), "fp").select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: Share of texts, one in so many, whose shingles are counted to tell frequent ones.
SAMPLED = 50
#: Frequent shingles that the order knows, at most.
FREQUENT = 200_000


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that several sampled texts hold.
    They only set the order of shingles, which no result depends on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), shingle, 42)).view(np.int64))], names=["key"])

    counted = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct().mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


#: Bits of a parity sketch.
SKETCH = 2048


def parity(hashes: np.ndarray) -> bytes:
    """One bit for each residue of the hashes: whether an odd number of them has it. Of two
    sets, the bits that differ are no more than the elements that only one of them has."""
    return np.packbits(np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def prefixes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id, same, size, fp, odd, keys, cold``: the number of distinct shingles of each
    text, its fingerprint, its parity sketch (``parity``), and its first shingles in one order of all shingles, rare ones first
    (``cold`` of them not known to be frequent). Sets
    of sizes m and n that are similar share ``similarity * max(m, n)`` shingles at least, so
    the first shared one is among the first ``n - similarity * n + 1`` of both (prefix
    filter): no similar pair is lost."""
    held = texts.sparkSession.sparkContext.broadcast(frequent(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                keys, sizes, fps, odd, cold = [], [], [], [], []
                for t in b.column(2):
                    every = shingle_hashes(t.as_py(), shingle, 42)
                    fps.append([int(np.uint64(majority(every)).view(np.int64))])
                    x = np.unique(every)
                    sizes.append(len(x))
                    odd.append(np.frombuffer(parity(x), np.int64))
                    cold.append(len(x))
                    if len(known) and len(x):
                        i = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        held_by = np.where(known[i] == x, counts[i], 0)
                        x, cold[-1] = x[np.argsort(held_by, kind="stable")], int((held_by == 0).sum())
                    # texts without shingles are alike and share a key
                    keys.append((x[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1] if len(x) else np.zeros(1, np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(fps, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(cold, pa.int32())],
                    names=["doc_id", "same", "size", "fp", "odd", "keys", "cold"],
                )

    return texts.select("doc_id", "same", "text").mapInArrow(run, "doc_id long, same string, size int, fp array<long>, odd array<long>, keys array<long>, cold int")


def company(rows: DataFrame) -> DataFrame:
    """``rep, size, at, key``: the rows whose ``key`` others have too, and those of
    frequent keys, which are salted. Rows meet sorted and pass as a stream, so a bucket of
    any size costs no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, last = None, None  # a row that the next may join, and the key before
        for b in batches:
            if not b.num_rows:
                continue
            key, salt = b.column(3).to_numpy(), b.column(4).to_numpy()
            met = np.zeros(len(key) + 1, bool)  # with the row before
            met[1:-1] = key[1:] == key[:-1]
            met[0] = last is not None and key[0] == last
            if pending is not None and met[0]:
                yield pending
            keep = met[:-1] | met[1:] | (salt > 0)
            last, pending = key[-1], None if keep[-1] else b.slice(len(key) - 1, 1).select(["rep", "size", "at", "key"])
            yield b.filter(pa.array(keep)).select(["rep", "size", "at", "key"])

    return rows.repartition("key", "salt").sortWithinPartitions("key").mapInArrow(run, "rep long, size int, at int, key long")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``id, shingles``: the distinct shingle hashes of a text, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle, 42)).tobytes() for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def possible(x, y, similarity: float) -> Column:
    """Whether the parity sketches of two sets (``size, odd``) allow the similarity: sets of
    sizes m and n that have it differ in ``(1 - s) / (1 + s) * (m + n)`` elements at most,
    and so do their sketches. Nothing alike is ruled out, and of small sets hardly
    anything else is let through. A sketch is much smaller than a set, so few sets travel."""
    return _sketches_allow(x, y, similarity, SKETCH // 64)


def _sketches_allow(x, y, similarity: float, longs: int) -> Column:
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.get(x["odd"], i).bitwiseXOR(F.get(y["odd"], i))) for i in range(longs)))
    return differ <= (1 - similarity) / (1 + similarity) * (x["size"] + y["size"]) + 1e-6


#: 64-bit words of a folded sketch.
FOLDED = 8


def folded(odd: str) -> Column:
    """A parity sketch of fewer residues: words of the whole one, one upon the other."""
    whole = [F.get(odd, i) for i in range(SKETCH // 64)]
    return F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), whole[i::FOLDED]) for i in range(FOLDED)])


def possible_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` that their sketches (``rep, size, odd``) do not rule out."""
    x, y = (sketches.select(F.col("rep").alias(c), F.struct("size", "odd").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(by_key(x), "a").join(by_key(y), "b").where(possible(F.col("x"), F.col("y"), similarity)).select("a", "b")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of at least ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - both
                if total == 0 or both >= similarity * total:
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(by_key(left), "a").join(by_key(right), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(rows: DataFrame, chosen: DataFrame, shingle: int, similarity: float, radius: int = 3) -> DataFrame:
    """``id, component`` of all texts that are linked. ``rows``: ``doc_id, same,
    text``; ``chosen``: ``doc_id, same, rep``, one for each text.

    First the deletion-variant index of the fingerprints (``links``) gives pairs,
    and so does every bucket of the prefix index: each member with the bucket's
    centre, the member that has the fewest shingles rarer than the bucket's (of
    a group of edits that is the text all were made from), and with its smallest
    one. Then all pairs that share a bucket and are not linked yet are compared
    too. So a group of near copies costs rows in proportion, and no link is left
    out."""
    # texts are long, so only their keys are joined to numbers
    drawn = cut(prefixes(rows, shingle, similarity).dropDuplicates(["doc_id", "same"]).join(by_key(chosen), ["doc_id", "same"]).select("rep", "size", "fp", "odd", "keys", "cold"), "similar-prefixes", free=True)
    salt = F.when(F.col("at") >= F.col("cold"), 1 + F.pmod("rep", F.lit(64))).otherwise(F.lit(0)).cast("int")
    placed = drawn.select("rep", "size", "cold", F.posexplode("keys").alias("at", "key")).select("rep", "size", "at", "key", salt.alias("salt"))
    before = F.lag("key").over(Window.partitionBy("rep").orderBy("at"))
    index = cut(company(placed).withColumn("before", before), "similar-index", free=True)

    def enough(m: str, i: str, n: str, j: str):
        """What is left of both sets from a first shared shingle on suffices."""
        return (1 + similarity) * F.least(F.col(m) - F.col(i), F.col(n) - F.col(j)) >= similarity * (F.col(m) + F.col(n)) - 1e-6

    def sets_of(pairs: DataFrame, but: DataFrame | None = None) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        if but is not None:
            wanted = wanted.join(by_key(but.select(F.col("id").alias("rep"))), "rep", "left_anti")
        named = cut(chosen.join(by_key(wanted), "rep", "left_semi"), "similar-wanted")
        # repeated rows meet by this join's keys already
        return cut(shingle_sets(rows.join(by_key(named), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"]).select("rep", "text"), shingle), "similar-sets", free=True)

    sort = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    classes = cut(drawn.groupBy("fp").agg(F.min("rep").alias("rep")), "similar-prints")
    equal = drawn.select("rep", "fp").join(by_key(classes.withColumnRenamed("rep", "head")), "fp").where("rep <> head").select(*sort("rep", "head"))
    prints = links(classes, radius, max(1, (radius + 2) // 2)).unionByName(equal)
    ends = index.groupBy("key").agg(F.min(F.struct("at", "size", "rep")).alias("centre"), F.min(F.struct("rep", "size", "at")).alias("low"))
    ends = ends.select("key", F.explode(F.array(F.struct("centre.rep", "centre.size", "centre.at"), "low")).alias("end"))
    stars = index.join(by_key(ends), "key").where("rep <> end.rep").where(enough("size", "at", "end.size", "end.at")).select(*sort("rep", "end.rep"))
    tried = cut(stars.unionByName(prints).distinct(), "similar-stars", free=True)
    pairs = cut(possible_pairs(tried, drawn, similarity), "similar-possible")
    sets = sets_of(pairs)
    found = cut(similar_pairs(pairs, sets, similarity), "similar-star-links")
    label = components(found, "similar-components")
    named = index.join(by_key(label), F.col("rep") == F.col("id"), "left").select("key", "rep", "size", "at", F.coalesce("component", "rep").alias("part"), "before")
    mixed = named.groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").select("key")
    mixed = cut(named.join(by_key(mixed), "key", "left_semi").join(by_key(drawn.select("rep", folded("odd").alias("odd"))), "rep"), "similar-mixed", free=True)
    x, y = mixed.alias("x"), by_key(mixed.alias("y"))
    of = lambda t: {c: F.col(f"{t}.{c}") for c in ("size", "odd")}
    # a pair whose keys before this one are the same, too, meets there
    first = ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.part") != F.col("y.part")) & first & enough("x.size", "x.at", "y.size", "y.at")
    rest = x.join(y, met & _sketches_allow(of("x"), of("y"), similarity, FOLDED)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    rest = cut(possible_pairs(rest.join(by_key(tried), ["a", "b"], "left_anti"), drawn, similarity), "similar-rest", free=True)
    return components(found.unionByName(similar_pairs(rest, sets.unionByName(sets_of(rest, sets)), similarity)), "similar-components")


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """``doc_id, component_id, same, first``: classes of texts that are equal or
    linked by shingle sets of at least that similarity, all of them. ``same``
    tells texts of one id apart; ``first`` marks the one (id, text) of each class
    that stands for it, of the smallest id. Null ids link nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("same", F.md5("text"))
    hashed = rows.select("doc_id", "same")
    # an id may have several texts, so each distinct text has a number of its own
    equal = cut(hashed.groupBy("same").agg(F.min("doc_id").alias("id_of")).withColumn("rep", F.monotonically_increasing_id()), "simhash-equal")
    chosen = equal.where("id_of is not null").select(F.col("id_of").alias("doc_id"), "same", "rep")
    linked = similar_links(rows, chosen, shingle, similarity)
    members = equal.join(by_key(linked), equal.rep == linked.id, "left").select("same", "id_of", F.coalesce("component", "rep").alias("part"))
    heads = members.groupBy("part").agg(F.min(F.struct("id_of", "same")).alias("head"))
    label = members.join(by_key(heads), "part").select("same", F.col("head.id_of").alias("component_id"), F.col("head.same").alias("head"))
    return hashed.join(by_key(label), "same").select("doc_id", "component_id", "same", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("same") == F.col("head"))).alias("first"))
