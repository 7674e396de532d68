"""Order MinHash fingerprints with DataFrame functions alone.

Words are hashed into k-mers, and each k-mer is numbered by its occurrence in
the text, so repeats stay apart. Every numbered k-mer gets one random rank; a
fingerprint has ``sketches`` entries, and entry j takes the ``tuple_size``
k-mers of the smallest ranks from the j-th of ``sketches`` equally spaced points
on (wrapping around at the top, which is one random order per entry), puts these
back into text order and hashes the tuple. Two texts that agree in an entry
share the k-mers and their order, so the share of equal entries falls with edit
distance, not only with set difference (Marcais et al. 2019).

Ranks are sorted as longs that carry the place in their low ``PLACE_BITS`` bits.

Defined cases. Null and empty texts have the one empty word as their k-mer.
A text with fewer k-mers than ``tuple_size`` hashes those that it has. Places
beyond ``2**PLACE_BITS`` start over, so only order is lost in such a text. Equal
texts have equal fingerprints. The next document of a row is the one of the
next greater ``doc_id`` (of several rows with that id, the one of the greatest
text hash); a null id has no place in the order and is compared with itself.
Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_BREAKS, cut

PLACE_BITS = 26
#: Characters in a part of the order of ids, about.
PART_CHARS = 8_000_000


def _numbered_ranks(text: Column, k: int) -> Column:
    """Sorted ranks of the occurrence-numbered k-mers, with their places."""
    words = F.split(F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS)), " ")
    low = (1 << PLACE_BITS) - 1

    def with_words(w: Column) -> Column:
        last = F.greatest(F.size(w) - k, F.lit(0))
        kmer = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        return F.transform(F.sequence(F.lit(0), last), lambda i: kmer(i).bitwiseAND(~low).bitwiseOR(i.cast("long").bitwiseAND(low)))

    def numbered(s: Column) -> Column:
        high = lambda x: F.shiftright(x, PLACE_BITS)
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (high(F.get(s, i)) != high(F.get(s, i - 1))))
        counts = _let(starts, lambda t: F.flatten(F.transform(t, lambda x, r: F.sequence(F.lit(0), F.coalesce(F.get(t, r + 1), F.size(s)) - x - 1))))
        return F.zip_with(s, counts, lambda x, n: F.xxhash64(high(x), n).bitwiseAND(~low).bitwiseOR(x.bitwiseAND(low)))

    return F.sort_array(_let(F.sort_array(_let(words, with_words)), numbered))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signature(text: Column, k: int = 2, tuple_size: int = 2, sketches: int = 64) -> Column:
    """Array of ``sketches`` 16-bit numbers."""
    low = (1 << PLACE_BITS) - 1
    top = 64 - (sketches - 1).bit_length()

    def entries(s: Column) -> Column:
        # signed order starts at the lowest long; the upper bits count up from -sketches / 2
        slot = lambda x: F.shiftright(x, top).cast("int") + sketches // 2
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (slot(F.get(s, i)) != slot(F.get(s, i - 1))))

        def entry(at: Column) -> Column:
            picked = F.transform(F.sequence(F.lit(0), F.least(F.size(s), F.lit(tuple_size)) - 1), lambda j: F.get(s, F.pmod(at + j, F.size(s)).cast("int")))
            ordered = F.transform(F.sort_array(F.transform(picked, lambda x: F.struct(x.bitwiseAND(low).alias("p"), F.shiftright(x, PLACE_BITS).alias("h")))), lambda x: x["h"])
            return (F.xxhash64(ordered).bitwiseAND(0xFFFF) - 0x8000).cast("smallint")

        def spread(f: Column) -> Column:
            # for each point the first rank at or after it; past the last one, the first of all
            place = F.transform(f, lambda i: slot(F.get(s, i)))
            reach = lambda r: F.coalesce(F.get(place, r + 1), F.lit(sketches))
            return _let(place, lambda p: F.flatten(F.concat(
                F.array(F.array_repeat(F.get(f, F.lit(0)), F.get(p, F.lit(0)) + 1)),
                F.transform(F.slice(f, 2, sketches), lambda i, r: F.array_repeat(i, F.get(p, r + 1) - F.get(p, r))),
                F.array(F.array_repeat(F.lit(0), sketches - 1 - F.get(p, F.size(p) - 1))),
            )))

        return F.transform(_let(firsts, spread), lambda i: entry(i))

    return _let(_numbered_ranks(F.coalesce(text, F.lit("")), k), entries)


def fingerprint(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("int") + 0x8000), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def next_ids(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id``: the next greater id, the first after the last.
    Ids are sorted in ranges; one row per range closes the gaps between them."""
    ids = ids.where("doc_id is not null").select("doc_id").distinct()
    ranged = cut(ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "order-minhash-ids")
    here = Window.partitionBy("part").orderBy("doc_id")
    opening = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = opening.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(every)).alias("follows"))
    return ranged.withColumn("next_id", F.lead("doc_id").over(here)).join(following, "part").select("doc_id", F.coalesce("next_id", "follows").alias("next_id"))


def openers(known: DataFrame) -> list[int]:
    """The first ids of the parts that the order of ids is cut into, of about
    ``PART_CHARS`` characters each."""
    rows, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    parts = max(1, min(-(-(chars + rows) // PART_CHARS), rows))
    cuts = known.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    firsts = known.groupBy(_part(F.col("doc_id"), sorted(set(cuts))).alias("part")).agg(F.min("doc_id").alias("first")).select("first").collect()
    return sorted(r[0] for r in firsts) or [0]


def _part(doc_id: Column, firsts: list[int]) -> Column:
    """How many of ``firsts``, in order, are not above an id: first by runs of them, then in one run."""
    if not firsts:
        return F.lit(0)
    width = math.isqrt(len(firsts))
    runs = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    reached = lambda xs: F.size(F.filter(xs, lambda x: x <= doc_id))
    whole = reached(longs([r[0] for r in runs])) - 1
    return _let(whole, lambda i: F.when(i < 0, 0).otherwise(i * width + reached(F.get(F.array(*map(longs, runs)), i))))


def compare_edits(docs: DataFrame, k: int = 2, tuple_size: int = 2, sketches: int = 64, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last half replaced by as
    much of the next document's opening. Texts are dealt once, by parts of the
    order of ids; the first rows of a part also end the one before it, so that
    every row meets the next document in its part."""
    sig = lambda c: signature(F.col(c), k, tuple_size, sketches)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    firsts = openers(known)
    own = known.withColumn("part", _part(F.col("doc_id"), firsts) - 1)
    lent = F.when(F.col("doc_id").isin(firsts), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = own.select("doc_id", "text", "part", F.explode(lent).alias("lent")).withColumn("part", F.when(F.col("lent"), F.pmod(F.col("part") - 1, F.lit(len(firsts)))).otherwise(F.col("part")))
    # a text is sketched where it arrives
    dealt = dealt.repartitionById(len(firsts), "part").withColumn("tag", F.xxhash64("text")).withColumn("sig", sig("text"))
    # from the greatest id down; of several rows with one id the greatest hash comes last
    down = Window.partitionBy("part").orderBy(F.desc("lent"), F.desc("doc_id"), "tag")
    met = dealt.withColumn("above", F.lag(F.struct("lent", "doc_id", "text", "sig")).over(down))
    met = met.withColumn("above", F.when((F.col("above.lent") != F.col("lent")) | (F.col("above.doc_id") != F.col("doc_id")), F.col("above")))
    met = met.withColumn("next", F.last("above", ignorenulls=True).over(down)).where("not lent")
    known = met.select("doc_id", "text", "sig", F.col("next.text").alias("opening"), F.col("next.sig").alias("next_sig"))
    alone = rows.where("doc_id is null").select("doc_id", "text", sig("text").alias("sig"), F.col("text").alias("opening")).withColumn("next_sig", F.col("sig"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("opening", F.lit(1), half))
    out = known.unionByName(alone).withColumn("edited", edited).withColumn("edited_sig", sig("edited"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
