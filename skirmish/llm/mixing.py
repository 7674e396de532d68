"""Mixing sources to target weights by temperature.

The weight of a source is its share of the tokens to the power ``1 / T``,
normalised. The exponent is found by bisection between 0 (all sources alike)
and 1 (shares as they are): with ``entropy`` the mix has that entropy in nats;
with ``repetition`` no source is read more often than so many times within the
budget, at the most even mix that allows it. Each pass over the table of
sources tries ``STEPS`` - 1 exponents at once, which halves the bracket four
times. Weights are then realised on documents: a source's epochs are
permutations of it by hash, one after another, cut where its token budget is
met; each is dealt to ``blocks`` blocks in proportion, so every block holds the
mix. Whole epochs and cuts come from token counts of hash slices; only the one
slice that holds a cut is summed row by row, so no source meets in one task.

A budget is met to within one document a source: the document that crosses it
is kept.

Defined cases. Null and empty texts count no token; such documents come with
the epochs of their source. A null source is a source of its own. Repeated rows
count each; ties of rank fall back on the id. An empty table, or one without
tokens, gives no row. Extra columns are kept; ``epoch``, ``block`` and
``position`` take the place of any such column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_BREAKS, cut

#: Parts of the bracket in each pass of the bisection.
STEPS = 16
PASSES = 7
#: Rows that a hash slice holds on average.
SLICE_ROWS = 2000


def tokens_of(text: Column) -> Column:
    """Words of a text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_BREAKS, " " * len(WORD_BREAKS))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def source_table(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``source, tokens, rows``."""
    return docs.select(F.col(source).alias("source"), tokens_of(F.col(text)).alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("rows"))


def measured(sources: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """Entropy and highest repetition of the mix of each exponent."""
    tried = sources.where("tokens > 0").select("tokens", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x"))
    power = F.exp(F.col("x") * F.ln("tokens"))
    # of weights p = v / sum(v): entropy = ln(sum v) - sum(v ln v) / sum v
    rows = tried.select("x", power.alias("v"), "tokens").groupBy("x").agg(
        F.sum("v").alias("total"), F.sum(F.col("v") * F.ln("v")).alias("vlogv"), F.max(F.col("v") / F.col("tokens")).alias("top")
    )
    return {r.x: (r.e, r.r) for r in rows.select("x", (F.ln("total") - F.col("vlogv") / F.col("total")).alias("e"), (budget * F.col("top") / F.col("total")).alias("r")).collect()}


def exponent(sources: DataFrame, budget: float, entropy: float | None = None, repetition: float | None = None) -> float:
    """The bisected exponent. Entropy and repetition both fall as it grows.
    A target out of reach gives the nearer end."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        found = measured(sources, grid, budget)
        if not found:
            return 1.0
        ok = [i for i, x in enumerate(grid) if (found[x][0] <= entropy if entropy is not None else found[x][1] <= repetition)]
        first = ok[0] if ok else STEPS
        if first == 0:
            return grid[0]
        low, high = grid[first - 1], grid[first]
    return high


def mix(
    docs: DataFrame, budget: float | None = None, entropy: float | None = None, repetition: float | None = None, blocks: int = 64, seed: int = 0, text: str = "text", source: str = "source"
) -> DataFrame:
    """``docs`` as mixed, with ``epoch``, ``block`` and ``position`` (a random
    number: a block is its rows in ascending order of it). ``budget`` in words,
    all by default."""
    if (entropy is None) == (repetition is None):
        raise ValueError("one of entropy and repetition")
    kept = [c for c in docs.columns if c not in ("epoch", "block", "position")]
    sources = cut(source_table(docs, text, source), "mixing-sources")
    total, rows = sources.agg(F.sum("tokens"), F.sum("rows")).first()
    budget = float(budget if budget is not None else total or 0)
    x = exponent(sources, budget, entropy, repetition)
    power = F.when(F.col("tokens") > 0, F.exp(x * F.ln("tokens"))).otherwise(0.0)
    norm = sources.agg(F.sum(power).alias("norm"))
    # epochs to read in full, and tokens of the epoch that is cut
    plan = sources.crossJoin(F.broadcast(norm)).select("source", "tokens", (budget * power / F.col("norm")).alias("goal"))
    plan = plan.where("tokens > 0").select("source", "tokens", "goal", F.floor(F.col("goal") / F.col("tokens") + 1e-9).cast("int").alias("full"))
    plan = plan.select("*", F.greatest(F.lit(0.0), F.col("goal") - F.col("full") * F.col("tokens")).alias("rest")).withColumn("rest", F.when(F.col("rest") < 1e-6 * F.col("tokens"), 0.0).otherwise(F.col("rest")))
    plan = cut(plan, "mixing-plan")

    slices = max(1, (rows or 0) // SLICE_ROWS)
    text_hash, order = F.xxhash64(text), F.lit(seed)
    rank = lambda epoch: F.xxhash64(order, epoch, F.col("doc_id"), text_hash)
    named = docs.select(*kept).withColumn("__source", F.col(source)).withColumn("__tokens", tokens_of(F.col(text)))
    placed = named.join(plan.select(F.col("source").alias("__s"), "full", "rest", "goal", F.col("tokens").alias("__all")), F.col("__source").eqNullSafe(F.col("__s")))
    epochs = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full")))).withColumn("__rank", rank(F.col("epoch")))
    whole = epochs.where("epoch < full")

    # the cut epoch: tokens of each slice, the running sum over slices, then rows of the slice that holds the cut
    slot = F.pmod(F.shiftright("__rank", 8), F.lit(slices))
    last = epochs.where("epoch = full and rest > 0").withColumn("__slot", slot)
    sums = last.groupBy("__source", "__slot").agg(F.sum("__tokens").alias("t"), F.first("rest").alias("rest"))
    running = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("__source").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = cut(running.where("before < rest").select(F.col("__source").alias("__e"), F.col("__slot").alias("__es"), "before", "t", (F.col("before") + F.col("t") > F.col("rest")).alias("cuts")), "mixing-slices")
    inside = last.join(edge, F.col("__source").eqNullSafe(F.col("__e")) & (F.col("__slot") == F.col("__es")))
    ahead = Window.partitionBy("__source", "__slot").orderBy("__rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    crossing = inside.where("cuts").withColumn("__ahead", F.col("before") + F.coalesce(F.sum("__tokens").over(ahead), F.lit(0))).where("__ahead < rest")

    # a source's stream runs once through all blocks; __ahead is the tokens of the epoch before a document, about so within a slice
    within = F.pmod(F.xxhash64("__rank"), F.lit(1 << 20)) / (1 << 20)
    columns = [*kept, "epoch", "__rank", "__ahead", "goal", "__all"]
    uncut = inside.where("not cuts").withColumn("__ahead", F.col("before") + within * F.col("t"))
    full = whole.withColumn("__ahead", (slot + within) / slices * F.col("__all"))
    chosen = full.select(*columns).unionByName(uncut.select(*columns)).unionByName(crossing.select(*columns))
    along = F.col("epoch") * F.col("__all") + F.col("__ahead")
    block = F.least(F.lit(blocks - 1), F.floor(blocks * along / F.col("goal"))).cast("int")
    out = chosen.withColumn("block", F.greatest(F.lit(0), block))
    return out.select(*kept, "epoch", "block", F.xxhash64(F.lit(seed), "__rank", "block").alias("position"))
