"""Ridge regression from one aggregation, and map selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skirmish.functions.ratings import best_of_3, best_of_5


def gram(rows: DataFrame, features: list[str], target: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Weighted normal equations, one row (a group), in a single aggregation."""
    names = ["1", *features, target]
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    sums = [F.sum(F.col(weight) * value(a) * value(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(*(by or [])).agg(*sums)


def solve(row, size: int, alpha: float) -> np.ndarray:
    """Ridge weights, intercept first and not penalised."""
    full = np.zeros((size + 2, size + 2))
    for i in range(size + 2):
        for j in range(i, size + 2):
            full[i, j] = full[j, i] = row[f"{i}_{j}"] or 0.0
    a = full[: size + 1, : size + 1] + alpha * np.diag([0.0] + [1.0] * size)
    return np.linalg.lstsq(a, full[: size + 1, size + 1], rcond=None)[0]


#: Rows that a search needs.
LEAST_ROWS = 12


def ridge(spark: SparkSession, rows: DataFrame, features: list[str], target: str, weight: str, fold: str, alphas: list[float] | None = None) -> DataFrame:
    """Weights of the alpha with the best mean R2 over expanding folds.

    ``fold`` numbers the folds in the order of time: each from the second on is
    foretold from all before it. Fits are weighted, R2 and the root of the mean
    squared error are not. Fewer than ``LEAST_ROWS`` rows fail. Two Gram matrices a
    fold reach the driver, never rows."""
    alphas = alphas or [10 ** (-3 + 5 * i / 14) for i in range(15)]
    fits = {r[fold]: r for r in gram(rows, features, target, weight, [fold]).collect()}
    plain = {r[fold]: r for r in gram(rows.withColumn("__one", F.lit(1.0)), features, target, "__one", [fold]).collect()}
    if sum(r["0_0"] for r in plain.values()) < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} rows to fit")
    size, order = len(features), sorted(fits)
    add = lambda rs: {k: sum(r[k] or 0.0 for r in rs) for k in rs[0].asDict() if k != fold}

    def score(alpha: float) -> tuple[float, float]:
        r2, errors = [], []
        for i in range(1, len(order)):
            w = solve(add([fits[k] for k in order[:i]]), size, alpha)
            t = plain[order[i]]
            full = np.array([[t[f"{min(a, b)}_{max(a, b)}"] for b in range(size + 2)] for a in range(size + 2)])
            e = np.append(-w, 1.0)
            left, total = e @ full @ e, full[-1, -1] - full[0, -1] ** 2 / max(full[0, 0], 1e-12)
            r2.append(1 - left / max(total, 1e-12))
            errors.append(np.sqrt(max(left, 0.0) / max(full[0, 0], 1e-12)))
        return (float(np.mean(r2)), float(np.mean(errors))) if r2 else (0.0, 0.0)

    scores = {x: score(x) for x in alphas}
    best = max(alphas, key=lambda x: scores[x][0])
    w = solve(add([fits[k] for k in order]), size, best)
    return spark.createDataFrame([(n, float(v), float(best), *scores[best]) for n, v in zip(["intercept", *features], w, strict=True)], "feature string, weight double, alpha double, r2 double, rmse double")


def mean_error(rows: DataFrame, weights: dict[str, float], target: str) -> DataFrame:
    """Mean absolute error and R2 of fitted weights (``intercept`` included), unweighted."""
    told = sum((F.col(n) * v for n, v in weights.items() if n != "intercept"), F.lit(weights.get("intercept", 0.0)))
    y, e = F.col(target), F.col(target) - told
    return rows.agg(F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y))).alias("r2"))


def time_folds(rows: DataFrame, day: str, order: list[str], splits: int = 5) -> DataFrame:
    """``rows`` with ``fold``: 0 for the first rows, then ``splits`` equal ones, in
    the order of ``day`` and ``order``. Rows are numbered within a day and days by
    their counts, so no task sees more than a day."""
    per_day = rows.groupBy(day).count()
    ahead = per_day.withColumn("__ahead", F.coalesce(F.sum("count").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    whole = per_day.agg(F.sum("count").alias("__n")).withColumn("__test", F.floor(F.col("__n") / (splits + 1)))
    numbered = rows.join(ahead, day).withColumn("__at", F.col("__ahead") + F.row_number().over(Window.partitionBy(day).orderBy(*order)))
    first = F.col("__n") - splits * F.col("__test")
    return numbered.crossJoin(F.broadcast(whole)).withColumn("fold", F.when(F.col("__at") <= first, 0).otherwise(1 + F.floor((F.col("__at") - 1 - first) / F.col("__test"))).cast("long")).drop("__ahead", "__at", "__n", "__test")


#: Acts of each series: who acts (1, 2) and whether it bans or picks; ``d``: the next of what is left.
SERIES = {"bo3": "1b 2b 1p 2p 1b 2b d", "bo5": "1b 2b 1p 2p 1p 2p 1p", "bo5_advantage": "1b 1b 1p 2p 1p 2p 1p"}


def select_maps(chances: Column, acts: str = SERIES["bo3"]) -> Column:
    """Arenas of a series from an array of ``struct(p, arena)`` (``p``: chance of
    the first side). Each act removes (ban) the arena that is worst for its side or
    takes (pick) the best, ties by name. An act on an empty pool does nothing, so
    small pools give short series; the caller falls back on even odds."""
    state = F.struct(chances.alias("left"), F.array().cast("array<struct<p:double,arena:string>>").alias("taken"))

    def turn(act: str):
        def go(s: Column) -> Column:
            want_low = act in ("1b", "2p")
            keyed = F.transform(s["left"], lambda x: F.struct((F.lit(0.0) if act == "d" else x["p"] if want_low else -x["p"]).alias("k"), x["arena"].alias("arena"), x["p"].alias("p")))
            best = F.array_min(keyed)
            left = F.filter(s["left"], lambda x: x["arena"] != best["arena"])
            taken = s["taken"] if act[-1] == "b" else F.when(F.size(s["left"]) > 0, F.concat(s["taken"], F.array(F.struct(best["p"].alias("p"), best["arena"].alias("arena"))))).otherwise(s["taken"])
            return F.struct(left.alias("left"), taken.alias("taken"))

        return go

    for act in acts.split():
        state = F.element_at(F.transform(F.array(state), turn(act)), 1)
    return state["taken"]


def series_chance(maps: Column, kind: str) -> Column:
    """Chance of the first side to win a series over selected maps: even where the
    pool was too small for it."""
    best_of = 3 if kind == "bo3" else 5
    p = [F.element_at(maps, i + 1)["p"] for i in range(best_of)]
    won = best_of_3(*p) if best_of == 3 else best_of_5(p)
    return F.when(F.size(maps) >= best_of, won).otherwise(0.5)


def fallback_maps(pool: Column, kind: str) -> Column:
    """The first arenas of the pool by name, for sides without ratings."""
    return F.slice(F.array_sort(pool), 1, 3 if kind == "bo3" else 5)
