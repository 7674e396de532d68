"""Operators that depend on order: the rating fold, the Kalman filter with its
smoother, and thinning. Each is a grouped map over a key whose rows must be seen
in turn; groups are (arena, season) or one player, and are independent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skirmish.functions.ratings import DEFAULT, RatingModel


_RATED = "game_id long, arena string, season long, winner_id long, loser_id long, played_at long, winner_before double, loser_before double, gain double"
RATED_COLUMNS = [c.split()[0] for c in _RATED.split(", ")]


def keys(column: pa.ChunkedArray) -> np.ndarray:
    """Integers to compare; null as the least of all."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers to reckon with; null as NaN."""
    return column.cast(pa.float64(), safe=False).to_numpy()


#: Rows that a fold takes at once, where a key has fewer.
ROWS = 1 << 18


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole keys from batches in which each key is one run."""
    held, rows, most = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held)
        turns = np.flatnonzero(np.diff(keys(t[key])))
        if len(turns):
            yield t.slice(0, turns[-1] + 1)
            t = t.slice(turns[-1] + 1)
        held, rows = t.to_batches(), t.num_rows
        most = max(ROWS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def rate_games(games: DataFrame, gate: bool = True, rated: DataFrame | None = None, model: RatingModel = DEFAULT, carried: tuple[str, ...] = ()) -> DataFrame:
    """Ratings of both sides before and after each game, reset every season.

    Games are rated in the order of their time, then id. Those without a time are
    never rated: with ``gate`` the job fails before it rates, without it the rest
    is rated and ``require_times`` may fail the job afterwards. Where earlier
    results are given as ``rated``, they stand: a game that comes late is rated
    from the ratings as of its time, and games after it are not rated again. Only
    new rows are returned. Each (arena, season) is a run of one sorted partition,
    so a task holds the ratings of one run's teams and a batch, never a season.
    ``carried`` names whole-number columns that the results have too."""
    if gate:
        require_times(games)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for pdf in batches:
            before_w, before_l, gains = [], [], []
            for arena, season, w, l, ahead, was_w, was_l, known in zip(pdf.arena, pdf.season, pdf.winner_id, pdf.loser_id, pdf.ahead, pdf.winner_before, pdf.loser_before, pdf.gain, strict=True):
                if (arena, season) != at:
                    at, held = (arena, season), {}
                if known == known:
                    a, b, gain = was_w, was_l, known
                else:
                    a, b = held.get(w, model.start), held.get(l, model.start)
                    gain = model.gain(a, b, ahead)
                before_w.append(a), before_l.append(b), gains.append(gain)
                held[w], held[l] = a + gain, b - gain
            out = pdf[keys].assign(winner_before=before_w, loser_before=before_l, gain=gains)
            yield out[pdf.gain.isna()]

    keys = ["game_id", "arena", "season", "winner_id", "loser_id", "played_at", *carried]
    nothing = F.lit(None).cast("double")
    rows = games.where("played_at is not null").select(*keys, (F.col("winner_rounds") - F.col("loser_rounds")).cast("double").alias("ahead"), nothing.alias("winner_before"), nothing.alias("loser_before"), nothing.alias("gain"))
    if rated is not None:
        touched = rows.select("arena", "season").distinct()
        old = rated.join(touched, ["arena", "season"], "left_semi").select(*keys, nothing.alias("ahead"), "winner_before", "loser_before", "gain")
        rows = rows.join(rated.select("game_id"), "game_id", "left_anti").select(*old.columns).unionByName(old)
    dealt = rows.repartition("arena", "season").sortWithinPartitions("arena", "season", "played_at", "game_id")
    found = _RATED.replace("winner_before", "".join(f"{c} long, " for c in carried) + "winner_before")
    return dealt.mapInPandas(fold, found)


def require_times(games: DataFrame) -> None:
    """Fails where a game has no time."""
    if games.where("played_at is null").head(1):
        raise ValueError("a game has no time")


def rated_sides(rated: DataFrame) -> DataFrame:
    """One row a side: the rating before and after the game."""
    side = lambda me, other, won, sign: F.struct(
        "game_id", "arena", "season", "played_at", F.col(f"{me}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"), F.lit(won).cast("long").alias("won"),
        F.col(f"{me}_before").alias("before"), (F.col(f"{me}_before") + sign * F.col("gain")).alias("rating"),
    )
    return rated.select(F.inline(F.array(side("winner", "loser", 1, 1), side("loser", "winner", 0, -1))))


def current_ratings(rated: DataFrame) -> DataFrame:
    """Latest rating of each (team, arena, season)."""
    sides = rated_sides(rated)
    return sides.groupBy("team_id", "arena", "season").agg(F.max_by("rating", F.struct("played_at", "game_id")).alias("rating"))


_LEVELS = "player_id long, event_id long, game_num long, kf_mean double, kf_std double, smooth_mean double, smooth_std double, day long, y double"


def kalman(observed: DataFrame, a: float = 0.995, q: float = 0.05, r0: float = 1.0, per: float = 24.0, by: str | None = None, pick=None) -> DataFrame:
    """Filtered and smoothed level of each player. ``observed``: ``player_id,
    event_id, day, moment, y, rounds``; a missing ``y`` moves time
    only, missing rounds count as one. Players of a batch go step by step together.
    ``by`` names a column of which each value holds whole players and is one run of a
    partition already, so that nothing is dealt. ``pick`` chooses the rows to return from
    arrays: where each player's begin, ``game_num`` and ``smooth_mean``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches, by or "player_id"):
            with np.errstate(all="ignore"):
                yield from levels(t).to_batches()

    def levels(t: pa.Table) -> pa.Table:
        player = keys(t["player_id"])
        order = np.lexsort((keys(t["event_id"]), numbers(t["moment"]), player))
        day, y, rounds = (numbers(t[c])[order] for c in ("day", "y", "rounds"))
        first = np.flatnonzero(np.r_[True, np.diff(player[order]) != 0])
        size = np.diff(np.r_[first, len(day)])
        step = np.maximum(1, np.diff(day, prepend=0))
        step[first] = np.where(np.isnan(day[first]), np.nan, 1)
        decay, noise, noise_of_y = a**step, q * step, r0 * per / np.maximum(np.where(np.isnan(rounds), 1.0, rounds), 1.0)
        seen = ~np.isnan(y) & np.isfinite(noise_of_y)
        # longest first: those with a further game are the front ones
        begin, left = first[np.argsort(-size, kind="stable")], np.sort(size)[::-1]
        front = lambda i: begin[: np.searchsorted(-left, -i)]
        mean_p, var_p, mean, var = (np.zeros(len(day)) for _ in range(4))
        m, v = np.zeros(len(begin)), np.full(len(begin), 10.0)
        for i in range(left[0]):
            at = front(i) + i
            m, v = decay[at] * m[: len(at)], decay[at] ** 2 * v[: len(at)] + noise[at]
            mean_p[at], var_p[at] = m, v
            gain = np.where(seen[at], v / (v + noise_of_y[at]), 0.0)
            m, v = np.where(seen[at], m + gain * (y[at] - m), m), (1 - gain) * v
            mean[at], var[at] = m, v
        smooth, smooth_var = mean.copy(), var.copy()
        for i in range(left[0] - 2, -1, -1):
            at = front(i + 1) + i
            back = var[at] * decay[at + 1] / np.maximum(var_p[at + 1], 1e-12)
            smooth[at] = mean[at] + back * (smooth[at + 1] - mean_p[at + 1])
            smooth_var[at] = np.maximum(0.0, var[at] + back**2 * (smooth_var[at + 1] - var_p[at + 1]))
        number = np.arange(len(day)) - np.repeat(first, size) + 1
        chosen = slice(None) if pick is None else pick(first, number, smooth)
        kept = t.select(["player_id", "event_id", "day", "y"]).take(pa.array(order[chosen]))
        found = [pa.array(x[chosen], from_pandas=True) for x in (mean, np.sqrt(var), smooth, np.sqrt(smooth_var))]
        columns = [kept["player_id"], kept["event_id"], pa.array(number[chosen]), *found, kept["day"], kept["y"]]
        return pa.table([c.cast(pa.int64()) if i in (0, 1, 7) else c for i, c in enumerate(columns)], names=[c.split()[0] for c in _LEVELS.split(", ")])

    read = observed.select(*dict.fromkeys([by or "player_id", "player_id", "event_id", "day", "moment"]), F.col("y").cast("double").alias("y"), F.col("rounds").cast("double").alias("rounds"))
    return (read if by else read.repartition("player_id").sortWithinPartitions("player_id")).mapInArrow(fold, _LEVELS)


def thin(points: DataFrame, seconds: int = 45 * 60) -> DataFrame:
    """Points of each team more than ``seconds`` after the last one kept and of
    another rating than that one."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["played_at", "game_id"])
        keep, last_at, last_rating = [], None, None
        for at, rating in zip(pdf.played_at, pdf.rating, strict=True):
            kept = last_at is None or (at - last_at > seconds and rating != last_rating)
            keep.append(kept)
            if kept:
                last_at, last_rating = at, rating
        return pdf[keep]

    rows = points.select("team_id", "game_id", "played_at", "rating")
    return rows.groupBy("team_id").applyInPandas(fold, rows.schema)
