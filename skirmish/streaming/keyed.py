"""Ratings as keyed state: each game costs the history of its two teams only.

The state of one (arena, season) is a map from team to the times and ratings of its
games, so a game that comes late is rated as of its own time. A new season is a new
key and starts from the rating that all begin with; ``keep`` lets the state of a
season go once it has not been touched for so long. The stream's checkpoint holds
the state: after a restart only new files are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from skirmish.functions.ratings import RatingModel
from skirmish.operators import folds

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _mapped_state(spark: SparkSession):
    """The state store that keeps maps, for streams started within."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class Standing(StatefulProcessor):
    """Rates the games of one (arena, season), batch by batch."""

    def __init__(self, model: RatingModel, keep: int | None) -> None:
        self.model, self.keep = model, keep

    def init(self, handle) -> None:
        self.past = handle.getMapState("past", "team_id long", "times array<long>, games array<long>, ratings array<double>", self.keep)

    def _standing(self, team: int) -> tuple[list, list]:
        if not self.past.containsKey((team,)):
            return [], []
        times, games, ratings = self.past.getValue((team,))
        return list(zip(times, games, strict=True)), list(ratings)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arena, season = key
        games = pd.concat(list(rows)).sort_values(["played_at", "game_id"])
        held: dict[int, tuple[list, list]] = {}
        out = []
        for g in games.itertuples():
            at, before = (int(g.played_at), int(g.game_id)), []
            for team in (int(g.winner_id), int(g.loser_id)):
                when, ratings = held.setdefault(team, None) or self._standing(team)
                held[team] = (when, ratings)
                i = bisect_left(when, at)
                known = when[i : i + 1] == [at]
                before.append(float(ratings[i - 1]) if i else self.model.start)
            if known:  # a game that is sent again stands
                continue
            gain = self.model.gain(before[0], before[1], g.ahead)
            for team, rating in ((int(g.winner_id), before[0] + gain), (int(g.loser_id), before[1] - gain)):
                when, ratings = held[team]
                i = bisect_left(when, at)
                when.insert(i, at), ratings.insert(i, rating)
            out.append((g.game_id, arena, season, g.winner_id, g.loser_id, g.played_at, before[0], before[1], gain))
        for team, (when, ratings) in held.items():
            self.past.updateValue((team,), ([t for t, _ in when], [i for _, i in when], ratings))
        yield pd.DataFrame(out, columns=folds.RATED_COLUMNS)

    def close(self) -> None:
        pass


def rate_keyed(spark: SparkSession, source: str, store: str, checkpoint: str, per_batch: int | None = None, model: RatingModel | None = None, keep: int | None = None) -> None:
    """Rate the games of a folder of Parquet files as they arrive, until all that are
    there have been read. Rows go to ``store`` once each. Games without a time wait in
    ``store-untimed``; the job fails at its end while there are any."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    games = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(source)
    ahead = (F.col("winner_rounds") - F.col("loser_rounds")).cast("double").alias("ahead")
    timed = games.where("played_at is not null").select("game_id", "arena", "season", "winner_id", "loser_id", "played_at", ahead)
    rated = timed.groupBy("arena", "season").transformWithStateInPandas(Standing(model or RatingModel(), keep), folds._RATED, "Append", "ProcessingTime" if keep else "None")
    written = partial(_written, spark)
    with _mapped_state(spark):
        written(rated, store, f"{checkpoint}/rated")
    written(games.where("played_at is null"), f"{store}-untimed", f"{checkpoint}/untimed")
    folds.require_times(spark.read.schema(schema).parquet(f"{store}-untimed"))


def _written(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str) -> None:
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def rated_rows(spark: SparkSession, store: str) -> DataFrame:
    """What ``rate_keyed`` has written."""
    return spark.read.schema(folds._RATED).parquet(store)
