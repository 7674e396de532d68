"""Ridge, folds in time, map selection and the player chain against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish import catalog
from skirmish.operators import folds, levels, models, player_state, queries
from skirmish.plans import players, ranked, vetoes
from skirmish.sources import arena

SF = "/root/testdata/sf0.001"


def plain_ridge(x, y, w, alpha):
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(a.T @ (a * w[:, None]) + alpha * np.diag([0] + [1] * x.shape[1]), a.T @ (w * y))


def test_ridge_equals_a_plain_search(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(61, 2)), rng.uniform(0.2, 2, 61)
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=61)
    rows = pd.DataFrame({"day": np.arange(61) // 4, "id": np.arange(61), "a": x[:, 0], "b": x[:, 1], "y": y, "w": w})
    dealt = models.time_folds(spark.createDataFrame(rows.sample(frac=1, random_state=1)), "day", ["id"])
    fold = dict(dealt.select("id", "fold").collect())
    assert [fold[i] for i in range(61)] == [0] * 11 + [1 + i // 10 for i in range(50)]
    got = {r.feature: r for r in models.ridge(spark, dealt, ["a", "b"], "y", "w", "fold").collect()}

    def r2(alpha):
        out = []
        for k in range(5):
            n = 11 + 10 * k
            b, t = plain_ridge(x[:n], y[:n], w[:n], alpha), slice(n, n + 10)
            e = y[t] - b[0] - x[t] @ b[1:]
            out.append(1 - (e @ e) / ((y[t] - y[t].mean()) ** 2).sum())
        return np.mean(out)

    alphas = [10 ** (-3 + 5 * i / 14) for i in range(15)]
    best = max(alphas, key=r2)
    assert got["a"].alpha == pytest.approx(best) and got["a"].r2 == pytest.approx(r2(best))
    assert [got[n].weight for n in ("intercept", "a", "b")] == pytest.approx(plain_ridge(x, y, w, best))
    told = models.mean_error(dealt, {n: got[n].weight for n in got}, "y").first()
    assert told.mae == pytest.approx(np.abs(y - got["intercept"].weight - x @ [got["a"].weight, got["b"].weight]).mean())
    with pytest.raises(ValueError):
        models.ridge(spark, dealt.limit(11), ["a", "b"], "y", "w", "fold")


def chosen(spark, pool, kind):
    column = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("arena")) for a, p in pool.items()])
    row = spark.range(1).select(models.select_maps(column, models.SERIES[kind]).alias("m")).select("m", models.series_chance(F.col("m"), kind).alias("c")).first()
    return [m.arena for m in row.m], row.c


def test_selection(spark):
    pool = {"a": 0.1, "b": 0.2, "c": 0.4, "d": 0.5, "e": 0.6, "f": 0.8, "g": 0.9}
    # bo3: bans a and g, picks f and b, bans c and e, d is left
    assert chosen(spark, pool, "bo3")[0] == ["f", "b", "d"]
    assert chosen(spark, pool, "bo5")[0] == ["f", "b", "e", "c", "d"]
    assert chosen(spark, pool, "bo5_advantage")[0] == ["g", "c", "f", "d", "e"]
    assert chosen(spark, pool, "bo3")[1] == pytest.approx(0.8 * 0.2 + 0.8 * 0.8 * 0.5 + 0.2 * 0.2 * 0.5)
    assert chosen(spark, dict.fromkeys("gfedcba", 0.5), "bo3")[0] == ["c", "d", "g"]
    assert chosen(spark, {"a": 0.9, "b": 0.8}, "bo5") == ([], 0.5)
    assert spark.range(1).select(models.fallback_maps(F.array(F.lit("c"), F.lit("a"), F.lit("b"), F.lit("d")), "bo3").alias("m")).first().m == ["a", "b", "c"]


def test_the_chain_of_the_player_model(spark):
    weights = {r.feature: r for r in queries.vpm_weights(spark, SF).collect()}
    assert set(weights) == {"intercept", *(f"pre_{n}" for n in players.BETAS)}
    assert len({r.version for r in weights.values()}) == 1 and len(weights["intercept"].version) == 12
    rows = ranked.ask(spark, SF, "vpm_training_rows", today=11000).toPandas()
    names = [f"pre_{n}" for n in players.BETAS]
    want = plain_ridge(rows[names].to_numpy(float), rows.y24.to_numpy(float), rows.weight.to_numpy(float), weights["intercept"].alpha)
    assert [weights[n].weight for n in ("intercept", *names)] == pytest.approx(want, rel=1e-6, abs=1e-7)
    folds_of = spark.createDataFrame(rows).transform(lambda df: models.time_folds(df, "day", ["game_id", "team_id"])).groupBy("fold").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).orderBy("fold").collect()
    assert [r.n for r in folds_of[1:]] == [len(rows) // 6] * 5 and all(a.last <= b.first for a, b in zip(folds_of, folds_of[1:], strict=False))
    # the chain with learned weights: its observations filtered by a plain loop
    given = {f"w_{n}": weights[f"pre_{n}"].weight for n in players.BETAS}
    seen = levels.observed(spark, SF, given).where("player_id = 5").orderBy("day", "event_id").collect()
    got = queries.player_levels(spark, SF).where("player_id = 5").orderBy("game_num").collect()
    m, v, before = 0.0, 10.0, seen[0].day - 1
    for r, g in zip(seen, got, strict=True):
        step, before = max(1, r.day - before), r.day
        m, v = 0.995**step * m, 0.995 ** (2 * step) * v + 0.05 * step
        k = v / (v + 24 / max(r.rounds, 1))
        m, v = m + k * (r.y - m), (1 - k) * v
        assert (g.kf_mean, g.kf_std, g.y) == pytest.approx((m, v**0.5, r.y), rel=1e-6, abs=1e-7)


def test_ridge_of_the_events(spark):
    got = {r.feature: r for r in queries.ridge_weights(spark, SF).collect()}
    stats = ranked.arena.frame(spark, SF, "stats").where("kills is not null").toPandas()
    x = np.column_stack([stats.kills / 50, stats.role.str.len() / 10])
    want = plain_ridge(x, stats.value.to_numpy(), 0.998 ** (19800 - stats.day.to_numpy()), got["kills"].alpha)
    assert [got[n].weight for n in ("intercept", "kills", "role")] == pytest.approx(want)


def test_arguments(spark):
    stored = ranked.elo_sides(spark, SF).cache()
    all_of = ranked.ask(spark, SF, "rankings", elo=stored).count()
    one = ranked.ask(spark, SF, "rankings", elo=stored, arena="AF", season=1997)
    assert 0 < one.count() < all_of and {(r.arena, r.season) for r in one.collect()} == {("AF", 1997)}
    assert ranked.ask(spark, SF, "elo_upsets", elo=stored, limit=3).count() == 3
    assert ranked.ask(spark, SF, "player_search", term="").count() == 0
    assert ranked.ask(spark, SF, "player_search", term="100%'").count() == 0
    with pytest.raises(TypeError):
        ranked.ask(spark, SF, "rankings", year=1)


def test_untimed_games_do_not_stop_the_rest(spark):
    rows = [(1, "A", 1, 10, 20, None, 13, 5), (2, "A", 1, 10, 20, 7, 13, 5)]
    games = spark.createDataFrame(rows, "game_id long, arena string, season long, winner_id long, loser_id long, played_at long, winner_rounds long, loser_rounds long")
    assert [r.game_id for r in folds.rate_games(games, gate=False).collect()] == [2]


def test_levels_kept_by_player(spark, tmp_path):
    kept = levels.stored(levels.of_players(spark, SF), str(tmp_path / "levels"))
    one = levels.series(kept, [5, 12])
    assert "folder" in one._jdf.queryExecution().executedPlan().toString() and one.select("player_id").distinct().count() == 2
    assert levels.current(kept, least=1, limit=3).count() == 3 and levels.current(kept, until=0).count() == 0
    assert levels.peaks(kept, after=25, limit=4).count() == 4
    for wrong in ([], [1, 2, 3, 4, 5, 6]):
        with pytest.raises(ValueError):
            levels.series(kept, wrong)


def test_a_season_is_rated_alone(spark, tmp_path):
    """A season's games are chosen before they are rated, and read alone from stored ratings."""
    plan = ranked.ask(spark, SF, "rankings", arena="AF", season=1997)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "1997" in below and "AF" in below
    kept = ranked.stored(ranked.elo_sides(spark, SF), str(tmp_path / "elo"))
    asked = ranked.ask(spark, SF, "rankings", elo=kept, arena="AF", season=1997)
    assert "PartitionFilters: [" in asked._jdf.queryExecution().executedPlan().toString() and "1997" in asked._jdf.queryExecution().executedPlan().toString()
    whole = {tuple(r) for r in ranked.ask(spark, SF, "rankings").where("season = 1997 and arena = 'AF'").collect()}
    assert {tuple(r) for r in asked.collect()} == whole == {tuple(r) for r in ranked.ask(spark, SF, "rankings", arena="AF", season=1997).collect()}


def test_a_series_of_two(spark):
    elo = vetoes.elo_sides(spark, SF).cache()
    given = queries.series_prediction(spark, SF, arenas=["H3", "H1", "H2"], elo=elo).first()
    assert given.maps == "H3,H1,H2" and 0 < given.chance < 1
    assert queries.series_prediction(spark, SF, arenas=["H3"], elo=elo).first().chance == 0.5
    nobody = queries.series_prediction(spark, SF, opponent="none", elo=elo).first()
    assert nobody.chance == 0.5 and nobody.chances == "0.500000,0.500000,0.500000"
    five = queries.series_prediction(spark, SF, kind="bo5", elo=elo).first()
    assert len(five.maps.split(",")) == 5
    assert queries.map_selection(spark, SF, teams=[1, 2, 3]).count() == 6


def test_models_are_kept_by_version(spark):
    fit = lambda v, w: spark.createDataFrame([("intercept", 0.5, 1.0, 0.25, 3.0, v), ("pre_kpr", w, 1.0, 0.25, 3.0, v)], "feature string, weight double, alpha double, r2 double, rmse double, version string")
    first = player_state.kept_models(None, player_state.model_row(fit("aa", 2.0)))
    both = player_state.kept_models(first, player_state.model_row(fit("bb", 3.0)))
    again = {r.version: r for r in player_state.kept_models(both, player_state.model_row(fit("bb", 4.0), "Rebuilt.")).collect()}
    assert set(again) == {"aa", "bb"} and again["bb"].weights == {"intercept": 0.5, "pre_kpr": 4.0} and again["aa"].components == ["intercept", "pre_kpr"]
    assert again["bb"].notes == "Rebuilt. cv_r2=0.250000, rmse=3.000000"


def test_player_state_of_absent_players_stays(spark):
    seen = spark.createDataFrame([(1, 1, 10, 10, 1.0, 24.0), (2, 2, 10, 10, 2.0, 24.0)], "player_id long, event_id long, day long, moment long, y double, rounds double")
    _, state = player_state.filtered(seen)
    _, later = player_state.filtered(seen.where("player_id = 1").selectExpr("player_id", "event_id + 5 AS event_id", "day + 3 AS day", "moment + 3 AS moment", "y", "rounds"), state)
    assert {r.player_id: (r.games, r.last_day) for r in later.collect()} == {1: (2, 13), 2: (1, 10)}


#: A hundred teams.
MORE = "/root/testdata/sf0.01"


def every_pair(spark, query, *columns):
    """Whether the query has each ordered pair of teams that meet on these columns, and no other."""
    teams = arena.frame(spark, MORE, "ratings").select("team_id", *columns).distinct()
    other = teams.withColumnRenamed("team_id", "opponent_id")
    want = (teams.join(other, list(columns)) if columns else teams.crossJoin(other)).where("team_id <> opponent_id").select("team_id", "opponent_id").distinct()
    got = catalog.QUERIES[query](spark, MORE).select("team_id", "opponent_id")
    return got.count() == want.count() and not got.exceptAll(want).count()


def test_series_probability_has_every_pair(spark):
    assert every_pair(spark, "series_probability", "arena")


def test_pairwise_matrix_has_every_pair(spark):
    assert every_pair(spark, "pairwise_matrix")


def test_map_selection_has_every_pair(spark):
    assert every_pair(spark, "map_selection", "arena")


def test_map_selection_bo5_has_every_pair(spark):
    assert every_pair(spark, "map_selection_bo5", "arena")


def test_map_selection_advantage_has_every_pair(spark):
    assert every_pair(spark, "map_selection_advantage", "arena")


def dealt_by(found):
    """The keys by which a query's plan deals rows."""
    import re

    return re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", found._jdf.queryExecution().executedPlan().toString())


def test_pre_means_deal_sides_not_players(spark):
    keys = dealt_by(ranked.ask(spark, SF, "vpm_pre_means"))
    assert "team_id" in keys and "player_id" not in keys


def test_whole_keys_of_batches(monkeypatch):
    """Tables hold whole keys, null ones too, however the batches cut them."""
    import pyarrow as pa

    monkeypatch.setattr(folds, "ROWS", 3)
    key = [None, None, 1, 1, 1, 1, 1, 1, 1, 2, 3, 3]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(key[i : i + 2], pa.int64())}) for i in range(0, 12, 2)]
    found = [t["k"].to_pylist() for t in folds.whole(batches, "k")]
    assert sum(found, []) == key and all(a[-1] != b[0] for a, b in zip(found, found[1:], strict=False)) and len(found) > 1


def test_observations_deal_sides_not_players(spark):
    keys = dealt_by(ranked.ask(spark, SF, "vpm_observations"))
    assert "team_id" in keys and "player_id" not in keys


@pytest.mark.parametrize("name", ["top_players", "peak_levels", "compared_players"])
def test_levels_deal_sides_not_players(spark, name):
    """Players are dealt only where few rows of them are left, if at all."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    folded = plan[plan.rindex("MapInArrow") :] if name == "compared_players" else plan[plan.index("MapInArrow") :]
    assert "hashpartitioning(team_id" in folded and "hashpartitioning(player_id" not in folded


def test_given_ratings_are_those_of_the_engine(spark):
    given = ranked.ask(spark, SF, "vpm_observations", elo=ranked.elo_sides(spark, SF))
    assert given.exceptAll(ranked.ask(spark, SF, "vpm_observations")).count() == 0 < given.count()


@pytest.mark.parametrize("name", ["map_selection", "map_selection_bo5", "map_selection_advantage", "series_probability"])
def test_pairs_are_never_dealt(spark, name):
    """Pairs come from blocks of teams that meet, and are not grouped from rows by arena."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "opponent_id" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "MapInArrow" in plan


def test_blocks_of_teams_meet(spark, monkeypatch):
    """Teams of one block and of others, without arenas in common and without ratings."""
    from skirmish.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 1)
    rows = [(1, "a", 1000.0), (1, "b", 1100.0), (2, "a", 1000.0), (3, "c", 900.0), (4, "b", 1100.0), (5, None, 1.0), (None, "a", 1.0)]
    got = {(r.team_id, r.opponent_id): (r.maps, r.chance) for r in pairs.of_teams(spark.createDataFrame(rows, "team_id long, arena string, rating double"), "maps string, chance double", pairs.selected(["1p", "2p", "1p"], 3)).collect()}
    assert got == {(1, 2): ("a", 0.5), (2, 1): ("a", 0.5), (1, 4): ("b", 0.5), (4, 1): ("b", 0.5)}


def test_training_rows_deal_sides_not_players(spark):
    keys = dealt_by(ranked.ask(spark, SF, "vpm_training_rows"))
    assert "team_id" in keys and "player_id" not in keys
