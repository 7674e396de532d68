"""Queries of the operators that are more than a statement."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.functions import surface
from skirmish.functions.ratings import RatingModel, rating_gain, win_chance
from skirmish.plans import players, ranked, vetoes
from skirmish.plans.ranked import REFERENCE
from skirmish.sources import arena

from . import folds, levels, models, pairs


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.rate_games(arena.frame(spark, sf_dir, "games"))


def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every game with both ratings before it and the change."""
    return _rated(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("winner_before", "loser_before", "gain")})


def elo_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.current_ratings(_rated(spark, sf_dir)).withColumn("rating", F.round("rating", 4))


def player_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = arena.frame(spark, sf_dir, "stats")
    levels = folds.kalman(stats.select("player_id", "event_id", "day", "moment", F.col("value").alias("y"), F.col("kills").cast("double").alias("rounds")))
    return levels.select("player_id", "event_id", F.col("game_num").cast("long").alias("game_num"), *[F.round(c, 5).alias(c) for c in ("kf_mean", "kf_std", "smooth_mean", "smooth_std")])


def thinned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.thin(arena.frame(spark, sf_dir, "ratings"))


def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of two features of a player's game, over folds in the order of time."""
    stats = arena.frame(spark, sf_dir, "stats").where("kills is not null")
    rows = stats.select("day", "moment", "event_id", (F.col("kills") / 50).alias("kills"), (F.length("role") / 10).alias("role"), F.col("value").alias("y"), F.pow(F.lit(0.998), 19800 - F.col("day")).alias("w"))
    return models.ridge(spark, models.time_folds(rows, "day", ["moment", "event_id"]), ["kills", "role"], "y", "w", "fold")


FEATURES = [f"pre_{n}" for n in players.BETAS]


def _folds(spark: SparkSession, sf_dir: str, today: int) -> DataFrame:
    """The training rows of the player model, in folds of time."""
    return models.time_folds(ranked.ask(spark, sf_dir, "vpm_training_rows", today=today), "day", ["game_id", "team_id"])


def _model(spark: SparkSession, sf_dir: str, today: int) -> DataFrame:
    return models.ridge(spark, _folds(spark, sf_dir, today), FEATURES, "y24", "weight", "fold")


def vpm_folds(spark: SparkSession, sf_dir: str, today: int = 11000) -> DataFrame:
    """All that the fit of the player model sees: the days of each fold and its weighted
    normal equations, an entry a row."""
    rows = _folds(spark, sf_dir, today)
    names = ["1", *FEATURES, "y24"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = models.gram(rows, FEATURES, "y24", "weight", ["fold"])
    days = rows.groupBy("fold").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))
    entries = F.inline(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.round(f"{i}_{j}", 3).alias("value")) for i, j in pairs]))
    return sums.join(days, "fold").select("fold", "first_day", "last_day", "n", entries)


def vpm_weights(spark: SparkSession, sf_dir: str, today: int = 11000) -> DataFrame:
    """The model's weights, learned from all training rows, with a version that
    changes with them."""
    found = _model(spark, sf_dir, today)
    version = F.substring(F.sha1(F.to_json(F.sort_array(F.collect_list(F.struct("feature", F.round("weight", 9).alias("weight")))))), 1, 12)
    return found.crossJoin(F.broadcast(found.agg(version.alias("version"))))


def player_levels(spark: SparkSession, sf_dir: str, today: int = 11000) -> DataFrame:
    """The whole chain: weights, adjusted observations, then filter and smoother."""
    weights = {r.feature: r.weight for r in _model(spark, sf_dir, today).collect()}
    return levels.of_players(spark, sf_dir, {f"w_{n}": weights[f"pre_{n}"] for n in players.BETAS})


#: A pool of arenas by game of the match, large enough for every kind of series.
POOL = "pool AS (SELECT team_id, concat(arena, CAST(game_id % 2 AS VARCHAR(20))) AS arena, avg(rating) AS rating FROM ratings GROUP BY team_id, concat(arena, CAST(game_id % 2 AS VARCHAR(20))))"


def _selection(spark: SparkSession, sf_dir: str, kind: str, teams: list[int] | None = None) -> DataFrame:
    """Arenas and chances of a series for every ordered pair of teams, or of the teams
    named. Pairs grow with the square of teams, not with games."""
    mean = arena.run(spark, sf_dir, f"WITH {POOL} SELECT * FROM pool")
    if teams is not None:
        mean = mean.where(F.col("team_id").isin(*teams))
    return pairs.of_teams(mean, "maps string, chance double", pairs.selected(models.SERIES[kind].split(), 3 if kind == "bo3" else 5))


def series_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chances of a series over three arenas for every ordered pair of teams."""
    means = arena.run(spark, sf_dir, "SELECT team_id, arena, avg(rating) AS rating FROM ratings GROUP BY team_id, arena")
    return pairs.of_teams(means, "best_of_3 double, clean_sweep double", pairs.three)


def _selection_chain(kind: str, base: str) -> str:
    """The same acts as steps of SQL over ``s0``, each over what the one before left."""
    steps, picks, left = [], [], "s0"
    for i, act in enumerate(models.SERIES[kind].split()):
        key = "0" if act == "d" else "p" if act in ("1b", "2p") else "-p"
        steps.append(f"c{i} AS (SELECT team_id, opponent_id, arena, p FROM (SELECT *, row_number() OVER (PARTITION BY team_id, opponent_id ORDER BY {key}, arena) AS rn FROM {left}) WHERE rn = 1)")
        steps.append(f"s{i + 1} AS (SELECT s.* FROM {left} s ANTI JOIN c{i} c ON s.team_id = c.team_id AND s.opponent_id = c.opponent_id AND s.arena = c.arena)")
        left = f"s{i + 1}"
        if act[-1] != "b":
            picks.append(f"SELECT *, {i} AS act FROM c{i}")
    n = 3 if kind == "bo3" else 5
    p = [f"max(CASE WHEN rn = {i + 1} THEN p END)" for i in range(n)]
    if n == 3:
        chance = f"{p[0]} * {p[1]} + {p[0]} * (1 - {p[1]}) * {p[2]} + (1 - {p[0]}) * {p[1]} * {p[2]}"
    else:
        ways = [[i in won for i in range(5)] for size in (3, 4, 5) for won in combinations(range(5), size)]
        chance = " + ".join("(" + " * ".join(p[i] if w else f"(1 - {p[i]})" for i, w in enumerate(way)) + ")" for way in ways)
    return f"""{base},
        {", ".join(steps)}, taken AS (SELECT *, row_number() OVER (PARTITION BY team_id, opponent_id ORDER BY act) AS rn FROM ({" UNION ALL ".join(picks)}))
        SELECT team_id, opponent_id, string_agg(arena, ',' ORDER BY rn) AS maps, string_agg(printf('%.6f', p), ',' ORDER BY rn) AS chances, round(CASE WHEN count(*) >= {n} THEN {chance} ELSE 0.5 END, 6) AS chance FROM taken GROUP BY team_id, opponent_id"""


def _selection_sql(kind: str) -> str:
    base = f"""WITH {POOL}, s0 AS (SELECT a.team_id, b.team_id AS opponent_id, a.arena, round(1 / (1 + pow(10, (b.rating - a.rating) / 1000)), 9) AS p FROM pool a JOIN pool b ON a.arena = b.arena AND a.team_id <> b.team_id)"""
    return arena.duck_sql("SELECT team_id, opponent_id, maps, chance FROM (" + _selection_chain(kind, base) + ")")


def map_selection(spark: SparkSession, sf_dir: str, teams: list[int] | None = None) -> DataFrame:
    return _selection(spark, sf_dir, "bo3", teams)


def map_selection_bo5(spark: SparkSession, sf_dir: str, teams: list[int] | None = None) -> DataFrame:
    return _selection(spark, sf_dir, "bo5", teams)


def map_selection_advantage(spark: SparkSession, sf_dir: str, teams: list[int] | None = None) -> DataFrame:
    return _selection(spark, sf_dir, "bo5_advantage", teams)


def series_prediction(spark: SparkSession, sf_dir: str, team: str = "T7", opponent: str = "T8", kind: str = "bo3", arenas: list[str] | None = None, elo: DataFrame | None = None) -> DataFrame:
    """A series of two teams over their current ratings: the arenas given, or those that
    bans and picks leave, and the chance of ``team``. An arena in which either has no
    rating is even, and so is a series that hasn't its number of arenas."""
    names = arena.run(spark, sf_dir, f"WITH {vetoes.HALLS} SELECT t.team_id, t.slug, h.arena FROM teams t JOIN (SELECT DISTINCT arena FROM hall_games) h ON t.team_id IS NOT NULL").where(F.col("slug").isin(team, opponent))
    elo = elo if elo is not None else vetoes.elo_sides(spark, sf_dir)
    now = elo.groupBy("team_id", "arena").agg(F.max_by("rating", F.struct("played_at", "game_id")).alias("rating"))
    rated = names.join(now, ["team_id", "arena"], "left").groupBy("arena").agg(F.max(F.when(F.col("slug") == team, F.col("rating"))).alias("own"), F.max(F.when(F.col("slug") == opponent, F.col("rating"))).alias("other"))
    p = F.round(F.coalesce(win_chance(F.col("own"), F.col("other")), F.lit(0.5)), 9).alias("p")
    pool = rated.select(p, "arena").groupBy().agg(F.array_sort(F.collect_list(F.struct("p", "arena"))).alias("pool"))
    if arenas is None:
        chosen = models.select_maps(F.col("pool"), models.SERIES[kind])
    else:
        chosen = F.flatten(F.transform(F.array(*map(F.lit, arenas)), lambda a: F.filter("pool", lambda x: x["arena"] == a)))
    maps = pool.select(chosen.alias("maps"))
    return maps.select(F.lit(team).alias("team"), F.lit(opponent).alias("opponent"), F.array_join(F.transform("maps", lambda m: m["arena"]), ",").alias("maps"), F.array_join(F.transform("maps", lambda m: F.format_number(m["p"], 6)), ",").alias("chances"), F.round(models.series_chance(F.col("maps"), kind), 6).alias("chance"))


#: Another configuration of the rating model.
MILD = RatingModel(k=40.0, scale=400.0, start=1500.0, margin=3.0)


def elo_configured(spark: SparkSession, sf_dir: str, model: RatingModel = MILD) -> DataFrame:
    """Every game rated by another configuration of the model."""
    rated = folds.rate_games(arena.frame(spark, sf_dir, "games"), model=model)
    return rated.select("game_id", *[F.round(c, 4).alias(c) for c in ("winner_before", "loser_before", "gain")])


def elo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations side by side as functions of the session."""
    surface.register(spark, "usual_")
    surface.register(spark, "mild_", MILD)
    return arena.run(spark, sf_dir, """WITH p AS (SELECT game_id, CAST(max(CASE WHEN won = 1 THEN rating END) AS DOUBLE) AS w, CAST(max(CASE WHEN won = 0 THEN rating END) AS DOUBLE) AS l, CAST(max(margin) AS DOUBLE) AS ahead FROM ratings GROUP BY game_id)
        SELECT game_id, round(usual_gain(w, l, ahead), 6) AS usual, round(mild_gain(w, l, ahead), 6) AS mild, round(usual_best_of_3(usual_chance(w, l), usual_chance(l, w), mild_chance(w, l)), 6) AS three,
               round(usual_best_of_5(usual_chance(w, l), usual_chance(l, w), mild_chance(w, l), 0.5D, usual_chance(w, l)), 6) AS five FROM p""")


def fold_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update formula alone, on the first game of each (arena, season)."""
    games = arena.frame(spark, sf_dir, "games")
    first = games.groupBy("arena", "season").agg(F.min_by(F.struct("game_id", "winner_rounds", "loser_rounds"), F.struct("played_at", "game_id")).alias("g"))
    return first.select("arena", "season", "g.game_id", F.round(rating_gain(F.lit(1000.0), F.lit(1000.0), F.col("g.winner_rounds") - F.col("g.loser_rounds")), 6).alias("gain"))


QUERIES = {f.__name__: f for f in (elo_ratings, elo_current, player_kalman, thinned_series, ridge_weights, vpm_folds, series_probability, map_selection, map_selection_bo5, map_selection_advantage, vpm_weights, player_levels, fold_gain, series_prediction, elo_configured, elo_functions)}
_KALMAN = """WITH numbered_stats AS MATERIALIZED (SELECT player_id, event_id, day, value AS y, CAST(kills AS DOUBLE) AS rounds, row_number() OVER (PARTITION BY player_id ORDER BY moment, event_id) AS n, greatest(1, coalesce(day - lag(day) OVER (PARTITION BY player_id ORDER BY moment, event_id), 1)) AS step FROM stats),
ahead AS (
  SELECT DISTINCT player_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(1 AS BIGINT) AS step, CAST(0 AS DOUBLE) AS mp, CAST(0 AS DOUBLE) AS vp, CAST(0 AS DOUBLE) AS m, CAST(10 AS DOUBLE) AS v FROM numbered_stats
  UNION ALL
  SELECT player_id, n, event_id, step, mp, vp, CASE WHEN y IS NULL THEN mp ELSE mp + vp / (vp + r) * (y - mp) END, CASE WHEN y IS NULL THEN vp ELSE (1 - vp / (vp + r)) * vp END FROM (
    SELECT s.player_id, s.n, s.event_id, s.step, pow(0.995, s.step) * a.m AS mp, pow(0.995, s.step) * pow(0.995, s.step) * a.v + 0.05 * s.step AS vp, s.y, 24 / greatest(coalesce(s.rounds, 1), 1) AS r
    FROM ahead a JOIN numbered_stats s ON s.player_id = a.player_id AND s.n = a.n + 1)
),
filtered AS MATERIALIZED (SELECT * FROM ahead WHERE n > 0),
back AS (
  SELECT f.player_id, f.n, f.m AS sm, f.v AS sv FROM filtered f JOIN (SELECT player_id, max(n) AS n FROM filtered GROUP BY player_id) l ON f.player_id = l.player_id AND f.n = l.n
  UNION ALL
  SELECT f.player_id, f.n, f.m + c * (b.sm - x.mp), greatest(0, f.v + c * c * (b.sv - x.vp)) FROM back b JOIN filtered x ON x.player_id = b.player_id AND x.n = b.n
    JOIN (SELECT f.*, f.v * pow(0.995, nx.step) / greatest(nx.vp, 1e-12) AS c FROM filtered f JOIN filtered nx ON nx.player_id = f.player_id AND nx.n = f.n + 1) f ON f.player_id = b.player_id AND f.n = b.n - 1
)
SELECT f.player_id, f.event_id, f.n AS game_num, round(f.m, 5) AS kf_mean, round(sqrt(f.v), 5) AS kf_std, round(b.sm, 5) AS smooth_mean, round(sqrt(b.sv), 5) AS smooth_std FROM filtered f JOIN back b ON b.player_id = f.player_id AND b.n = f.n"""
#: The filter alone.
FILTER_SQL = arena.duck_sql(_KALMAN[: _KALMAN.index(",\nback AS (")] + " SELECT player_id, event_id, n AS game_num, round(m, 5) AS kf_mean, round(sqrt(v), 5) AS kf_std FROM filtered", recursive=True)
_THIN = """WITH points AS MATERIALIZED (SELECT team_id, game_id, played_at, rating, row_number() OVER (PARTITION BY team_id ORDER BY played_at, game_id) AS n FROM ratings),
walk AS (
  SELECT team_id, n, game_id, played_at, rating, 1 AS kept, played_at AS last_at, rating AS last_rating FROM points WHERE n = 1
  UNION ALL
  SELECT p.team_id, p.n, p.game_id, p.played_at, p.rating, CASE WHEN p.played_at - w.last_at > 2700 AND p.rating <> w.last_rating THEN 1 ELSE 0 END,
         CASE WHEN p.played_at - w.last_at > 2700 AND p.rating <> w.last_rating THEN p.played_at ELSE w.last_at END, CASE WHEN p.played_at - w.last_at > 2700 AND p.rating <> w.last_rating THEN p.rating ELSE w.last_rating END
  FROM walk w JOIN points p ON p.team_id = w.team_id AND p.n = w.n + 1
)
SELECT team_id, game_id, played_at, rating FROM walk WHERE kept = 1"""
_NAMES = ["1.0", *FEATURES, "y24"]
_GRAM = f"""WITH {players.TRAINING}, rounded AS (SELECT game_id, team_id, day, {", ".join(f"round({f}, 5) AS {f}" for f in FEATURES)}, round(y24, 6) AS y24, round(weight, 6) AS weight FROM training),
numbered_rows AS (SELECT *, row_number() OVER (ORDER BY day, game_id, team_id) AS rn FROM rounded), whole AS (SELECT count(*) AS n, CAST(floor(count(*) / 6) AS BIGINT) AS test FROM rounded),
folded AS MATERIALIZED (SELECT r.*, CAST(CASE WHEN rn <= n - 5 * test THEN 0 ELSE 1 + floor((rn - 1 - (n - 5 * test)) / test) END AS BIGINT) AS fold FROM numbered_rows r CROSS JOIN whole)
""" + " UNION ALL ".join(
    f"SELECT fold, min(day) AS first_day, max(day) AS last_day, count(*) AS n, '{a.replace('1.0', '1')}' AS a, '{b.replace('1.0', '1')}' AS b, round(sum(weight * {a} * {b}), 3) AS value FROM folded GROUP BY fold"
    for i, a in enumerate(_NAMES) for b in _NAMES[i:])
_MILD = REFERENCE.replace("74 *", "40 *").replace("5.95", "3.0").replace("/ 1000)", "/ 400)").replace("1000.0", "1500.0")
_TWO = f"""WITH {vetoes.HALLS}, now AS (SELECT team_id, arena, rating FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena ORDER BY played_at DESC, game_id DESC) AS rn FROM elo_sides) WHERE rn = 1),
  s0 AS (SELECT 1 AS team_id, 2 AS opponent_id, h.arena, round(coalesce(1 / (1 + pow(10, (b.rating - a.rating) / 1000)), 0.5), 9) AS p FROM (SELECT DISTINCT arena FROM hall_games) h
    LEFT JOIN (SELECT n.* FROM now n JOIN teams t ON t.team_id = n.team_id WHERE t.slug = 'T7') a ON a.arena = h.arena LEFT JOIN (SELECT n.* FROM now n JOIN teams t ON t.team_id = n.team_id WHERE t.slug = 'T8') b ON b.arena = h.arena)"""
ORACLE = {
    "series_prediction": vetoes._reference(_selection_chain("bo3", _TWO).replace("SELECT team_id, opponent_id, string_agg", "SELECT 'T7' AS team, 'T8' AS opponent, string_agg")),
    "elo_configured": arena.duck_sql(_MILD + " SELECT game_id, round(winner_before, 4) AS winner_before, round(loser_before, 4) AS loser_before, round(gain, 4) AS gain FROM rated", recursive=True),
    "elo_functions": arena.duck_sql("""WITH p AS (SELECT game_id, max(CASE WHEN won = 1 THEN rating END) AS w, max(CASE WHEN won = 0 THEN rating END) AS l, max(margin) AS ahead FROM ratings GROUP BY game_id),
        q AS (SELECT *, 1 / (1 + pow(10, (l - w) / 1000.0)) AS a, 1 / (1 + pow(10, (w - l) / 1000.0)) AS b, 1 / (1 + pow(10, (l - w) / 400.0)) AS c FROM p),
        g AS (SELECT *, a * b + a * (1 - b) * c + (1 - a) * b * c AS three, a * b * c AS all3, a * b * (1 - c) + a * (1 - b) * c + (1 - a) * b * c AS two, a * (1 - b) * (1 - c) + (1 - a) * b * (1 - c) + (1 - a) * (1 - b) * c AS one FROM q)
        SELECT game_id, round(74 * ln(5.95 * sqrt(greatest(ahead, 0) + 1)) * (1 - a), 6) AS usual, round(40 * ln(3.0 * sqrt(greatest(ahead, 0) + 1)) * (1 - c), 6) AS mild, round(three, 6) AS three,
               round(all3 + two * (1 - 0.5 * (1 - a)) + one * 0.5 * a, 6) AS five FROM g"""),
    "vpm_folds": arena.duck_sql(_GRAM, args={"today": 11000}),
    "player_kalman": arena.duck_sql(_KALMAN, recursive=True),
    "thinned_series": arena.duck_sql(_THIN, recursive=True),
    "map_selection": _selection_sql("bo3"),
    "map_selection_bo5": _selection_sql("bo5"),
    "map_selection_advantage": _selection_sql("bo5_advantage"),
    "elo_ratings": arena.duck_sql(REFERENCE + """ SELECT game_id, arena, season, winner_id, loser_id, played_at, round(winner_before, 4) AS winner_before, round(loser_before, 4) AS loser_before, round(gain, 4) AS gain FROM rated""", recursive=True),
    "elo_current": arena.duck_sql(REFERENCE + """ SELECT team_id, arena, season, round(rating, 4) AS rating FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena, season ORDER BY played_at DESC, game_id DESC) AS rn FROM elo_sides) WHERE rn = 1""", recursive=True),
    "fold_gain": arena.duck_sql("""SELECT arena, season, game_id, round(74 * ln(5.95 * sqrt(winner_rounds - loser_rounds + 1)) * 0.5, 6) AS gain
        FROM (SELECT *, row_number() OVER (PARTITION BY arena, season ORDER BY played_at, game_id) AS rn FROM games) WHERE rn = 1"""),
}
