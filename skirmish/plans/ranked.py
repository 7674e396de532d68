"""Questions over the engine's own ratings, with arguments.

Each is one statement over ``elo_sides`` (one row a side of a rated game:
``game_id, arena, season, played_at, team_id, opponent_id, won, before,
rating``), the arena tables and named parameters. A null parameter means "all".
``ask`` runs one; pass it a ``stored`` ``elo_sides`` to rate the games only once.
Without one, only the games of the season and arenas asked for are rated. Peaks are
joined back with their season, so an equal rating of another season gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skirmish.functions.ratings import DEFAULT, RatingModel
from skirmish.operators import folds
from skirmish.plans import by_team, players
from skirmish.sources import arena

#: The same ratings for the reference engine: the fold as a recursive statement.
REFERENCE = """WITH ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY arena, season ORDER BY played_at, game_id) AS n FROM games WHERE played_at IS NOT NULL),
fold AS (
  SELECT DISTINCT arena, season, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS game_id, CAST(NULL AS BIGINT) AS winner_id, CAST(NULL AS BIGINT) AS loser_id, CAST(NULL AS BIGINT) AS played_at,
         CAST(NULL AS DOUBLE) AS winner_before, CAST(NULL AS DOUBLE) AS loser_before, CAST(NULL AS DOUBLE) AS gain, CAST(MAP {} AS MAP(BIGINT, DOUBLE)) AS held FROM ordered
  UNION ALL
  SELECT arena, season, n, game_id, winner_id, loser_id, played_at, a, b, gain, map_concat(held, MAP {winner_id: a + gain, loser_id: b - gain}) FROM (
    SELECT *, 74 * ln(5.95 * sqrt(greatest(ahead, 0) + 1)) * (1 - 1 / (1 + pow(10, (b - a) / 1000))) AS gain FROM (
      SELECT o.arena, o.season, o.n, o.game_id, o.winner_id, o.loser_id, o.played_at, o.winner_rounds - o.loser_rounds AS ahead,
             coalesce(f.held[o.winner_id], 1000.0) AS a, coalesce(f.held[o.loser_id], 1000.0) AS b, f.held
      FROM fold f JOIN ordered o ON o.arena = f.arena AND o.season = f.season AND o.n = f.n + 1))
),
rated AS MATERIALIZED (SELECT arena, season, game_id, winner_id, loser_id, played_at, winner_before, loser_before, gain FROM fold WHERE n > 0),
elo_sides AS MATERIALIZED (
  SELECT game_id, arena, season, played_at, winner_id AS team_id, loser_id AS opponent_id, CAST(1 AS BIGINT) AS won, winner_before AS before, winner_before + gain AS rating FROM rated
  UNION ALL SELECT game_id, arena, season, played_at, loser_id, winner_id, CAST(0 AS BIGINT), loser_before, loser_before - gain FROM rated
)"""

_LATEST = "latest AS (SELECT team_id, arena, season, rating, played_at FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena, season ORDER BY played_at DESC, game_id DESC) AS rn FROM elo_sides) WHERE rn = 1)"
_PEAKS = """WITH tops AS (SELECT team_id, arena, season, {f}(rating) AS rating FROM elo_sides WHERE :season IS NULL OR season = :season GROUP BY team_id, arena, season),
    back AS (SELECT p.season, p.team_id, p.arena, p.rating, min(e.played_at) AS reached_at FROM tops p JOIN elo_sides e ON e.team_id = p.team_id AND e.arena = p.arena AND e.season = p.season AND e.rating = p.rating GROUP BY p.season, p.team_id, p.arena, p.rating)
    SELECT t.team, b.arena, b.season, round(b.rating, 4) AS rating, b.reached_at FROM back b JOIN teams t ON b.team_id = t.team_id ORDER BY round(b.rating, 4) {o}, t.team, b.arena, b.season LIMIT {n}"""
_BY_YEAR = """WITH tops AS (SELECT team_id, arena, season, rating, played_at, row_number() OVER (PARTITION BY team_id, arena, season ORDER BY round(rating, 4) {o}, played_at, game_id) AS nth FROM elo_sides)
    SELECT t.team, x.arena, x.season, round(x.rating, 4) AS rating, x.played_at AS reached_at FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(rating, 4) {o}, team_id, arena) AS rn FROM tops WHERE nth = 1) x JOIN teams t ON x.team_id = t.team_id WHERE x.rn <= :per_year"""
_TEAMS = """SELECT t.team, x.season, x.arena, round(x.rating, 4) AS rating, x.played_at FROM (
      SELECT *, row_number() OVER (PARTITION BY team_id, season ORDER BY round(rating, 4) {o}, played_at, game_id) AS rn FROM elo_sides WHERE :season IS NULL OR season = :season) x
    JOIN teams t ON x.team_id = t.team_id WHERE x.rn = 1"""

#: name -> (statement, default arguments). ``{limit}`` is filled in as a number.
ASKED: dict[str, tuple[str, dict]] = {
    "rankings": (f"""WITH {_LATEST} SELECT t.team, t.slug, l.arena, l.season, round(l.rating, 4) AS rating FROM latest l JOIN teams t ON l.team_id = t.team_id
        WHERE (:arena IS NULL OR l.arena = :arena) AND (:season IS NULL OR l.season = :season)""", {"arena": None, "season": None}),
    "rankings_of_arenas": (f"""WITH {_LATEST} SELECT t.team, l.arena, l.season, round(l.rating, 4) AS rating FROM latest l JOIN teams t ON l.team_id = t.team_id
        WHERE array_contains(:arenas, l.arena) AND l.season = :season""", {"arenas": ["AF", "RF"], "season": 1997}),
    "elo_history": ("""SELECT e.game_id, t.team, o.team AS opponent, e.arena, e.won, round(e.before, 4) AS rating_before, round(e.rating, 4) AS rating, concat(CAST(CASE WHEN e.won = 1 THEN g.winner_rounds ELSE g.loser_rounds END AS VARCHAR(20)), '-', CAST(CASE WHEN e.won = 1 THEN g.loser_rounds ELSE g.winner_rounds END AS VARCHAR(20))) AS score
        FROM elo_sides e JOIN games g ON g.game_id = e.game_id JOIN teams t ON e.team_id = t.team_id JOIN teams o ON e.opponent_id = o.team_id
        WHERE (:season IS NULL OR e.season = :season) AND (:team IS NULL OR t.slug = :team) AND (:since IS NULL OR e.played_at >= :since) AND (:until IS NULL OR e.played_at < :until)""",
        {"season": None, "team": None, "since": None, "until": None}),
    "elo_history_of_pairs": ("""SELECT e.game_id, e.team_id, e.arena, e.season, round(e.rating, 4) AS rating FROM elo_sides e
        WHERE array_contains(:pairs, concat(CAST(e.team_id AS VARCHAR(20)), '/', e.arena)) AND (:season IS NULL OR e.season = :season)""", {"pairs": ["1/AF", "2/RF", "3/NO"], "season": None}),
    "seasons": ("""SELECT season, min(day) AS begins, max(day) AS ends, CASE WHEN season = max(season) OVER () THEN 1 ELSE 0 END AS is_active FROM games WHERE :season IS NULL OR season = :season GROUP BY season""", {"season": None}),
    "team_map_ratings": (f"""WITH {_LATEST} SELECT l.arena, l.season, round(l.rating, 4) AS rating FROM latest l JOIN teams t ON l.team_id = t.team_id WHERE t.slug = :team AND (:season IS NULL OR l.season = :season)""", {"team": "T7", "season": None}),
    "top_teams_of_arena": (f"""WITH {_LATEST} SELECT t.team, l.season, round(l.rating, 4) AS rating FROM latest l JOIN teams t ON l.team_id = t.team_id WHERE l.arena = :arena AND (:season IS NULL OR l.season = :season) ORDER BY 3 DESC, 1, 2 LIMIT {{limit}}""", {"arena": "AF", "season": None, "limit": 10}),
    "elo_at": ("""SELECT team_id, arena, round(max_by(rating, played_at * 1000000000 + game_id), 4) AS rating FROM elo_sides WHERE team_id = :team_id AND played_at <= :at AND season = :season GROUP BY team_id, arena""", {"team_id": 7, "at": 870000000, "season": 1997}),
    "elo_snapshot": ("""WITH arenas AS (SELECT DISTINCT arena FROM games), chosen AS (SELECT team_id, team FROM teams WHERE array_contains(:slugs, slug)),
        grid AS (SELECT c.team_id, c.team, a.arena FROM chosen c JOIN arenas a ON c.team_id IS NOT NULL),
        before_it AS (SELECT team_id, arena, max_by(rating, played_at * 1000000000 + game_id) AS rating FROM elo_sides WHERE played_at < :at AND season = :season GROUP BY team_id, arena)
        SELECT g.team, g.arena, round(coalesce(b.rating, 1000.0), 4) AS rating FROM grid g LEFT JOIN before_it b ON b.team_id = g.team_id AND b.arena = g.arena""", {"slugs": ["T1", "T2", "T3", "T4"], "at": 870000000, "season": 1997}),
    "top_map_ratings": (_PEAKS.format(f="max", o="DESC", n="{limit}"), {"season": None, "limit": 10}),
    "worst_map_ratings": (_PEAKS.format(f="min", o="ASC", n="{limit}"), {"season": None, "limit": 10}),
    "top_maps_by_year": (_BY_YEAR.format(o="DESC"), {"per_year": 10}),
    "worst_maps_by_year": (_BY_YEAR.format(o="ASC"), {"per_year": 10}),
    "elo_variances": ("""SELECT t.team, x.arena, x.season, round(x.best, 4) AS best, round(x.worst, 4) AS worst, round(x.best - x.worst, 4) AS spread FROM (
          SELECT team_id, arena, season, max(rating) AS best, min(rating) AS worst FROM elo_sides WHERE :season IS NULL OR season = :season GROUP BY team_id, arena, season) x
        JOIN teams t ON x.team_id = t.team_id ORDER BY 6 DESC, 1, 2, 3 LIMIT {limit}""", {"season": None, "limit": 10}),
    "elo_upsets": ("""SELECT w.game_id, t.team AS winner, o.team AS loser, w.arena, round(l.rating - w.rating, 4) AS gap, CAST(floor(l.rating + 0.5) - floor(w.rating + 0.5) AS BIGINT) AS shown_gap
        FROM elo_sides w JOIN elo_sides l ON w.game_id = l.game_id AND w.won = 1 AND l.won = 0 JOIN teams t ON w.team_id = t.team_id JOIN teams o ON l.team_id = o.team_id
        WHERE l.rating > w.rating AND (:season IS NULL OR w.season = :season) ORDER BY 5 DESC, 1 LIMIT {limit}""", {"season": None, "limit": 25}),
    "greatest_teams_of": (_TEAMS.format(o="DESC"), {"season": None}),
    "worst_teams_of": (_TEAMS.format(o="ASC"), {"season": None}),
    "team_best_and_worst": ("""SELECT e.arena, round(max(e.rating), 4) AS best, round(min(e.rating), 4) AS worst, min(e.played_at) AS first_game FROM elo_sides e JOIN teams t ON e.team_id = t.team_id WHERE t.slug = :team GROUP BY e.arena""", {"team": "T7"}),
    "elo_deltas": ("""SELECT game_id, team_id, CAST(floor(rating + 0.5) AS BIGINT) AS shown, CAST(floor(rating + 0.5) - floor(coalesce(lag(rating) OVER (PARTITION BY team_id, arena, season ORDER BY played_at, game_id), rating) + 0.5) AS BIGINT) AS change FROM elo_sides WHERE :season IS NULL OR season = :season""", {"season": None}),
    "season_baselines": (f"""WITH {_LATEST}, arenas AS (SELECT DISTINCT arena FROM games), years AS (SELECT season FROM (SELECT DISTINCT season FROM games) WHERE :season IS NULL OR season = :season),
        grid AS (SELECT t.team_id, a.arena, y.season FROM teams t JOIN arenas a ON t.is_active JOIN years y ON t.is_active)
        SELECT g.team_id, g.arena, g.season, round(coalesce(l.rating, 1000.0), 4) AS rating, CASE WHEN l.rating IS NULL THEN 1 ELSE 0 END AS untouched
        FROM grid g LEFT JOIN latest l ON l.team_id = g.team_id AND l.arena = g.arena AND l.season = g.season""", {"season": None}),
    "veto_elo": ("""SELECT v.match_id, v.step, v.action, v.arena, round(w.before - l.before, 4) AS edge_before FROM veto_steps v
        JOIN elo_sides w ON w.game_id = v.match_id * 100 + v.step AND w.won = 1 JOIN elo_sides l ON l.game_id = w.game_id AND l.won = 0 WHERE :action IS NULL OR v.action = :action""", {"action": None}),
    "team_radar": ("""WITH best AS (SELECT e.arena, t.slug, max(e.rating) AS rating FROM elo_sides e JOIN teams t ON e.team_id = t.team_id WHERE array_contains(:slugs, t.slug) AND (:season IS NULL OR e.season = :season) GROUP BY e.arena, t.slug),
        arenas AS (SELECT DISTINCT arena FROM games), chosen AS (SELECT slug FROM teams WHERE array_contains(:slugs, slug))
        SELECT a.arena, c.slug, round(coalesce(b.rating, 0), 4) AS rating FROM arenas a JOIN chosen c ON a.arena IS NOT NULL LEFT JOIN best b ON b.arena = a.arena AND b.slug = c.slug""", {"slugs": ["T1", "T2", "T3"], "season": None}),
    "forecast_scorecard": ("""WITH halves AS (SELECT season, floor((min(played_at) + max(played_at)) / 2) AS middle FROM games GROUP BY season),
        latest AS (SELECT team_id, season, rating FROM (SELECT e.*, row_number() OVER (PARTITION BY e.team_id, e.arena, e.season ORDER BY e.played_at DESC, e.game_id DESC) AS rn FROM elo_sides e JOIN halves h ON h.season = e.season AND e.played_at <= h.middle) x WHERE rn = 1),
        forecast AS (SELECT season, team_id, row_number() OVER (PARTITION BY season ORDER BY round(mean, 6) DESC, team_id) AS predicted FROM (SELECT season, team_id, avg(rating) AS mean FROM latest GROUP BY season, team_id) means),
        results AS (SELECT season, team_id, row_number() OVER (PARTITION BY season ORDER BY ahead DESC, team_id) AS actual FROM (
          SELECT s.season, s.team_id, sum(s.margin) AS ahead FROM sides s JOIN halves h ON h.season = s.season AND s.played_at > h.middle GROUP BY s.season, s.team_id) sums),
        compared AS (SELECT coalesce(r.season, f.season) AS season, coalesce(r.team_id, f.team_id) AS team_id, r.actual, f.predicted FROM results r FULL JOIN forecast f ON f.season = r.season AND f.team_id = r.team_id),
        totals AS (SELECT season, max(CASE WHEN actual = 1 THEN predicted END) AS winner_rank, max(CASE WHEN actual = 2 THEN predicted END) AS runner_up_rank, count(CASE WHEN actual <= :top AND predicted <= :top THEN 1 END) AS top_correct FROM compared GROUP BY season)
        SELECT c.season, t.team, c.actual, coalesce(c.predicted, :unranked) AS predicted, coalesce(c.predicted, :unranked) - c.actual AS displaced,
               CASE WHEN c.actual = c.predicted THEN 'as predicted' WHEN c.predicted < c.actual THEN 'underperformed' ELSE 'overperformed' END AS verdict, x.winner_rank, x.runner_up_rank, x.top_correct
        FROM compared c JOIN totals x ON x.season = c.season JOIN teams t ON t.team_id = c.team_id WHERE (c.actual <= :top OR c.predicted <= :top) AND (:season IS NULL OR c.season = :season)""", {"season": None, "top": 4, "unranked": 100}),
    "elo_matrix": ("""SELECT t.slug, e.arena, round(min(e.rating), 4) AS rating FROM (SELECT team_id, arena, season, rating FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena, season ORDER BY played_at DESC, game_id DESC) AS rn FROM elo_sides) WHERE rn = 1) e JOIN teams t ON e.team_id = t.team_id GROUP BY t.slug, e.arena""", {}),
}
ASKED |= players.ASKED


def elo_sides(spark: SparkSession, sf_dir: str, season: int | None = None, arenas: list[str] | None = None, model: RatingModel = DEFAULT) -> DataFrame:
    """Both sides of every rated game. A season and arenas are rated for themselves, so
    the games of others are left out before they are dealt and sorted."""
    games = arena.frame(spark, sf_dir, "games")
    if season is not None:
        games = games.where(F.col("season") == season)
    if arenas is not None:
        games = games.where(F.col("arena").isin(*arenas))
    return folds.rated_sides(folds.rate_games(games, model=model))


def stored(elo: DataFrame, path: str) -> DataFrame:
    """Write rated sides in folders by arena and season; a question reads only its own."""
    elo.repartition("arena", "season").write.partitionBy("arena", "season").parquet(path)
    return elo.sparkSession.read.schema(elo.schema).parquet(path).select(*elo.columns)


def _split(name: str, args: dict) -> tuple[str, dict]:
    sql, defaults = ASKED[name]
    if unknown := set(args) - set(defaults):
        raise TypeError(f"{name} has no argument {sorted(unknown)}")
    filled = defaults | args
    if "limit" in filled:
        sql = sql.replace("{limit}", str(int(filled.pop("limit"))))
    return sql, filled


def ask(spark: SparkSession, sf_dir: str, name: str, elo: DataFrame | None = None, **args) -> DataFrame:
    """The named question with these arguments."""
    sql, filled = _split(name, args)
    if name in by_team.PLANS:
        return by_team.PLANS[name](spark, sf_dir, elo, **filled)
    if "elo_sides" not in sql:
        return arena.run(spark, sf_dir, sql, args=filled)
    of = [filled["arena"]] if filled.get("arena") is not None else filled.get("arenas")
    elo = elo if elo is not None else elo_sides(spark, sf_dir, filled.get("season"), of)
    return arena.run(spark, sf_dir, sql, args=filled, elo_sides=elo)


def reference(name: str, **args) -> str:
    sql, filled = _split(name, args)
    return joined_reference(sql, filled) if "elo_sides" in sql else arena.duck_sql(sql, args=filled)


def joined_reference(sql: str, args: dict | None = None) -> str:
    """A statement over ``elo_sides`` for the reference engine."""
    body = sql.strip()
    joined = REFERENCE + (",\n" + body[4:].lstrip() if body[:4].upper() == "WITH" else "\n" + body)
    return arena.duck_sql(joined, recursive=True, args=args)
