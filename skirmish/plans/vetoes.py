"""Vetoes over ratings as of the match, and their replay by win chance.

A veto is a match's steps in order; each bans or picks one of the match's arenas,
or leaves the decider. Arenas of a veto are those of ``hall_games``, which the
engine rates like any other. Both teams' ratings of all arenas of a match, as of
its time and within its season (1000 where there are none), come from one as-of
pass (``board``); ``edge`` is the first team's rating less the second's. A step
without a team is repaired from its match's first known mover; matches without
any are left out and listed by ``unresolved_vetoes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skirmish.functions.ratings import best_of_3
from skirmish.operators import folds
from skirmish.plans import ranked
from skirmish.sources import arena

HALLS = """hall_games AS (SELECT game_id, match_id, game_number, concat('H', CAST((match_id + game_number) % 9 AS VARCHAR(20))) AS arena, winner_id, loser_id, winner_rounds, loser_rounds, played_at, season FROM games)"""
STEPS = f"""{HALLS},
vetoes AS (
  SELECT match_id, game_number AS step, CASE WHEN game_number % 7 IN (1, 2, 5, 6) THEN 'ban' WHEN game_number % 7 IN (3, 4) THEN 'pick' ELSE 'decider' END AS action, arena AS map,
         CASE WHEN game_number % 7 = 0 OR winner_id % 5 = 0 THEN NULL ELSE 2 - game_number % 2 END AS side FROM hall_games
),
pairings AS (SELECT match_id, winner_id AS team_1, loser_id AS team_2 FROM hall_games WHERE game_number = 1),
known AS (SELECT match_id, min(step) AS at, min_by(side, step) AS mover FROM vetoes WHERE side IS NOT NULL GROUP BY match_id),
steps AS (
  SELECT v.match_id, v.step, v.action, v.map, p.team_1, p.team_2, m.season, m.completed_at, m.event_name,
         CASE WHEN v.action = 'decider' THEN NULL WHEN v.side IS NOT NULL THEN v.side WHEN (v.step - k.at) % 2 = 0 THEN k.mover ELSE 3 - k.mover END AS side
  FROM vetoes v JOIN known k ON k.match_id = v.match_id JOIN pairings p ON p.match_id = v.match_id JOIN matches m ON m.match_id = v.match_id
)"""
#: Every step with what it cost its team against the best arena left, ties to the earlier one.
SCORED = f"""{STEPS},
asked AS (
  SELECT match_id, step, action, map, side, team_1, team_2, event_name, who, CASE who WHEN 1 THEN team_1 ELSE team_2 END AS team_id, season, completed_at
  FROM steps CROSS JOIN (SELECT CAST(who AS BIGINT) AS who FROM (VALUES (1), (2)) AS t(who)) both_teams
),
line AS (
  SELECT team_id, arena, season, played_at AS moment, 0 AS kind, game_id AS id, rating, CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS BIGINT) AS step, CAST(NULL AS VARCHAR(20)) AS action,
         CAST(NULL AS BIGINT) AS side, CAST(NULL AS BIGINT) AS team_1, CAST(NULL AS BIGINT) AS team_2, CAST(NULL AS VARCHAR(20)) AS event_name FROM elo_sides
  UNION ALL SELECT team_id, map, season, completed_at, 1, match_id, CAST(NULL AS DOUBLE), who, match_id, step, action, side, team_1, team_2, event_name FROM asked
),
filled AS (SELECT *, LASTKNOWN(rating) OVER (PARTITION BY team_id, arena, season ORDER BY moment, kind, id, step ROWS UNBOUNDED PRECEDING) AS standing FROM line),
board AS (
  SELECT match_id, step, action, arena AS map, side, team_1, team_2, event_name, moment AS completed_at,
         round(max(CASE WHEN who = 1 THEN coalesce(standing, 1000) END) - max(CASE WHEN who = 2 THEN coalesce(standing, 1000) END), 4) AS edge
  FROM filled WHERE kind = 1 GROUP BY match_id, step, action, arena, side, team_1, team_2, event_name, moment
),
seen AS (
  SELECT *, array_join(collect_list(map) OVER w, ',') AS available,
         max_by(map, struct(edge, -step)) OVER w AS high_map, max(edge) OVER w AS high, max_by(map, struct(-edge, -step)) OVER w AS low_map, min(edge) OVER w AS low
  FROM board WINDOW w AS (PARTITION BY match_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
scored AS (
  SELECT match_id, step, action, map, side, event_name, completed_at, edge, available, CASE side WHEN 1 THEN team_1 ELSE team_2 END AS team_id, CASE side WHEN 1 THEN team_2 ELSE team_1 END AS opponent_id,
         CASE WHEN (action = 'pick') = (side = 1) THEN high_map ELSE low_map END AS optimal_choice, CASE WHEN side IS NULL THEN 0 WHEN (action = 'pick') = (side = 1) THEN high - edge ELSE edge - low END AS lost FROM seen
),
analysed AS (SELECT *, sum(lost) OVER (PARTITION BY match_id, side ORDER BY step ROWS UNBOUNDED PRECEDING) AS running FROM scored WHERE side IS NOT NULL)"""

ASKED: dict[str, tuple[str, dict]] = {
    "veto_optimality": (f"""WITH {SCORED} SELECT match_id, step, team_id, action, map, optimal_choice, round(lost, 4) AS elo_lost, round(running, 4) AS cumulative_elo_lost, available FROM analysed
        WHERE :event IS NULL OR event_name = :event""", {"event": None}),
    "veto_leaderboard": (f"""WITH {SCORED}, worst AS (SELECT team_id, match_id, max(running) AS worst FROM analysed WHERE :event IS NULL OR event_name = :event GROUP BY team_id, match_id)
        SELECT w.team_id, t.team, t.slug, round(avg(w.worst), 7) AS average_elo_lost, count(*) AS matches FROM worst w JOIN teams t ON t.team_id = w.team_id GROUP BY w.team_id, t.team, t.slug ORDER BY 4, 2""", {"event": None}),
    "veto_history": (f"""WITH {SCORED}, worst AS (SELECT a.match_id, a.opponent_id, a.event_name, a.completed_at, max(a.running) AS worst FROM analysed a JOIN teams t ON t.team_id = a.team_id
          WHERE t.slug = :team AND (:event IS NULL OR a.event_name = :event) GROUP BY a.match_id, a.opponent_id, a.event_name, a.completed_at)
        SELECT w.match_id, round(w.worst, 4) AS elo_lost, w.event_name, w.completed_at, o.team AS opponent FROM worst w LEFT JOIN teams o ON o.team_id = w.opponent_id ORDER BY w.completed_at DESC, w.match_id""", {"team": "T7", "event": None}),
    "veto_deciders": (f"""WITH {STEPS}, last_step AS (SELECT match_id, max(step) AS step FROM steps WHERE side IS NOT NULL GROUP BY match_id)
        SELECT s.match_id, s.step, s.map AS decider FROM steps s JOIN last_step l ON s.match_id = l.match_id AND s.step = l.step + 1""", {}),
    "first_vetoes": (f"""WITH {STEPS}, mine AS (SELECT s.*, CASE WHEN s.side = (CASE t.team_id WHEN s.team_1 THEN 1 ELSE 2 END) THEN 1 ELSE 0 END AS own FROM steps s JOIN teams t ON t.team_id = s.team_1 OR t.team_id = s.team_2 WHERE t.slug = :team AND (:event IS NULL OR s.event_name = :event)),
        firsts AS (SELECT own, action, map, row_number() OVER (PARTITION BY match_id, side, action ORDER BY step) AS rn FROM mine WHERE side IS NOT NULL)
        SELECT own, action, map, count(*) AS times FROM firsts WHERE rn = 1 GROUP BY own, action, map""", {"team": "T7", "event": None}),
    "unresolved_vetoes": (f"""WITH {STEPS} SELECT v.match_id, v.step, v.action, v.map FROM vetoes v LEFT JOIN known k ON k.match_id = v.match_id WHERE v.action <> 'decider' AND k.match_id IS NULL""", {}),
}


def elo_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every rated game of the veto arenas."""
    return folds.rated_sides(folds.rate_games(arena.run(spark, sf_dir, f"WITH {HALLS} SELECT * FROM hall_games")))


def _split(name: str, args: dict) -> tuple[str, dict]:
    sql, defaults = ASKED[name]
    if unknown := set(args) - set(defaults):
        raise TypeError(f"{name} has no argument {sorted(unknown)}")
    return sql, defaults | args


def _run(spark: SparkSession, sf_dir: str, sql: str, args: dict, elo: DataFrame | None) -> DataFrame:
    given = {"elo_sides": elo if elo is not None else elo_sides(spark, sf_dir)} if "elo_sides" in sql else {}
    return arena.run(spark, sf_dir, sql, args=args, **given)


def ask(spark: SparkSession, sf_dir: str, name: str, elo: DataFrame | None = None, **args) -> DataFrame:
    """The named question with these arguments; ``elo``: stored ``elo_sides``."""
    sql, filled = _split(name, args)
    return _run(spark, sf_dir, sql, filled, elo)


def _reference(sql: str, args: dict | None = None) -> str:
    body = sql.strip()[4:].lstrip()
    if "elo_sides" not in sql:
        return arena.duck_sql(f"WITH {body}", args=args)
    rated = ranked.REFERENCE.replace("FROM games WHERE", "FROM hall_games WHERE")[4:].lstrip()
    assert body.startswith(HALLS)
    return arena.duck_sql(f"WITH {HALLS},\n{rated}" + body[len(HALLS) :], recursive=True, args=args)


def reference(name: str, **args) -> str:
    return _reference(*_split(name, args))


#: What each step of a whole veto of a best of three does.
ORDER = ("ban", "ban", "pick", "pick", "ban", "ban")


def _completed(steps: Column, taken: Column) -> Column:
    """Chance of the first team if the first ``taken`` steps stand and each later one
    is the best for its team; even where three arenas don't come of it."""

    def act(state: Column, i: Column) -> Column:
        step, order = F.element_at(steps, i + 1), F.element_at(F.array(*map(F.lit, ORDER)), i + 1)
        stands = i < taken
        sign = F.when((order == "pick") == (step["side"] == 1), F.lit(1.0)).otherwise(F.lit(-1.0))
        best = -F.array_max(F.transform(state["left"], lambda x: F.struct((x["edge"] * sign).alias("e"), (-x["step"]).alias("s"))))["s"]
        chosen = F.when(stands, step["step"]).otherwise(best)
        picks = F.when(stands, step["action"]).otherwise(order) == "pick"
        edge = F.filter(state["left"], lambda x: x["step"] == chosen)[0]["edge"]
        after = F.struct(F.filter(state["left"], lambda x: x["step"] != chosen).alias("left"), F.when(picks, F.concat(state["picked"], F.array(edge))).otherwise(state["picked"]).alias("picked"))
        return F.when(stands | (F.size(state["left"]) > 1), after).otherwise(state)

    left = F.transform(steps, lambda x: F.struct(x["step"].alias("step"), x["edge"].alias("edge")))
    start = F.struct(left.alias("left"), F.array().cast("array<double>").alias("picked"))

    def chance(state: Column) -> Column:
        picked = F.when((F.size(state["picked"]) < 3) & (F.size(state["left"]) == 1), F.concat(state["picked"], F.transform(state["left"], lambda x: x["edge"]))).otherwise(state["picked"])
        p = F.transform(picked, lambda e: 1 / (1 + F.pow(F.lit(10.0), -e / 1000)))
        return F.when(F.size(p) == 3, best_of_3(F.get(p, 0), F.get(p, 1), F.get(p, 2))).otherwise(F.lit(0.5))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(ORDER) - 1)), start, act, chance)


def veto_replay(spark: SparkSession, sf_dir: str, elo: DataFrame | None = None, event: str | None = None) -> DataFrame:
    """Each veto of at least six steps as a series of points, from the start: the first
    team's chance to win a best of three if the rest went as well as it can, its
    change, and the ratings gained by then through the other team's losses and lost by
    its own. The decider adds no choice, so its chance is that before it."""
    sql = f"WITH {SCORED} SELECT match_id, step, action, map, side, edge, lost FROM scored WHERE :event IS NULL OR event_name = :event"
    rows = _run(spark, sf_dir, sql, {"event": event}, elo)
    veto = rows.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("step", "action", "map", "side", "edge", "lost"))).alias("steps")).where(F.size("steps") >= len(ORDER))
    points = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda k: _completed(F.col("steps"), F.least(k, F.lit(len(ORDER)))))
    veto = veto.select("match_id", "steps", points.alias("chances"))
    at = veto.select("match_id", "steps", "chances", F.posexplode("chances").alias("point", "chance"))
    swing = lambda s: F.when(s["side"].isNull(), 0.0).when(s["side"] == 1, -s["lost"]).otherwise(s["lost"])
    step, before = F.element_at("steps", F.greatest("point", F.lit(1))), F.element_at("chances", F.greatest("point", F.lit(1)))
    gained = F.aggregate(F.slice("steps", 1, F.col("point")), F.lit(0.0), lambda total, s: total + swing(s))
    first = F.col("point") == 0
    return at.select("match_id", F.col("point").cast("long").alias("point"), F.when(first, "start").otherwise(step["action"]).alias("action"), F.when(~first, step["map"]).alias("map"), F.round("chance", 5).alias("win_chance"),
                     (F.round(F.when(first, 0.0).otherwise(F.col("chance") - before), 5) + 0.0).alias("change"), F.round(F.when(first, 0.0).otherwise(swing(step)) + 0.0, 4).alias("swing"), F.round(gained + 0.0, 4).alias("advantage"))


def replay_reference(event: str | None = None) -> str:
    """The same in steps of SQL, each over what the one before left."""
    chain, picks, left = [], [], "r0"
    for i, order in enumerate(ORDER):
        sign = "-" if order == "pick" else ""
        greedy = f"CASE WHEN a.side = 1 THEN {sign}r.edge ELSE -({sign}r.edge) END"
        chain.append(f"""c{i} AS (SELECT match_id, k, step, edge, CASE WHEN {i} < k THEN action ELSE '{order}' END AS action FROM (
          SELECT r.match_id, r.k, r.step, r.edge, a.action, count(*) OVER (PARTITION BY r.match_id, r.k) AS n,
                 row_number() OVER (PARTITION BY r.match_id, r.k ORDER BY CASE WHEN {i} < r.k THEN CASE WHEN r.step = {i + 1} THEN 0 ELSE 1 END ELSE {greedy} END, r.step) AS rn
          FROM {left} r JOIN full_steps a ON a.match_id = r.match_id AND a.step = {i + 1}) WHERE rn = 1 AND ({i} < k OR n > 1))""")
        chain.append(f"r{i + 1} AS MATERIALIZED (SELECT r.* FROM {left} r ANTI JOIN c{i} c ON r.match_id = c.match_id AND r.k = c.k AND r.step = c.step)")
        picks.append(f"SELECT match_id, k, {i} AS act, edge FROM c{i} WHERE action = 'pick'")
        left = f"r{i + 1}"
    p = [f"max(CASE WHEN rn = {i} THEN 1 / (1 + pow(10, -edge / 1000)) END)" for i in (1, 2, 3)]
    filled = arena.literal(event)
    sql = f"""WITH {SCORED}, sized AS (SELECT match_id, count(*) AS n FROM scored WHERE {filled} IS NULL OR event_name = {filled} GROUP BY match_id HAVING count(*) >= {len(ORDER)}),
      full_steps AS MATERIALIZED (SELECT s.* FROM scored s JOIN sized z ON z.match_id = s.match_id),
      r0 AS MATERIALIZED (SELECT s.match_id, k.k, s.step, s.edge FROM full_steps s CROSS JOIN (SELECT unnest(generate_series(0, {len(ORDER)})) AS k) k),
      {", ".join(chain)}, chosen AS ({" UNION ALL ".join(picks)}),
      picked AS (SELECT match_id, k, count(*) AS n FROM chosen GROUP BY match_id, k), rest AS (SELECT match_id, k, count(*) AS n, max(edge) AS edge FROM {left} GROUP BY match_id, k),
      maps AS (SELECT * FROM chosen UNION ALL SELECT r.match_id, r.k, 9, r.edge FROM rest r LEFT JOIN picked p ON p.match_id = r.match_id AND p.k = r.k WHERE r.n = 1 AND coalesce(p.n, 0) < 3),
      placed AS (SELECT *, row_number() OVER (PARTITION BY match_id, k ORDER BY act) AS rn FROM maps),
      odds AS (SELECT match_id, k, CASE WHEN count(*) = 3 THEN {p[0]} * {p[1]} + {p[0]} * (1 - {p[1]}) * {p[2]} + (1 - {p[0]}) * {p[1]} * {p[2]} ELSE 0.5 END AS chance FROM placed GROUP BY match_id, k),
      points AS (SELECT match_id, 0 AS point, 'start' AS action, CAST(NULL AS VARCHAR) AS map, CAST(0 AS DOUBLE) AS swing FROM sized UNION ALL SELECT match_id, step, action, map, CASE WHEN side IS NULL THEN 0 WHEN side = 1 THEN -lost ELSE lost END FROM full_steps),
      joined AS (SELECT p.*, coalesce(o.chance, 0.5) AS chance FROM points p LEFT JOIN odds o ON o.match_id = p.match_id AND o.k = least(p.point, {len(ORDER)}))
      SELECT match_id, CAST(point AS BIGINT) AS point, action, map, round(chance, 5) AS win_chance, round(coalesce(chance - lag(chance) OVER (PARTITION BY match_id ORDER BY point), 0), 5) + 0.0 AS change,
             round(swing + 0.0, 4) AS swing, round(sum(swing) OVER (PARTITION BY match_id ORDER BY point ROWS UNBOUNDED PRECEDING) + 0.0, 4) AS advantage FROM joined"""
    return _reference(sql)
