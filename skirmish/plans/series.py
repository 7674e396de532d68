"""Window functions, streaks, calendars, ratings series and their rankings."""

from __future__ import annotations


def _streaks(kind: int) -> str:
    return f"""WITH marked AS (
          SELECT team_id, arena, season, won, margin, played_at, game_id,
                 CASE WHEN won = lag(won) OVER (PARTITION BY team_id, arena ORDER BY played_at, game_id) THEN 0 ELSE 1 END AS turn,
                 max(played_at) OVER (PARTITION BY team_id, arena) AS latest FROM sides),
        islands AS (SELECT *, sum(turn) OVER (PARTITION BY team_id, arena ORDER BY played_at, game_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
        runs AS (SELECT team_id, arena, count(*) AS streak, round(avg(margin), 2) AS average_margin, min(played_at) AS began, max(played_at) AS ended, max(played_at) = max(latest) AS is_active
          FROM islands WHERE won = {kind} GROUP BY team_id, arena, island HAVING count(*) >= 2)
        SELECT t.team, r.arena, r.streak, r.average_margin, r.began, r.ended, r.is_active FROM runs r JOIN teams t ON r.team_id = t.team_id
        ORDER BY r.streak DESC, r.average_margin DESC, t.team, r.arena, r.began LIMIT 10"""


def _extreme(order: str) -> str:
    return f"""SELECT team_id, season, arena, rating FROM (SELECT *, row_number() OVER (PARTITION BY team_id, season ORDER BY rating {order}, played_at, game_id) AS rn FROM ratings) WHERE rn = 1 ORDER BY rating {order}, team_id, season LIMIT 25"""


PLANS: dict[str, str] = {
    "win_streaks": _streaks(1),
    "lose_streaks": _streaks(0),
    "team_streaks": """WITH marked AS (SELECT team_id, arena, won, played_at, game_id, CASE WHEN won = lag(won) OVER (PARTITION BY team_id, arena ORDER BY played_at, game_id) THEN 0 ELSE 1 END AS turn FROM sides),
        islands AS (SELECT *, sum(turn) OVER (PARTITION BY team_id, arena ORDER BY played_at, game_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
        runs AS (SELECT team_id, arena, island, max(won) AS won, count(*) AS streak, max(played_at) AS ended FROM islands GROUP BY team_id, arena, island)
        SELECT team_id, arena, coalesce(max(CASE WHEN won = 1 THEN streak END), 0) AS longest_win, coalesce(max(CASE WHEN won = 0 THEN streak END), 0) AS longest_loss, max_by(streak, island) AS current_streak, max_by(won, island) AS current_won FROM runs GROUP BY team_id, arena""",
    "greatest_teams": _extreme("DESC"),
    "worst_teams": _extreme("ASC"),
    "latest_per_group": "SELECT team_id, arena, season, rating FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena, season ORDER BY played_at DESC, game_id DESC) AS rn FROM ratings) WHERE rn = 1",
    "rating_history": "SELECT r.game_id, t.team, o.team AS opponent, r.arena, r.won, r.rating, r.played_at FROM ratings r JOIN teams t ON r.team_id = t.team_id JOIN teams o ON r.opponent_id = o.team_id",
    "biggest_upsets": """WITH pairs AS (SELECT game_id, max(CASE WHEN won = 1 THEN team_id END) AS winner_id, max(CASE WHEN won = 0 THEN team_id END) AS loser_id, max(CASE WHEN won = 0 THEN rating END) - max(CASE WHEN won = 1 THEN rating END) AS gap FROM ratings GROUP BY game_id)
        SELECT game_id, winner_id, loser_id, gap FROM pairs WHERE gap > 0 ORDER BY gap DESC, game_id LIMIT 10""",
    "biggest_spreads": "SELECT team_id, arena, season, max(rating) - min(rating) AS spread FROM ratings GROUP BY team_id, arena, season ORDER BY spread DESC, team_id, arena, season LIMIT 10",
    "peak_players": """SELECT player_id, game_num, form FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY form DESC, game_num) AS rn FROM (
          SELECT player_id, CAST(row_number() OVER (PARTITION BY player_id ORDER BY moment, event_id) AS BIGINT) AS game_num, round(avg(value) OVER (PARTITION BY player_id ORDER BY moment, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS form FROM stats) WHERE game_num >= 10) WHERE rn = 1""",
    "day_gaps": "SELECT event_id, greatest(1, day - lag(day) OVER (PARTITION BY player_id ORDER BY moment, event_id)) AS gap FROM stats",
    "cumulative_edge": "SELECT match_id, step, side, CAST(sum(edge) OVER (PARTITION BY match_id, side ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM veto_steps WHERE side IS NOT NULL",
    "rating_change": "SELECT game_id, team_id, rating - lag(rating, 1, 1000) OVER (PARTITION BY team_id, arena, season ORDER BY played_at, game_id) AS change FROM ratings",
    "rank_players": """WITH totals AS (SELECT player_id, round(sum(value), 4) AS total FROM stats GROUP BY player_id),
        steps AS (SELECT *, coalesce(CAST(floor(total) AS BIGINT), -1) AS step FROM totals),
        ahead AS (SELECT step, coalesce(sum(count(*)) OVER (ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM steps GROUP BY step)
        SELECT s.player_id, s.total, CAST(a.ahead + row_number() OVER (PARTITION BY s.step ORDER BY s.total DESC, s.player_id) AS BIGINT) AS place FROM steps s JOIN ahead a ON s.step = a.step""",
    "cv_folds": """WITH per_day AS (SELECT day, count(*) AS games FROM stats GROUP BY day),
        before_day AS (SELECT day, coalesce(sum(games) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM per_day),
        whole AS (SELECT sum(games) AS n, CAST(floor(sum(games) / 6) AS BIGINT) AS test FROM per_day),
        placed AS (SELECT s.event_id, b.earlier + row_number() OVER (PARTITION BY s.day ORDER BY s.moment, s.event_id) AS rn FROM stats s JOIN before_day b ON s.day = b.day)
        SELECT event_id, CAST(CASE WHEN rn <= n - 5 * test THEN 0 ELSE 1 + floor((rn - 1 - (n - 5 * test)) / test) END AS BIGINT) AS fold FROM placed CROSS JOIN whole""",
    "season_axis": """WITH spans AS (SELECT season, min(day) AS begins, max(day) AS ends FROM games GROUP BY season)
        SELECT season, begins, ends, CAST(coalesce(sum(ends - begins + 1) OVER (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM spans""",
    "map_popularity": """WITH daily AS (SELECT day, arena, count(*) AS games FROM games GROUP BY day, arena),
        days AS (SELECT DISTINCT day FROM daily), arenas AS (SELECT DISTINCT arena FROM daily),
        grid AS (SELECT d.day, a.arena, coalesce(g.games, 0) AS games FROM days d CROSS JOIN arenas a LEFT JOIN daily g ON g.day = d.day AND g.arena = a.arena),
        totals AS (SELECT day, sum(games) OVER (ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS total FROM (SELECT day, sum(games) AS games FROM daily GROUP BY day)),
        rolling AS (SELECT day, arena, sum(games) OVER (PARTITION BY arena ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS games FROM grid)
        SELECT r.day, r.arena, CAST(r.games AS BIGINT) AS games, round(CAST(r.games AS DOUBLE) * 100 / nullif(t.total, 0), 6) AS share FROM rolling r JOIN totals t ON r.day = t.day""",
    "step_series": """WITH points AS (SELECT team_id, game_id, played_at * 1000 AS moment, rating, lag(rating) OVER (PARTITION BY team_id ORDER BY played_at, game_id) AS before, lag(played_at) OVER (PARTITION BY team_id ORDER BY played_at, game_id) AS earlier FROM ratings)
        SELECT team_id, moment, rating FROM points UNION ALL SELECT team_id, moment - 1 AS moment, before AS rating FROM points WHERE before IS NOT NULL AND earlier * 1000 <> moment""",
    "win_probability": """SELECT game_id, round(1 / (1 + power(10, (lr - wr) / 1000.0)), 6) AS expected, round(74 * ln(5.95 * sqrt(greatest(margin, 0) + 1)) * (1 - 1 / (1 + power(10, (lr - wr) / 1000.0))), 6) AS delta
        FROM (SELECT game_id, max(CASE WHEN won = 1 THEN rating END) AS wr, max(CASE WHEN won = 0 THEN rating END) AS lr, max(margin) AS margin FROM ratings GROUP BY game_id)""",
    "series_probability": """WITH means AS (SELECT team_id, arena, avg(rating) AS rating FROM ratings GROUP BY team_id, arena),
        p AS (SELECT team_id, opponent_id, max(CASE WHEN arena = 'AF' THEN q END) AS a, max(CASE WHEN arena = 'NO' THEN q END) AS b, max(CASE WHEN arena = 'RF' THEN q END) AS c FROM (
          SELECT x.team_id, y.team_id AS opponent_id, x.arena, 1 / (1 + power(10, (y.rating - x.rating) / 1000.0)) AS q FROM means x JOIN means y ON x.arena = y.arena AND x.team_id <> y.team_id) odds GROUP BY team_id, opponent_id)
        SELECT team_id, opponent_id, round(a * b + a * (1 - b) * c + (1 - a) * b * c, 6) AS best_of_3, round(a * b * c, 6) AS clean_sweep FROM p""",
    "player_components": "SELECT event_id, player_id, round(kills / greatest(1, value), 6) AS per_round, round(kills / nullif(kills + value, 0), 6) AS duel_share FROM stats",
    "decayed_means": """WITH last_day AS (SELECT max(day) AS last FROM stats), d AS (SELECT event_id, player_id, moment, value, kills, day - last AS ago FROM stats CROSS JOIN last_day)
        SELECT event_id, player_id, round(sum(kills * value * power(0.985, -ago)) OVER w / sum(value * power(0.985, -ago)) OVER w, 6) AS pre FROM d WINDOW w AS (PARTITION BY player_id ORDER BY moment, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "training_rows": """WITH pairs AS (SELECT game_id, max(CASE WHEN won = 1 THEN team_id END) AS w, max(CASE WHEN won = 0 THEN team_id END) AS l, CAST(max(CASE WHEN won = 1 THEN rating END) - max(CASE WHEN won = 0 THEN rating END) AS DOUBLE) AS x, max(margin) AS margin, max(day) AS day FROM ratings GROUP BY game_id),
        both_teams AS (SELECT game_id, w AS team_id, x, margin, day FROM pairs UNION ALL SELECT game_id, l, -x, -margin, day FROM pairs)
        SELECT game_id, team_id, x + 0.0 AS x, CAST(margin AS DOUBLE) / 24 AS y_raw, round(power(0.998, 11000 - day) * 24, 9) AS weight FROM both_teams""",
    "gram_matrix": """SELECT round(sum(w * x * x), 2) AS xx, round(sum(w * x * y), 2) AS xy, round(sum(w * x), 3) AS sx, round(sum(w * y), 3) AS sy, round(sum(w), 3) AS sw FROM (
        SELECT CAST(kills AS DOUBLE) AS x, value AS y, power(0.998, 19800 - day) AS w FROM stats)""",
    "centred_by_date": "SELECT event_id, day, round(value - avg(value) OVER (PARTITION BY day), 6) AS centred FROM stats",
    "veto_scores": """SELECT v.match_id, v.step, v.side, v.action, CAST(CASE WHEN v.action = 'pick' THEN max(o.edge) - v.edge ELSE v.edge - min(o.edge) END AS BIGINT) AS lost FROM veto_steps v
        JOIN veto_steps o ON o.match_id = v.match_id AND (o.step >= v.step OR o.side IS NULL OR o.action = 'decider') WHERE v.side IS NOT NULL AND v.action <> 'decider' GROUP BY v.match_id, v.step, v.side, v.action, v.edge""",
    "pairwise_matrix": """WITH r AS (SELECT team_id, avg(rating) AS rating FROM ratings GROUP BY team_id)
        SELECT a.team_id, b.team_id AS opponent_id, round(1 / (1 + power(10, (b.rating - a.rating) / 1000.0)), 6) AS chance FROM r a JOIN r b ON a.team_id <> b.team_id""",
}

#: The same where Spark needs other words: a quotient by 0 fails in it, and is infinite or
#: undefined in SQL engines that follow IEEE.
PLANNED: dict[str, str] = {
    "decayed_means": PLANS["decayed_means"].replace(
        "round(sum(kills * value * power(0.985, -ago)) OVER w / sum(value * power(0.985, -ago)) OVER w, 6) AS pre FROM d",
        "round(CASE WHEN below = 0 THEN CASE WHEN above = 0 THEN double('NaN') ELSE above * double('Infinity') END ELSE above / below END, 6) AS pre FROM (SELECT *, sum(kills * value * power(0.985, -ago)) OVER w AS above, sum(value * power(0.985, -ago)) OVER w AS below FROM d").replace("1 PRECEDING)", "1 PRECEDING))"),
}

RECURSIVE: dict[str, str] = {
    "calendar": """WITH calendar AS (SELECT min(day) AS day, max(day) AS last FROM stats UNION ALL SELECT day + 1, last FROM calendar WHERE day < last)
        SELECT c.day, count(s.event_id) AS games FROM calendar c LEFT JOIN stats s ON s.day = c.day GROUP BY c.day""",
}
