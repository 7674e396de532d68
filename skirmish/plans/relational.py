"""Scans, filters, joins, aggregates and set operations over the arena tables."""

from __future__ import annotations

PLANS: dict[str, str] = {
    "scan_teams": "SELECT team_id, team, slug, region, is_active FROM teams",
    "arena_names": "SELECT DISTINCT arena FROM games",
    "keyed_lookup": "SELECT team_id, team, region FROM teams WHERE slug = 'T7'",
    "filter_optional_predicates": "SELECT game_id, arena, winner_id FROM games WHERE season = 1997 AND arena = 'AF' AND played_at >= 852076800 AND played_at < 883612800",
    "date_between": "SELECT event_id, player_id, day FROM stats WHERE day BETWEEN 19725 AND 19730",
    "ilike_search": "SELECT player_id, player FROM (SELECT c_custkey AS player_id, c_name AS player FROM customer) WHERE player ILIKE '%#00000001%' ORDER BY player, player_id LIMIT 10",
    "ilike_exact": "SELECT c_custkey AS player_id, c_name AS player FROM customer WHERE c_name ILIKE 'customer#000000042' ORDER BY c_custkey LIMIT 1",
    "tuple_pairs_semi": """WITH pairs AS (SELECT DISTINCT winner_id AS team_id, arena FROM games WHERE loser_rounds = 0)
        SELECT r.game_id, r.team_id, r.arena, r.rating FROM ratings r LEFT SEMI JOIN pairs p ON r.team_id = p.team_id AND r.arena = p.arena""",
    "semi_event": "SELECT g.game_id, g.match_id FROM games g WHERE g.match_id IN (SELECT match_id FROM matches WHERE event_name = '1-URGENT' AND season = 1998)",
    "anti_unprocessed": "SELECT m.match_id, m.event_name FROM matches m WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.match_id = m.match_id AND g.arena = 'RF')",
    "join_winner_loser": """SELECT g.game_id, w.team AS winner, w.region AS winner_region, l.team AS loser, l.region AS loser_region
        FROM games g JOIN teams w ON g.winner_id = w.team_id JOIN teams l ON g.loser_id = l.team_id WHERE g.loser_rounds <= 1""",
    "perfect_games": """SELECT g.game_id, w.team AS winner, l.team AS loser, g.arena, g.played_at FROM games g
        JOIN teams w ON g.winner_id = w.team_id JOIN teams l ON g.loser_id = l.team_id WHERE g.winner_rounds = 13 AND g.loser_rounds = 0""",
    "season_range_join": """WITH seasons AS (SELECT * FROM (VALUES (1, 788918400, 820368000), (2, 820454400, 851904000), (3, 852076800, NULL)) AS t(season_id, begins, ends))
        SELECT s.season_id, g.arena, count(*) AS games, CAST(sum(g.loser_rounds) AS BIGINT) AS rounds FROM games g
        JOIN seasons s ON g.played_at >= s.begins AND (s.ends IS NULL OR g.played_at < s.ends) GROUP BY s.season_id, g.arena""",
    "asof_strict": """SELECT r.game_id, r.team_id, r.arena, coalesce(lag(r.rating) OVER (PARTITION BY r.team_id, r.arena, r.season ORDER BY r.played_at, r.game_id), 1000) AS rating_before FROM ratings r""",
    "asof_inclusive": """WITH arenas AS (SELECT DISTINCT arena FROM games),
        line AS (SELECT team_id, season, arena, played_at AS moment, 0 AS kind, game_id AS id, rating FROM ratings
          UNION ALL SELECT m.cust_id % 100, m.season, a.arena, m.completed_at, 1, m.match_id, NULL FROM matches m JOIN arenas a ON m.match_id IS NOT NULL),
        filled AS (SELECT id, arena, kind, LASTKNOWN(rating) OVER (PARTITION BY team_id, season, arena ORDER BY moment, kind, id ROWS UNBOUNDED PRECEDING) AS rating FROM line)
        SELECT id AS match_id, arena, rating FROM filled WHERE kind = 1 AND rating IS NOT NULL""",
    "case_key_opponent": """SELECT g.game_id, t.team AS opponent FROM games g
        JOIN teams t ON CASE WHEN g.winner_id = 3 THEN g.loser_id ELSE g.winner_id END = t.team_id WHERE g.winner_id = 3 OR g.loser_id = 3""",
    "self_join_opponent": """WITH pairs AS (SELECT game_id, max(CASE WHEN won = 1 THEN team_id END) AS w, max(CASE WHEN won = 0 THEN team_id END) AS l, max(CASE WHEN won = 1 THEN rating END) - max(CASE WHEN won = 0 THEN rating END) AS ahead FROM ratings GROUP BY game_id)
        SELECT game_id, w AS team_id, l AS opponent_id, ahead FROM pairs UNION ALL SELECT game_id, l, w, -ahead FROM pairs""",
    "perspective_union": "SELECT team_id, arena, count(*) AS games, CAST(sum(won) AS BIGINT) AS wins FROM sides GROUP BY team_id, arena",
    "team_map_record": """SELECT s.team_id, t.team, s.arena, CAST(sum(s.won) AS BIGINT) AS wins, CAST(sum(1 - s.won) AS BIGINT) AS losses, round(avg(s.won) * 100, 6) AS win_rate, max_by(s.rating, s.played_at * 1000000000 + s.game_id) AS rating
        FROM ratings s JOIN teams t ON s.team_id = t.team_id GROUP BY s.team_id, t.team, s.arena""",
    "veto_loss_leaderboard": """SELECT team_id, round(avg(worst), 6) AS average_loss, count(*) AS matches
        FROM (SELECT team_id, match_id, max(-margin) AS worst FROM sides GROUP BY team_id, match_id) GROUP BY team_id HAVING count(*) >= 2""",
    "rating_range": "SELECT team_id, arena, season, max(rating) AS best, min(rating) AS worst, max(rating) - min(rating) AS spread FROM ratings GROUP BY team_id, arena, season",
    "rating_peaks_joined_back": """WITH tops AS (SELECT team_id, arena, season, max(rating) AS rating FROM ratings GROUP BY team_id, arena, season)
        SELECT p.season, p.team_id, p.arena, p.rating, min(r.played_at) AS reached_at FROM tops p
        JOIN ratings r ON r.team_id = p.team_id AND r.arena = p.arena AND r.season = p.season AND r.rating = p.rating GROUP BY p.season, p.team_id, p.arena, p.rating""",
    "agent_mode": """SELECT player_id, role, uses FROM (SELECT player_id, role, count(*) AS uses, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, role) AS rn FROM stats GROUP BY player_id, role) WHERE rn = 1""",
    "lower_median": "SELECT arena, season, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY rating) AS BIGINT) AS median FROM ratings GROUP BY arena, season",
    "spread_of_play": "SELECT arena, round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS deviation FROM ratings GROUP BY arena",
    "share_of_total": "SELECT arena, count(*) AS games, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 6) AS share FROM games GROUP BY arena",
    "type_pivot": """SELECT cust_id, count(CASE WHEN event_name = '1-URGENT' THEN 1 END) AS champions, count(CASE WHEN event_name = '2-HIGH' THEN 1 END) AS masters, count(*) AS total FROM matches GROUP BY cust_id""",
    "radar_pivot": """SELECT arena, coalesce(max(CASE WHEN team_id = 1 THEN rating END), 0) AS team_1, coalesce(max(CASE WHEN team_id = 2 THEN rating END), 0) AS team_2 FROM ratings GROUP BY arena""",
    "first_pick_ban": """WITH firsts AS (SELECT match_id, side, action, arena, row_number() OVER (PARTITION BY match_id, side, action ORDER BY step) AS rn FROM veto_steps WHERE side IS NOT NULL)
        SELECT side, action, arena, count(*) AS times, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (PARTITION BY side, action), 6) AS share FROM firsts WHERE rn = 1 GROUP BY side, action, arena""",
    "distinct_events_ordered": """SELECT e.event_name, coalesce(o.place, 0) AS place FROM (SELECT DISTINCT event_name FROM matches) e
        LEFT JOIN (SELECT * FROM (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 2), ('5-LOW', 1)) AS t(name, place)) o ON e.event_name = o.name ORDER BY 2 DESC, 1""",
    "teams_by_region": "SELECT region, count(*) AS teams, min(team) AS first_team, CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS active FROM teams GROUP BY region",
    "regions_of_arena": "SELECT s.arena, t.region, count(*) AS teams FROM (SELECT DISTINCT arena, team_id FROM sides) s JOIN teams t ON s.team_id = t.team_id GROUP BY s.arena, t.region",
    "null_side_report": "SELECT v.match_id, v.step, v.action, m.event_name FROM veto_steps v JOIN matches m ON v.match_id = m.match_id WHERE v.side IS NULL AND v.action <> 'decider'",
    "tournament_winners": """SELECT m.event_name, m.season, max_by(g.winner_id, g.played_at * 1000000000 + g.game_id) AS winner_id, CASE WHEN m.event_name LIKE '1%' THEN 'Champions' WHEN m.event_name LIKE '2%' THEN 'Masters' ELSE 'Domestic' END AS kind
        FROM matches m JOIN games g ON g.match_id = m.match_id GROUP BY m.event_name, m.season""",
    "veto_repair": """WITH known AS (SELECT match_id, min(step) AS at, min_by(side, step) AS mover FROM veto_steps WHERE side IS NOT NULL GROUP BY match_id)
        SELECT v.match_id, v.step, CAST(CASE WHEN (v.step - k.at) % 2 = 0 THEN k.mover ELSE 1 - k.mover END AS BIGINT) AS side FROM veto_steps v JOIN known k ON v.match_id = k.match_id WHERE v.side IS NULL AND v.action <> 'decider'""",
    "registry_merge": """WITH old AS (SELECT match_id, event_name AS region, CAST(completed_at AS BIGINT) AS ends FROM matches WHERE match_id % 3 <> 0),
        feed AS (SELECT match_id, 'new' AS region, CAST(0 AS BIGINT) AS ends, 'completed' AS status FROM matches WHERE match_id % 2 = 0)
        SELECT coalesce(o.match_id, f.match_id) AS match_id, coalesce(o.region, f.region) AS region, coalesce(o.ends, f.ends) AS ends, coalesce(f.status, 'kept') AS status FROM old o FULL JOIN feed f ON o.match_id = f.match_id""",
    "upsert_latest": """WITH versions AS (SELECT team_id, arena, rating, played_at, game_id FROM ratings WHERE season <= 1998 UNION ALL SELECT team_id, arena, rating, played_at, game_id FROM ratings WHERE season >= 1998)
        SELECT team_id, arena, rating, played_at FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena ORDER BY played_at DESC, game_id DESC) AS rn FROM versions) WHERE rn = 1""",
    "event_links": "SELECT page_id, regexp_extract(html, 'href=\"(/[^\"]*)\"', 1) AS first_link, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages",
    "json_props": "SELECT role, count(kills) AS games, CAST(sum(kills) AS BIGINT) AS kills, round(avg(value), 6) AS value FROM stats GROUP BY role",
    "text_identifiers": "SELECT doc_id, upper(substr(text, 1, 1)) AS initial, md5(lower(trim(text))) AS folded, CAST(length(replace(text, ' ', '')) AS BIGINT) AS letters FROM documents",
}
