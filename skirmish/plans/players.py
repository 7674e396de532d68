"""The player model in steps and team pages, with arguments.

``player_games`` (see ``sources.arena``) holds one row a player of a game. The
steps are seven per-round components, their decayed means before the game, team
differences as training rows, raw and centred ratings, and the observation
adjusted for opponent and result that the Kalman filter reads.
"""

from __future__ import annotations

# fixed values of the model: decay a day of each component, of a training row, and the adjustments
BETAS = {"kpr": 0.992, "dpr": 0.992, "apr": 0.992, "fk_att_rate": 0.99, "fk_win_rate": 0.985, "adr_pr": 0.993, "kast01": 0.991}
ROW_BETA, OPPONENT_BONUS, RESULT_BONUS = 0.998, 0.15, 0.2

COMPONENTS = """components AS (
  SELECT row_id, game_id, match_id, arena, season, day, player_id, team_id, opponent_id, won, rounds,
         CAST(kills AS DOUBLE) / rounds AS kpr, CAST(deaths AS DOUBLE) / rounds AS dpr, CAST(assists AS DOUBLE) / rounds AS apr, CAST(fk + fd AS DOUBLE) / rounds AS fk_att_rate,
         CAST(fk AS DOUBLE) / nullif(fk + fd, 0) AS fk_win_rate, CAST(adr AS DOUBLE) AS adr_pr, CAST(kast AS DOUBLE) / 100 AS kast01 FROM player_games
)"""


def _mean(name: str, beta: float) -> str:
    weight = f"CASE WHEN {name} IS NOT NULL THEN rounds * power({beta}, l.last - day) END"
    return f"sum({name} * ({weight})) OVER w / sum({weight}) OVER w AS pre_{name}"


#: The decay cancels in the ratio but for the difference of days, so a running sum does.
PRE = f"""{COMPONENTS},
last_day AS (SELECT max(day) AS last FROM games),
pre AS (
  SELECT row_id, game_id, arena, day, player_id, team_id, opponent_id, won, rounds, {", ".join(_mean(n, b) for n, b in BETAS.items())}
  FROM components CROSS JOIN last_day l WINDOW w AS (PARTITION BY player_id ORDER BY day, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_FEATURES = [f"pre_{n}" for n in BETAS]
TRAINING = f"""{PRE},
difference AS (
  SELECT game_id, max(day) AS day, max(rounds) AS rounds, {", ".join(f"sum(CASE WHEN won = 1 THEN coalesce({f}, 0) ELSE -coalesce({f}, 0) END) AS {f}" for f in _FEATURES)}
  FROM pre GROUP BY game_id HAVING count(DISTINCT team_id) = 2
),
training AS (
  SELECT d.game_id, s.team_id, d.day, {", ".join(f"CASE WHEN s.won = 1 THEN d.{f} ELSE -d.{f} END AS {f}" for f in _FEATURES)},
         CAST(s.margin AS DOUBLE) / d.rounds * 24 AS y24, power({ROW_BETA}, greatest(0, :today - d.day)) * d.rounds AS weight
  FROM difference d JOIN sides s ON s.game_id = d.game_id
)"""
_RAW = " + ".join(f"coalesce({f}, 0) * :w_{n}" for f, n in zip(_FEATURES, BETAS, strict=True))
DPM = f"""{PRE},
raw AS (SELECT row_id, game_id, arena, day, player_id, team_id, opponent_id, won, rounds, {_RAW} AS raw FROM pre),
league AS (MEDIAN_RATING),
dpm AS (
  SELECT r.row_id, r.game_id, r.day, r.player_id, r.team_id, r.rounds, r.raw, r.raw - avg(r.raw) OVER (PARTITION BY r.day) AS centred,
         r.raw - avg(r.raw) OVER (PARTITION BY r.day) + {OPPONENT_BONUS} * (coalesce(e.rating, l.median) - l.median) / 100 + CASE WHEN r.won = 1 THEN {RESULT_BONUS} ELSE -{RESULT_BONUS} END AS dpm
  FROM raw r LEFT JOIN elo_sides e ON e.game_id = r.game_id AND e.team_id = r.opponent_id CROSS JOIN league l
)"""
#: The lower median of all ratings: counted by thousandths first (as many as the range
#: of ratings has, whatever their number), so that only those of one are sorted.
MEDIAN = """
  WITH counted AS (SELECT floor(rating * 1000) AS bin, count(*) AS n FROM elo_sides GROUP BY floor(rating * 1000)),
  passed AS (SELECT bin, n, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM counted),
  holding AS (SELECT bin, floor((total + 1) / 2) - (upto - n) AS nth FROM passed WHERE upto >= floor((total + 1) / 2) AND upto - n < floor((total + 1) / 2)),
  placed AS (SELECT e.rating, h.nth, row_number() OVER (ORDER BY e.rating) AS rn FROM elo_sides e JOIN holding h ON floor(e.rating * 1000) = h.bin)
  SELECT rating AS median FROM placed WHERE rn = nth"""
DPM = DPM.replace("MEDIAN_RATING", MEDIAN)
WEIGHTS = {"w_kpr": 2.5, "w_dpr": -2.0, "w_apr": 0.8, "w_fk_att_rate": 0.3, "w_fk_win_rate": 0.4, "w_adr_pr": 0.01, "w_kast01": 1.2}

#: Arenas of the derived games.
ARENAS = ("AF", "AO", "NF", "NO", "RF", "RO")
#: The team that won more games of an event's last match.
_WINNERS = """ended AS (SELECT event_name, season, max_by(match_id, completed_at * 1000000000 + match_id) AS match_id FROM matches WHERE :season IS NULL OR season = :season GROUP BY event_name, season),
        score AS (SELECT s.match_id, s.team_id, CAST(sum(s.won) AS BIGINT) AS won FROM sides s JOIN ended e ON e.match_id = s.match_id GROUP BY s.match_id, s.team_id),
        top AS (SELECT match_id, team_id, won, row_number() OVER (PARTITION BY match_id ORDER BY won DESC, team_id DESC) AS rn FROM score),
        winners AS (SELECT e.event_name, e.season, e.match_id, t.team_id AS winner_id, t.won, CASE WHEN lower(e.event_name) LIKE '%urgent%' THEN 'Champions' WHEN e.event_name LIKE '2%' THEN 'Masters' ELSE 'Domestic' END AS kind
          FROM ended e JOIN top t ON t.match_id = e.match_id AND t.rn = 1)"""

ASKED: dict[str, tuple[str, dict]] = {
    "vpm_components": (f"WITH {COMPONENTS} SELECT row_id, player_id, {', '.join(f'round({n}, 6) AS {n}' for n in BETAS)} FROM components WHERE :season IS NULL OR season = :season", {"season": None}),
    "vpm_pre_means": (f"WITH {PRE} SELECT row_id, player_id, {', '.join(f'round({f}, 6) AS {f}' for f in _FEATURES)} FROM pre", {}),
    "vpm_training_rows": (f"WITH {TRAINING} SELECT game_id, team_id, day, {', '.join(f'round({f}, 5) + 0.0 AS {f}' for f in _FEATURES)}, round(y24, 6) AS y24, round(weight, 6) AS weight FROM training", {"today": 11000}),
    "vpm_observations": (f"WITH {DPM} SELECT row_id, player_id, round(raw, 5) + 0.0 AS raw, round(centred, 5) + 0.0 AS centred, round(dpm, 5) + 0.0 AS dpm FROM dpm", WEIGHTS),
    "team_roster": ("""WITH mine AS (SELECT g.player_id, g.role, g.played_at, g.game_id FROM player_games g JOIN teams t ON g.team_id = t.team_id WHERE t.slug = :team),
        recent AS (SELECT player_id, count(*) AS games, max(played_at) AS last_at FROM mine GROUP BY player_id ORDER BY 3 DESC, 1 LIMIT {limit}),
        uses AS (SELECT player_id, role, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, role) AS rn FROM mine GROUP BY player_id, role)
        SELECT r.player_id, r.games, r.last_at, u.role AS top_role FROM recent r JOIN uses u ON u.player_id = r.player_id AND u.rn = 1""", {"team": "T7", "limit": 5}),
    "team_compositions": ("""WITH mine AS (SELECT g.* FROM player_games g JOIN teams t ON g.team_id = t.team_id WHERE t.slug = :team),
        latest AS (SELECT arena, max_by(game_id, played_at * 1000000000 + game_id) AS game_id FROM mine GROUP BY arena)
        SELECT m.arena, m.game_id, m.player_id, m.role FROM mine m JOIN latest l ON m.game_id = l.game_id""", {"team": "T7"}),
    "team_recent_results": ("""SELECT s.game_id, s.arena, t.team, o.team AS opponent, s.won, s.margin, s.played_at FROM sides s JOIN teams t ON s.team_id = t.team_id JOIN teams o ON s.opponent_id = o.team_id
        WHERE t.slug = :team AND (:arena IS NULL OR s.arena = :arena) ORDER BY s.played_at DESC, s.game_id DESC LIMIT {limit}""", {"team": "T7", "arena": None, "limit": 10}),
    "team_first_round_records": ("""SELECT s.arena, count(*) AS games, CAST(sum(s.won) AS BIGINT) AS wins, round(CAST(sum(s.won) AS DOUBLE) / nullif(count(*), 0), 6) AS win_rate FROM sides s JOIN teams t ON s.team_id = t.team_id
        WHERE t.slug = :team AND (:season IS NULL OR s.season = :season) GROUP BY s.arena""", {"team": "T7", "season": None}),
    "event_names": ("SELECT DISTINCT m.event_name FROM matches m JOIN sides s ON s.match_id = m.match_id WHERE :team_id IS NULL OR s.team_id = :team_id", {"team_id": 7}),
    "popularity_calendar": ("""WITH span AS (SELECT CAST(:since AS BIGINT) AS a, CAST(:until AS BIGINT) AS b), days AS (SELECT DAYS(a, b) AS day FROM span), arenas AS (SELECT DISTINCT arena FROM games),
        daily AS (SELECT day, arena, count(*) AS games FROM games WHERE day BETWEEN :since AND :until GROUP BY day, arena),
        grid AS (SELECT d.day, a.arena, coalesce(g.games, 0) AS games FROM days d JOIN arenas a ON d.day IS NOT NULL LEFT JOIN daily g ON g.day = d.day AND g.arena = a.arena),
        rolling AS (SELECT day, arena, sum(games) OVER (PARTITION BY arena ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS games FROM grid),
        totals AS (SELECT day, sum(games) AS total FROM rolling GROUP BY day)
        SELECT r.day, r.arena, CAST(r.games AS BIGINT) AS games, round(CAST(r.games AS DOUBLE) * 100 / nullif(t.total, 0), 2) AS share FROM rolling r JOIN totals t ON r.day = t.day""", {"since": 9862, "until": 10226}),
    "popularity_pivot": ("SELECT day, " + ", ".join(f"CAST(sum(CASE WHEN arena = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS of_{x.lower()}" for x in ARENAS) + ", count(*) AS total FROM games WHERE :season IS NULL OR season = :season GROUP BY day", {"season": None}),
    "event_winners": (f"""WITH {_WINNERS} SELECT event_name, season, match_id, winner_id, won, kind FROM winners""", {"season": None}),
    "team_titles": (f"""WITH {_WINNERS} SELECT t.team, t.slug, count(CASE WHEN w.kind = 'Champions' THEN 1 END) AS champions, count(CASE WHEN w.kind = 'Masters' THEN 1 END) AS masters, count(CASE WHEN w.kind = 'Domestic' THEN 1 END) AS domestic,
          count(CASE WHEN w.kind <> 'Domestic' THEN 1 END) AS international, count(*) AS total FROM winners w JOIN teams t ON t.team_id = w.winner_id WHERE :team IS NULL OR t.slug = :team GROUP BY t.team, t.slug""", {"season": None, "team": None}),
    "compressed_series": ("""WITH spans AS (SELECT season, min(day) AS begins, max(day) AS ends FROM games GROUP BY season),
        axis AS (SELECT season, begins, ends, coalesce(sum(ends - begins) OVER (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM spans),
        points AS (SELECT r.game_id, r.arena, r.season, r.day, r.rating, CAST(floor(r.day / 30) AS BIGINT) AS bin FROM ratings r JOIN teams t ON t.team_id = r.team_id WHERE t.slug = :team),
        events_of AS (SELECT event_name, season, floor(completed_at / 86400 / 20) AS part, CAST(floor(min(completed_at) / 86400) AS BIGINT) AS begins, CAST(floor(max(completed_at) / 86400) AS BIGINT) AS ends, CAST(floor(min(completed_at) / 2592000) AS BIGINT) AS first_bin, CAST(floor(max(completed_at) / 2592000) AS BIGINT) AS last_bin
          FROM matches WHERE event_name = :event GROUP BY event_name, season, floor(completed_at / 86400 / 20)),
        bands AS (SELECT begins, ends, DAYS(first_bin, last_bin) AS bin FROM events_of),
        hit AS (SELECT p.game_id, p.arena, min(b.begins) AS begins, max(b.ends) AS ends FROM points p JOIN bands b ON b.bin = p.bin AND p.day BETWEEN b.begins AND b.ends GROUP BY p.game_id, p.arena)
        SELECT p.game_id, p.arena, p.rating, CAST(a.shift + p.day - a.begins AS BIGINT) AS x, CAST(a.shift + h.begins - a.begins AS BIGINT) AS band_from, CAST(a.shift + h.ends - a.begins AS BIGINT) AS band_to
        FROM points p JOIN axis a ON a.season = p.season AND p.day BETWEEN a.begins AND a.ends LEFT JOIN hit h ON h.game_id = p.game_id AND h.arena = p.arena""", {"team": "T7", "event": "1-URGENT"}),
    "registry_listing": ("""SELECT event_name, season, min(completed_at) AS begins, max(completed_at) AS ends, count(*) AS matches, CASE WHEN max(completed_at) < :now THEN 'completed' WHEN min(completed_at) <= :now THEN 'ongoing' ELSE 'upcoming' END AS status
        FROM matches GROUP BY event_name, season ORDER BY 2 DESC, 1""", {"now": 880000000}),
    "player_search": ("""SELECT c_custkey AS player_id, c_name AS player FROM customer WHERE :term <> '' AND c_name ILIKE concat('%', :term, '%') ORDER BY 2, 1 LIMIT {limit}""", {"term": "#0000_001", "limit": 10}),
    "latest_of_players": ("""SELECT player_id, row_id, game_id, team_id, role, played_at FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played_at DESC, row_id DESC) AS rn FROM player_games WHERE :season IS NULL OR season = :season) x WHERE rn = 1""", {"season": None}),
    "sampled_series": ("""SELECT team_id, arena, game_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena ORDER BY played_at, game_id) AS rn, count(*) OVER (PARTITION BY team_id, arena) AS n FROM ratings) x WHERE (rn - 1) % :every = 0 OR rn = n""", {"every": 5}),
    "issue_summary": ("""WITH issues AS (SELECT CASE WHEN v.action = 'decider' AND v.side IS NOT NULL THEN 'decider with a side' WHEN v.action <> 'decider' AND v.side IS NULL THEN 'no side' WHEN m.match_id IS NULL THEN 'no match' END AS issue, v.action, v.match_id
          FROM veto_steps v LEFT JOIN matches m ON m.match_id = v.match_id UNION ALL SELECT 'no numbers' AS issue, role AS action, match_id FROM player_games WHERE adr IS NULL OR kast IS NULL)
        SELECT issue, action, count(*) AS times, count(DISTINCT match_id) AS matches, min(match_id) AS first_match FROM issues WHERE issue IS NOT NULL GROUP BY issue, action""", {}),
    "season_rollover": ("""WITH spans AS (SELECT season, min(day) AS begins, max(day) AS ends FROM games GROUP BY season), newest AS (SELECT max(season) AS season FROM spans)
        SELECT s.season, s.begins, CASE WHEN s.season = n.season THEN CAST(:today AS BIGINT) ELSE s.ends END AS ends, 0 AS is_active FROM spans s JOIN newest n ON n.season IS NOT NULL
        UNION ALL SELECT season + 1, CAST(:today AS BIGINT), CAST(NULL AS BIGINT), 1 FROM newest""", {"today": 10700}),
    "games_by_month": ("""SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS season_start, CAST(extract(MONTH FROM l_shipdate) AS BIGINT) AS month_number, count(*) AS games, CAST(max(l_shipdate) + INTERVAL '30' DAY AS DATE) AS until,
          CAST(sum(CASE WHEN l_shipdate >= date_trunc('year', l_shipdate) + INTERVAL '180' DAY THEN 1 ELSE 0 END) AS BIGINT) AS late FROM lineitem GROUP BY CAST(date_trunc('year', l_shipdate) AS DATE), CAST(extract(MONTH FROM l_shipdate) AS BIGINT)""", {}),
    "matches_between": ("""SELECT m.match_id, m.event_name, m.completed_at FROM matches m WHERE (:event IS NULL OR m.event_name = :event) AND m.completed_at BETWEEN :since AND :until""", {"event": None, "since": 820454400, "until": 852076799}),
}
