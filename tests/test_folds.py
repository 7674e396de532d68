"""The ordered operators against plain loops, with hand-computed values."""

import math

import pytest

from skirmish.operators import folds

GAMES = "game_id long, arena string, season long, winner_id long, loser_id long, played_at long, winner_rounds long, loser_rounds long"


def test_first_game_and_season_reset(spark):
    rows = [(1, "A", 1, 10, 20, 100, 13, 5), (2, "A", 1, 20, 10, 200, 13, 13), (3, "A", 2, 10, 20, 300, 13, 12), (4, "B", 1, 20, 10, 50, 13, 0)]
    got = {r.game_id: r for r in folds.rate_games(spark.createDataFrame(rows, GAMES)).collect()}
    gain = 74 * math.log(5.95 * math.sqrt(8 + 1)) * 0.5
    assert (got[1].winner_before, got[1].loser_before) == (1000, 1000) and got[1].gain == pytest.approx(gain)
    # the loser of game 1 wins game 2 with no rounds ahead
    chance = 1 / (1 + 10 ** ((1000 + gain - (1000 - gain)) / 1000))
    assert (got[2].winner_before, got[2].loser_before) == (pytest.approx(1000 - gain), pytest.approx(1000 + gain))
    assert got[2].gain == pytest.approx(74 * math.log(5.95) * (1 - chance))
    # a new season and another arena start at 1000
    assert (got[3].winner_before, got[4].winner_before) == (1000, 1000)
    now = {(r.team_id, r.arena, r.season): r.rating for r in folds.current_ratings(folds.rate_games(spark.createDataFrame(rows, GAMES))).collect()}
    assert now[10, "A", 1] == pytest.approx(1000 + gain - got[2].gain)
    assert len(now) == 6


def test_a_game_without_a_time_fails(spark):
    with pytest.raises(ValueError):
        folds.rate_games(spark.createDataFrame([(1, "A", 1, 10, 20, None, 13, 5)], GAMES))


def test_kalman_with_missing_values(spark):
    rows = [(1, 1, 10, 10, 2.0, 24.0), (1, 2, 12, 12, None, 20.0), (1, 3, 12, 12, 1.0, None), (1, 4, 20, 20, -1.0, 48.0)]
    got = {r.event_id: r for r in folds.kalman(spark.createDataFrame(rows, "player_id long, event_id long, day long, moment long, y double, rounds double")).collect()}
    m, v, before, means = 0.0, 10.0, 9, []
    states = []
    for _, _, day, _, y, rounds in rows:
        step = max(1, day - before)
        before, mp, vp = day, 0.995**step * m, 0.995 ** (2 * step) * v + 0.05 * step
        m, v = mp, vp
        if y is not None:
            k = vp / (vp + 24.0 / max(rounds or 1.0, 1.0))
            m, v = mp + k * (y - mp), (1 - k) * vp
        means.append(m)
        states.append((m, v, mp, vp, 0.995**step))
    assert [got[i].kf_mean for i in (1, 2, 3, 4)] == pytest.approx(means)
    smooth = [0, 0, 0, states[3][0]]
    for i in (2, 1, 0):
        back = states[i][1] * states[i + 1][4] / states[i + 1][3]
        smooth[i] = states[i][0] + back * (smooth[i + 1] - states[i + 1][2])
    assert [got[i].smooth_mean for i in (1, 2, 3, 4)] == pytest.approx(smooth)


def test_thinning(spark):
    points = [(1, 1, 0, 1000), (1, 2, 2700, 1010), (1, 3, 2701, 1010), (1, 4, 5402, 1010), (1, 5, 5403, 1020), (2, 6, 5, 1000)]
    got = folds.thin(spark.createDataFrame(points, "team_id long, game_id long, played_at long, rating long")).collect()
    assert sorted(r.game_id for r in got) == [1, 3, 5, 6]
