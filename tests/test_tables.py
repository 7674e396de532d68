"""Keyed writes, versions, JSON, page feeds and the incremental rating."""

import pytest
from pyspark.sql import functions as F

from skirmish.functions.ratings import RatingModel
from skirmish.operators import folds
from skirmish.sources import match_pages, tables
from skirmish.streaming import incremental, keyed

GAMES = "game_id long, arena string, season long, winner_id long, loser_id long, played_at long, winner_rounds long, loser_rounds long"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, None, 3)], "id long, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (9, "z", 9)], "id long, name string, n int")
    assert pairs(tables.updated(old, new, ["id"])) == [(1, "a", 1), (2, "b", 5), (3, None, 3)]
    assert pairs(tables.deleted(old, new, ["id"]).select("id")) == [(1,), (3,)]
    assert pairs(tables.inserted_new(old, new.union(new), ["id"]).select("id")) == [(1,), (2,), (3,), (9,)]
    assert tables.emptied(old).count() == 0 and tables.emptied(old).schema == old.schema
    once = tables.with_children(old, new, ["id"])
    assert pairs(once.select("id")) == pairs(tables.with_children(once, new, ["id"]).select("id"))
    feed = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "w", 1)], "id long, name string, at int")
    assert pairs(tables.last_of_id(feed, "id", ["at"]).select("id", "name")) == [(1, "y"), (2, "w")]


def test_a_completed_event_waits(spark):
    old = spark.createDataFrame([(1, "ongoing"), (2, "upcoming"), (3, "completed")], "id long, status string")
    feed = spark.createDataFrame([(1, "completed"), (2, "ongoing"), (4, "upcoming")], "id long, status string")
    now, held = tables.merged_registry(old, feed)
    assert pairs(now) == [(1, "ongoing"), (2, "ongoing"), (3, "completed"), (4, "upcoming")]
    assert pairs(held) == [(1, "completed")]
    assert pairs(tables.updated(now, held, ["id"]))[0] == (1, "completed")


def test_an_update_can_set_null(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    new = spark.createDataFrame([(2, None, 5)], "id long, name string, n int")
    assert pairs(tables.updated(old, new, ["id"], nulls=True)) == [(1, "a", 1), (2, None, 5)]


def test_commits_and_json(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert tables.version(spark, root) == 0
    first = spark.createDataFrame([(1, "a")], "id long, name string")
    assert tables.commit({"x": first, "y": first}, root) == 1
    seen = tables.current(spark, root)
    assert tables.commit({"x": tables.inserted(seen["x"], seen["x"].selectExpr("id + 1 AS id", "name"))}, root, base=1) == 2
    assert {n: pairs(t) for n, t in tables.current(spark, root).items()} == {"x": [(1, "a"), (2, "a")], "y": [(1, "a")]}
    # a writer that started from an older state fails, and so does one that dies between two tables
    with pytest.raises(tables.Conflict):
        tables.commit({"x": first}, root, base=1)
    broken = first.selectExpr("raise_error('stop') AS id", "name")
    with pytest.raises(Exception, match="stop"):
        tables.commit({"x": first, "y": broken}, root)
    assert tables.version(spark, root) == 2 and tables.current(spark, root)["x"].count() == 2
    # two that began together: the second to end finds the place taken
    monkeypatch.setattr(tables, "version", lambda *_: 1)
    with pytest.raises(tables.Conflict):
        tables.commit({"x": first}, root)
    tables.write_json(spark.createDataFrame([(1, None)], "id long, name string"), str(tmp_path / "j"))
    assert pairs(tables.read_json(spark, str(tmp_path / "j"), "id long, name string")) == [(1, None)]


def test_page_feeds(spark):
    html = '<a class="m" href="/12/x"><b>Completed</b> 2mo</a><a href="/about">c</a><A HREF=\'/7/y\'>Live</A><table><tr><th>P</th><td>1 <i>k</i></td></tr><tr></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert pairs(tables.links(pages)) == [(1, 0, "/12/x", "completed", "2mo"), (1, 2, "/7/y", "open", None)]
    assert pairs(tables.links(pages, backfill=False).select("href")) == [("/7/y",)]
    assert pairs(tables.cells(pages)) == [(1, 0, 0, "P"), (1, 0, 1, "1 k")]


def test_incremental_ratings(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = [(1, "A", 1, 10, 20, 100, 13, 5), (3, "A", 1, 20, 10, 300, 13, 2)]
    late = [(2, "A", 1, 10, 20, 200, 13, 8), (4, "A", 1, 10, 20, 400, 13, 0), (1, "A", 1, 10, 20, 100, 13, 5)]
    spark.createDataFrame(first, GAMES).coalesce(1).write.parquet(source)
    incremental.rate_stream(spark, source, store, checkpoint)
    spark.createDataFrame(late, GAMES).coalesce(1).write.mode("append").parquet(source)
    incremental.rate_stream(spark, source, store, checkpoint)
    incremental.rate_stream(spark, source, store, checkpoint)
    got = {r.game_id: r for r in incremental.stored(spark, store).collect()}
    whole = {r.game_id: r for r in folds.rate_games(spark.createDataFrame(first, GAMES)).collect()}
    assert len(got) == incremental.stored(spark, store).count() == 4
    # games that were rated stand; the late game starts from the ratings as of its time, the last from the latest
    assert got[3].winner_before == pytest.approx(whole[3].winner_before)
    assert got[2].winner_before == pytest.approx(1000 + got[1].gain) and got[2].loser_before == pytest.approx(1000 - got[1].gain)
    assert got[4].winner_before == pytest.approx(got[3].loser_before - got[3].gain)


def test_untimed_games_are_set_aside_and_reported(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([(1, "A", 1, 10, 20, None, 13, 5), (2, "A", 1, 10, 20, 7, 13, 5)], GAMES).coalesce(1).write.parquet(source)
    with pytest.raises(ValueError):
        incremental.rate_stream(spark, source, store, checkpoint)
    assert [r.game_id for r in incremental.stored(spark, store).collect()] == [2]


def test_daily_roles_and_merge(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = spark.sql("SELECT timestamp '2024-01-01 05:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts, 'a' AS event_type, 1.0D AS value FROM range(8)")
    rows.write.parquet(source)
    incremental.daily_roles(spark, source, sink, checkpoint)
    got = sorted((r.day.day, r.games, r.value) for r in spark.read.parquet(sink).collect())
    assert got == [(d, 1, 1.0) for d in range(1, len(got) + 1)] and len(got) >= 4
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, at int")
    new = spark.createDataFrame([(1, "c", 2)], "id long, name string, at int")
    assert pairs(incremental.merge_latest(old, new, ["id"], ["at"])) == [(1, "c", 2), (2, "b", 1)]


def test_keyed_state(spark, tmp_path):
    """Restarts read only new files; late games are rated as of their time; a new season starts anew."""
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = [(1, "A", 1, 10, 20, 100, 13, 5), (3, "A", 1, 20, 10, 300, 13, 2), (7, "A", 2, 20, 10, 900, 13, 2)]
    late = [(2, "A", 1, 10, 20, 200, 13, 8), (4, "A", 1, 10, 20, 400, 13, 0), (1, "A", 1, 10, 20, 100, 13, 5), (9, "B", 1, 10, 20, None, 13, 5)]
    spark.createDataFrame(first, GAMES).coalesce(1).write.parquet(source)
    keyed.rate_keyed(spark, source, store, checkpoint)
    spark.createDataFrame(late, GAMES).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        with pytest.raises(ValueError):
            keyed.rate_keyed(spark, source, store, checkpoint)
    rows = keyed.rated_rows(spark, store).collect()
    got = {r.game_id: r for r in rows}
    whole = {r.game_id: r for r in folds.rate_games(spark.createDataFrame(first, GAMES)).collect()}
    assert len(rows) == 5 and got[3].gain == pytest.approx(whole[3].gain) and got[7].winner_before == 1000
    assert got[2].winner_before == pytest.approx(1000 + got[1].gain) and got[2].loser_before == pytest.approx(1000 - got[1].gain)
    assert got[4].winner_before == pytest.approx(got[3].loser_before - got[3].gain)


def test_models_of_ratings(spark):
    games = spark.createDataFrame([(1, "A", 1, 10, 20, 100, 13, 5)], GAMES)
    mild = RatingModel(k=10, start=500)
    row = folds.rate_games(games, model=mild).first()
    assert row.winner_before == 500 and row.gain == pytest.approx(mild.gain(500, 500, 8)) and folds.rate_games(games).first().winner_before == 1000
    with pytest.raises(ValueError):
        RatingModel(k=0)


def test_odd_match_pages(spark):
    html = """<table><tr><td class="player">A&amp;B<td class=number>13 (2)<td class=number>-<td class=number>4</tr><tr><td class=player>C</table>
      <div class="team x">One <b>of</b>\n two</div><script>var x = "<i class=team>no</i>"</script><div class=team>Two</div></p><div class=vetoes>;One of two bans Dune; nonsense; Two pick Cove ;Mire Two remains</div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<div class=team>alone")], "page_id long, html string")
    found = match_pages.fields(pages).cache()
    assert pairs(match_pages.player_rows(found)) == [(1, "A&B", 13, None, 4), (1, "C", None, None, None)]
    assert pairs(match_pages.vetoes(found).drop("page_id")) == [(2, "One of two", "ban", "Dune"), (4, "Two", "pick", "Cove"), (5, None, "decider", "Mire Two")]
    row = match_pages.matches(found, F.lit(2024)).collect()
    assert [(r.page_id, r.team_1, r.team_2, r.score_1, r.best_of, r.starts) for r in row] == [(1, "One of two", "Two", 0, 3, None)]


def test_decayed_means_of_nothing(spark, tmp_path):
    """A player whose first values are 0: the quotient is undefined, as in the SQL."""
    from skirmish import catalog

    rows = [(1, "2024-01-01 00:00:00", 7, "a", 0.0, '{"k": 3}'), (2, "2024-01-02 00:00:00", 7, "a", 2.0, '{"k": 3}'), (3, "2024-01-03 00:00:00", 7, "a", 1.0, '{"k": 5}')]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    for t in ("supplier", "nation", "region", "lineitem", "orders", "documents", "pages", "customer", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    got = {r.event_id: r.pre for r in catalog.QUERIES["decayed_means"](spark, str(tmp_path)).collect()}
    assert got[1] is None and got[2] != got[2] and got[3] == 3.0


@pytest.mark.parametrize("name", ["match_pages_read", "match_page_players"])
def test_pages_are_made_and_read_once(spark, name):
    """One pass over a page gives all that is asked of it."""
    from skirmish import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BatchEvalPythonUDTF" not in plan and plan.count("AS html") == 1
