"""Feeds as queries: texts of dates, events, arenas and teams, page links and cells,
registry tables that change, JSON, and streams, each over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skirmish.functions import texts
from skirmish.operators import folds, models
from skirmish.plans import relational, vetoes
from skirmish.plans.ranked import REFERENCE
from skirmish.sources import arena, match_pages, tables
from skirmish.streaming import incremental, keyed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str, recursive: bool = False):
    """Registers a query with its SQL, which may use the arena tables."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = arena.duck_sql(sql, recursive=recursive)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.run(spark, sf_dir, "SELECT match_id, event_name, season, completed_at FROM matches")


@_query("SELECT o_orderkey AS match_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 1440 * 60 AS starts FROM orders")
def match_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each match starts, read from the words of its page: "Friday, March 7", "3:05 PM UTC"."""
    at = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 1440 * 60)
    said = _table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "EEEE, MMMM d").alias("date"), F.concat(F.date_format(at, "h:mm a"), F.lit(" UTC")).alias("time"), F.year(at).alias("year"))
    return said.select(F.col("o_orderkey").alias("match_id"), F.unix_timestamp(texts.match_time(F.col("date"), F.col("time"), F.col("year"))).alias("starts"))


_SPAN = "INTERVAL (o_orderkey % 40) DAY"


@_query(f"""SELECT o_orderkey AS match_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' WHEN 'P' THEN 'upcoming' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 1990 ELSE year(o_orderdate) + 10 END AS year,
    CASE WHEN o_orderkey % 7 <> 0 THEN epoch_days(CAST(o_orderdate AS DATE)) END AS begins,
    CASE WHEN o_orderkey % 7 <> 0 THEN epoch_days(TRY_CAST(concat(year(o_orderdate), '-', month(o_orderdate + {_SPAN}), '-', day(o_orderdate + {_SPAN})) AS DATE)) END AS ends FROM orders""".replace("epoch_days(", "date_diff('day', DATE '1970-01-01', "))
def event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, year and days of an event, read from its heading; no year means 1990 here."""
    orders = _table(spark, sf_dir, "orders")
    until = F.date_add("o_orderdate", (F.col("o_orderkey") % 40).cast("int"))
    same = F.month("o_orderdate") == F.month(until)
    span = F.concat(F.date_format("o_orderdate", "MMM d"), F.when(same, "—").otherwise(" - "), F.when(~same, F.date_format(until, "MMMM ")).otherwise(""), F.date_format(until, "d"))
    word = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "ONGOING").when(F.col("o_orderstatus") == "P", "upcoming").otherwise("unknown")
    name = F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Cup "), F.year("o_orderdate") + 10)), word, F.when(F.col("o_orderkey") % 7 != 0, span))
    rows = orders.select("o_orderkey", name.alias("heading"), F.year("o_orderdate").alias("now"))
    days = texts.date_range(F.col("heading"), F.col("now"))
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long")
    return rows.withColumn("days", days).select(F.col("o_orderkey").alias("match_id"), texts.event_status(F.col("heading")).alias("status"), texts.event_year(F.col("heading"), F.lit(1990).cast("long")).alias("year"), day("days.begins").alias("begins"), day("days.ends").alias("ends"))


KINDS = ["bolt", "widget", "gear", "ring"]


@_query(f"SELECT p_partkey AS part_id, CASE WHEN k <> '' THEN concat(upper(substr(k, 1, 1)), lower(substr(k, 2))) END AS kind FROM (SELECT p_partkey, regexp_extract(p_name, '(?i)\\b({'|'.join(KINDS)})\\b', 1) AS k FROM part)")
def arenas_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arena that a text names."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), texts.named_arena(F.col("p_name"), KINDS).alias("kind"))


TEAMS = {"first": ["und", "andon"], "second": ["the", "thand"], "third": ["de", "la", "ción"]}


def _named_sql(name: str) -> str:
    if len(name) <= 3:
        return f"list_contains(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), '{name}')"
    folded = "".join(c for c in name if c.isascii() and c.isalnum())
    return f"(contains(lower(coalesce(text, '')), '{name}') OR contains(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g'), '{folded}'))"


@_query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(_named_sql(i) for i in ids)} THEN '{t}'" for t, ids in TEAMS.items()) + " END AS team FROM documents")
def teams_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first team that a text names by one of its identifiers."""
    return _table(spark, sf_dir, "documents").select("doc_id", texts.named_team(F.col("text"), TEAMS).alias("team"))


@_query(relational.PLANS["text_identifiers"])
def text_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's initial, a key of it and its length without blanks, letter by letter."""
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", texts.capital(F.substring(text, 1, 1)).alias("initial"), F.md5(texts.lowered(texts.trimmed(text))).alias("folded"), F.length(F.replace(text, F.lit(" "), F.lit(""))).cast("long").alias("letters"))


@_query("SELECT c_custkey AS player_id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS folded FROM customer")
def names_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of a name as one key."""
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), texts.bare(F.col("c_name")).alias("folded"))


REGIONS = {"North": ["T1", "T2", "T3"], "South": ["T4", "T5"], "Late": ["T3", "T9"]}


@_query("SELECT slug, CASE WHEN slug IN ('T1', 'T2', 'T3') THEN 'North' WHEN slug IN ('T4', 'T5') THEN 'South' WHEN slug = 'T9' THEN 'Late' ELSE 'Unknown' END AS region FROM teams")
def regions_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that lists a team, or that none does."""
    return arena.run(spark, sf_dir, "SELECT slug FROM teams").select("slug", texts.region_of(F.col("slug"), REGIONS).alias("region"))


@_query("""WITH spans AS (SELECT year(l_shipdate) AS season, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1), days AS (SELECT season, unnest(generate_series(a, b, INTERVAL 14 DAY)) AS d FROM spans)
    SELECT season, date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS tick, strftime(d, '%b %Y') AS label FROM days""")
def season_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark every 14 days of a season, with its month."""
    day = F.to_date("l_shipdate")
    spans = _table(spark, sf_dir, "lineitem").groupBy(F.year(day).cast("long").alias("season")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    ticks = spans.select("season", F.explode(texts.ticks(F.col("a"), F.col("b"))).alias("d"))
    return ticks.select("season", F.datediff("d", F.lit("1970-01-01")).cast("long").alias("tick"), F.date_format("d", "MMM yyyy").alias("label"))


@_query("""WITH played AS (SELECT match_id, list(arena ORDER BY game_number) AS arenas FROM games GROUP BY match_id) SELECT match_id, list_filter(arenas, lambda a: a <> arenas[1])[1] AS other FROM played""")
def first_other_arenas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first arena of a match that isn't its first game's."""
    played = arena.frame(spark, sf_dir, "games").groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("game_number", "arena"))), lambda g: g["arena"]).alias("arenas"))
    return played.select("match_id", texts.first_other(F.col("arenas"), F.get("arenas", 0)).alias("other"))


@_query("SELECT team_id, substr(sha1(to_json({'team_id': team_id, 'team': team, 'region': region})), 1, 12) AS version FROM teams")
def row_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve digits that change with a row."""
    return arena.run(spark, sf_dir, "SELECT team_id, team, region FROM teams").select("team_id", texts.version_of(F.col("team_id"), F.col("team"), F.col("region")).alias("version"))


_MIX = "CAST(((CAST(xor(CAST({h} AS BIGINT), CAST({h} AS BIGINT) >> {by}) AS HUGEINT) * {times}) % 4294967296) AS BIGINT)"


def _seeded_sql() -> str:
    once = _MIX.format(h="s.h", by=15, times=2246822507)
    h = _MIX.format(h=f"({once})", by=13, times=3266489909)
    j = f"(CASE WHEN {h} >= 2147483648 THEN 4294967296 - {h} ELSE {h} END % (x.i + 1)) + 1"
    swap = f"list_transform(s.a, lambda v, k: CASE WHEN k = x.i + 1 THEN s.a[{j}] WHEN k = {j} THEN s.a[x.i + 1] ELSE v END)"
    return f"""WITH held AS (SELECT region, list(slug ORDER BY team_id) AS a FROM teams GROUP BY region),
      started AS (SELECT region, a, list_reduce(list_transform(range(1, length(region) + 1), lambda i: CAST(ascii(region[i]) AS BIGINT)), lambda h, c: CAST((CAST(xor(h, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT), 2166136261) AS h FROM held),
      walked AS (SELECT region, list_reduce(list_transform(range(len(a) - 1, 0, -1), lambda i: {{'h': CAST(0 AS BIGINT), 'i': CAST(i AS BIGINT), 'a': a}}), lambda s, x: {{'h': {h}, 'i': x.i, 'a': {swap}}}, {{'h': h, 'i': CAST(0 AS BIGINT), 'a': a}}) AS s FROM started)
      SELECT region, array_to_string(s.a, ',') AS seeding FROM walked"""


@_query(_seeded_sql())
def seedings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's teams in an order that its name alone decides."""
    held = arena.run(spark, sf_dir, "SELECT region, slug, team_id FROM teams").groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("team_id", "slug"))), lambda t: t["slug"]).alias("a"))
    return held.select("region", F.array_join(texts.seeded_order(F.col("a"), F.col("region")), ",").alias("seeding"))


@_query("SELECT game_id, season, row_number() OVER (PARTITION BY season, arena ORDER BY md5(concat('cup:', CAST(game_id AS VARCHAR)))) AS place FROM games")
def shuffled_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games of each season and arena in a random order that a seed repeats."""
    order = Window.partitionBy("season", "arena").orderBy(texts.shuffle_key("cup", F.col("game_id")))
    return arena.run(spark, sf_dir, "SELECT game_id, season, arena FROM games").select("game_id", "season", F.row_number().over(order).cast("long").alias("place"))


@_query("""WITH r AS (SELECT role, value / (CASE WHEN kills % 5 = 0 THEN 0 ELSE kills END) AS x FROM stats), f AS (SELECT role, x FROM r WHERE x IS NOT NULL AND isfinite(x))
    SELECT role, count(*) AS n, round(avg(x), 6) AS mean FROM f GROUP BY role""")
def finite_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over numbers only: quotients by nothing are left out."""
    by = F.when(F.col("kills") % 5 == 0, F.lit(0)).otherwise(F.col("kills")).cast("double")
    rows = arena.frame(spark, sf_dir, "stats").select("role", F.try_divide("value", by).alias("x")).where(texts.finite(F.col("x")))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@_query("""WITH t AS (SELECT value AS y, value - (3.0 + 0.25 * kills) AS e FROM stats WHERE kills IS NOT NULL) SELECT round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(y)), 6) AS r2 FROM t""")
def fit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far given weights are from what they foretell."""
    told = models.mean_error(arena.frame(spark, sf_dir, "stats").where("kills is not null"), {"intercept": 3.0, "kills": 0.25}, "value")
    return told.select(F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"))


@_query("WITH pool AS (SELECT winner_id AS team_id, list_sort(list(DISTINCT arena)) AS arenas FROM games GROUP BY winner_id) SELECT team_id, array_to_string(arenas[1:3], ',') AS bo3, array_to_string(arenas[1:5], ',') AS bo5 FROM pool")
def fallback_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arenas of a series where no ratings tell better ones."""
    pool = arena.frame(spark, sf_dir, "games").groupBy(F.col("winner_id").alias("team_id")).agg(F.collect_set("arena").alias("arenas"))
    return pool.select("team_id", *[F.array_join(models.fallback_maps(F.col("arenas"), k), ",").alias(k) for k in ("bo3", "bo5")])


@_query("""SELECT match_id, CASE WHEN match_id % 2 = 0 THEN CASE WHEN match_id % 4 = 0 THEN NULL ELSE 'moved' END ELSE event_name END AS event_name, season FROM matches WHERE match_id % 3 <> 0""")
def rows_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values set by key, to null as well."""
    m = _matches(spark, sf_dir)
    changes = m.where("match_id % 2 = 0").select("match_id", F.when(F.col("match_id") % 4 != 0, "moved").alias("event_name"))
    return tables.updated(m.where("match_id % 3 <> 0").drop("completed_at"), changes, ["match_id"], nulls=True)


@_query("SELECT match_id, event_name FROM matches WHERE season <> 1997")
def rows_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without those of given keys."""
    m = _matches(spark, sf_dir)
    return tables.deleted(m.select("match_id", "event_name"), m.where("season = 1997"), ["match_id"])


@_query("SELECT match_id, event_name, 'old' AS source FROM matches WHERE match_id % 3 = 0 UNION ALL SELECT match_id, event_name, NULL FROM matches")
def rows_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put in from a query, missing columns null."""
    m = _matches(spark, sf_dir).select("match_id", "event_name")
    return tables.inserted(m.where("match_id % 3 = 0").withColumn("source", F.lit("old")), m)


@_query("SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'old' ELSE 'new' END AS source FROM matches")
def rows_inserted_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put in unless their key is there; twice the same feed changes nothing."""
    m = _matches(spark, sf_dir).select("match_id")
    feed = m.union(m).withColumn("source", F.lit("new"))
    once = tables.inserted_new(m.where("match_id % 3 = 0").withColumn("source", F.lit("old")), feed, ["match_id"])
    return tables.inserted_new(once, feed, ["match_id"])


@_query("SELECT match_id, game_number, CASE WHEN match_id % 2 = 0 THEN 'again' ELSE arena END AS arena FROM games WHERE match_id % 2 = 1 OR game_number <= 2")
def children_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All games of a match replaced by those of a reload."""
    games = arena.run(spark, sf_dir, "SELECT match_id, game_number, arena FROM games")
    return tables.with_children(games, games.where("match_id % 2 = 0 and game_number <= 2").withColumn("arena", F.lit("again")), ["match_id"])


@_query("SELECT event_name, season, max(completed_at) AS completed_at FROM matches GROUP BY event_name, season")
def events_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an event listed several times, the last."""
    rows = _matches(spark, sf_dir).withColumn("id", F.concat_ws("/", "event_name", "season"))
    return tables.last_of_id(rows, "id", ["completed_at", "match_id"]).select("event_name", "season", "completed_at")


@_query("""WITH o AS (SELECT match_id AS id, CASE match_id % 3 WHEN 0 THEN 'ongoing' WHEN 1 THEN 'upcoming' ELSE 'completed' END AS was FROM matches WHERE match_id % 5 <> 0), f AS (SELECT match_id AS id FROM matches WHERE match_id % 2 = 0)
    SELECT coalesce(o.id, f.id) AS id, CASE WHEN f.id IS NULL THEN o.was WHEN o.was = 'ongoing' THEN 'ongoing' ELSE 'completed' END AS status, CASE WHEN f.id IS NOT NULL AND o.was = 'ongoing' THEN 1 ELSE 0 END AS held FROM o FULL JOIN f ON o.id = f.id""")
def registry_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a feed merged in; events that end now wait until their games are read."""
    m = _matches(spark, sf_dir).select(F.col("match_id").alias("id"))
    was = F.when(F.col("id") % 3 == 0, "ongoing").when(F.col("id") % 3 == 1, "upcoming").otherwise("completed")
    now, held = tables.merged_registry(m.where("id % 5 <> 0").withColumn("status", was), m.where("id % 2 = 0").withColumn("status", F.lit("completed")))
    return now.join(held.select("id", F.lit(1).alias("held")), "id", "left").select("id", "status", F.coalesce("held", F.lit(0)).alias("held"))


@_query("SELECT team_id, team, CASE WHEN team_id % 4 = 0 THEN NULL ELSE region END AS region FROM teams")
def teams_through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and read back, nulls kept."""
    path = tables.shared_folder(spark, "teams-json")
    rows = arena.run(spark, sf_dir, "SELECT team_id, team, CASE WHEN team_id % 4 = 0 THEN NULL ELSE region END AS region FROM teams")
    tables.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@_query("SELECT 'teams' AS kept, region AS name, count(*) AS n FROM teams GROUP BY region UNION ALL SELECT 'arenas', arena, count(*) FROM games GROUP BY arena UNION ALL SELECT 'emptied', NULL, 0")
def tables_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables replaced together, the old ones gone at once."""
    root = tables.shared_folder(spark, "registry")
    regions = arena.run(spark, sf_dir, "SELECT region AS name, count(*) AS n FROM teams GROUP BY region")
    arenas = arena.run(spark, sf_dir, "SELECT arena AS name, count(*) AS n FROM games GROUP BY arena")
    first = tables.commit({"teams": regions.limit(0), "arenas": regions, "emptied": regions}, root, base=0)
    old = tables.current(spark, root)
    tables.commit({"teams": tables.inserted(old["teams"], regions), "arenas": arenas, "emptied": tables.emptied(old["emptied"])}, root, base=first)
    now = tables.current(spark, root)
    kept = now["teams"].select(F.lit("teams").alias("kept"), "*").unionByName(now["arenas"].select(F.lit("arenas").alias("kept"), "*"))
    return kept.unionByName(now["emptied"].agg(F.lit("emptied").alias("kept"), F.lit(None).cast("string").alias("name"), F.count("*").alias("n")))


@_query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*?href\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS link, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*?href\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>'), 1) - 1 AS at_link FROM pages),
    t AS (SELECT page_id, at_link, regexp_extract(link, '(?is)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(regexp_replace(link, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS said FROM l)
    SELECT page_id, at_link AS place, href, CASE WHEN contains(lower(said), 'completed') THEN 'completed' ELSE 'open' END AS status, nullif(regexp_extract(said, '\\b(\\d+(?:mo|yr))\\b', 1), '') AS age FROM t WHERE regexp_matches(href, '^/')""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a page to its own site, with what their texts say."""
    return tables.links(_table(spark, sf_dir, "pages"), pattern="^/").withColumnRenamed("at", "place")


@_query("""WITH s AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<tr\\b[^>]*>(.*?)</tr>', 1) AS trs FROM pages), r AS (SELECT page_id, unnest(trs) AS tr, generate_subscripts(trs, 1) - 1 AS nth_row FROM s),
    c AS (SELECT page_id, nth_row, regexp_extract_all(tr, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1) AS tds FROM r), d AS (SELECT page_id, nth_row, unnest(tds) AS td, generate_subscripts(tds, 1) - 1 AS nth_cell FROM c)
    SELECT page_id, nth_row, nth_cell, trim(regexp_replace(regexp_replace(td, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM d""")
def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table cell of a page."""
    return tables.cells(_table(spark, sf_dir, "pages"))


_RATED = """SELECT game_id, arena, season, winner_id, loser_id, played_at, round(winner_before, 4) AS winner_before, round(loser_before, 4) AS loser_before, round(gain, 4) AS gain FROM rated"""


def _arriving(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> str:
    """The games as files that come in the order of time."""
    folder = tables.shared_folder(spark, name)
    games = arena.frame(spark, sf_dir, "games")
    games.repartitionByRange(files, "season", "played_at", "game_id").sortWithinPartitions("season", "played_at", "game_id").write.parquet(f"{folder}/in")
    return folder


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*folds.RATED_COLUMNS).withColumns({c: F.round(c, 4) for c in ("winner_before", "loser_before", "gain")})


@_query(REFERENCE + " " + _RATED, recursive=True)
def elo_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games rated as they arrive, from keyed state."""
    folder = _arriving(spark, sf_dir, "streamed")
    keyed.rate_keyed(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return _rounded(keyed.rated_rows(spark, f"{folder}/out"))


@_query(REFERENCE + " " + _RATED, recursive=True)
def elo_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games rated as they arrive, from the stored rows of their arena and season."""
    folder = _arriving(spark, sf_dir, "incremental")
    incremental.rate_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return _rounded(incremental.stored(spark, f"{folder}/out"))


@_query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type AS role, count(*) AS games, sum(value) AS value FROM events GROUP BY 1, 2), late AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events)
    SELECT date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) AS day, role, games, round(value, 4) AS value FROM d, late WHERE day + INTERVAL 1 DAY <= mark""")
def daily_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and roles as a stream that writes a day once no more of it is awaited."""
    folder = tables.shared_folder(spark, "daily")
    _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/in")
    incremental.daily_roles(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select(F.datediff("day", F.lit("1970-01-01")).cast("long").alias("day"), "role", "games", F.round("value", 4).alias("value"))


@_query("SELECT team_id, arena, rating, game_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id, arena ORDER BY played_at DESC, game_id DESC) AS rn FROM ratings) WHERE rn = 1")
def latest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows after a merge of newer and older ones."""
    rows = arena.run(spark, sf_dir, "SELECT team_id, arena, rating, played_at, game_id, season FROM ratings")
    return incremental.merge_latest(rows.where("season <= 1998"), rows.where("season >= 1997"), ["team_id", "arena"], ["played_at", "game_id"]).select("team_id", "arena", "rating", "game_id")


def _match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match as a page of its feed: teams, score, time, vetoes and its first game's players."""
    steps = arena.run(spark, sf_dir, f"""WITH {vetoes.STEPS} SELECT s.match_id, s.step, CASE WHEN s.action = 'decider' THEN concat(s.map, ' remains') ELSE concat(t.slug, ' ', s.action, ' ', s.map) END AS said
        FROM steps s LEFT JOIN teams t ON t.team_id = CASE s.side WHEN 1 THEN s.team_1 ELSE s.team_2 END""")
    said = steps.groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "said"))), lambda x: x["said"]), "; ").alias("vetoes"))
    heads = arena.run(spark, sf_dir, """WITH counted AS (SELECT match_id, count(*) AS n, CAST(sum(game_number % 2) AS BIGINT) AS won, max(CASE WHEN game_number = 1 THEN winner_id END) AS team_1, max(CASE WHEN game_number = 1 THEN loser_id END) AS team_2 FROM games GROUP BY match_id)
        SELECT c.match_id, a.team AS team_1, b.team AS team_2, c.won, c.n, m.completed_at FROM counted c JOIN matches m ON m.match_id = c.match_id JOIN teams a ON a.team_id = c.team_1 JOIN teams b ON b.team_id = c.team_2""")
    lines = arena.run(spark, sf_dir, "SELECT match_id, player_id, kills, deaths, adr FROM player_games WHERE game_id = match_id * 100 + 1")
    row = F.concat(F.lit("<TR><td class=player>P"), "player_id", F.lit("<td class='number x'>"), "kills", F.lit(" (2)<td class=number>"), "deaths", F.lit("</td><td class=number>"), F.coalesce(F.col("adr").cast("string"), F.lit("&nbsp;")), F.lit("</tr>"))
    stats = lines.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("stats"))
    at = F.timestamp_seconds(F.col("completed_at") + F.col("match_id") % 1440 * 60)
    team = lambda c: F.concat(F.lit('<a class="link team">'), F.replace(c, F.lit("#"), F.lit("&#35;")), F.lit("<br></a>"))
    html = F.concat(
        F.lit("<html><style>.team{}</style><!-- <b class=team>no</b> --><div>"), team("team_1"), F.lit("<span class=score> "), "won", F.lit("</span>"), team("team_2"), F.lit("<span class=score>"), F.col("n") - F.col("won"), F.lit("</span></div>"),
        F.when(F.col("n") != 3, F.concat(F.lit("<i class=format>Bo"), "n", F.lit("</i>"))).otherwise(""), F.lit("<p class=date>"), F.date_format(at, "EEEE, MMMM d"), F.lit("</p><p class=time>\n"), F.date_format(at, "h:mm a"), F.lit("  UTC</p>"),
        F.coalesce(F.concat(F.lit("<div class=vetoes>"), "vetoes", F.lit("</div>")), F.lit("")), F.lit("<table>"), "stats", F.lit("</table></html>"))
    joined = heads.join(said, "match_id", "left").join(stats, "match_id")
    return joined.select(F.col("match_id").alias("page_id"), html.alias("html"), F.year(at).alias("year"))


@_query("""WITH counted AS (SELECT match_id, count(*) AS n, CAST(sum(game_number % 2) AS BIGINT) AS won, max(CASE WHEN game_number = 1 THEN winner_id END) AS team_1, max(CASE WHEN game_number = 1 THEN loser_id END) AS team_2 FROM games GROUP BY match_id)
    SELECT c.match_id AS page_id, a.team AS team_1, b.team AS team_2, c.won AS score_1, c.n - c.won AS score_2, c.n AS best_of, m.completed_at + m.match_id % 1440 * 60 AS starts FROM counted c JOIN matches m ON m.match_id = c.match_id JOIN teams a ON a.team_id = c.team_1 JOIN teams b ON b.team_id = c.team_2""")
def match_pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams, score, number of games and time of every match, read from its page."""
    found = match_pages.fields(_match_pages(spark, sf_dir), "year")
    return match_pages.matches(found, F.max("year")).withColumn("starts", F.unix_timestamp("starts"))


@_query(f"""WITH {vetoes.STEPS} SELECT s.match_id AS page_id, s.step, CASE WHEN s.action <> 'decider' THEN t.slug END AS team, s.action, s.map FROM steps s LEFT JOIN teams t ON t.team_id = CASE s.side WHEN 1 THEN s.team_1 ELSE s.team_2 END""")
def match_page_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of every veto, read from its match's page."""
    return match_pages.vetoes(match_pages.fields(_match_pages(spark, sf_dir)))


@_query("SELECT match_id AS page_id, concat('P', CAST(player_id AS VARCHAR)) AS player, kills, deaths, adr FROM player_games WHERE game_id = match_id * 100 + 1")
def match_page_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players' numbers of every match, read from its page."""
    return match_pages.player_rows(match_pages.fields(_match_pages(spark, sf_dir)), ("kills", "deaths", "adr"))
