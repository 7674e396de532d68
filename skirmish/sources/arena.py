"""Arena tables derived from the star schema, as common table expressions.

``BASE`` is one text for both engines; ``spark_sql`` and ``duck_sql`` fill in
the few functions whose names differ. Catalyst drops the expressions that a
query doesn't use, so a query over ``teams`` never scans ``lineitem``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")

#: What a row of ``player_games`` holds, of a side ``s`` and a slot of its team.
PLAYER = """s.game_id * 10 + s.won * 5 + slot AS row_id, s.game_id, s.match_id, s.arena, s.season, s.day, s.played_at, s.team_id * 5 + slot AS player_id, s.team_id, s.opponent_id, s.won, 26 - abs(s.margin) AS rounds,
         concat('role', CAST((s.game_id + s.team_id * 3 + slot * slot) % 9 AS VARCHAR(20))) AS role,
         (s.game_id * 7 + s.team_id * 13 + slot * 5) % 30 + s.won * 3 AS kills, (s.game_id * 11 + s.team_id * 5 + slot * 3) % 25 AS deaths, (s.game_id * 3 + s.team_id + slot) % 12 AS assists,
         (s.game_id + s.team_id + slot) % 4 AS fk, (s.game_id + 2 * s.team_id + slot) % 3 AS fd,
         CASE WHEN (s.game_id + s.team_id + slot) % 17 = 0 THEN NULL ELSE 80 + (s.game_id * 19 + s.team_id * 31 + slot) % 120 END AS adr,
         CASE WHEN (s.game_id + s.team_id * 2 + slot) % 23 = 0 THEN NULL ELSE 40 + (s.game_id * 5 + s.team_id * 7 + slot) % 60 END AS kast"""

BASE = f"""
teams AS (
  SELECT s_suppkey AS team_id, s_name AS team, concat('T', CAST(s_suppkey AS VARCHAR(20))) AS slug, r_name AS region, s_acctbal > 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
team_count AS (SELECT count(*) AS n FROM supplier),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS game_number FROM lineitem
),
games AS (
  SELECT l_orderkey * 100 + game_number AS game_id, l_orderkey AS match_id, game_number, concat(l_returnflag, l_linestatus) AS arena,
         l_suppkey AS winner_id, (l_suppkey + 1 + l_partkey % (n - 1)) % n AS loser_id,
         CAST(13 AS BIGINT) AS winner_rounds, CAST(l_quantity AS BIGINT) % 12 AS loser_rounds,
         EPOCH(l_shipdate) + (l_orderkey % 4000) * 20 + game_number AS played_at, CAST(year(l_shipdate) AS BIGINT) AS season,
         CAST(floor(EPOCH(l_shipdate) / 86400) AS BIGINT) AS day
  FROM numbered CROSS JOIN team_count
),
matches AS (SELECT o_orderkey AS match_id, o_orderpriority AS event_name, EPOCH(o_orderdate) AS completed_at, CAST(year(o_orderdate) AS BIGINT) AS season, o_custkey AS cust_id, o_totalprice AS prize FROM orders),
sides AS (
  SELECT game_id, match_id, arena, season, day, played_at, CASE WHEN won = 1 THEN winner_id ELSE loser_id END AS team_id, CASE WHEN won = 1 THEN loser_id ELSE winner_id END AS opponent_id, won,
         CASE WHEN won = 1 THEN winner_rounds - loser_rounds ELSE loser_rounds - winner_rounds END AS margin
  FROM games CROSS JOIN (SELECT CAST(won AS BIGINT) AS won FROM (VALUES (1), (0)) AS t(won)) both_sides
),
ratings AS (
  SELECT *, 1000 + CAST(sum(margin) OVER (PARTITION BY team_id, arena, season ORDER BY played_at, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rating FROM sides
),
veto_steps AS (
  SELECT match_id, game_number AS step, CASE WHEN game_number % 7 IN (1, 2, 5, 6) THEN 'ban' WHEN game_number % 7 IN (3, 4) THEN 'pick' ELSE 'decider' END AS action,
         concat(arena, CAST(game_number AS VARCHAR(20))) AS choice, arena,
         CASE WHEN game_number % 7 = 0 OR winner_id % 5 = 0 THEN NULL ELSE game_number % 2 END AS side, CAST(winner_rounds - loser_rounds AS BIGINT) AS edge
  FROM games
),
player_games AS (
  SELECT {PLAYER}
  FROM sides s CROSS JOIN (SELECT CAST(slot AS BIGINT) AS slot FROM (VALUES (0), (1), (2), (3), (4)) AS t(slot)) five
),
stats AS (
  SELECT event_id, user_id AS player_id, event_type AS role, CAST(floor(EPOCH(ts) / 86400) AS BIGINT) AS day, EPOCH(ts) AS moment, value, CAST(JSONINT(props, k) AS BIGINT) AS kills FROM events
)
"""


def _filled(sql: str, functions: dict[str, str]) -> str:
    for name, to in functions.items():
        sql = re.sub(rf"\b{name}\(", to + "(", sql)
    return sql


def _with_base(query: str, recursive: bool) -> str:
    body = query.strip()
    rest = body[4:].lstrip() if body[:4].upper() == "WITH" else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + BASE.strip() + (",\n" + rest if rest is not None else "\n" + body)


def literal(value) -> str:
    """A value as SQL text, for the reference SQL; Spark gets parameters."""
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(literal(v) for v in value) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def duck_sql(query: str, recursive: bool = False, args: dict | None = None) -> str:
    sql = _with_base(query, recursive)
    # tables that a statement names more than once are computed once
    sql = re.sub(r"^(numbered|games|sides|ratings) AS \(", r"\1 AS MATERIALIZED (", sql, flags=re.M)
    sql = re.sub(r"\bDAYS\(([^()]*)\)", r"unnest(generate_series(\1))", sql)
    sql = re.sub(r"\bLASTKNOWN\((\w+)\)", r"last_value(\1 IGNORE NULLS)", sql)
    sql = _filled(sql, {"struct": "row", "collect_list": "list", "array_join": "array_to_string"})
    sql = re.sub(r"(?<!:):([a-z_0-9]+)\b", lambda m: literal(args[m[1]]) if args and m[1] in args else m[0], sql)
    sql = re.sub(r"JSONINT\(([^,()]+), (\w+)\)", r"json_extract_string(\1, '$.\2')", sql)
    sql = re.sub(r"\bEPOCH\(((?:[^()]|\([^()]*\))*)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return sql


def spark_sql(query: str, recursive: bool = False) -> str:
    sql = _with_base(query, recursive)
    sql = re.sub(r"JSONINT\(([^,()]+), (\w+)\)", r"get_json_object(\1, '$.\2')", sql)
    sql = re.sub(r"\bDAYS\(([^()]*)\)", r"explode(sequence(\1))", sql)
    sql = re.sub(r"\bLASTKNOWN\((\w+)\)", r"last_value(\1) IGNORE NULLS", sql)
    return _filled(sql, {"EPOCH": "unix_timestamp"})


def tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}


def run(spark: SparkSession, sf_dir: str, query: str, recursive: bool = False, args: dict | None = None, **given: DataFrame) -> DataFrame:
    """The query over the tables of ``sf_dir`` and the ``given`` ones; names are
    bound to DataFrames, so no view is registered in the session. ``args`` fill
    the statement's ``:name`` parameters."""
    sql = spark_sql(query, recursive)
    frames = tables(spark, sf_dir, sql) | given
    for t in frames:
        sql = re.sub(rf"(?<=FROM ){t}\b|(?<=JOIN ){t}\b", "{" + t + "}", sql)
    bound = {k: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v for k, v in (args or {}).items()}
    return spark.sql(sql, args=bound or None, **frames)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    return run(spark, sf_dir, f"SELECT * FROM {name}")
