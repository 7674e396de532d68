"""URL verdicts: prefix rules first, then trust over the host graph.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they
block are distrusted seeds, each in the share of its pages. Trust flows along
links by personalised PageRank; distrust flows against them, to hosts that link
to distrusted ones. A host is blocked when its distrust passes its trust by more
than the share ``margin`` of that trust, whatever the size of the graph. Both ranks move in one join a round, over distinct host
edges; each round is a written table of hosts, and rounds go on
until ``tolerance`` is met; a walk that does not meet it within ``rounds`` fails.

Defined cases. A null url, or one without ``://``, has empty host and path and
fits no rule; with no evidence the verdict is ``allow``. Null pages have no
links. Repeated rows each give a row and count as pages of their host. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Rules are literals of the plan, at most so many.
MOST_RULES = 1000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits. ``rules``: verdict and
    host with path, as ``("block", "net/es/")``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/")[0]))):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct ``src, dst`` between different hosts, from absolute links."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link")).select("src", host_of(target).alias("dst"))
    return out.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """``kind, host, rank``. ``seeds``: ``kind, host, seed``, summing to 1 for
    each kind; ``edges``: ``kind, src, dst, weight``, summing to 1 for each
    (kind, src)."""
    rank = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        flow = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("weight")).alias("rank"))
        back = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
        after = cut(flow.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "url-ranks")
        change = after.alias("a").join(rank.alias("b"), ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("a.rank", F.lit(0.0)) - F.coalesce("b.rank", F.lit(0.0))))).first()[0]
        rank = after
        if (change or 0.0) < tolerance:
            return rank
    raise RuntimeError(f"ranks not within {tolerance} after {rounds} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str]], damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, margin: float = 1e-9) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    share = ruled.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("trust"), F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("distrust"))
    kinds = cut(share.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).where("seed > 0"), "url-seeds")
    totals = kinds.groupBy("kind").agg(F.sum("seed").alias("total"))
    seeds = kinds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed"))
    forward = cut(host_edges(pages), "url-edges")
    both = forward.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(forward.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    # every round reads them
    edges = cut(both.join(both.groupBy("kind", "src").agg(F.count("*").alias("n")), ["kind", "src"]).select("kind", "src", "dst", (1 / F.col("n")).alias("weight")), "url-weights")
    rank = propagate(seeds, edges, damping, rounds, tolerance)
    scores = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    blocked = F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * (1 + margin)
    own = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
