"""URL filtering: rules for hosts and paths, and trust over the link graph.

Pages that no rule decides are judged by their host.  Trust starts at hosts
with pages that rules allow and follows links (personalised PageRank);
distrust starts at hosts with pages that rules block and follows links
backwards, to those who link there.  A host starts with the share of its
pages that are allowed or blocked.  Scores are scaled so that a host without
links keeps its own share; a host is blocked if its distrust is at least
``limit`` and above its trust.

All of it is joins and sums over host edges in Spark, until no host's score
changes by ``tolerance`` in a round.  Damping makes every round's changes
smaller in sum, so that it always comes to an end, also on cycles.  Every fifth
round is written to the shared folder and compared with the one before.

Pages are never shuffled by host: seeds and edges are counted with map-side
partial sums, and the hosts' verdicts are a stored table of known size, which
is broadcast to the pages while it is small.  Beyond that the join is a
sort-merge join on the host, salted: a page picks one of ``SALT`` copies of its
host's verdict, so a host with a third of all pages is dealt to as many tasks.

Cases.  A null url, or one without ``://``, has an empty host and path; no
rule fits, and its verdict is ``allow``.  A null html has no links.  Repeated
pages count as often as they occur.  Extra columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed rules of the query: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, LIMIT = 0.85, 1e-6, 0.5
#: Rounds between two looks at the changes; copies of a verdict where verdicts are not broadcast.
EVERY, SALT = 5, 16
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return out if out is not None else F.lit(None).cast("string")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src``, ``dst``, ``n``: links between different hosts."""
    to = F.regexp_extract_all(F.col(html), F.lit(_LINK), 1)
    return (pages.select(host_of(F.col(url)).alias("src"), F.explode(to).alias("to"))
            .select("src", F.regexp_replace(_lower(F.col("to")), r"^.*@|:\d*$", "").alias("dst"))
            .where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def _flow(state: DataFrame, edges: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Score that arrives over edges from ``a`` to ``b``, by edge weight."""
    return (edges.join(state.select(F.col("host").alias(a), F.col(score)), a)
            .groupBy(F.col(b).alias("host")).agg(F.sum(F.col(score) * F.col(f"w_{a}")).alias("got")))


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust``, ``distrust`` from ``host``, ``good``, ``bad``."""
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and under 1")
    edges = common.stored(edges, "host-edges")
    state = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    if edges.isEmpty():
        return state            # nothing to follow: every host keeps its share
    total = {c: edges.groupBy(c).agg(F.sum("n").alias(f"s_{c}")) for c in ("src", "dst")}
    edges = common.stored(
        edges.join(total["src"], "src").join(total["dst"], "dst")
        .select("src", "dst", (F.col("n") / F.col("s_src")).alias("w_src"), (F.col("n") / F.col("s_dst")).alias("w_dst")),
        "host-weights")
    every = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    seeds = common.stored(every.join(seeds, "host", "full").select(
        "host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")), "host-seeds")
    state = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    change = None
    while change is None or change > tolerance:
        for _ in range(EVERY):
            before = state
            on = _flow(state, edges, "src", "dst", "trust").withColumnRenamed("got", "t")
            back = _flow(state, edges, "dst", "src", "distrust").withColumnRenamed("got", "d")
            state = seeds.join(on, "host", "left").join(back, "host", "left").select(
                "host", (F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                (F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        both = state.join(before.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host")
        state = common.stored(both.select("host", "trust", "distrust", F.greatest(
            F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))).alias("moved")), "host-scores")
        change = state.agg(F.max("moved")).first()[0]
        state = state.drop("moved")
    return state


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html",
          damping: float = DAMPING, tolerance: float = TOLERANCE, limit: float = LIMIT) -> DataFrame:
    """One row per page: its id, ``host``, ``path``, ``rule`` (null if none
    fits), ``verdict``, and its host's ``trust`` and ``distrust``."""
    cut = pages.select(F.col(page_id).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    cut = cut.select("_id", "host", "path", _ruled(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"),
                     _ruled(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("ruled"))
    share = lambda v: (F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)) / F.count(F.lit(1)))
    seeds = cut.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    scores = host_scores(seeds, host_edges(pages, url, html), damping, tolerance)
    bad = (F.col("distrust") >= limit) & (F.col("distrust") > F.col("trust"))
    by_host = common.stored(scores.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("of_host")), "hosts")
    spark = pages.sparkSession
    if int(by_host._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= _broadcast_limit(spark):
        both = cut.join(F.broadcast(by_host), "host", "left")              # size checked
    else:
        salted = by_host.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        both = cut.withColumn("_salt", F.pmod(F.xxhash64("_id", "path"), F.lit(SALT)).cast("int")).join(salted, ["host", "_salt"], "left")
    return both.select(
        F.col("_id").alias(page_id), "host", "path", "rule",
        F.coalesce("ruled", "of_host", F.lit("allow")).alias("verdict"), "trust", "distrust")


def _broadcast_limit(spark) -> int:
    """The session's broadcast threshold in bytes (-1: none)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text) if not text.startswith("-") else -1


def sql(table: str = "pages", rules=RULES, damping: float = DAMPING, limit: float = LIMIT, rounds: int = 120) -> str:
    """The result of ``judge`` as DuckDB SQL, scores as the sum of what flows
    along paths of up to ``rounds`` links (rounded to 4 places)."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in order]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = _LINK.replace("(?i)", "").replace("'", "''")
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM {table}),
ruled AS (SELECT *, {case([h + p for _, h, p in order])} AS rule, {case([v for v, _, _ in order])} AS verdict FROM cut),
seeds AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END)::DOUBLE AS good,
  avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END)::DOUBLE AS bad FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, regexp_replace({lower.format("l")}, '^.*@|:[0-9]*$', '', 'g') AS dst FROM (
  SELECT host, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS l FROM cut)),
edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
flow AS (SELECT 0 AS k, 'trust' AS kind, host, good AS v FROM seeds UNION ALL SELECT 0, 'distrust', host, bad FROM seeds
  UNION ALL SELECT k + 1, kind, b, {damping}::DOUBLE * sum(v * w) FROM (
    SELECT k, flow.kind, b, v, w FROM flow JOIN ways ON ways.kind = flow.kind AND a = host WHERE k < {rounds}) AS went GROUP BY ALL),
scores AS (SELECT host, coalesce(sum(v) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(v) FILTER (kind = 'distrust'), 0) AS distrust
  FROM flow GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= {limit} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  round(trust, 4) AS trust, round(distrust, 4) AS distrust
FROM ruled LEFT JOIN scores USING (host)"""


SQL = sql()
