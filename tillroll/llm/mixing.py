"""Mixing sources to target weights, with DataFrame functions only.

Targets.  Sources share ``budget`` times all words by weight; a target stops
at ``cap`` times its source's words, and the excess is shared by weight among
the others until none is above.  Each round is one aggregate of the table of
sources (one row per source).

Blocks.  The mix is made of equal blocks of ``block`` words.  Sainte-Laguë
apportionment gives each source an integer quota of them: seats go to the
highest quotients target / 1, target / 3, target / 5, ...  The same rule deals
a source's quota to its shards, by their words.  Only quotients near the last
seat are listed and ranked (about three per item): for n items and N seats,
the rounded quotas at divisors total / (N - n/2) and total / (N + n/2 + 1)
hold at most, and at least, N seats.

Selection.  A shard is a seeded hash class of a source's documents, about
``shard_words`` words, so no source is one group.  Its documents lie in seeded
order on a circle of S words; its blocks are numbered from a seeded place, and
a quota of q takes blocks 0 .. q - 1, going round again where q blocks are
more than S words (never more than ``cap`` times).  So a shard gives exactly
q blocks, each document is taken whole but for the two ends, and what is taken
of a document follows from its place by arithmetic.  Equal seeds give equal
mixes, however the table is partitioned.

Cases.  Null and empty texts have no words and nothing taken.  The null source
is a source, last in order.  Ids may be null or repeated: rows of equal source,
id and size are counted first, cut into entries of at most ``_COPIES`` copies
and dealt to shards like documents, so that repeated rows are no hot group.
Fewer words than half a block may leave a source without seat.  Extra columns
are ignored; an empty table gives an empty result.

Shuffles: narrow rows (source, id, size) twice; texts are read once and never
shuffled.  Windows run per shard, and over the small tables of sources and of
one source's shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2
BLOCK, SHARD_WORDS, SEED = 16, 1 << 20, 13
_COPIES = 1024
_TRIM = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a text without making them: each word and the space after it becomes one letter."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")).cast("long")


def _drawn(*parts: Column) -> Column:
    """Seeded hash text; the same in any SQL with md5."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))


def _number(md5: Column, digits: int) -> Column:
    return F.conv(F.substring(md5, 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``_pos`` (1, 2, ..
    by code point, null last), ``_w`` and ``target``."""
    order = Window.orderBy(F.asc_nulls_last("source"))                               # one row per source
    table = sizes.select("*", F.row_number().over(order).alias("_pos"))
    table = table.select("*", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                           ((F.col("_pos") - 1) % len(weights) + 1).cast("int")).alias("_w"))
    table = common.stored(table, "sources")
    limit = cap * F.col("source_size")
    level, held = 0.0, -1
    while True:
        full = F.col("_w") * F.lit(level) > limit
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit).otherwise(0)).alias("capped"),
                        F.sum(F.when(full, 0).otherwise(F.col("_w"))).alias("open"),
                        F.count_if(full).alias("held")).first()
        if not row["all"] or row["held"] == held:
            break
        level, held = (budget * row["all"] - row["capped"]) / row["open"], row["held"]
    return table.select("*", F.least(F.col("_w") * F.lit(level), limit.cast("double")).alias("target"))


def apportion(items: DataFrame, group: list[str], item: str, votes: str, seats: str) -> DataFrame:
    """``items`` with ``_quota``: Sainte-Laguë seats within each ``group``; ties: smaller ``item``."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    t = items.select("*", F.sum(votes).over(w).cast("double").alias("_all"), F.count(F.lit(1)).over(w).alias("_n"))
    rate = F.col(votes).cast("double") / F.col("_all")
    some = (F.col("_all") > 0) & (F.col(seats) > 0)
    t = t.select("*",
                 F.when(some, F.greatest(F.floor(rate * (F.col(seats) - F.col("_n") / 2) + 0.5) - 1, F.lit(0))).otherwise(0)
                 .cast("long").alias("_sure"),
                 F.when(some, F.floor(rate * (F.col(seats) + F.col("_n") / 2 + 1) + 0.5) + 1).otherwise(0)
                 .cast("long").alias("_most"))
    t = t.select("*", (F.col(seats) - F.sum("_sure").over(w)).alias("_left"))
    near = t.select(*group, item, votes, "_left", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(
        F.col("_sure") + 1, F.col("_most")))).alias("_k"))
    quotient = F.col(votes).cast("double") / (2 * F.col("_k") - 1)
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last(quotient), item, "_k"))
    won = near.where(F.col("_k").isNotNull()).select("*", rank.alias("_r")).where(F.col("_r") <= F.col("_left"))
    won = won.groupBy(*group, item).agg(F.count(F.lit(1)).alias("_won"))
    return (t.join(won, [*group, item], "left")
            .withColumn("_quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
            .select(*items.columns, "_quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        budget: float = BUDGET, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS,
        seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``,
    ``target``, ``taken`` (words), ``passes`` (times the whole text is taken)
    and ``spans`` (word start and length of what is taken beyond that)."""
    spark = docs.sparkSession
    rows = common.stored(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"),
                                     word_count(F.col(text)).alias("size")), "sizes")
    table = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")     # one row per source
    table = apportion(table.withColumn("_seats", seats), [], "_pos", "target", "_seats")
    table = table.select("source", "source_size", "_pos", "target",
                         F.least("_quota", F.expr(f"{cap} * source_size div {block}")).alias("_seats"),
                         F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("_shards"))
    table = common.stored(table, "quotas")

    key = _drawn(F.lit(seed), F.col("id"), F.col("size"), F.col("_chunk"))
    entries = (rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("_m"))
               .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {_COPIES}"))).alias("_chunk"))
               .select("source", "id", "size", "_chunk", F.least(F.col("_m") - F.col("_chunk") * _COPIES, F.lit(_COPIES)).alias("_m"),
                       key.alias("_key")))
    here = table.select(F.col("source").alias("_source"), "_pos", "_shards")
    entries = entries.join(here, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_pos", (_number(F.col("_key"), 8) % F.col("_shards")).alias("_shard"), "id", "size", "_chunk", "_m", "_key")
    entries = common.stored(entries, "entries")

    shards = entries.groupBy("_pos", "_shard").agg(F.sum(F.col("size") * F.col("_m")).alias("_words"))
    shards = shards.join(table, "_pos")
    shards = apportion(shards, ["_pos"], "_shard", "_words", "_seats")
    taken = F.least(F.col("_quota"), F.expr(f"{cap} * _words div {block}")) * block
    begin = _number(_drawn(F.lit(seed), F.col("_pos"), F.col("_shard")), 15)
    shards = shards.select("_pos", "_shard", "source", "source_size", "target", "_words", taken.alias("_take"),
                           F.when(F.col("_words") > 0, begin % F.col("_words")).otherwise(0).alias("_begin"))
    shards = common.stored(shards, "shards")

    own = Window.partitionBy("_pos", "_shard").orderBy("_key", "id", "size", "_chunk")
    length = F.col("size") * F.col("_m")
    laid = entries.select("*", (F.sum(length).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                                - length).alias("_at"))
    each = (laid.join(shards, ["_pos", "_shard"])
            .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_copy")))
    s, size, rest = F.col("_words"), F.col("size"), F.expr("if(_words > 0, _take % _words, 0)")
    at = F.expr("if(_words > 0, pmod(_at + _copy * size - _begin, _words), 0)")
    each = each.select("*", at.alias("_p"), F.expr("if(_words > 0, _take div _words, 0)").alias("passes"), rest.alias("_rest"))
    p, rest = F.col("_p"), F.col("_rest")
    head, tail = F.greatest(F.least(p + size, rest) - p, F.lit(0)), F.greatest(F.least(p + size - s, rest), F.lit(0))
    span = lambda a, n: F.struct(a.cast("long").alias("start"), n.cast("long").alias("length"))
    spans = F.filter(F.array(span(F.lit(0), head), span(s - p, tail)), lambda x: x["length"] > 0)
    return each.select(F.col("id").alias(doc_id), "source", "size", "source_size", "target",
                       (F.col("passes") * size + head + tail).cast("long").alias("taken"),
                       F.col("passes").cast("long").alias("passes"), spans.alias("spans"))


def sql(table: str = "documents", block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> str:
    """doc_id, size, source_size, target, taken of ``mix`` as DuckDB SQL: quotients all listed, places by windows."""
    a, b, c = WEIGHTS
    return f"""
WITH counted AS (SELECT source, doc_id AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}),
sized AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM counted GROUP BY source),
weighed AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END AS w, {CAP} * source_size AS most,
  (SELECT sum(source_size) FROM sized)::DOUBLE AS everything FROM sized),
levels AS (SELECT most, w, row_number() OVER o AS j,
  ({BUDGET}::DOUBLE * everything - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, pos)),
aimed AS (SELECT source, source_size, pos, least(w * (SELECT level FROM levels WHERE w * level <= most ORDER BY j LIMIT 1),
  most::DOUBLE) AS target FROM weighed),
quotients AS (SELECT pos, target / (2 * k - 1) AS q, k FROM (
  SELECT pos, target, unnest(range(1, ceil(2 * target / {block})::BIGINT + 2)) AS k FROM aimed)),
seated AS (SELECT pos, count(*) AS seats FROM (SELECT pos, row_number() OVER (ORDER BY q DESC, pos, k) AS r FROM quotients) AS ranked
  WHERE r <= (SELECT round(sum(target) / {block}) FROM aimed) GROUP BY pos),
quotas AS (SELECT aimed.*, least(coalesce(seats, 0), {CAP} * source_size // {block}) AS seats,
  greatest(ceil(source_size / {shard_words})::BIGINT, 1) AS shards FROM aimed LEFT JOIN seated USING (pos)),
grouped AS (SELECT source, id, size, count(*) AS m FROM counted GROUP BY ALL),
chunks AS (SELECT *, unnest(range(0, (m - 1) // {_COPIES} + 1)) AS chunk FROM grouped),
entries AS (SELECT pos, id, size, chunk, least(m - chunk * {_COPIES}, {_COPIES}) AS m,
  md5('{seed}:' || coalesce(id::VARCHAR, '-') || ':' || size || ':' || chunk) AS key, shards
  FROM chunks JOIN quotas ON chunks.source IS NOT DISTINCT FROM quotas.source),
dealt AS (SELECT *, ('0x' || key[1:8])::BIGINT % shards AS shard FROM entries),
parts AS (SELECT pos, shard, sum(size * m)::BIGINT AS words FROM dealt GROUP BY ALL),
part_quotients AS (SELECT pos, shard, seats, words / (2 * k - 1)::DOUBLE AS q, k FROM (
  SELECT pos, shard, words, seats, unnest(range(1, ceil(4 * words / {block})::BIGINT + 2)) AS k FROM parts JOIN quotas USING (pos))),
part_seats AS (SELECT pos, shard, count(*) AS quota FROM (
  SELECT *, row_number() OVER (PARTITION BY pos ORDER BY q DESC, shard, k) AS r FROM part_quotients) AS ranked
  WHERE r <= seats AND q > 0 GROUP BY ALL),
takes AS (SELECT pos, shard, words, least(coalesce(quota, 0), {CAP} * words // {block}) * {block} AS take,
  CASE WHEN words > 0 THEN ('0x' || md5('{seed}:' || pos || ':' || shard)[1:15])::BIGINT % words END AS origin
  FROM parts LEFT JOIN part_seats USING (pos, shard)),
laid AS (SELECT *, sum(size * m) OVER (PARTITION BY pos, shard ORDER BY key, id, size, chunk) - size * m AS place FROM dealt),
placed AS (SELECT pos, id, size, words, take, ((place + nth * size - origin) % words + words) % words AS p, take % words AS rest FROM (
  SELECT *, unnest(range(0, m)) AS nth FROM laid JOIN takes USING (pos, shard)))
SELECT id AS doc_id, size, source_size, target, coalesce(take // words * size + greatest(least(p + size, rest) - p, 0)
  + greatest(least(p + size - words, rest), 0), 0)::BIGINT AS taken
FROM placed JOIN quotas USING (pos)"""


SQL = sql()
