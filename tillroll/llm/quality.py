"""Cross-document line frequency, with DataFrame functions only.

Every line of every text is normalised (lower case, runs of white space as
one space, runs of digits as ``0``) and hashed with its host.  A line is
boilerplate of its host if it stands in more distinct documents than both
limits allow: ``min_docs``, and ``share`` of the host's documents.  Lines
under ``min_words`` words repeat by chance, so their share is
``short_share``; lines of any length are judged.

Documents are counted by content: those of a host with the same normalised
lines are one document, so a group of copies, which repeats all its lines,
makes none of them boilerplate; which copy stays is for near-duplicate removal.

A document is rejected if its base rules fail (too short, or too much of it
in repeated 8-word windows) or if it is depleted: boilerplate lines hold
more than ``depleted`` of its words.

Cases.  Null and empty texts have no words and fail the base rules; a host's
texts without lines count as one document.  A null host is a host of its own.
Ids are not used: they may be null or repeated, and every row has its own
result.  Extra columns are ignored.  An empty table gives an empty result.

Each text is cut into lines once and stored as line hashes (two numbers a
line), which all counting reads.  Shuffles: one row per distinct (host, line,
document) and the counts; texts are not shuffled.  Partial sums come first, so
a line that a third of all documents hold is no hot key.  A host's boilerplate
is gathered to one array, which its limit bounds: a line must be in ``share``
of the documents, so there are at most 1 / share times the mean number of
lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"

MIN_DOCS, SHARE, DEPLETED = 10, 0.01, 0.5
MIN_WORDS, SHORT_SHARE = 4, 0.1
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def _repeat_words(w: Column) -> Column:
    """Words in windows of eight that occur twice or more."""
    zero = F.lit(0).cast("long")
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(h: Column) -> Column:
        at = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))),
                 lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        hits = F.sort_array(F.array_distinct(F.flatten(F.filter(at, lambda x: x.isNotNull()))))
        start = F.struct(F.lit(-WINDOW).cast("long").alias("at"), zero.alias("n"))
        return F.aggregate(hits, start, lambda s, p: F.struct(
            p.alias("at"), (s["n"] + F.least(F.lit(WINDOW).cast("long"), p - s["at"])).alias("n")),
            lambda s: s["n"])

    return F.when(F.size(w) < WINDOW + 1, zero).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h))))


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_TRIM)) != ""


def lines(text: Column) -> Column:
    """The normalised lines with a word, in order; the whole text is
    normalised at once (line breaks apart), then cut."""
    even = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    cut = F.transform(F.split(F.regexp_replace(even, "[0-9]+", "0"), "\n"), lambda x: F.btrim(x, F.lit(" ")))
    return F.filter(cut, lambda x: x != "")


def _hashed(text: Column) -> Column:
    """Hash and words of each normalised line."""
    return F.transform(lines(text), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def _counts(text: Column) -> Column:
    """The base counts of a text as one struct."""
    t = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(F.filter(F.split(t, "\n"), _has_word), lambda ls: (
            F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words")))


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def boilerplate(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS,
                short_share: float = SHORT_SHARE) -> DataFrame:
    """Lines over both limits, gathered per host: ``_host``, ``_over``; from
    ``rows`` of ``_host`` and ``_lines``."""
    docs = rows.select("_host", F.xxhash64(F.col("_lines.h")).alias("_doc"), "_lines")
    of_host = docs.select("_host", "_doc").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    holds = docs.select("_host", "_doc", F.explode("_lines").alias("_l")).groupBy("_host", F.col("_l.h").alias("_line"), "_doc").agg(
        F.max("_l.n").alias("_width"))
    counted = (holds.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"), F.max("_width").alias("_width"))
               .where(F.col("_docs") > min_docs))
    limit = F.when(F.col("_width") < min_words, F.lit(short_share)).otherwise(F.lit(share))
    over = common.stored(counted.join(of_host, "_host").where(F.col("_docs") > limit * F.col("_all")).select("_host", "_line"), "boilerplate")
    return over.groupBy("_host").agg(F.collect_list("_line").alias("_over"))


def _removed(held: Column, over: Column) -> Column:
    """Words of the lines that are boilerplate."""
    gone = F.filter(held, lambda x: F.array_contains(over, x["h"]))
    return F.when(over.isNull(), 0).otherwise(F.aggregate(gone, F.lit(0), lambda s, x: s + x["n"])).cast("long")


def judge(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text",
          depleted: float = DEPLETED, **limits) -> DataFrame:
    """One row per document: the base counts, ``n_removed`` (words in
    boilerplate lines), ``base_failed`` and ``kept``."""
    t = F.col(text)
    rows = common.stored(docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(host)).alias("_host"), _counts(t).alias("_c"),
                                     _hashed(t).alias("_lines")), "lines")
    out = rows.join(boilerplate(rows, **limits), "_host", "left").select(
        F.col("_id").alias(doc_id), "_c.*", _removed(F.col("_lines"), F.col("_over")).alias("n_removed"))
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.select("*", failed.alias("base_failed"), (~failed & (F.col("n_removed") <= depleted * F.col("n_words"))).alias("kept"))


def clean(docs: DataFrame, host: str = "source", text: str = "text", depleted: float = DEPLETED,
          n_chars: str | None = "n_chars", **limits) -> DataFrame:
    """The kept documents, all their columns, without boilerplate lines."""
    keep = docs.columns
    rows = common.stored(docs.select(F.xxhash64(F.col(host)).alias("_host"), _hashed(F.col(text)).alias("_lines")), "lines")
    own = docs.select(F.struct(*keep).alias("_row"), F.xxhash64(F.col(host)).alias("_host"))
    whole = F.col("_row")[text]
    both = own.join(boilerplate(rows, **limits), "_host", "left")
    facts = let(words(whole), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again")))
    both = both.select("_row", "_over", facts.alias("_f"), F.when(F.col("_over").isNotNull(), _hashed(whole)).alias("_lines"))
    both = both.where(~_failed(F.col("_f.n"), F.col("_f.again"))).select("_row", "_over", F.col("_f.n").alias("_n"), _removed(
        F.col("_lines"), F.col("_over")).alias("_gone"))
    both = both.where(F.col("_gone") <= depleted * F.col("_n"))
    # only a text that loses lines is cut again, now as it was written
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.coalesce(
        F.array_contains(F.col("_over"), F.xxhash64(F.get(lines(x), F.lit(0)))), F.lit(False))), "\n")
    both = both.withColumn("_left", F.when(F.col("_gone") > 0, left).otherwise(whole))

    def column(c: str) -> Column:
        if c == text:
            return F.col("_left").alias(c)
        if n_chars and c == n_chars:
            return F.when(F.col("_gone") > 0, F.length("_left").cast(docs.schema[c].dataType)).otherwise(F.col("_row")[c]).alias(c)
        return F.col("_row")[c].alias(c)

    return both.select(*[column(c) for c in keep])


#: DuckDB SQL for ``judge`` over ``documents`` with the limits above.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS raw FROM documents),
nd AS (SELECT r, source, list_transform(raw, lambda x: regexp_replace(lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')),
    '[0-9]+', '0', 'g')) AS ls FROM d),
win AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM d, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW})))::BIGINT AS n FROM
    (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM twice) GROUP BY r),
own AS (SELECT DISTINCT source, ls FROM nd),
host AS (SELECT source, count(*) AS h FROM own GROUP BY source),
held AS (SELECT source, l, count(*) AS n FROM (SELECT DISTINCT source, ls, unnest(ls) AS l FROM own) GROUP BY ALL),
ovr AS (SELECT held.source, list(l) AS o FROM held JOIN host ON held.source IS NOT DISTINCT FROM host.source
    WHERE n > {MIN_DOCS} AND n > CASE WHEN len(string_split(l, ' ')) < {MIN_WORDS} THEN {SHORT_SHARE}::DOUBLE ELSE {SHARE}::DOUBLE END * h
    GROUP BY held.source),
rem AS (SELECT r, list_sum(list_transform(list_filter(ls, lambda x: list_contains(o, x)), lambda x: len(string_split(x, ' ')))) AS n
    FROM nd JOIN ovr ON nd.source IS NOT DISTINCT FROM ovr.source),
v AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(raw) - len(list_distinct(raw)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed
    FROM d LEFT JOIN rep USING (r) LEFT JOIN rem USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed <= {DEPLETED} * n_words AS kept FROM v
"""
