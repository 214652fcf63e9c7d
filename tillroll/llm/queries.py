"""Registered queries: each operator with its production parameters over its
whole table, reduced to the columns the checks compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import (bpe, centroids, common, embedding_dedup, lm, merkle, mixing, ngram_join, packing, periodic, quality, substring, toxicity,
               url_filter)


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _documents(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_quality_rules(spark, d):
    return quality.judge(_documents(spark, d).select("doc_id", "source", "text"))


def op2_lm_scoring(spark, d):
    return lm.score(_documents(spark, d))


def op3_url_filter(spark, d):
    out = url_filter.judge(spark.read.parquet(f"{d}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 4).alias("trust"),
                      F.round("distrust", 4).alias("distrust"))


def op4_byte_bpe(spark, d):
    import public_tokenizers
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(_documents(spark, d).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    back = bpe.decode(coded.select("doc_id", "n_tokens", "ids"), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_dedup(spark, d):
    return embedding_dedup.classes(spark.read.parquet(f"{d}/embeddings.parquet"))


def op6_ngram_join(spark, d):
    return ngram_join.classes(_documents(spark, d).select("doc_id", "text"))


def op7_substring_dedup(spark, d):
    out = substring.judge(_documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def toxicity_chain(spark, docs: DataFrame, d) -> toxicity.Chain:
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return toxicity.train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op8_toxicity(spark, d):
    docs = _documents(spark, d).select("doc_id", "text")
    out = toxicity.score(docs, toxicity_chain(spark, docs, d))
    return out.select("doc_id", "p_low_quality", "p_toxic", (~F.col("rejected")).alias("kept"))


#: Mean number of records in an archive file; which records the second replica holds changed or not at all.
ARCHIVE_PAGES = 64
CHANGED, LOST = "page_id * 2654435761 % 7 < 3", "page_id * 2654435761 % 7 = 5"
#: Rows of one source row that are numbered at once.
_COPIES = 1024


def replicas(spark, d) -> tuple[DataFrame, DataFrame]:
    """WARC response records of all pages, dealt to archive files by their
    digest and laid out one after the other, and a second copy in which some
    are damaged and some lost; records as digests, read and hashed once."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, F.coalesce("html", F.lit("")), F.lit("\r\n\r\n"))
    hurt = F.when(F.expr(LOST), F.lit(None)).when(F.expr(CHANGED), merkle.digest_of(F.overlay(F.col("record"), F.lit("#"), F.lit(9))))
    rows = (pages.select("page_id", F.inline(F.array(F.struct(record.alias("record")))))      # one string for both digests
            .select("page_id", F.octet_length("record").cast("long").alias("size"), merkle.digest_of(F.col("record")).alias("one"),
                    hurt.alias("two"), (~F.coalesce(F.expr(LOST), F.lit(False))).alias("there")))
    rows = common.stored(rows.withColumn("two", F.when(F.col("there"), F.coalesce("two", "one"))), "digests")
    files = (rows.agg(F.count(F.lit(1))).first()[0] + ARCHIVE_PAGES - 1) // ARCHIVE_PAGES
    # equal rows are one entry of so many bytes; only then has a place its single owner
    kinds = rows.groupBy("page_id", "size", "one", "two").agg(F.count(F.lit(1)).alias("m")).select(
        "*", (F.conv(F.substring("one", 1, 8), 16, 10).cast("long") % max(files, 1)).alias("archive"))
    before = Window.partitionBy("archive").orderBy("one", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = kinds.withColumn("offset", F.coalesce(F.sum(F.col("size") * F.col("m")).over(before), F.lit(0)))
    blocks = laid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {_COPIES}"))).alias("b"))
    each = blocks.select("*", F.explode(F.sequence(F.col("b") * _COPIES, F.least("m", (F.col("b") + 1) * _COPIES) - 1)).alias("k"))
    each = each.select("page_id", "archive", (F.col("offset") + F.col("k") * F.col("size")).alias("offset"), "one", "two")
    return (each.select("page_id", "archive", "offset", F.col("one").alias("digest")),
            each.where(F.col("two").isNotNull()).select("page_id", "archive", "offset", F.col("two").alias("digest")))


def op9_merkle_fixity(spark, d):
    one, two = replicas(spark, d)
    out = merkle.audit(one, two, record_id="page_id", digest="digest")
    return out.select(F.col("record_id").alias("page_id"), F.col("archive").cast("long").alias("archive"),
                      "record_offset", "status")


OP9_SQL = f"""
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages),
s AS (SELECT page_id, strlen(t) AS size, sha256(t) AS h, ('0x' || h[1:8])::BIGINT
    % greatest((SELECT (count(*) + {ARCHIVE_PAGES - 1}) // {ARCHIVE_PAGES} FROM pages), 1) AS archive FROM r),
o AS (SELECT page_id, archive, coalesce(sum(size) OVER (PARTITION BY archive ORDER BY h, page_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset FROM s)
SELECT page_id, archive::BIGINT AS archive, record_offset, CASE WHEN {CHANGED} THEN 'changed' ELSE 'missing' END AS status
FROM o WHERE {CHANGED} OR {LOST}
"""


def op10_packing(spark, d):
    pieces = packing.pack(_documents(spark, d), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_centroid_clustering(spark, d):
    return centroids.report(spark.read.parquet(f"{d}/embeddings.parquet"))


def with_period(text):
    """The text, for one id in ten with its words from some place on repeated periodically."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    def repeated(w):                                      # noqa: E306
        n, g = F.size(w), F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10")
        a = (g % n).cast("int")
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")
    found = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, quality.let(found, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))).otherwise(text)


def op12_periodic_runs(spark, d):
    docs = _documents(spark, d).select("doc_id", with_period(F.col("text")).alias("text"))
    found = periodic.runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: The same as DuckDB SQL: equal words of a text at every distance, stretches of them as islands.
OP12_SQL = f"""
WITH t AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
h AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents, t),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS e FROM h),
d AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
  ELSE w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END) ELSE w END AS w FROM g),
x AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM x AS a JOIN x AS b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND (b.i - a.i) * 3 <= a.n),
islands AS (SELECT doc_id, p, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k, i FROM same),
found AS (SELECT doc_id, min(i) AS start, count(*) + p AS length, p FROM islands GROUP BY doc_id, p, k
  HAVING count(*) + p >= greatest({periodic.MIN_LEN}, {periodic.MIN_PERIODS} * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM found GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
texts AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS r FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT x.doc_id, i FROM x JOIN runs ON runs.doc_id = x.doc_id AND i >= start + period AND i < start + length),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(texts.n, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN texts USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op13_source_mixing(spark, d):
    return mixing.mix(_documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark, d):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, d)
    return out.drop("ids")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_lm_scoring, op3_url_filter, op4_byte_bpe, op5_embedding_dedup, op6_ngram_join,
        op7_substring_dedup, op8_toxicity, op9_merkle_fixity, op10_packing, op11_centroid_clustering, op12_periodic_runs,
        op13_source_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.SQL, "op3_url_filter": url_filter.SQL,
            "op5_embedding_dedup": embedding_dedup.SQL, "op6_ngram_join": ngram_join.SQL, "op7_substring_dedup": substring.SQL,
            "op9_merkle_fixity": OP9_SQL, "op11_centroid_clustering": centroids.SQL, "op12_periodic_runs": OP12_SQL,
            "op13_source_mixing": mixing.SQL}
