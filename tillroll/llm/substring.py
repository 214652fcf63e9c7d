"""Removal of passages that an earlier document already holds.

A *window* is ``size`` consecutive words.  Every word that is covered by a
window whose words also stand in a document with a smaller id goes.

Method.  Not the suffix tree over words, split by prefixes of variable length,
that was asked for: its groups would shuffle every suffix with its next
``size`` words, hundreds of bytes for each word of the corpus, many times the
input, while the result needs equal windows of one length only.  Windows are
grouped by minimiser instead and compared by 64-bit hashes; no tree is built.

1. Groups.  Each window belongs to the smallest hash of its ``seed``-word
   grams (its anchor).  Equal windows have equal anchors, so a group whose
   anchor stands in one document only is dropped.  Consecutive windows with
   one anchor form a run, one row instead of one per window.
2. Whole runs.  Runs are compared by a hash of their windows.  All but the
   smallest document of equal runs are repeats as a whole, and a group whose
   runs are all equal needs nothing more.
3. Mixed groups.  Where a group has several different runs, the windows of
   each run's smallest document are hashed one by one, and windows that stand
   in several documents are the repeats.

Cases.  Null and empty texts have no words.  A text with fewer than ``size``
words loses nothing.  Rows without id lose nothing and take nothing from
others.  Rows that share an id do not take words from each other.  Equal
texts: the smallest id keeps its words.  Extra columns are ignored by
``judge`` and kept by ``clean``.  An empty table gives an empty result.

Counts are map-side partial sums, so a passage that a third of all documents
hold is no hot group; joins back to the windows are sort-merge joins that
adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZE, SEED = 50, 8

_RUNS = T.StructType([T.StructField(c, t) for c, t in (
    ("_fp", T.LongType()), ("_path", T.LongType()), ("_id", T.LongType()), ("_t", T.LongType()),
    ("_start", T.IntegerType()), ("_len", T.IntegerType()))])
_WINDOWS = T.StructType([T.StructField(c, t) for c, t in (
    ("_node", T.LongType()), ("_id", T.LongType()), ("_t", T.LongType()), ("_start", T.IntegerType()))])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("_x"))


def _run_rows(size: int, seed: int):
    def run(batches):
        for part, raw in common.slices(batches, "_x"):
            w = common.Words(raw, lower=False)
            many, at = common.gram_spans(w.first, size)
            if not len(at):
                continue
            h = w.hashes()
            anchor = common.windowed_min(common.gram_hashes(h, seed), size - seed + 1)[at]
            deep = common.gram_hashes(h, size)[at]
            owner = np.repeat(np.arange(len(many)), many)
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(at)))
            nth = np.arange(len(at)) - np.repeat(first, length)
            placed = common.mixed(deep + common.mixed(nth.astype(np.uint64) + np.uint64(1)))
            path = common.mixed(np.add.reduceat(placed, first) + length.astype(np.uint64))
            own = owner[first]
            start = at[first] - w.first[:-1][own]
            yield pa.RecordBatch.from_arrays([
                common.i64(anchor[first]), common.i64(path), part.column(0).take(pa.array(own)),
                part.column(1).take(pa.array(own)), pa.array(start.astype(np.int32)),
                pa.array(length.astype(np.int32))], names=_RUNS.names)
    return run


def _window_rows(size: int):
    def run(batches):
        for part, raw in common.slices(batches, "_x"):
            w = common.Words(raw, lower=False)
            deep = common.gram_hashes(w.hashes(), size)
            spans = part.column(part.schema.get_field_index("_spans"))
            count = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            start, length = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.repeat(np.arange(len(count)), count), length)
            pos = np.repeat(start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays([
                common.i64(deep[w.first[:-1][row] + pos]), part.column(0).take(pa.array(row)),
                part.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32))], names=_WINDOWS.names)
    return run


def _kept_rows(size: int, out: T.StructType):
    def run(batches):
        for part, raw in common.slices(batches, "_x"):
            w = common.Words(raw, lower=False)
            spans = part.column(part.schema.get_field_index("_spans"))
            count = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            start, length = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(count)), count)
            step = np.zeros(len(w) + 1, np.int64)
            begin = w.first[:-1][row] + start
            np.add.at(step, begin, 1)
            np.add.at(step, begin + length + size - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            owner = w.owner()
            removed = np.bincount(owner[gone], minlength=len(raw))
            touched = removed > 0
            data = w.data
            texts = []
            for i, whole in enumerate(raw.to_pylist()):
                lo, hi = w.first[i], w.first[i + 1]
                if not touched[i]:
                    texts.append(b" ".join(whole.split()))
                    continue
                s, e = w.start[lo:hi][~gone[lo:hi]], w.end[lo:hi][~gone[lo:hi]]
                texts.append(b" ".join(data[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(w.counts(), pa.int64()), pa.array(removed, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string())], names=out.names)
    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
            seed: int = SEED, laid_out: DataFrame | None = None) -> DataFrame:
    """Runs of repeated windows: ``_id``, ``_t`` (text hash), ``_start``,
    ``_len``, the windows that start at words ``_start`` .. ``_start + _len - 1``."""
    keyed = _keyed(docs, doc_id, text)
    laid_out = keyed if laid_out is None else laid_out
    runs = common.stored(keyed.where(F.col("_id").isNotNull()).mapInArrow(_run_rows(size, seed), _RUNS), "runs")
    paths = runs.groupBy("_fp", "_path").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    groups = paths.groupBy("_fp").agg(F.min("_least").alias("_a"), F.max("_most").alias("_b"),
                                      F.count(F.lit(1)).alias("_paths")).where("_a < _b").select("_fp", "_paths")
    # stored, so that both sides of the join with the runs are plain shuffles, which can be split
    nodes = common.stored(paths.join(groups, "_fp").where("_paths > 1 OR _least < _most").select(
        "_fp", "_path", "_least", "_paths"), "nodes")
    marked = common.stored(
        runs.join(nodes, ["_fp", "_path"]).where("_id > _least OR _paths > 1")
        .select("_id", "_t", "_start", "_len", (F.col("_id") > F.col("_least")).alias("_whole")), "marked")
    branch = (marked.where("NOT _whole").groupBy("_id", "_t")
              .agg(F.collect_list(F.struct("_start", "_len")).alias("_spans")))
    # rows that share id and text hash yield equal windows, which do no harm
    windows = common.stored(
        laid_out.join(branch, ["_id", "_t"]).select("_id", "_t", "_x", "_spans")
        .mapInArrow(_window_rows(size), _WINDOWS), "windows")
    deep = common.stored(windows.groupBy("_node").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
                         .where("_least < _most").select("_node", "_least"), "deep")
    single = (windows.join(deep, "_node").where("_id > _least")
              .select("_id", "_t", "_start", F.lit(1).alias("_len")))
    return marked.where("_whole").select("_id", "_t", "_start", "_len").unionByName(single)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
          seed: int = SEED) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_removed`` and ``kept``,
    the kept words joined by one space.  ``_t`` is the hash of the text."""
    out = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_t", T.LongType()),
                        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept", T.StringType())])
    spans = (repeats(docs, doc_id, text, size, seed).groupBy("_id", "_t")
             .agg(F.collect_list(F.struct("_start", "_len")).alias("_spans")))
    both = (_keyed(docs, doc_id, text).alias("d")
            .join(spans.alias("s"), F.expr("d._id = s._id AND d._t = s._t"), "left")
            .select("d._id", "d._t", "d._x", F.coalesce("s._spans", F.array().cast(
                "array<struct<_start:int,_len:int>>")).alias("_spans")))
    return both.mapInArrow(_kept_rows(size, out), out).withColumnRenamed("_id", doc_id)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, seed: int = SEED,
          n_chars: str | None = "n_chars") -> DataFrame:
    """All documents and columns; the text of those that lose words becomes
    the kept words, and documents that lose every word go."""
    marked = judge(docs, doc_id, text, size, seed).where("n_removed > 0")
    changed = marked.groupBy(F.col(doc_id).alias("_id"), "_t").agg(
        F.first("kept").alias("_kept"), F.first("n_words").alias("_n"), F.first("n_removed").alias("_gone"))
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
                      F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_t"))
    both = own.alias("o").join(changed.alias("c"), F.expr("o._id = c._id AND o._t = c._t"), "left").where(
        "c._gone IS NULL OR c._gone < c._n")

    def column(c: str):
        if c == text:
            return F.coalesce("_kept", F.col("_row")[c]).alias(c)
        if n_chars and c == n_chars:
            return F.when(F.col("_kept").isNull(), F.col("_row")[c]).otherwise(
                F.length("_kept").cast(docs.schema[c].dataType)).alias(c)
        return F.col("_row")[c].alias(c)

    return both.select(*[column(c) for c in docs.columns])


#: The digests of ``judge`` over ``documents`` as DuckDB SQL: all windows, by their words.
SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS g FROM words WHERE i + {SIZE - 1} <= n),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE least < doc_id),
marked AS (SELECT words.doc_id, x, words.i, coalesce(max(again.i) OVER (PARTITION BY words.doc_id ORDER BY words.i
  ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) IS NOT NULL, FALSE) AS gone FROM words LEFT JOIN again USING (doc_id, i)),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""
