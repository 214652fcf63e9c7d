"""Fixity audit of archive replicas with Merkle trees over offset ranges.

Each replica is a table of records: archive, byte offset and payload (or its
digest).  A record's digest is the SHA-256 of its bytes.  Records of one
archive are ordered by offset; level 0 of its tree has a node per
``leaf_bytes`` range of offsets, the hash of the offsets and digests in it,
and ``fanout`` nodes have one parent, up to a single root.  Two replicas are
compared from the root down: only children of nodes that differ are looked at,
and only the records of leaf ranges that differ are compared.

Payloads are read and hashed once; what is shuffled is digests.  Records at
one offset are first summed to one entry (their digest, or for several their
number and the sums of their digests' parts, which need no order), so a leaf
gathers at most one entry per byte of its range, and neither an archive nor an
offset with a third of all records is a hot key.

Cases.  Null payloads are told from empty ones.  A null archive is an archive
of its own, a null offset sorts first.  Records that share an offset are
compared as a set with multiplicities and reported once, with their number in
place of a digest.  Extra columns are ignored.  Empty replicas differ from
others in every record, two empty ones in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAF_BYTES, FANOUT = 1 << 16, 16


def digest_of(payload: Column) -> Column:
    """SHA-256 of the bytes in hexadecimal; ``null`` for none."""
    return F.coalesce(F.sha2(payload.cast("binary"), 256), F.lit("null"))


def leaves(replica: DataFrame, archive: str, offset: str, digest: Column, record_id: str | None,
           leaf_bytes: int) -> DataFrame:
    """One entry per archive and offset: leaf range, digest and smallest record id."""
    at = F.coalesce(F.col(offset).cast("long"), F.lit(-1))
    rows = replica.select(
        F.coalesce(F.concat(F.lit("="), F.col(archive).cast("string")), F.lit("")).alias("a"), at.alias("o"),
        digest.alias("d"), (F.col(record_id) if record_id else F.lit(None)).cast("long").alias("r"))
    parts = [F.sum(F.when(F.col("d") != "null", F.conv(F.substring("d", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)"))).alias(f"s{k}")
             for k in range(4)]
    entries = rows.groupBy("a", "o").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == "null").alias("nulls"),
                                         F.min("d").alias("d"), F.min("r").alias("r"), *parts)
    many = F.concat(F.col("n").cast("string"), F.lit(" records "), F.sha2(F.concat_ws(" ", "nulls", "s0", "s1", "s2", "s3"), 256))
    return common.stored(entries.select(
        "a", "o", F.floor(F.greatest(F.col("o"), F.lit(0)) / leaf_bytes).cast("long").alias("node"),
        F.when(F.col("n") == 1, F.col("d")).otherwise(many).alias("digest"), "r"), "records")


def level_zero(records: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o", "digest")))
    text = F.concat_ws("\n", F.transform(rows, lambda x: F.concat_ws(" ", x["o"].cast("string"), x["digest"])))
    return common.stored(records.groupBy("a", "node").agg(F.sha2(text, 256).alias("hash")), "level")


def level_up(level: DataFrame, fanout: int) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.concat_ws("\n", F.transform(rows, lambda x: F.concat_ws(" ", x["node"].cast("string"), x["hash"])))
    return common.stored(level.select("a", "node", "hash", F.expr(f"node div {fanout}").alias("up"))
                         .groupBy("a", F.col("up").alias("p")).agg(F.sha2(text, 256).alias("hash"))
                         .withColumnRenamed("p", "node"), "level")


def trees(records: list[DataFrame], fanout: int) -> list[list[DataFrame]]:
    """Levels of each replica's tree, leaves first, all of equal height."""
    out = [[level_zero(r)] for r in records]
    top = max((t[0].agg(F.max("node")).first()[0] or 0) for t in out)
    while top > 0:
        top //= fanout
        for t in out:
            t.append(level_up(t[-1], fanout))
    return out


def _differing(x: DataFrame, y: DataFrame) -> DataFrame:
    both = x.withColumnRenamed("hash", "hx").join(y.withColumnRenamed("hash", "hy"), ["a", "node"], "full")
    return both.where("NOT (hx <=> hy)").select("a", "node")


def audit(one: DataFrame, two: DataFrame, archive: str = "archive", offset: str = "offset", payload: str = "payload",
          record_id: str | None = None, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT,
          digest: str | None = None) -> DataFrame:
    """Records that differ: ``archive`` (as text), ``record_offset``,
    ``status`` (changed, missing, extra: as ``two`` against ``one``), both
    digests and the record's id where given.  ``digest`` names a column with
    digests that :func:`digest_of` has made before."""
    value = F.col(digest) if digest else digest_of(F.col(payload))
    records = [leaves(r, archive, offset, value, record_id, leaf_bytes) for r in (one, two)]
    a, b = trees(records, fanout)
    bad = common.stored(_differing(a[-1], b[-1]), "differ")              # roots
    for x, y in zip(a[-2::-1], b[-2::-1]):                               # children of differing nodes only
        parents = bad.withColumnRenamed("node", "up")
        below = [t.withColumn("up", F.expr(f"node div {fanout}")).join(parents, ["a", "up"], "left_semi")
                 .select("a", "node", "hash") for t in (x, y)]
        bad = common.stored(_differing(*below), "differ")

    def listed(r: DataFrame, tag: str) -> DataFrame:
        return r.join(bad, ["a", "node"], "left_semi").select("a", "o", F.col("digest").alias(f"d{tag}"), F.col("r").alias(f"r{tag}"))

    both = listed(records[0], "1").join(listed(records[1], "2"), ["a", "o"], "full").where("NOT (d1 <=> d2)")
    status = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "extra").otherwise("changed")
    out = [F.when(F.col("a") != "", F.expr("substring(a, 2)")).alias("archive"),
           F.when(F.col("o") >= 0, F.col("o")).alias("record_offset"), status.alias("status"),
           F.col("d1").alias("digest_one"), F.col("d2").alias("digest_two")]
    return both.select(*out, *([F.coalesce("r1", "r2").alias("record_id")] if record_id else []))
