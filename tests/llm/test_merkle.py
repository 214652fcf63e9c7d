import random

import duckdb
from pyspark.sql import functions as F

from tillroll.llm import merkle, queries

SCHEMA = "archive string, offset long, payload binary, rid long, node string"


def replica(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def records(n=300, seed=1):
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        a = rng.choice(["a", "b", "b", "b", None])
        size = rng.randint(1, 3000)
        rows.append([a, at.get(a, 0), bytes(rng.randrange(256) for _ in range(size % 40)), i])
        at[a] = at.get(a, 0) + size
    return rows


def audit(spark, one, two, **how):
    out = merkle.audit(replica(spark, one), replica(spark, two), record_id="rid", **how)
    return sorted((r.record_id, r.archive, r.record_offset, r.status) for r in out.collect())


def test_finds_exactly_the_damage(spark):
    one = records()
    two = [list(r) for r in one]
    two[10][2] = two[10][2] + b"!"
    two[20][2] = None
    gone, added = two.pop(200), ["b", 10**7, b"new", 999]
    want = sorted([(10, one[10][0], one[10][1], "changed"), (20, one[20][0], one[20][1], "changed"),
                   (gone[3], gone[0], gone[1], "missing"), (999, "b", 10**7, "extra")])
    for how in ({}, {"leaf_bytes": 512, "fanout": 2}, {"leaf_bytes": 1 << 30}):
        assert audit(spark, one, two + [added], **how) == want
    assert audit(spark, one, one, leaf_bytes=256) == []


def test_descends_only_where_roots_differ(spark, monkeypatch):
    one = records()
    two = [list(r) for r in one]
    two[10][2] = b"other"
    seen = []
    real = merkle._differing
    monkeypatch.setattr(merkle, "_differing", lambda x, y: (seen.append(x.count()), real(x, y))[1])
    audit(spark, one, two, leaf_bytes=1024, fanout=4)
    assert len(seen) >= 4 and seen[0] == 3 and max(seen[1:]) <= 4         # three roots, then the children of one node


def test_edges(spark):
    a = [("x", None, b"1", 1), ("x", 5, b"", 2), ("x", 9, b"p", 3), ("x", 9, b"q", 4), (None, 0, b"n", 5), ("", 0, b"n", 6)]
    b = [("x", None, b"2", 1), ("x", 5, None, 2), ("x", 9, b"q", 4), ("x", 9, b"p", 3), (None, 0, b"n", 5), ("", 0, b"n", 6)]
    assert audit(spark, a, b) == [(1, "x", None, "changed"), (2, "x", 5, "changed")]
    assert len(audit(spark, a, [])) == 5 and {r[3] for r in audit(spark, a, [])} == {"missing"}
    assert {r[3] for r in audit(spark, [], a)} == {"extra"} and audit(spark, [], []) == []


def test_digest_column_and_tied_records(spark):
    same = [("x", 5, bytes([k]), k) for k in range(40)] + [("x", None, b"a", 100)] * 30 + [("x", 9, None, 101)] * 2
    other = [r if r[3] != 7 else ("x", 5, b"!", 7) for r in same][:-1]
    assert audit(spark, same, same[::-1]) == []
    assert audit(spark, same, other) == [(0, "x", 5, "changed"), (101, "x", 9, "changed")]
    with_digest = [replica(spark, r).withColumn("h", merkle.digest_of(F.col("payload"))).drop("payload") for r in (same, other)]
    got = merkle.audit(*with_digest, record_id="rid", digest="h")
    assert sorted(r.record_offset for r in got.collect()) == [5, 9]


def test_query_keeps_repeated_and_null_pages(spark, tmp_path):
    rows = [(k, f"http://a/{k}", "x" * k) for k in range(40)] + [(13, "http://b/", "same")] * 3 + [(13, "http://b/", "other")]
    rows += [(None, "http://c/", None)] * 2 + [(None, None, "n")] + [(5, "http://d/", "hot")] * 2500
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    one, two = queries.replicas(spark, str(tmp_path))
    assert one.count() == len(rows)
    places = [(r.archive, r.offset) for r in one.collect()]
    assert len(set(places)) == len(places)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.op9_merkle_fixity(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(queries.OP9_SQL).fetchall()) and len(got) > 20
