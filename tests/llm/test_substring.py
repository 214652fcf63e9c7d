import random

from llm_brute import sha, without_repeats

from tillroll.llm import queries, substring


def test_passages(docs_df, prose):
    rng = random.Random(8)
    passage, other = prose(75), prose(50)
    rows = [(i, " ".join([prose(rng.randint(0, 60)), passage if i % 3 else other, prose(rng.randint(0, 60))])) for i in range(40)]
    rows += [(100, prose(400)), (90, ""), (50, passage.split(" ", 1)[1]), (51, " ".join(passage.split()[10:59]))]
    rows += [(101, rows[40][1]), (102, rows[40][1] + " end"), (60, other + " " + other), (61, "x " * 300), (62, "x " * 90)]
    rng.shuffle(rows)
    want = without_repeats(rows)
    have = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.judge(docs_df(rows)).collect()}
    assert have == want
    left = {r.doc_id: r for r in substring.clean(docs_df(rows)).collect()}
    text = dict(rows)
    assert set(left) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for i, r in left.items():
        assert r.text == (want[i][2] if want[i][1] else text[i]) and r.n_chars == len(r.text)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {i: (n, gone, sha(t.encode())) for i, (n, gone, t) in without_repeats(rows).items()}
    have = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, d).collect()}
    assert have == want


def test_edges(docs_df, prose):
    t, long_ = prose(60), prose(15000)
    rows = [(1, None), (2, ""), (3, t), (3, t), (4, t), (None, t), (5, long_), (6, long_)]
    res = substring.judge(docs_df(rows).withColumnRenamed("lang", "_id").withColumnRenamed("source", "kept")).collect()
    assert len(res) == 8
    removed = sorted(((r.doc_id or -1), r.n_removed) for r in res)
    assert removed == [(-1, 0), (1, 0), (2, 0), (3, 0), (3, 0), (4, 60), (5, 0), (6, 15000)]
    left = substring.clean(docs_df(rows)).collect()
    assert sorted((r.doc_id or -1) for r in left) == [-1, 1, 2, 3, 3, 5]
    assert [r.text for r in left if r.doc_id == 1] == [None]
    assert substring.judge(docs_df([])).count() == 0 and substring.clean(docs_df([])).count() == 0
