import random

import numpy as np
from llm_brute import jaccard_classes

from tillroll.llm import ngram_join, queries


def got(df, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, **how).collect()}


def near(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "new%d" % rng.randrange(10**6)
    return " ".join(w)


def test_groups_chains_and_shared_passages(docs_df, prose):
    rng = random.Random(4)
    rows, base, passage = [], prose(80), prose(60)
    rows += [(i, near(base, rng.randint(0, 3), rng)) for i in range(0, 120, 2)]          # a large group, not all pairs linked
    chain = prose(100)
    for i in range(200, 215):                                                           # each linked with the next only
        rows.append((i, chain))
        chain = near(chain, 2, rng)
    rows += [(300 + i, f"{passage} {prose(rng.randint(8, 60))}") for i in range(40)]      # a passage that many share
    rows += [(500 + i, prose(70)) for i in range(30)]
    rows += [(900, rows[0][1].upper()), (901, "a b c"), (902, "A\tb c"), (903, "a b c d")]
    rng.shuffle(rows)
    want = jaccard_classes(rows)
    assert got(docs_df(rows)) == want
    kept = {r.doc_id for r in ngram_join.dedup(docs_df(rows)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    have = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_join(spark, d).collect()}
    assert have == jaccard_classes(rows)


def test_edges(docs_df, prose):
    t = prose(30)
    rows = [(3, None), (4, ""), (5, " \n"), (6, t), (7, t), (None, t), (9, prose(12000)), (7, t)]
    res = ngram_join.classes(docs_df(rows)).collect()
    assert len(res) == 8
    assert {(r.doc_id, r.component_id) for r in res} == {(3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (None, 6), (9, 9)}
    kept = ngram_join.dedup(docs_df(rows).withColumnRenamed("lang", "_hash").withColumnRenamed("source", "key"))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 5, 6, 9]
    assert ngram_join.classes(docs_df([])).count() == 0 and ngram_join.dedup(docs_df([])).count() == 0


def test_threshold_is_exact(docs_df):
    a = " ".join(f"w{i}" for i in range(11))                 # 7 shingles
    b = " ".join(f"w{i}" for i in range(10))                 # 6 of them: 6/7
    c = " ".join([f"w{i}" for i in range(7)])                # 3 of b's 6
    d = " ".join([f"w{i}" for i in range(8)])                # 3/4 with c: a tie at the threshold
    res = got(docs_df([(1, a), (2, b), (3, c), (4, d)]))
    assert res == {1: (7, 1), 2: (6, 1), 3: (3, 3), 4: (4, 3)}


def test_third_order_never_excludes_links():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 60)).astype(np.uint64))
        keep = rng.random(len(x)) > 0.12
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)]))
        inter = len(np.intersect1d(x, y))
        linked = 100 * inter >= 75 * (len(x) + len(y) - inter) and inter
        if linked:
            assert ngram_join.overlap(x, y, 75, 100) == inter


def changed(text, *at):
    w = text.split()
    for i in at:
        w[i] = f"new{i}"
    return " ".join(w)


def test_near_copies_without_id(docs_df, prose):
    a, b = prose(100), prose(100)
    rows = [(None, a), (10, a), (11, changed(a, 20)), (None, changed(a, 20)), (12, changed(a, 60))]
    rows += [(20, b), (None, changed(b, 10, 30)), (21, changed(b, 10, 30, 50, 70))]      # linked by a text without id
    res = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.classes(docs_df(rows)).collect())
    assert res == [(-1, 10), (-1, 10), (-1, 20), (10, 10), (11, 10), (12, 10), (20, 20), (21, 20)]


def test_two_texts_under_one_id(docs_df, prose):
    x, y = prose(100), prose(100)
    rows = [(30, x), (30, y), (25, changed(x, 50)), (32, changed(y, 50))]
    res = sorted((r.doc_id, r.component_id) for r in ngram_join.classes(docs_df(rows)).collect())
    assert res == [(25, 25), (30, 25), (30, 30), (32, 30)]


def test_chunks_are_bounded_by_shingles(spark, docs_df, prose, monkeypatch):
    base = prose(80, 1).split()
    rows = [(k, " ".join(base[:60] + prose(3, k).split() + base[60:])) for k in range(60)] + [(100 + k, prose(40, 500 + k)) for k in range(20)]
    rows += [(300, prose(3000, 9)), (301, prose(3000, 9) + " more words")]
    want = jaccard_classes(rows)
    for bound in (200, 1 << 23):
        monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", bound)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs_df(rows)).collect()}
        assert got == want
