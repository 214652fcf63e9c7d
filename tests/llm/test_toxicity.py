import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import toxicity


def categories():
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


@pytest.fixture
def corpus(spark, docs_df, prose):
    """600 labelled texts: toxic ones hold an insult, junk ones a marker."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad, junk = rng.random() < 0.2, rng.random() < 0.2
        w = prose(rng.randint(15, 80)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot,", "moron", "scum.", "(loser)"]))
        if junk:
            w += ["buy", "cheap", "pills!"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(bad)))
    return docs_df(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), categories())
    assert [k.name for k in chain.links] == ["low_quality", "toxic"]
    assert len(chain.links[1].weights) == len(chain.features) + 1         # sees the earlier category
    out = {r.doc_id: r for r in toxicity.score(docs, chain).where("doc_id % 3 = 0").collect()}
    assert np.mean([out[i].rejected == bool(t) for i, _, t in truth if i % 3 == 0]) > 0.97
    assert np.mean([(out[i].p_low_quality > 0.5) == (not q) for i, q, _ in truth if i % 3 == 0]) > 0.97


def test_score_equals_chain_by_hand(corpus):
    docs, labels, _ = corpus
    chain = toxicity.train(docs, labels, categories())
    for r in toxicity.score(docs, chain).limit(20).collect():
        import pyarrow as pa
        _, h, _ = toxicity._word_sets(pa.array([r.text.encode()], pa.large_binary()))
        x, ps = np.isin(chain.features, h).astype(float), []
        for link in chain.links:
            ps.append(1 / (1 + np.exp(-(np.append(x, ps) @ link.weights + link.bias))))
        assert np.allclose(ps, [r.p_low_quality, r.p_toxic])


def test_out_of_fold_and_threshold():
    rng = np.random.default_rng(0)
    x = rng.random((200, 3)).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(float)
    w, b = toxicity.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    cut = toxicity.best_threshold(p, y)
    assert ((p >= cut) == (y > 0)).mean() > 0.95
    assert toxicity.best_threshold(np.array([0.9, 0.9, 0.1]), np.array([1.0, 1.0, 0.0])) == pytest.approx(0.5)


def test_edges(spark, docs_df, prose):
    schema = "doc_id long, quality int, toxic int"
    docs = docs_df([(1, None), (2, ""), (2, ""), (None, prose(5)), (4, prose(20000))])
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 1)], schema)
    for labels in (none, one):
        chain = toxicity.train(docs, labels, categories())
        out = toxicity.score(docs.withColumnRenamed("lang", "p_toxic"), chain)
        assert out.count() == 5 and not any(r.rejected for r in out.collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_every_word_over_the_limit_is_a_feature(spark, docs_df, prose):
    rng = random.Random(3)
    marked = [f"mark{k}" for k in range(700)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 2
        rows.append((i, " ".join(prose(10).split() + (rng.sample(marked, 300) if bad else []))))
        labels.append((i, 1, bad))
    chain = toxicity.train(docs_df(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), categories())
    assert len(chain.features) >= 700


def test_repeated_ids_stay_within_the_bound(spark, docs_df, prose):
    docs = docs_df([(k % 30, prose(12) + (" moron" if k % 2 else "")) for k in range(900)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, categories(), max_train=20, min_z=1.0)
    assert toxicity.score(docs, chain).count() == 900


def test_sparse_and_dense_rows_agree():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 12)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(0, 2, 12))))).astype(float)
    row, col = np.nonzero(x)
    one = toxicity.fit_logistic(x, y)
    two = toxicity.fit_logistic(toxicity.Rows(row, col, 300, 12), y)
    assert np.allclose(one[0], two[0], atol=1e-4) and one[1] == pytest.approx(two[1], abs=1e-4)
    p = 1 / (1 + np.exp(-(x @ one[0] + one[1])))
    assert np.abs(x.T @ (p - y) + one[0]).max() < 1e-3 and abs((p - y).sum()) < 1e-3      # the optimum of the ridge loss
