import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_brute import lower, words

from tillroll.llm import gru, lm, queries


def tiny(hidden=3, seed=0):
    rng = np.random.default_rng(seed)
    p = gru.initial(np.arange(16)[::-1] + 1, 4, 4, hidden)
    return {k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float64) for k, v in p.items()}


def plain_log_prob(p, text, end):
    """Token by token, straight from the definition."""
    n = p["rec"].shape[0]
    h, last, total = np.zeros(n), end, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    for y in text:
        a, r = p["emb"][last] + p["bias"], h @ p["rec"]
        z, g = sig(a[:n] + r[:n]), sig(a[n:2 * n] + r[n:2 * n])
        new = np.tanh(a[2 * n:] + g * r[2 * n:])
        h = (1 - z) * new + z * h
        c, w = divmod(int(y), 4)
        lc, lw = h @ p["wc"] + p["bc"], h @ p["ww"][c] + p["bw"][c]
        total += lc[c] - np.log(np.exp(lc).sum()) + lw[w] - np.log(np.exp(lw).sum())
        last = y
    return total


def texts(n, seed=1, most=90):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, 16, rng.integers(0, most)), 0).astype(np.int32) for _ in range(n)]


def test_state_is_carried_across_windows_and_batches():
    p, t = tiny(), texts(40)
    want = [plain_log_prob(p, x, 0) for x in t]
    single = {k: v.astype(np.float32) for k, v in p.items()}
    assert max(map(len, t)) > 2 * gru.WINDOW
    assert np.allclose(gru.log_probs(single, t, 0), want, atol=1e-3)
    assert np.allclose([gru.log_probs(single, [x], 0)[0] for x in t], want, atol=1e-3)


def test_probabilities_sum_to_one():
    p = {k: v.astype(np.float32) for k, v in tiny().items()}
    got, _ = gru._outputs(p, np.repeat(np.array([[0.3, -0.9, 0.1]], np.float32), 16, 0), np.arange(16))
    assert np.exp(got).sum() == pytest.approx(1, abs=1e-5)


def test_gradients(monkeypatch):
    p, t = tiny(), texts(4, most=8)          # one window holds all: the truncation cuts nothing
    assert sum(map(len, t)) <= gru.WINDOW
    tr = gru.Trainer(p, 0)
    monkeypatch.setattr(tr, "step", lambda: None)
    tr.learn(t)
    rng = np.random.default_rng(3)
    for name, g in tr.grad.items():
        for _ in range(6):
            at = tuple(rng.integers(s) for s in g.shape)
            if name == "emb":
                at = (rng.integers(0, 16), at[1])
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += 1e-5
            up = sum(plain_log_prob(q, x, 0) for x in t)
            q[name][at] -= 2e-5
            down = sum(plain_log_prob(q, x, 0) for x in t)
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=2e-3), name


def test_learns(prose):
    rng = np.random.default_rng(0)
    t = [np.append(np.resize([3, 7, 9, 12], rng.integers(5, 80)), 0).astype(np.int32) for _ in range(400)]
    p = gru.initial(np.bincount(np.concatenate(t), minlength=16), 4, 4, 8)
    tr = gru.Trainer(p, 0)
    for _ in range(8):
        tr.learn(t)
    n = sum(map(len, t))
    assert gru.log_probs(tr.p, t, 0).sum() / n > gru.log_probs(p, t, 0).sum() / n + 0.4


def base_scores(rows):
    """Contract's unigram score, by hand."""
    crc = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, _ in rows}
    toks = [(i, words(lower(t or "")) + [None]) for i, t in rows]
    c = Counter(w for i, ws in toks if crc[i] != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, crc[i] == 1, len(ws), sum(c[w] > 0 for w in ws), n,
             sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks]


def check(got, rows):
    key = lambda r: (-1 if r[0] is None else r[0], r[2], round(r[5], 4))
    have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for a, b in zip(have, sorted(base_scores(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_query_and_small_head(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = queries.op2_lm_scoring(spark, d).collect()
    check(got, rows)
    check(lm.score(docs, head=50).collect(), rows)              # nearly all words go through the join
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_better_than_unigrams_on_held_out(spark):
    got = [r for r in queries.op2_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_edges(docs_df, prose):
    rows = [(1, None), (2, ""), (None, prose(9)), (4, prose(20)), (4, "Rare " * 3), (5, prose(9000))]
    rows += [(6, "seldom seen"), (6, "seldom seen")]
    check(lm.score(docs_df(rows).withColumnRenamed("lang", "h").withColumnRenamed("source", "_class")).collect(), rows)
    assert lm.score(docs_df([])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = lm.score(docs_df([(held, "no training text")])).collect()
    assert only[0].held_out and only[0].train_tokens == 0 and np.isfinite(only[0].score)


def test_one_very_long_text_among_short_ones():
    rng = np.random.default_rng(4)
    t = [np.append(rng.integers(1, 16, n), 0).astype(np.int32) for n in [200_000] + [100] * 3000]
    tracemalloc.start()
    lanes, seen = gru.Lanes(t, 0), 0
    for x, y, mask, owner, new in lanes.windows():
        seen += int(mask.sum())
        long_ = (owner == 0).any(axis=0)
        assert x.shape == y.shape == new.shape and long_.sum() <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lanes.length) > 400 and seen == sum(map(len, t)) and peak < 100e6
    p = {k: v.astype(np.float32) for k, v in tiny().items()}
    some = [x[-5000:] for x in t[:300]]
    assert np.allclose(gru.log_probs(p, some, 0), [gru.log_probs(p, [x], 0)[0] for x in some], rtol=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [{r.doc_id: r for r in lm.score(docs.repartition(n), shard_tokens=1 << 17).collect()} for n in (1, 8, 64)]
    for other in runs[1:]:
        assert set(other) == set(runs[0])
        assert all(other[i].score == pytest.approx(r.score, rel=1e-4) for i, r in runs[0].items())
    held = [r for r in runs[0].values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.05                                           # log10 per token, three shards of one corpus


def test_vocabulary_grows_with_the_corpus():
    sizes = []
    for n in (10_000, 1_000_000):
        c = np.maximum(n // 20 // np.arange(1, 3000), 1)
        v = lm.Vocabulary(np.arange(10, 10 + len(c), dtype=np.uint64), c, int(c.sum()), len(c))
        assert (v.side - 1) ** 2 < (c >= np.sqrt(c.sum()) / 2).sum() + 2 <= v.side ** 2
        sizes.append(v.side)
    assert sizes[1] > sizes[0]


def test_copies_are_dealt_to_all_shards(spark):
    rows = spark.createDataFrame([(7, 1, 0, "the same text every time") for _ in range(4000)], "_id long, _t long, _class int, _x string")
    words = lm.vocabulary_of(lm.count_tokens(rows.select("_x")))
    coded = lm.code(rows, words, shard_tokens=3000, rounds=4)
    many = [r["count"] for r in coded.groupBy("round", "shard").count().collect()]
    assert len(many) == 32 and max(many) < 400


def test_logits_within_a_bound_are_not_searched():
    """The search for logits out of range is left out only where none can be."""
    class Watched(np.ndarray):
        def max(self, *a, **k):
            raise AssertionError("searched")
    z, y = np.random.default_rng(0).normal(0, 5, (20, 7)).astype(np.float32), np.arange(20) % 7
    want = gru._softmax(z.copy(), y)
    got = gru._softmax(z.copy().view(Watched), y, float(np.abs(z).max()))
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(want, got))
    far = gru._softmax(z * 100, y, float(np.abs(z).max()) * 100)[0]
    assert np.isfinite(far).all()


def test_narrow_windows_share_their_outputs_and_gradients(monkeypatch):
    """One text longer than all others makes many windows of a few tokens; the
    costly part runs once per optimiser step, or per gathered group."""
    rng = np.random.default_rng(5)
    t = [np.append(rng.integers(1, 16, n), 0).astype(np.int32) for n in [20_000] + [100] * 300]
    size, windows = sum(map(len, t)), sum(1 for _ in gru.Lanes(t, 0).windows())
    calls, plain = [], gru._outputs
    monkeypatch.setattr(gru, "_outputs", lambda p, h, y, g=None: calls.append(len(y)) or plain(p, h, y, g))
    p = {k: v.astype(np.float32) for k, v in tiny().items()}
    tr = gru.Trainer(p, 0)
    tr.learn(t)
    assert windows > 500 and tr.tokens == size == sum(calls) and tr.steps == len(calls) <= size // gru.STEP + 1
    calls.clear()
    gru.log_probs(p, t, 0)
    assert sum(calls) == size and len(calls) <= size // gru.GROUP + 1


def test_windows_side_by_side_give_the_sum_of_their_gradients(monkeypatch):
    got = []
    for alone in (False, True):
        tr = gru.Trainer(tiny(), 0)                  # double precision
        monkeypatch.setattr(tr, "step", lambda: None)
        if alone:
            each = tr._learn_from
            monkeypatch.setattr(tr, "_learn_from", lambda held: [each([w]) for w in held])
        tr.learn(texts(9, most=150))
        got.append(tr.grad)
    assert all(np.allclose(got[0][k], got[1][k], rtol=1e-9, atol=1e-9) and np.abs(got[0][k]).max() > 0 for k in got[0])


def test_blocks_of_rows_do_not_show(monkeypatch):
    p, rng = tiny(), np.random.default_rng(6)
    h, y = rng.normal(0, 1, (500, 3)), rng.integers(0, 16, 500)
    runs = []
    for rows in (1 << 12, 7):
        monkeypatch.setattr(gru, "ROWS", rows)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        runs.append([*gru._outputs(p, h, y, g), *g.values()])
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-9) for a, b in zip(*runs))
