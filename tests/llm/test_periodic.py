"""Periodic runs against a comparison at every period."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_brute import collapse, periodic_runs, sha, words
from pyspark.sql import functions as F

from tillroll.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def found(texts):
    """Runs per text of lists of numbers."""
    first = np.cumsum([0] + [len(w) for w in texts])
    start, length, period = periodic.find(np.array([x for w in texts for x in w], np.int64), first)
    own = np.searchsorted(first, start, "right") - 1
    return [[(int(s - first[k]), int(n), int(p)) for s, n, p, o in zip(start, length, period, own) if o == k]
            for k in range(len(texts))]


def made(rng):
    """A text of repeated pieces, some of them periodic inside, between noise."""
    w = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.4:
            w += [rng.randint(0, rng.choice([1, 3, 100])) for _ in range(rng.randint(0, 60))]
            continue
        p = rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 31, 40, 64, 100])
        unit = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(p)]
        if p > 4 and rng.random() < 0.5:
            unit = (unit[:rng.randint(1, 3)] * p)[:p - 1] + [99]
        w += (unit * 7)[:rng.randint(p, 5 * p + 30)]
    return w * rng.choice([1, 1, 1, 3, 4])


def test_random_texts():
    rng = random.Random(3)
    for _ in range(250):
        texts = [made(rng) for _ in range(rng.randint(1, 4))]
        assert found(texts) == [periodic_runs(w) for w in texts]


@pytest.mark.parametrize("low, high", [(1, 2), (0, 1)])
def test_words_full_of_runs(low, high):
    a, b = [low], [low, high]                      # Fibonacci words
    while len(b) < 1500:
        a, b = b, b + a
    pairs = [bin(i).count("1") % 2 for i in range(1024)]      # Thue-Morse: no cubes at all
    assert found([b, pairs]) == [periodic_runs(b), []]


def test_long_texts_of_one_run():
    n = 200_000
    assert found([[7] * n, list(range(400)) * (n // 400), list(range(n))]) == [[(0, n, 1)], [(0, n, 400)], []]


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 64, 100):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        lo, x = rng.integers(0, n, 50), rng.integers(0, n + 1, 50)
        hi = lo + 1 + (rng.random(50) * (n - lo)).astype(int)
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
        rank = (rng.random(50) * (hi - lo)).astype(int)
        assert tree.smallest(lo, hi, rank).tolist() == [int(np.sort(values[a:b])[r]) for a, b, r in zip(lo, hi, rank)]


def test_limits_are_refused(docs_df):
    with pytest.raises(ValueError):
        periodic.runs(docs_df([(1, "a")]), min_periods=2)


def test_rows_and_edge_cases(spark):
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    texts = [None, "", " \t\n", "word", "a b c " * 8, "x " * 23, "x " * 24, "é è\u000b" * 30, "u v w " * 12,
             (morse + " " + other + " ") * 12, "a b c " * 8]
    rows = [(None if k == 4 else k % 9, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = periodic.runs(df).collect()
    assert len(got) == len(rows)
    for (i, t, _), r in zip(rows, got):
        want = periodic_runs(words(t))
        assert (r["doc_id"], r["n_words"]) == (i, len(words(t)))
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapse(words(t), want)
    assert periodic.runs(df.limit(0)).count() == 0


def expected(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = periodic_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(collapse(w, runs).encode()))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 4000).select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == 200
    planted = 0
    for i, t in docs:
        want = expected(i, t)
        planted += want[1] > 0
        assert got[i] == want
    assert planted > 5
