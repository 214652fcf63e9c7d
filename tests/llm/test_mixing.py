"""Source mixing: targets, seats and places by hand, and DuckDB SQL."""

import random
from collections import defaultdict

import duckdb
import pytest

from tillroll.llm import mixing, queries
from llm_brute import words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def reshared(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    """Targets by sharing the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target = {s: 0.0 for s in sizes}
    left, open_ = budget * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        for s in list(open_):
            target[s] += share * w[s]
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def seats(votes, n):
    """Highest quotients, one seat after the other."""
    got = {k: 0 for k in votes}
    for _ in range(n):
        best = min(votes, key=lambda k: (-votes[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


def test_apportionment(spark):
    rng = random.Random(6)
    for trial in range(6):
        rows, wanted = [], {}
        for g in range(3):
            votes = {k: float(rng.choice([0, 1, 5, 5, 40, 1000, rng.randint(0, 9999)])) for k in range(rng.choice([1, 2, 9, 30]))}
            n = rng.choice([0, 1, 7, 200]) if sum(votes.values()) else 0
            rows += [(g, k, v, n) for k, v in votes.items()]
            wanted |= {(g, k): s for k, s in seats(votes, n).items()}
        df = spark.createDataFrame(rows, "g long, k long, v double, n long")
        got = {(r["g"], r["k"]): r["_quota"] for r in mixing.apportion(df, ["g"], "k", "v", "n").collect()}
        assert got == wanted


def test_cases(spark, prose):
    sources = [None, "\U00010000b", "￮a", "a", "", "tiny"]
    rows = []
    for k in range(120):
        s = sources[k % 5] if k % 3 else "a"
        rows.append((None if k % 10 == 3 else k, [None, "", " \t "][k % 3] if k % 17 == 0 else prose(k * 3 % 90, k), s))
    rows += [(5, prose(20, 1), "a")] * 2500 + [(6, "one two", "tiny")] + [(7, prose(5000, 2), "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, _pos string")
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    aims = reshared(sizes)
    results = []
    for parts in (1, 6):
        got = mixing.mix(df.repartition(parts), shard_words=4000).collect()
        results.append(sorted((tuple(r) for r in got), key=str))
    assert results[0] == results[1] and len(got) == len(rows)
    assert sorted(map(str, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(
        map(str, ((i, s, len(words(t))) for i, t, s in rows)))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(x["length"] for x in r["spans"])
        assert all(0 <= x["start"] and x["start"] + x["length"] <= r["size"] for x in r["spans"])
        taken[r["source"]] += r["taken"]
    shards = max(sizes.values()) // 4000 + 1
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= mixing.BLOCK * (shards + 3)
    assert mixing.mix(df.limit(0)).count() == 0
    none = mixing.mix(df.where("text is null or trim(text) = ''")).collect()
    assert none and all(r["taken"] == 0 and r["target"] == 0 for r in none)


def test_seed_changes_the_choice(spark, docs_df, prose):
    df = docs_df([(k, prose(50 + 40 * (k % 2), k), "ab"[k % 2]) for k in range(80)])
    one, two = ({r["doc_id"]: r["taken"] for r in mixing.mix(df, seed=s).collect()} for s in (1, 2))
    assert one != two and abs(sum(one.values()) - sum(two.values())) <= 2 * mixing.BLOCK


@pytest.mark.parametrize("shard_words", [mixing.SHARD_WORDS, 700])
def test_query_and_sql(spark, shard_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = queries.op13_source_mixing(spark, SF) if shard_words == mixing.SHARD_WORDS else mixing.mix(docs, shard_words=shard_words)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in df.collect()) == sorted(con.sql(mixing.sql(shard_words=shard_words)).fetchall())


def test_native(spark):
    plan = queries.op13_source_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
