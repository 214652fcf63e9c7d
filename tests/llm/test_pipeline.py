import random

import corpus_pipeline
import public_tokenizers as P
import pytest
from llm_brute import jaccard_classes, without_repeats
from test_packing import check
from tokenizers import Tokenizer

from tillroll.llm import common


@pytest.fixture
def planted(spark, docs_df, prose, tmp_path):
    """A corpus in which each stage has something to do, and its labels."""
    rng = random.Random(9)
    passage, base = prose(70), prose(90)
    rows = [(i, prose(rng.randint(30, 90))) for i in range(120)]
    rows += [(200 + i, base + (f" tail{i}" if i % 2 else "")) for i in range(12)]               # copies
    rows += [(300 + i, f"{prose(60)} {passage} {prose(60)}") for i in range(6)]                  # a shared passage
    rows += [(400 + i, prose(40) + " idiot " + prose(5)) for i in range(40)]                     # toxic
    rows += [(500, "too short"), (501, "again " * 60), (502, None), (503, "")]                   # junk
    docs_df(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(400 <= i < 430)) for i, _ in rows if i < 430]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_against_brute_force(spark, planted):
    d, rows = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, d), "stage")
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    text = dict(rows)
    assert seen["quality rules"] == {i: t for i, t in text.items() if i not in (500, 501, 502, 503)}
    clean = {i: t for i, t in seen["quality rules"].items() if not 400 <= i < 440}
    assert seen["toxicity"] == clean
    single = {i: t for i, t in clean.items() if jaccard_classes(list(clean.items()))[i][1] == i}
    assert seen["n-gram join"] == single and 200 in single and 201 not in single
    left = {i: (kept if gone else single[i]) for i, (n, gone, kept) in without_repeats(list(single.items())).items() if gone < n}
    assert seen["substring dedup"] == left and 301 in left
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in left.items()}
    check(corpus_pipeline.STAGES[-1][1](spark, docs, d).collect(), want)
    check(corpus_pipeline.run(spark, d).collect(), want)


def test_empty_documents(spark, planted, tmp_path):
    d, _ = planted
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == 0


def test_null_repeated_and_very_long_rows(spark, prose, tmp_path):
    from collections import Counter
    long_ = prose(30_000, 1)
    rows = [(i, prose(60, 100 + i), "en", None if i % 3 else "h", 1) for i in range(40)]
    rows += [(None, prose(60, 300 + i), None, "h", None) for i in range(4)] + [(50, long_, "en", "h", 2), (51, long_ + " end", "en", "h", 2)]
    rows += rows[:3] + [rows[40]] * 2 + [(7, prose(70, 400), "en", "h", 5), (60, None, None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        seen.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    full = Counter((r[0], r[1]) for r in rows if r[1] is not None)
    assert seen[0] == seen[1] == full                                             # only rows without text go
    kept = Counter(set(full)) - Counter([(51, long_ + " end")])                   # one of equal rows, of near copies the first
    kept.update({k: n - 1 for k, n in full.items() if k[0] is None})              # rows without id stay
    assert seen[2] == kept
    assert {i for i, _ in seen[3]} == {i for i, _ in kept}
    tokens = Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        tokens[p.doc_id] += p.length
    assert set(tokens) == {i for i, _ in kept} and tokens[50] > 30_000
