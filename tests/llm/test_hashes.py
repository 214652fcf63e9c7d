"""Words that collide under a polynomial hash modulo 2**64 (Thue-Morse words)
are told apart by every operator."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from tillroll.llm import bpe, common, lm, ngram_join, packing, queries, substring


def pair(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_word_hashes_differ(n):
    one, two = pair(n)
    texts = pa.array([f"{one} {two}", two, one], pa.large_binary())
    h = common.Words(texts, lower=False).hashes()
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_hashes_depend_on_every_byte_and_place():
    rng = np.random.default_rng(0)
    seen = {}
    for size in (1, 7, 8, 9, 16, 40):
        for _ in range(300):
            span = rng.integers(0, 3, size).astype(np.uint8)
            h = int(common.span_hashes(span, np.array([0]))[0])
            assert seen.setdefault(h, span.tobytes()) == span.tobytes()


def test_equal_hashes_do_not_share_ids():
    data = np.frombuffer(b"aabbaaccaa", np.uint8)
    start = np.arange(0, 10, 2)
    table = common.IdTable(lambda spans: [np.array(list(s), "<u4").tobytes() for s in spans], 100)
    ids, count = table.look_up(data, start, start + 2, np.array([5, 5, 5, 5, 5], np.uint64))
    assert ids.tolist() == list(data) and count.tolist() == [2] * 5


@pytest.mark.parametrize("n", [1024, 2048])
def test_byte_bpe(spark, docs_df, n):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for b, i in bpe.read_ranks(path)}, special_tokens={})
    one, two = pair(n)
    df = docs_df([(1, one), (2, two), (3, f"{two} {one}")]).coalesce(1)
    for r in bpe.encode(df, path, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"])


@pytest.mark.parametrize("n", [1024, 2048])
def test_packing(spark, docs_df, n):
    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_str(json.dumps(json.load(open(path, encoding="utf-8"))))
    one, two = pair(n)
    got = {}
    for r in packing.pack(docs_df([(1, one), (2, two)]).coalesce(1), path).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids_crc32"], r["length"]))
    import zlib
    for doc, text in ((1, one), (2, two)):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        for start, crc, length in got[doc]:
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())


@pytest.mark.parametrize("n", [1024, 2048])
def test_scores_joins_and_repeats(spark, docs_df, n):
    one, two = pair(n)
    tail = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{one} x") for k in range(40)] + [(100, f"{two} x"), (101, f"{one} x")]
    known = {r["doc_id"]: (r["n_known"], r["n_tokens"], r["held_out"]) for r in lm.score(docs_df(rows)).collect()}
    held = [k for k, v in known.items() if v[2]]
    assert all(known[k][0] == 3 for k in held if k != 100) and (known[100][0] == 2 or not known[100][2])
    sets = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs_df(
        [(1, f"{one} b c d e"), (2, f"{two} b c d e"), (3, f"{one} b c d e")])).collect()}
    assert sets == {1: 1, 2: 2, 3: 1}
    gone = {r["doc_id"]: r["n_removed"] for r in substring.judge(docs_df(
        [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")])).collect()}
    assert gone == {1: 0, 2: 60, 3: 61}
