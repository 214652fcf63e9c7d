import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from llm_brute import sha

from tillroll.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["Th", "ER", " ", "  ", "a", "É", "é", "ß", "Σ", "İ", "\n", "\r\n", "\t", "ing", "1", "23", "日本", "!", ",", "'s", "'",
        "\xa0", " ", "　", "“", "ﬁ", "\x1c", "x́", "÷", "the", " the", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == P.PATTERN


def test_equals_library_on_random_texts(ranks, library):
    r = random.Random(3)
    enc = bpe.TextEncoder(ranks, P.PATTERN)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    got = enc.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
    for t, g in zip(texts, got):
        assert ids_of(g) == library.encode_ordinary(t), repr(t)
    split = bpe.TextEncoder(ranks, P.PATTERN + "|z{99}")           # another pattern: no shared spans
    assert not split.plain
    assert split.encode(pa.array([t.encode() for t in texts[:300]], pa.large_binary())) == got[:300]


def test_long_pieces_stay_linear(ranks, library):
    enc = bpe.Encoder(ranks)
    for piece in ("a" * 5000, "onthe" * 1500, "é" * 2000, "!?" * 800):
        assert enc.encode(piece.encode()) == library.encode_ordinary(piece)


def test_edges_and_round_trip(spark, library):
    rows = [(1, None, 7), (2, "", 8), (2, "", 8), (None, "It's  a\n test ", 9), (4, "x " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")          # a clashing column
    coded = bpe.encode(df, PATH, P.PATTERN)
    back = {(r.doc_id, r.text): r for r in bpe.decode(coded, PATH).collect()}
    assert coded.count() == 5
    for i, t, _ in rows:
        r = back[i, t]
        assert ids_of(r.ids) == library.encode_ordinary(t or "") and r.n_tokens == len(ids_of(r.ids))
        assert bytes(r.decoded) == (t or "").encode()
    empty = bpe.decode(bpe.encode(df.limit(0), PATH, P.PATTERN), PATH)
    assert empty.count() == 0


def test_query(spark, library):
    from tillroll.llm import queries
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, d).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id].encode()))
