import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tillroll.llm import packing, queries

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(pieces, ids_by_doc, most=4096):
    """Every id in one piece, sequences gapless and within their size."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_by_doc)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids_by_doc[d])
            cut = ids_by_doc[d][p.start:p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += p.length
        assert at == len(ids_by_doc[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most
    return by_seq


def test_tokenizer_equals_library(library):
    tok = packing.ChunkTokenizer(open(PATH).read())
    texts = ["", " ", "It's  The END.\n1984 éÉ, déjà-vu!", "Σίσυφος ΣΑΣ", "日本 x<|endoftext|>y <|ENDOFTEXT|>", "İx ﬁ x́ ́",
             "a\x1cb\x85c\xa0d", "w" * 5000]
    for _ in range(2):
        got = tok.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2]
            for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seqs = check(queries.op10_packing(spark, d).collect(), want)
    total = sum(map(len, want.values()))
    assert len(seqs) <= total // 4096 + 2            # little padding


def test_edges(spark, docs_df, library):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 9000), (5, "x")]
    df = docs_df(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "offset")
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    check(packing.pack(df, PATH).collect(), want)
    assert packing.pack(docs_df([(7, "same"), (7, "same")]), PATH).count() == 2
    assert packing.pack(docs_df([(None, "no id")]), PATH).collect()[0].doc_id is None
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_limits_hold_together():
    rng = np.random.default_rng(1)
    size, loss = rng.integers(1, 3000, 400), rng.random(400) < 0.5
    rows, done = packing.pack_block(size, loss, 1024, 5, 300, True)
    assert (done == size).all()
    tokens, segments, bearing = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, _, n, b, offset in rows:
        assert offset == tokens[b]
        tokens[b] += n
        segments[b] += 1
        bearing[b] += n * bool(loss[i])
    assert max(tokens.values()) <= 1024 and max(segments.values()) <= 5 and max(bearing.values()) <= 300


def test_loss_column(spark):
    df = spark.createDataFrame([(1, "a " * 500, True), (2, "b " * 500, False), (3, "c", None)], "id long, t string, bears boolean")
    got = packing.pack(df, PATH, doc_id="id", text="t", loss="bears", max_tokens=256, max_loss=64).collect()
    per = defaultdict(int)
    for p in got:
        per[p.sequence_id] += p.loss_tokens
    assert max(per.values()) <= 64
    assert sum(p.loss_tokens for p in got) == 501


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_new_words_reach_the_tokenizer_together(library):
    """Thousands of new words, odd ones among them: the library's ids, in a few texts."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdeéßñøžĀ"))
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 14, 3000)]
    words += ["İx", "don't", "a1b22", "<<>>", "日本", "é", "Σ", "x\x85y", "'s", "''s", "w" * 3000]
    tok = packing.ChunkTokenizer(open(PATH).read())
    counted = []
    for name in ("tok", "spaced"):
        if getattr(tok, name, None):
            counted.append(Counted(getattr(tok, name)))
            setattr(tok, name, counted[-1])
    got = tok.encode(pa.array([" ".join(words).encode(), b"\xff\xfe z\xc3 a"], pa.large_binary()))
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert np.frombuffer(got[1], "<u4").tolist() == library.encode("�� z� a", add_special_tokens=False).ids
    assert sum(c.texts for c in counted) < 100
