"""Scoring of whole texts by a recurrent language model trained on the corpus.

Tokens are words (A-Z lower-cased) and one end token per text.  Counts cover
every training token.  The model (``gru``) knows the words that come at least
half the square root of all tokens times, so its vocabulary grows with the
corpus, as the square root of that vocabulary does the classes and the words
of a class.  All other words are one class; the probability of another word is
that class's times its smoothed share of the other training tokens.  So
``score`` is the log10 probability of the complete text, state carried to its
end.

Training passes over every training text once.  Texts are dealt by hash to
shards of about ``SHARD_TOKENS`` and to ``ROUNDS`` rounds; how the table is
partitioned plays no part.  In a round one replica per shard learns the texts
of its share, all from the same model and the same state of the optimiser;
models and states are then averaged by tokens, and the next round starts from
the averages.  So the number of steps that the model makes one after the other
does not fall with the number of tasks.  Averaging sums blocks of parameters
in groups of 32, so no task gathers all replicas.

Counts beyond the ``HEAD`` most frequent words (a broadcast of bounded size)
are joined to the texts' rare words in a shuffle of hashes.

Cases.  Null and empty texts have the end token only.  Which texts are held
out depends on the id's text; a null id counts as the empty text.  Repeated
rows get their own result rows.  Without training texts every word has the
same chance.  Extra columns are ignored; an empty table gives an empty
result.  Words are told apart by 64-bit hashes.  Rows of equal id and text go
to shards in turn, so that copies are no hot shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gru

#: Broadcast counts (12 bytes each), a bound of the model's words as well.
HEAD = 1 << 18
#: Training tokens of a shard, and rounds in which its texts are learnt.
SHARD_TOKENS, ROUNDS = 1 << 22, 8
END = np.uint64(0x5EED0E0D5EED0E0D)
#: Tokens that one pass of the model holds in memory.
HELD = 1_500_000

_COUNTS = "h long, c long"
_BLOCKS = T.StructType([T.StructField("block", T.StringType()), T.StructField("task", T.LongType()),
                        T.StructField("tokens", T.DoubleType()), T.StructField("mean", T.BinaryType())])
_CODED = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("_t", T.LongType()), T.StructField("_class", T.IntegerType()),
    T.StructField("round", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
    T.StructField("other", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("rest", T.DoubleType()),
    T.StructField("tail_h", T.ArrayType(T.LongType())), T.StructField("tail_m", T.ArrayType(T.IntegerType()))])
_SCORED = T.StructType([_CODED[c] for c in ("_id", "_t", "_class", "n_tokens", "known", "other", "base", "rest")]
                       + [T.StructField("model", T.DoubleType())])


def held_out_class(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def tokens(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end per text, first position of each text + 1)."""
    w = common.Words(raw, lower=True)
    n = w.counts()
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(first[-1]), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = w.hashes()
    return out, first


def _count_rows(batches):
    for part, raw in common.slices(batches, "_x"):
        h, n = np.unique(tokens(raw)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([common.i64(h), pa.array(n.astype(np.int64))], names=["h", "c"])


class Vocabulary:
    """Counts of the head, and the model's words among them."""

    def __init__(self, h: np.ndarray, c: np.ndarray, n: int, v: int):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.n, self.v = n, v
        top = np.lexsort((self.h, -self.c))
        top = top[(self.h[top] != END) & (self.c[top] >= np.sqrt(n) / 2)]
        self.side = max(4, int(np.ceil(np.sqrt(len(top) + 2))))        # classes, and words of a class
        ends = int(self.c[self.h == END].sum())
        others = n - ends - int(self.c[top].sum())
        self.n_other, self.v_other = others, v - len(top) - (ends > 0)
        counts = np.concatenate([self.c[top], [ends, others]])
        rank = np.argsort(-counts, kind="stable")
        place = np.empty(len(counts), np.int64)
        place[rank] = np.arange(len(counts))
        self.counts = counts[rank]
        self.end, self.unknown = int(place[-2]), int(place[-1])
        self.id_at = np.full(len(self.h), self.unknown, np.int32)       # word id by place in the head
        self.id_at[top] = place[: len(top)]
        self.id_at[self.h == END] = self.end

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(in the head, count, model's id) of each token."""
        found, back = np.unique(h, return_inverse=True)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, found), len(self.h) - 1)
            hit = self.h[at] == found
            c, i = np.where(hit, self.c[at], 0), np.where(hit, self.id_at[at], self.unknown)
        else:
            hit, c, i = np.zeros(len(found), bool), np.zeros(len(found), np.int64), np.full(len(found), self.unknown)
        i = np.where(found == END, self.end, i)
        return hit[back], c[back], i[back].astype(np.int32)


def _ids_of(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.side ** 2 <= 1 << 16 else "<u4"


def _code_rows(vocabulary: Vocabulary, shards: int, rounds: int):
    """Texts as word numbers, dealt to rounds and shards by their key, with
    what the head tells of their unigram scores and the words beyond it."""
    kind = _ids_of(vocabulary)

    def run(batches):
        seen: dict[int, int] = {}
        for part, raw in common.slices(batches, "_x"):
            h, first = tokens(raw)
            hit, c, ids = vocabulary.look_up(h)
            n = len(raw)
            owner = np.repeat(np.arange(n), np.diff(first))
            other = ids == vocabulary.unknown
            value = np.where(hit, np.log10(c + 0.5), 0.0)
            add = lambda w: np.bincount(owner, w, n)
            tail = np.empty(int((~hit).sum()), [("o", np.int64), ("h", np.uint64)])
            tail["o"], tail["h"] = owner[~hit], h[~hit]
            tail, many = np.unique(tail, return_counts=True)
            edge = np.searchsorted(tail["o"], np.arange(n + 1)).astype(np.int32)
            key = part.column(part.schema.get_field_index("_k")).to_numpy().view(np.uint64)
            turn = np.empty(n, np.uint64)
            for i, k in enumerate(key.tolist()):
                turn[i] = seen[k] = seen.get(k, -1) + 1
            place = common.mixed(key + turn)
            packed = ids.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(name)) for name in ("_id", "_t", "_class")],
                 pa.array((place % np.uint64(rounds)).astype(np.int32)),
                 pa.array((place // np.uint64(rounds) % np.uint64(shards)).astype(np.int64)), common.i64(place),
                 pa.array([x.tobytes() for x in np.split(packed, first[1:-1])], pa.binary()),
                 pa.array(np.diff(first).astype(np.int64)), pa.array(add((hit & (c > 0)).astype(float)).astype(np.int64)),
                 pa.array(add(other.astype(float)).astype(np.int64)), pa.array(add(value)), pa.array(add(np.where(other, value, 0.0))),
                 pa.ListArray.from_arrays(pa.array(edge), common.i64(np.ascontiguousarray(tail["h"]))),
                 pa.ListArray.from_arrays(pa.array(edge), pa.array(many.astype(np.int32)))], names=_CODED.names)
    return run


def code(keyed: DataFrame, vocabulary: Vocabulary, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """All texts coded once, stored by round; training and scoring read them."""
    shards = max(1, -(-vocabulary.n // shard_tokens))
    path = common.new_folder(keyed.sparkSession, "coded")
    rows = keyed.select("_id", "_t", "_class", F.xxhash64("_id", "_t").alias("_k"), "_x").mapInArrow(
        _code_rows(vocabulary, shards, rounds), _CODED)
    rows.write.partitionBy("round").parquet(path)               # a round reads its own files only
    names = [c for c in _CODED.names if c != "round"]
    return keyed.sparkSession.read.schema(T.StructType([*[_CODED[c] for c in names], _CODED["round"]])).parquet(path)


def _learner(vocabulary: Vocabulary, model: dict, square: dict | None, steps: int):
    kind = _ids_of(vocabulary)

    def run(table: pa.Table) -> pa.Table:
        common.one_blas_thread()
        table = table.sort_by("place")
        trainer = gru.Trainer(model, vocabulary.end, square=square, steps=steps)
        held, size = [], 0
        for x in table["ids"].to_pylist():
            held.append(np.frombuffer(x, kind).astype(np.int32))
            size += len(held[-1])
            if size >= HELD:
                trainer.learn(held)
                held, size = [], 0
        trainer.learn(held)
        n = float(trainer.tokens)
        both = [(f"{what}:{k}", v) for what, of in (("p", trainer.p), ("s", trainer.square)) for k, v in of.items()]
        return pa.Table.from_arrays(
            [pa.array([k for k, _ in both]), pa.array([table["shard"][0].as_py()] * len(both), pa.int64()), pa.array([n] * len(both)),
             pa.array([v.astype("<f4").tobytes() for _, v in both], pa.binary())], names=_BLOCKS.names)
    return run


def _mean_blocks(table: pa.Table) -> pa.Table:
    """Blocks of several replicas as one, weighted by tokens."""
    table = table.sort_by("task")
    n = table["tokens"].to_pylist()
    total = sum(np.frombuffer(b, "<f4") * k for b, k in zip(table["mean"].to_pylist(), n))
    return pa.Table.from_arrays(
        [table["block"][:1], table["task"][:1], pa.array([sum(n)]),
         pa.array([(total / sum(n)).astype("<f4").tobytes()], pa.binary())], names=_BLOCKS.names)


def train(coded: DataFrame, vocabulary: Vocabulary, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> dict:
    """The model after all rounds over the training texts of ``coded``."""
    model = gru.initial(vocabulary.counts, vocabulary.side, vocabulary.side)
    if not vocabulary.n:
        return model
    shards = max(1, -(-vocabulary.n // shard_tokens))
    square = None
    for k in range(rounds):
        part = coded.where((F.col("round") == k) & (F.col("_class") != 1)).select("shard", "place", "ids")
        rows = part.groupBy("shard").applyInArrow(_learner(vocabulary, model, square, k * (vocabulary.n // (shards * rounds * gru.STEP))), _BLOCKS)
        replicas = shards
        while replicas > 32:
            rows = (rows.withColumn("task", F.expr("task div 32")).groupBy("block", "task")
                    .applyInArrow(lambda t: _mean_blocks(t.select(_BLOCKS.names)), _BLOCKS))
            replicas = -(-replicas // 32)
        rows = rows.groupBy("block").applyInArrow(lambda t: _mean_blocks(t.select(_BLOCKS.names)), _BLOCKS)
        got = {r["block"]: np.frombuffer(r["mean"], "<f4") for r in rows.collect()}   # one model
        if got:
            square = {key: got[f"s:{key}"].reshape(v.shape).copy() for key, v in model.items()}
            model = {key: got[f"p:{key}"].reshape(v.shape).copy() for key, v in model.items()}
    return model


def _score_rows(vocabulary: Vocabulary, model: dict):
    """Log10 probabilities of coded texts; the other columns pass."""
    kind = _ids_of(vocabulary)

    def finish(held):
        batches, texts = [b for b, _ in held], [x for _, part in held for x in part]
        got = gru.log_probs(model, texts, vocabulary.end) / np.log(10)
        lo = 0
        for batch in batches:
            hi = lo + batch.num_rows
            columns = [batch.column(batch.schema.get_field_index(c)) for c in _SCORED.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got[lo:hi])], names=_SCORED.names)
            lo = hi

    def run(batches):
        common.one_blas_thread()
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("ids")
            texts = [np.frombuffer(x, kind).astype(np.int32) for x in batch.column(at).to_pylist()]
            held.append((batch, texts))
            size += sum(map(len, texts))
            if size >= HELD:
                yield from finish(held)
                held, size = [], 0
        if held:
            yield from finish(held)
    return run


def count_tokens(texts: DataFrame) -> DataFrame:
    """``h``, ``c``: every distinct token of ``_x`` and its count."""
    return common.stored(texts.mapInArrow(_count_rows, _COUNTS).groupBy("h").agg(F.sum("c").alias("c")), "counts")


def vocabulary_of(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2("c") * 8).cast("int")                # a few hundred levels at most
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    least, used = None, 0
    for step, many in steps:
        if used + many > head:
            break
        least, used = step, used + many
    if least is None:
        return Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), n, v)
    got = counts.where(level >= least).toArrow()                # at most ``head`` rows
    return Vocabulary(got["h"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy().astype(np.int64), n, v)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head: int = HEAD,
          shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """One row per text: its id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (unigrams) and ``score`` (the model)."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_t"),
                        held_out_class(F.col(doc_id)).alias("_class"), F.col(text).alias("_x"))
    training = keyed.where("_class <> 1")
    counts = count_tokens(training.select("_x"))
    words = vocabulary_of(counts, head)
    coded = code(keyed, words, shard_tokens, rounds)
    model = train(coded, words, shard_tokens, rounds)
    scored = common.stored(coded.select("ids", *_SCORED.names[:-1]).mapInArrow(_score_rows(words, model), _SCORED), "scored")
    tail = (coded.select("_id", "_t", F.explode(F.arrays_zip("tail_h", "tail_m")).alias("x"))
            .select("_id", "_t", F.col("x.tail_h").alias("h"), F.col("x.tail_m").alias("m")))
    seen = F.coalesce("c", F.lit(0))
    rare = (tail.join(counts, "h", "left").groupBy("_id", "_t")
            .agg(F.sum(F.col("m") * F.log10(seen + 0.5)).alias("_sum"),
                 F.sum(F.when(seen > 0, F.col("m")).otherwise(0)).alias("_known")))
    # equal rows were summed together; their number divides it out
    same = scored.groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_rows"))
    facts = rare.alias("r").join(same.alias("s"), F.expr("r._id <=> s._id AND r._t = s._t")).select(
        "r._id", "r._t", (F.col("_sum") / F.col("_rows")).alias("_sum"), F.expr("_known div _rows").alias("_known"))
    both = scored.alias("d").join(facts.alias("f"), F.expr("d._id <=> f._id AND d._t = f._t"), "left")
    rest = F.coalesce("f._sum", F.lit(0.0))
    of_all = float(np.log10(words.n + 0.5 * (words.v + 1)))
    of_other = float(np.log10(words.n_other + 0.5 * (words.v_other + 1)))
    return both.select(
        F.col("d._id").alias(doc_id), (F.col("d._class") == 1).alias("held_out"), "d.n_tokens",
        (F.col("d.known") + F.coalesce("f._known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(words.n)).cast("long").alias("train_tokens"),
        (F.col("d.base") + rest - F.col("d.n_tokens") * of_all).alias("base_score"),
        (F.col("d.model") + F.col("d.rest") + rest - F.col("d.other") * of_other).alias("score"))
