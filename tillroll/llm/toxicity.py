"""Toxicity by a chain of linear classifiers.

The chain has one logistic regression per category, in a fixed order.  Each
sees the words of a text and the probabilities that the earlier links give
for the earlier categories.  In training those probabilities are
out-of-fold predictions, so a later link never learns from an earlier one's
memory of the same row.

Features are words (lower-cased A-Z, cut at ASCII punctuation, so ``don't`` is
two words), present or not.  A word is a feature of the chain if its document
frequencies differ between the classes of some category by ``min_z`` standard
errors; there is no fixed number of features.

Training takes at most ``max_train`` labelled rows (the documented bound),
those with the smallest hash of their id, and one text per id; scoring takes
every text whole.  Frequencies are counted in Spark; the driver receives the
chosen words and, of each training row, which of them it holds, so that long
texts do not weigh on it.  The regressions are fitted on these sparse rows.
The threshold of a category is the one with the best F1 out of fold.

Cases.  Null and empty texts have no words and get the prior; labels that
are null are left out of that category.  A category without both classes,
or without labels, predicts its share (0 without labels) and rejects
nothing.  Repeated rows are scored each; a repeated label of a row counts
once (its maximum); of several texts under one id the one of the smallest
hash is learnt from.  Extra columns pass through ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TRAIN, MIN_Z, FOLDS = 20_000, 4.0, 5


@dataclass
class Link:
    name: str
    weights: np.ndarray        # one per word feature, then one per earlier link
    bias: float
    threshold: float           # above 1: rejects nothing


@dataclass
class Chain:
    features: np.ndarray       # sorted word hashes
    links: list[Link]


_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text index, word hash) of the distinct words of each text, sorted.

    Punctuation counts as white space here, so ``idiot,`` and ``idiot`` are
    one word.
    """
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]: off[-1]] if raw is not None else np.zeros(0, np.uint8)
    data = np.where(_EDGE[data], np.uint8(32), data)
    plain = pa.Array.from_buffers(pa.large_binary(), len(texts), [
        None, pa.py_buffer((off - off[0]).tobytes()), pa.py_buffer(data.tobytes())])
    w = common.Words(plain, lower=True)
    pairs = np.empty(len(w), [("t", np.int64), ("h", np.uint64)])
    pairs["t"], pairs["h"] = w.owner(), w.hashes()
    pairs = np.unique(pairs)
    return pairs["t"], pairs["h"], len(texts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Training rows: places of the words they hold (``row``, ``col`` of ``k``
    words), then dense columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, k: int, dense: np.ndarray | None = None):
        self.row, self.col, self.n, self.k = row, col, n, k                # ``row`` ascends
        self.dense = np.zeros((n, 0)) if dense is None else np.asarray(dense, np.float64)
        self.first = np.searchsorted(row, np.arange(n))
        self.some = np.append(self.first[1:], len(row)) > self.first

    def __len__(self) -> int:
        return self.n

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = (self.dense * w[self.k:]).sum(axis=1)
        if len(self.row):
            out[self.some] += np.add.reduceat(w[self.col], self.first[self.some])
        return out

    def transposed_dot(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row], self.k), (self.dense * r[:, None]).sum(axis=0)])

    def where(self, mask: np.ndarray) -> "Rows":
        at = np.cumsum(mask) - 1
        hit = mask[self.row]
        return Rows(at[self.row[hit]], self.col[hit], int(mask.sum()), self.k, self.dense[mask])

    def with_column(self, c: np.ndarray) -> "Rows":
        return Rows(self.row, self.col, self.n, self.k, np.column_stack([self.dense, c]))


def fit_logistic(x: "Rows | np.ndarray", y: np.ndarray, l2: float = 1.0, steps: int = 300,
                 start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Ridge logistic regression (the bias is not shrunk) by L-BFGS, from
    ``start`` (weights, then the bias) if given: the optimum is the same."""
    if isinstance(x, np.ndarray):
        none = np.zeros(0, np.int64)
        x = Rows(none, none, len(x), 0, x)
    size = x.k + x.dense.shape[1]
    ridge = np.full(size + 1, l2)
    ridge[-1] = 1e-6

    def loss(w):
        m = x.dot(w[:-1]) + w[-1]
        value = float((np.logaddexp(0, m) - y * m).sum() + 0.5 * (ridge * w * w).sum())
        r = _sigmoid(m) - y
        return value, np.append(x.transposed_dot(r), r.sum()) + ridge * w

    w = np.zeros(size + 1) if start is None else start.copy()
    enough = max(1e-4, 2e-6 * len(x))                     # of a gradient that sums over the rows
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < enough:
            break
        q, alphas = grad.copy(), []
        for s, g in reversed(past):
            alphas.append((s @ q) / (s @ g))
            q -= alphas[-1] * g
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, np.abs(grad).max())
        for (s, g), a in zip(past, reversed(alphas)):
            q += (a - (g @ q) / (s @ g)) * s
        rate, slope = 1.0, float(grad @ q)
        while rate > 1e-10:
            new_value, new_grad = loss(w - rate * q)
            if new_value <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, g = -rate * q, new_grad - grad
        w, value, grad = w + s, new_value, new_grad
        if s @ g > 1e-12:
            past = [*past[-9:], (s, g)]
    return w[:-1], float(w[-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, midway between neighbouring predictions."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    at = int(np.argmax(f1))
    low = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + low) / 2, 0.05, 0.95))


def fit_chain(x: Rows, features: np.ndarray, y: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """Fit the links in order; ``y`` has a column per category (nan: unknown)."""
    n = len(x)
    fold = np.arange(n) % folds
    links: list[Link] = []
    for k, name in enumerate(names):
        known = ~np.isnan(y[:, k])
        yk = np.where(known, y[:, k], 0)
        if len(np.unique(yk[known])) < 2:
            share = float(yk[known].mean()) if known.any() else 0.0
            bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
            links.append(Link(name, np.zeros(x.k + x.dense.shape[1]), bias, 2.0))
            oof = np.full(n, share)
        else:
            oof = np.zeros(n)
            w, b = fit_logistic(x.where(known), yk[known])
            whole = np.append(w, b)
            for f in range(folds):
                rest, mine = known & (fold != f), fold == f
                if len(np.unique(yk[rest])) < 2:
                    oof[mine] = yk[known].mean()
                    continue
                part, at = fit_logistic(x.where(rest), yk[rest], start=whole)
                oof[mine] = _sigmoid(x.where(mine).dot(part) + at)
            links.append(Link(name, w, b, best_threshold(oof[known], yk[known])))
        x = x.with_column(oof)
    return Chain(features, links)


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of packed sets."""
    sets = [np.frombuffer(b, np.uint64) for b in column.to_pylist()]
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)


def choose(sets: DataFrame, ys: list[str], min_z: float = MIN_Z) -> np.ndarray:
    """Sorted hashes of the words whose document frequencies differ between the
    classes of a category; counted in Spark from packed sets ``_h``."""
    classes = [(f"{v}{k}", y, v) for k, y in enumerate(ys) for v in (1, 0)]

    def count(batches):
        for batch in batches:
            row, h = _unpacked(batch.column(0))
            found, at = np.unique(h, return_inverse=True)
            marks = [batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(ys))]
            yield pa.RecordBatch.from_arrays(
                [common.i64(found), *[pa.array(np.bincount(at[marks[ys.index(y)][row] == v], minlength=len(found)).astype(np.int64))
                                      for _, y, v in classes]], names=["h", *[f"c{c}" for c, _, _ in classes]])

    schema = "h long, " + ", ".join(f"c{c} long" for c, _, _ in classes)
    total = sets.agg(*[F.count_if(F.col(y) == v).alias(c) for c, y, v in classes]).first()
    counts = sets.select("_h", *ys).mapInArrow(count, schema).groupBy("h").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c, _, _ in classes])
    passes = F.lit(False)
    for k in range(len(ys)):
        n1, n0 = total[f"1{k}"], total[f"0{k}"]
        if not n1 or not n0:
            continue
        c1, c0 = F.col(f"c1{k}"), F.col(f"c0{k}")
        p = (c1 + c0) / (n1 + n0)
        error = F.sqrt(F.greatest(p * (1 - p) * (1 / n1 + 1 / n0), F.lit(1e-12)))
        passes = passes | ((c1 + c0 >= 5) & (F.abs(c1 / n1 - c0 / n0) / error >= min_z))
    return np.sort(counts.where(passes).select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, object], doc_id: str = "doc_id",
          text: str = "text", max_train: int = MAX_TRAIN, min_z: float = MIN_Z) -> Chain:
    """``categories``: name -> Column over ``labels`` (1, 0 or null), in chain order."""
    names = list(categories)
    marks = (labels.select(F.col(doc_id).alias("_id"), *[categories[c].cast("double").alias(f"_y{i}")
                                                         for i, c in enumerate(names)])
             .where(F.col("_id").isNotNull()).groupBy("_id")
             .agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(names))])
             .orderBy(F.xxhash64(F.lit(7), "_id"), "_id").limit(max_train))
    texts = (docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(marks.select("_id")), "_id")
             .groupBy("_id").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")))      # at most max_train rows
    rows = texts.join(marks, "_id")
    ys = [f"_y{i}" for i in range(len(names))]
    out = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_h", T.BinaryType()),
                        *[T.StructField(c, T.DoubleType()) for c in ys]])

    def pack(batches):
        for part, raw in common.slices(batches, "_t"):
            t, h, n = _word_sets(raw)
            cut = np.searchsorted(t, np.arange(n + 1))
            packed = [h[cut[i]:cut[i + 1]].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(packed, pa.binary()),
                 *[part.column(part.schema.get_field_index(c)) for c in ys]], names=out.names)

    sets = common.stored(rows.select("_id", "_t", *ys).mapInArrow(pack, out), "word-sets")
    features = choose(sets, ys, min_z)

    def held(batches):
        for batch in batches:
            row, h = _unpacked(batch.column(1))
            at = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
            hit = features[at] == h if len(features) else np.zeros(len(h), bool)
            cut = np.searchsorted(row[hit], np.arange(batch.num_rows + 1))
            places = at[hit].astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([places[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), *batch.columns[2:]],
                names=out.names)

    got = sets.mapInArrow(held, out).toArrow().sort_by("_id")                         # of each row its chosen words
    places = [np.frombuffer(b, "<i4") for b in got["_h"].to_pylist()]
    n = len(places)
    row = np.repeat(np.arange(n), [len(x) for x in places]) if n else np.zeros(0, np.int64)
    col = np.concatenate(places).astype(np.int64) if n else np.zeros(0, np.int64)
    y = np.column_stack([got[c].to_numpy(zero_copy_only=False) for c in ys]).astype(float) if n else np.zeros((0, len(ys)))
    return fit_chain(Rows(row, col, n, len(features)), features, y, names)


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_", verdict: str = "rejected",
          reject: list[str] | None = None) -> DataFrame:
    """Adds ``p_<category>`` for each category and ``rejected``: whether a
    category in ``reject`` (default: the last) is above its threshold."""
    names = [k.name for k in chain.links]
    reject = reject or names[-1:]
    added = [prefix + c for c in names] + [verdict]
    keep = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    out = T.StructType([*keep, *[T.StructField(c, T.DoubleType()) for c in added[:-1]],
                        T.StructField(verdict, T.BooleanType())])

    def run(batches):
        for part, raw in common.slices(batches, text):
            t, h, n = _word_sets(raw)
            f = chain.features
            at = np.minimum(np.searchsorted(f, h), max(len(f) - 1, 0)) if len(f) else np.zeros(0, np.int64)
            hit = f[at] == h if len(f) else np.zeros(0, bool)
            rows, cols = (t[hit], at[hit]) if len(f) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            ps, bad = [], np.zeros(n, bool)
            for k, link in enumerate(chain.links):
                m = np.bincount(rows, link.weights[: len(f)][cols], n) + link.bias
                for j, p in enumerate(ps):
                    m = m + link.weights[len(f) + j] * p
                p = _sigmoid(m)
                ps.append(p)
                if link.name in reject:
                    bad |= p >= link.threshold
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c.name)) for c in keep]
                + [pa.array(p) for p in ps] + [pa.array(bad)], names=out.names)

    return docs.mapInArrow(run, out)
