"""Near-duplicate vectors by cosine, from products of int8 tiles.

Unit vectors are quantised to int8 with a scale of their own.  With x = s q + e
the cosine of two vectors differs from s1 s2 (q1 . q2) by at most
|e1| |s2 q2| + |e2| |s1 q1| + |e1| |e2|, both from norms known per vector.
Pairs whose upper bound is below the threshold are out, pairs whose lower
bound is above it are links, and only the rest are computed from the full
vectors in double precision.  So the bounds change no result.

Only codes are dealt to the pairs of tiles.  A pair of tiles marks the vectors
that it can't decide about, and these alone come to it again, with their full
vectors.  Codes are taken in the main axes of the data: most pairs are out by
their leading components and the length of the rest (Cauchy-Schwarz), and all
components are multiplied for the others only.

Tiles are ranges of the projection on the main direction of the data.  Unit
vectors with a cosine of at least t are at most sqrt(2 - 2 t) apart, and so
are their projections: a vector meets only the tiles that this band touches.
The axes come from at most ``SAMPLE`` vectors (they decide how much is
skipped, not what is found); the tiles hold all vectors.  A range with more
vectors than a tile, as when many have one projection, is split by hash into
parts of that size, and a vector meets all parts of a range it reaches.  Tiles
grow with the table until there are ``PARTS`` of them or their codes fill
``MOST`` bytes, since every vector is sent to each tile it may meet.

Equal vectors are one node with a weight; two 64-bit hashes name it.  A pair of tiles returns sums and a
spanning forest, one row per vector that has links, never its pairs; so a
group of near copies costs products, not rows.  On data without a main
direction all pairs of tiles remain and the products grow with the square of
the distinct vectors, as of any exact join by cosine in many dimensions.

Cases.  Vectors that are null, empty, zero or hold null or non-finite
components link with nothing.  Vectors of different lengths do not link.
Rows without id get their links counted but give no name to a component.
Repeated rows link with each other.  Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import default_parallelism

from . import common
from .components import components, join_labels

THRESHOLD, TILE, SAMPLE, BLOCK, STRIDE = 0.95, 4096, 4096, 512, 2048
#: Tiles wanted of a large table (their pairs are the tasks), and the most bytes of codes in one.
PARTS, MOST = 8, 6 << 20
#: Bytes of rows that one output batch holds, and of components that one step on single pairs does.
SLICE, STEP = 4 << 20, 4 << 20
#: Nodes whose names are broadcast to fetch their vectors.
NAMES = 1 << 16
#: Least rank error of the cuts, which bounds the sketch that finds them.
ERROR = 1e-4
#: Bounds and cosines in double precision are this far from the threshold before they decide.
SLACK = 1e-9

_ROWS = T.StructType([T.StructField("_id", T.LongType()), T.StructField("dim", T.IntegerType()),
                      T.StructField("vec", T.BinaryType())])
_DEALT = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("i", T.IntegerType()),
                       T.StructField("j", T.IntegerType()), T.StructField("tile", T.IntegerType()),
                       T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()),
                       T.StructField("vec", T.BinaryType())])
_FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()),
                       T.StructField("root", T.LongType())])
#: Undecided nodes keep what they were dealt with; ``vec`` is null for the others.
_MARKED = T.StructType([*_FOUND, *(f for f in _DEALT if f.name != "node")])


def _rows(batches):
    for batch in batches:
        col = batch.column(1)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(col)
        value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        good = np.add.reduceat(np.append(~np.isfinite(value), False), np.minimum(end - size, len(value))) if len(size) else np.zeros(0)
        square = np.add.reduceat(np.append(value * value, 0.0), np.minimum(end - size, len(value))) if len(size) else np.zeros(0)
        # reduceat gives a single entry for an empty range, so those are set apart by their size
        fine = (size > 0) & (good == 0) & np.isfinite(square) & (square > 0)
        data = np.where(value == 0, 0.0, value).astype("<f8")      # -0.0 and 0.0 are one value
        with np.errstate(over="ignore", invalid="ignore"):
            short = data.astype("<f4")                              # kept where it is the same value
            lost = short.astype("<f8") != data
        long = np.add.reduceat(np.append(lost, False), np.minimum(end - size, len(value))) if len(size) else np.zeros(0, bool)
        vecs = [(data if w else short)[e - s:e].tobytes() if ok else None for s, e, ok, w in zip(size, end, fine, long)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size.astype(np.int32)),
                                          pa.array(vecs, pa.binary())], names=_ROWS.names)


def _raw(vecs: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length, kept in single or double precision, as doubles."""
    short = np.fromiter(map(len, vecs), np.int64, len(vecs)) == 4 * dim
    x = np.empty((len(vecs), dim))
    x[short] = np.frombuffer(b"".join(v for v, f in zip(vecs, short) if f), "<f4").reshape(-1, dim)
    x[~short] = np.frombuffer(b"".join(v for v, f in zip(vecs, short) if not f), "<f8").reshape(-1, dim)
    return x


def _unit(vecs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = _raw(vecs, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, |s q| and |e| per vector (norms rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127.0
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    near = code * scale[:, None]
    up = 1 + 1e-12
    return code, scale, np.linalg.norm(near, axis=1) * up, np.linalg.norm(unit - near, axis=1) * up


def _packed(unit: np.ndarray) -> pa.Array:
    """Scale, |e| and int8 codes of each vector in one binary value."""
    code, scale, _, err = quantised(unit)
    data = np.concatenate([scale[:, None].view(np.uint8), err[:, None].view(np.uint8), code.view(np.uint8)], axis=1)
    ends = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


class Codes:
    """int8 codes of some vectors with what bounds their products."""

    def __init__(self, packed: list[bytes], dim: int):
        data = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), 16 + dim)
        self.scale, self.err = (np.ascontiguousarray(data[:, k:k + 8]).view("<f8")[:, 0] for k in (0, 8))
        self.code = data[:, 16:].view(np.int8)
        self.near = self.lengths(np.arange(len(packed)), 0) * (1 + 1e-12)
        self.top = float((self.near + self.err).max())
        #: Type in which products of codes are exact.
        self.kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64

    def lengths(self, at: np.ndarray, first: int) -> np.ndarray:
        """|s q| of the components from ``first`` on."""
        out = np.empty(len(at))
        step = max(1, STEP // self.code.shape[1])
        for lo in range(0, len(at), step):
            q = self.code[at[lo:lo + step], first:].astype(np.int32)
            out[lo:lo + step] = (q * q).sum(axis=1)
        return np.sqrt(out) * self.scale[at]

    def heads(self, at: np.ndarray, m: int, left: bool) -> np.ndarray:
        """Rows whose products, a left with a right one, are upper bounds: the
        first ``m`` components, the length of the rest, the errors' share."""
        out = np.empty((len(at), m + 3), np.float32)
        np.multiply(self.code[at, :m], self.scale[at][:, None].astype(np.float32), out=out[:, :m])
        out[:, m] = self.lengths(at, m)
        out[:, m + 1], out[:, m + 2] = (self.err[at], self.top) if left else (self.top, self.err[at])
        return out

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact products of the codes of a[i] and b[i]."""
        out = np.empty(len(a))
        step = max(1, STEP // self.code.shape[1])
        for lo in range(0, len(a), step):
            out[lo:lo + step] = np.einsum("ij,ij->i", self.code[a[lo:lo + step]].astype(self.kind),
                                          self.code[b[lo:lo + step]].astype(self.kind))
        return out


def _leading(codes: Codes, rows: np.ndarray, cols: np.ndarray, least: float) -> int:
    """Number of leading components that leave few pairs more than all do,
    judged on some pairs (it decides how much is multiplied, nothing else)."""
    dim = codes.code.shape[1]
    rows, cols = rows[::-(-len(rows) // 256)], cols[::-(-len(cols) // STRIDE)]

    def share(m: int) -> float:
        return float((codes.heads(rows, m, True) @ codes.heads(cols, m, False).T >= least).mean())
    few, m = 1.5 * share(dim) + 1 / 2000, 16
    while m < dim and share(m) > few:
        m += m // 2 if m & (m - 1) == 0 else m // 3          # 16, 24, 32, 48, 64, ...
    return min(m, dim)


def _set(mask: np.ndarray) -> np.ndarray:
    """Positions of the few true entries of a contiguous mask, eight at a time."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    word = np.flatnonzero(flat.view(np.uint64))
    of, at = np.nonzero(flat.reshape(-1, 8)[word])
    return word[of] * 8 + at


def near_pairs(codes: Codes, side: np.ndarray, same: bool, threshold: float):
    """(a, b, estimate, bound) of all pairs of two tiles, in blocks, whose
    cosine may reach the threshold.

    ``side`` tells the tile of each vector (0 or 1); ``same``: one tile with
    itself, each pair once.  A pair gets the same figures whatever other
    vectors there are.
    """
    n, dim = codes.code.shape
    rows = np.arange(n) if same else np.flatnonzero(side == 0)
    cols = np.arange(n) if same else np.flatnonzero(side == 1)
    if not len(rows) or not len(cols):
        return
    m = _leading(codes, rows, cols, threshold)
    least = np.float32(threshold - SLACK - (m + 8) * 2.0 ** -22)       # single precision rounds the products
    left, right = codes.heads(rows, m, True), np.ascontiguousarray(codes.heads(cols, m, False).T)
    full = np.empty((BLOCK, STRIDE), np.float32)
    for lo in range(0, len(rows), BLOCK):
        r = rows[lo:lo + BLOCK]
        for at in range(lo if same else 0, len(cols), STRIDE):
            c = cols[at:at + STRIDE]
            whole = len(r) == BLOCK and len(c) == STRIDE
            hit = _set(np.matmul(left[lo:lo + BLOCK], right[:, at:at + STRIDE], out=full if whole else None) >= least)
            many = len(hit) > len(r) * len(c) // 32
            a, b = np.divmod(hit, len(c))
            if same:
                once = r[a] < c[b]
                hit, a, b = hit[once], a[once], b[once]
            if not len(a):
                continue
            if many:
                dot = (codes.code[r].astype(codes.kind) @ codes.code[c].astype(codes.kind).T).ravel()[hit].astype(np.float64)
            a, b = r[a], c[b]
            if not many:
                dot = codes.dots(a, b)
            est = dot * codes.scale[a] * codes.scale[b]
            bound = codes.err[a] * (codes.near[b] + codes.err[b]) + codes.near[a] * codes.err[b]
            kept = np.flatnonzero(est + bound >= threshold - SLACK)
            if len(kept):
                yield a[kept], b[kept], est[kept], bound[kept]


class Links:
    """Weighted link counts and component labels, from pairs as they come."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.label = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append((a, b))
        self.waiting += len(a)
        if self.waiting > max(len(self.weight), 1 << 16):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.pairs))
            n = len(self.weight)
            self.count += (np.bincount(a, self.weight[b], n) + np.bincount(b, self.weight[a], n)).astype(np.int64)
            join_labels(self.label, a, b)
        self.pairs, self.waiting = [], 0


def tile_links(codes: Codes, weight: np.ndarray, side: np.ndarray, same: bool,
               threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts and labels by the pairs of two tiles that the bounds decide,
    and which vectors have a pair that they don't."""
    links, unsure = Links(weight), np.zeros(len(weight), bool)
    for a, b, est, bound in near_pairs(codes, side, same, threshold):
        sure = est - bound >= threshold + SLACK
        links.add(a[sure], b[sure])
        unsure[a[~sure]] = unsure[b[~sure]] = True
    links.settle()
    return links.count, links.label, unsure


def unsure_links(codes: Codes, vecs: list[bytes], weight: np.ndarray, side: np.ndarray, same: bool,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and labels by the pairs that the bounds don't decide, from
    the full vectors."""
    links, dim = Links(weight), codes.code.shape[1]
    step = max(1, STEP // dim)
    for a, b, est, bound in near_pairs(codes, side, same, threshold):
        open_ = est - bound < threshold + SLACK
        a, b = a[open_], b[open_]
        for lo in range(0, len(a), step):
            one, two = a[lo:lo + step], b[lo:lo + step]
            at, back = np.unique(np.concatenate([one, two]), return_inverse=True)
            x = _raw([vecs[k] for k in at], dim)
            p, s = x[back[:len(one)]], x[back[len(one):]]
            cos = (p * s).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((s * s).sum(1)))
            links.add(one[cos >= threshold], two[cos >= threshold])
    links.settle()
    return links.count, links.label


def _group(table: pa.Table) -> tuple[pa.Table, Codes, tuple]:
    """A pair of tiles by node, its codes, and weights, sides and whether it is
    one tile."""
    common.one_blas_thread()
    table = table.sort_by("node")
    side = (table["tile"].to_numpy() != table["i"].to_numpy()).astype(np.int8)
    same = table["i"][0].as_py() == table["j"][0].as_py()
    return table, Codes(table["vec"].to_pylist(), table["dim"][0].as_py()), (table["weight"].to_numpy(), side, same)


def _tile_rows(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table, codes, tiles = _group(table)
        count, label, unsure = tile_links(codes, *tiles, threshold)
        hit = np.flatnonzero((count > 0) | unsure)
        node, none = table["node"].to_numpy(), ~unsure[hit]
        table = table.take(pa.array(hit))
        return pa.Table.from_arrays(
            [table["node"], pa.array(count[hit]), pa.array(node[label[hit]], mask=count[hit] == 0),
             *(pc.if_else(pa.array(none), pa.scalar(None, table[c].type), table[c]) for c in _MARKED.names[3:])], names=_MARKED.names)
    return run


def _unsure_rows(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table, codes, tiles = _group(table)
        count, label = unsure_links(codes, table["full"].to_pylist(), *tiles, threshold)
        hit, node = np.flatnonzero(count > 0), table["node"].to_numpy()
        return pa.Table.from_arrays([pa.array(node[hit]), pa.array(count[hit]), pa.array(node[label[hit]])],
                                    names=_FOUND.names)
    return run


def _tiles(direction: dict[int, np.ndarray], cuts: dict[int, np.ndarray], parts: dict[int, np.ndarray], reach: float,
           out: T.StructType, axes: dict[int, np.ndarray] | None = None):
    """``parts``: per vector length, the number of parts of each range;
    ``axes``: those to code vectors in (none: vectors go as they are)."""
    def run(batches):
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            vec = batch.column(batch.schema.get_field_index("vec"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                vecs = vec.take(pa.array(at))
                unit = _unit(vecs.to_pylist(), int(dim))
                p = unit @ direction[int(dim)]
                cut = cuts[int(dim)]
                low, tile, high = (np.searchsorted(cut, p + d, "right") for d in (-reach, 0.0, reach))
                part_of = parts[int(dim)]
                base = np.cumsum(part_of) - part_of
                key = batch.column(batch.schema.get_field_index("node")).to_numpy()[at].view(np.uint64)
                tile = base[tile] + (key % part_of[tile].astype(np.uint64)).astype(np.int64)
                low, high = base[low], base[high] + part_of[high] - 1
                if axes:
                    vecs = _packed(unit @ axes[int(dim)])
                part = part.select(["dim", "node", "weight"])
                ends = np.cumsum(high - low + 1)
                first, most = 0, SLICE // (64 + 8 * int(dim))
                while first < len(at):                              # a batch of bounded size, a vector's rows at least
                    sent = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, sent + most, "right")))
                    lo, many = low[first:last], (high - low + 1)[first:last]
                    row = np.repeat(np.arange(first, last), many)
                    to = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                    own, first = tile[row], last
                    kept = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([
                        kept.column(0), pa.array(np.minimum(own, to).astype(np.int32)),
                        pa.array(np.maximum(own, to).astype(np.int32)), pa.array(own.astype(np.int32)),
                        kept.column(1), kept.column(2), vecs.take(pa.array(row))], names=out.names)
    return run


def _projected(direction: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                unit = _unit(batch.column(1).take(at).to_pylist(), int(dim))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(unit @ direction[int(dim)])],
                                                 names=["dim", "p"])
    return run


def _ranged(cut: np.ndarray):
    def run(batches):
        for batch in batches:
            found, many = np.unique(np.searchsorted(cut, batch.column(0).to_numpy(), "right"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(many, pa.int64())], names=["r", "n"])
    return run


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
            threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: its id, ``n_links`` (other vectors linked
    directly), ``component_id`` and ``kept`` (id = component_id)."""
    rows = common.stored(
        vectors.select(F.col(vec_id).cast("long").alias("_id"), F.col(embedding).alias("_v")).mapInArrow(_rows, _ROWS)
        .select("*", F.xxhash64("dim", "vec").alias("node"), F.xxhash64("vec", "dim").alias("twin")), "vectors")
    nodes = common.stored(
        rows.where(F.col("vec").isNotNull()).groupBy("dim", "vec", "node", "twin")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("_id").alias("least")), "nodes")
    direction: dict[int, np.ndarray] = {}
    axes: dict[int, np.ndarray] = {}
    cuts: dict[int, np.ndarray] = {}
    parts: dict[int, np.ndarray] = {}
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):      # a row per vector length
        some = nodes.where(F.col("dim") == dim).select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow()
        unit = _unit(some["vec"].to_pylist(), dim)
        axes[dim] = np.ascontiguousarray(np.linalg.eigh(unit.T @ unit)[1][:, ::-1])
        direction[dim] = axes[dim][:, 0]
        size = min(max(tile, -(-n // PARTS)), max(1, MOST // dim))
        k = -(-n // size)
        p = nodes.where(F.col("dim") == dim).select("dim", "vec").mapInArrow(_projected(direction), "dim int, p double")
        at = p.approxQuantile("p", [i / k for i in range(1, k)], max(0.1 / k, ERROR)) if k > 1 else []
        cuts[dim] = np.unique(at)
        sizes = p.select("p").mapInArrow(_ranged(cuts[dim]), "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).toArrow()
        parts[dim] = np.ones(len(cuts[dim]) + 1, np.int64)
        parts[dim][sizes["r"].to_numpy()] = -(-4 * sizes["n"].to_numpy() // (5 * size))      # a row per range; a quarter more goes
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    dealt = nodes.select("node", "dim", "vec", "weight").mapInArrow(_tiles(direction, cuts, parts, reach, _DEALT, axes), _DEALT)
    pairs = sum(int(x.sum()) * (int(x.sum()) + 1) // 2 for x in parts.values())
    spread = max(default_parallelism(nodes.sparkSession), min(2 * pairs, 2048))
    marked = common.stored(dealt.repartition(spread, "dim", "i", "j").groupBy("dim", "i", "j")
                           .applyInArrow(_tile_rows(threshold), _MARKED), "tiles")
    unsure = marked.where(F.col("vec").isNotNull()).drop("links", "root")
    wanted = unsure.select("node").distinct()
    few = wanted.limit(NAMES + 1).count() <= NAMES
    full = nodes.select("node", F.col("vec").alias("full")).join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    decided = common.stored(unsure.join(full, "node").groupBy("dim", "i", "j").applyInArrow(_unsure_rows(threshold), _FOUND), "unsure")
    found = marked.where("root IS NOT NULL").select(*_FOUND.names).unionByName(decided)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select("node", "root"), "node", "root")
    named = (nodes.join(comp, "node", "left").join(links, "node", "left")
             .select("node", "twin", "least", "weight", F.coalesce("component", "node").alias("c"),
                     F.coalesce("links", F.lit(0)).alias("links")))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    known = named.join(least, "c").select("node", "twin", (F.col("links") + F.col("weight") - 1).alias("n_links"),
                                          "component_id")
    good = rows.where(F.col("vec").isNotNull()).join(known, ["node", "twin"]).select("_id", "n_links", "component_id")
    bad = rows.where(F.col("vec").isNull()).select("_id", F.lit(0).cast("long").alias("n_links"),
                                                   F.col("_id").alias("component_id"))
    both = good.unionByName(bad)
    return both.select(F.col("_id").alias(vec_id), "n_links", "component_id",
                       F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The result over ``embeddings`` as DuckDB SQL: every pair, then all that can be reached.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
  AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine AS a JOIN fine AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM fine UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN many USING (vec_id) LEFT JOIN least USING (vec_id)
"""
