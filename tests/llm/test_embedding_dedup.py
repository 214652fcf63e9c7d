import numpy as np
from llm_brute import roots

from tillroll.llm import embedding_dedup as ed


def brute(x, t=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= t
    np.fill_diagonal(link, False)
    top = roots(range(len(x)), zip(*(a.tolist() for a in np.nonzero(link))))
    return {i: (int(link[i].sum()), top[i]) for i in range(len(x))}


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def vectors(n=420, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n, 3):                                     # pairs near the threshold
        j = rng.integers(n)
        x[i] = x[j] + rng.normal(size=dim) * np.linalg.norm(x[j]) / 4 * rng.uniform(0.2, 0.45)
    x[50:90] = x[50] + rng.normal(size=(40, dim)).astype(np.float32) * 0.05
    x[100:130] = x[100]                                          # equal vectors
    x[131] = 3 * x[100]                                          # and a parallel one
    return x


def test_all_pairs_over_several_tiles(spark):
    x = vectors()
    want = brute(x.astype(np.float64))
    for tile in (32, 4096):
        have = {r.vec_id: (r.n_links, r.component_id) for r in ed.classes(table(spark, x), tile=tile).collect()}
        assert have == want


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(300, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code, scale, near, err = ed.quantised(u)
    est = (code.astype(float) @ code.T.astype(float)) * scale[:, None] * scale[None]
    bound = err[:, None] * near[None] + near[:, None] * err[None] + err[:, None] * err[None]
    assert (np.abs(u @ u.T - est) <= bound + 1e-12).all() and bound.max() < 0.1


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (None, [2.0, 4.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string")
    have = sorted(((r.vec_id or -1), r.n_links, r.component_id) for r in ed.classes(df).collect())
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert have == sorted(alone + [(7, 3, 7), (8, 3, 7), (8, 3, 7), (-1, 3, 7), (10, 1, 10), (11, 1, 10)])
    assert ed.classes(df.limit(0)).count() == 0


def test_tied_projections_are_split(spark):
    rng = np.random.default_rng(5)
    x = np.zeros((500, 12), np.float32)                           # a main direction, and sparse vectors across it
    x[:200, 0] = 1
    x[:200, 1:] = rng.normal(0, 0.02, (200, 11))
    for k in range(200, 500):
        i, j = rng.choice(np.arange(1, 12), 2, replace=False)
        x[k, i], x[k, j] = rng.choice([1, 2, 3, 20], 2)
    direction = {12: np.eye(12)[0]}
    cuts, parts = {12: np.array([0.5])}, {12: np.array([-(-300 // 64), -(-200 // 64)])}
    want = brute(x.astype(np.float64))
    have = {r.vec_id: (r.n_links, r.component_id) for r in ed.classes(table(spark, x), tile=64).collect()}
    assert have == want
    import pyarrow as pa
    from pyspark.sql import types as T
    names = ["dim", "i", "j", "tile", "node", "weight", "vec"]
    out = T.StructType([T.StructField(c, T.LongType()) for c in names])
    node = rng.integers(0, 1 << 60, 500)
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array([12] * 500, pa.int32()), pa.array([1] * 500, pa.int64()), pa.array(
        [row.astype("<f8").tobytes() for row in x], pa.binary())], names=["node", "dim", "weight", "vec"])
    dealt = pa.Table.from_batches(ed._tiles(direction, cuts, parts, 0.1, out)(iter([batch])))
    own = dealt.group_by("tile").aggregate([("node", "count_distinct")])
    assert own.num_rows == 9 and max(own["node_count_distinct"].to_pylist()) < 110
    pairs = set(zip(dealt["i"].to_pylist(), dealt["j"].to_pylist()))
    assert len(pairs) == 5 * 6 // 2 + 4 * 5 // 2                   # parts of a range meet each other, ranges apart do not


def test_batches_stay_small_with_many_tiles():
    import pyarrow as pa
    from pyspark.sql import types as T
    rng = np.random.default_rng(6)
    names = ["dim", "i", "j", "tile", "node", "weight", "vec"]
    out = T.StructType([T.StructField(c, T.LongType()) for c in names])
    batch = pa.RecordBatch.from_arrays([
        pa.array(rng.integers(0, 1 << 60, 3000)), pa.array([8] * 3000, pa.int32()), pa.array([1] * 3000, pa.int64()),
        pa.array([row.tobytes() for row in rng.normal(size=(3000, 8))], pa.binary())], names=["node", "dim", "weight", "vec"])
    cuts = np.linspace(-0.9, 0.9, 63)
    sent = list(ed._tiles({8: np.eye(8)[0]}, {8: cuts}, {8: np.ones(64, np.int64)}, 3.0, out)(iter([batch])))
    assert sum(b.num_rows for b in sent) == 3000 * 64              # every vector to every tile
    assert max(b.nbytes for b in sent) <= 4 << 20


def test_copies_do_not_grow_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(7)
    made, tiles = [], ed._tiles

    def counted(direction, cuts, parts, *rest):
        made.append(int(parts[6].sum()))
        return tiles(direction, cuts, parts, *rest)
    monkeypatch.setattr(ed, "_tiles", counted)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    have = {r.vec_id: (r.n_links, r.component_id) for r in ed.classes(table(spark, x), tile=16).collect()}
    assert have == brute(x.astype(np.float64))
    assert 4 < made[0] <= 2 * ed.PARTS                             # 57 tiles of 16 vectors would be


def around(rng, n, dim, gap):
    """Pairs with cosines a little over and under 0.95, in turn."""
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, n, 2):
        y = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        c = 0.95 + (gap if k % 4 else -gap)
        x[k + 1] = (c * x[k] + np.sqrt(1 - c * c) * y / np.linalg.norm(y)) * rng.uniform(0.5, 9)
    return x


def test_tiles_decide_or_mark_every_pair():
    rng = np.random.default_rng(8)
    for dim, n, gap in ((3, 300, 1e-6), (40, 600, 1e-6), (64, 2600, 1e-3), (1100, 90, 1e-6)):
        x = around(rng, n, dim, gap)
        x[-60:] = x[-60] + rng.normal(size=(60, dim)) * np.linalg.norm(x[-60]) / np.sqrt(dim) * 0.2       # many links in a block
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        packed = ed._packed(u @ axes).to_pylist()
        codes = ed.Codes(packed, dim)
        weight = rng.integers(1, 5, n)
        link = u @ u.T >= 0.95
        np.fill_diagonal(link, False)
        for same in (True, False):
            side = np.zeros(n, np.int8) if same else rng.integers(0, 2, n).astype(np.int8)
            want = link if same else link & (side[:, None] != side)
            count, label, unsure = ed.tile_links(codes, weight, side, same, 0.95)
            some = np.flatnonzero(unsure)
            vecs = [row.astype("<f8").tobytes() for row in x[some]]
            rest = ed.Codes([packed[k] for k in some], dim)
            more, join = ed.unsure_links(rest, vecs, weight[some], side[some], same, 0.95) if len(some) else (0, some)
            assert len(some) >= (n // 4 if gap == 1e-6 and same else 0)
            count[some] += more
            assert (count == want @ weight).all()
            top = roots(range(n), [*zip(range(n), label.tolist()), *zip(some.tolist(), some[join].tolist())])
            assert top == roots(range(n), zip(*(a.tolist() for a in np.nonzero(want))))


def test_undecided_pairs_come_with_full_vectors(spark):
    x = around(np.random.default_rng(9), 400, 40, 1e-7)
    x[10] = x[11]
    x[20:24] = x[20].astype(np.float32)                            # kept in four bytes a component, the others in eight
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    have = {r.vec_id: (r.n_links, r.component_id) for r in ed.classes(df, tile=64).collect()}
    assert have == brute(x)
