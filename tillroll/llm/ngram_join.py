"""Exact self-join of documents by the Jaccard similarity of their word
n-grams, by prefix filters under several global orders.

If two sets have a similarity of at least t, a set x shares at least
``a = ceil(t |x|)`` shingles with any partner.  So under any global order of
shingles the first ``|x| - a + 1`` shingles of both have one in common.
Three orders are used, and a pair must pass all three before it is verified:

1. Rarity: by the number of sets that hold a shingle, then by hash.  The
   counts take one shuffle, packed per slice of texts.  A shingle of a single
   set matches nothing, so a set has index entries only if at least ``a`` of
   its shingles are shared, and most sets have none.
2. Hash order, and 3. reversed hash order: tested on the sets themselves,
   with their sizes, before the full intersection.

Links are wanted as components.  Two rounds of *blocks* settle groups of
copies: a set goes to the block of one of its most frequent index shingles,
a block is dealt into chunks of about ``CHUNK`` sets and ``CHUNK_SHINGLES``
shingles (a longer set goes with few others), and all pairs of a chunk are
filtered and verified there by matrix products; a chunk returns a spanning
forest, never its pairs.  So a group of m copies costs m / CHUNK chunks a
round.  What is left are pairs of sets that share an index shingle, were in
no chunk together and are in different components: all of them are verified.
No candidate is capped or dropped.

Cases.  Null and empty texts have no shingles and link with nothing.  Texts
of fewer than ``size`` words have one shingle, all their words.  Equal sets
are one node from the start.  Rows without id take part, but give no name to
a component; a component of such rows only has a null id.  Rows that share an
id are linked only through their texts.  Extra columns are ignored by
``classes`` and kept by ``dedup``.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components, join_labels

SIZE = 5
#: Similarity as a fraction of integers.
NUM, DEN = 75, 100
#: Shingles of one packed part (about 60 MB in a task), whatever the table's size.
PART = 3_000_000
#: Frequent shingles that are dealt over several parts (a bounded list).
HOT = 8192
#: Sets whose pairs are verified together, and their shingles (64 MB).
CHUNK, CHUNK_SHINGLES = 2048, 1 << 23
_END = np.uint64(0xA5A5A5A5A5A5A5A5)

_SETS = T.StructType([T.StructField("_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                      T.StructField("_key", T.LongType()), T.StructField("_t", T.LongType()),
                      T.StructField("_hot", T.BinaryType())])
_PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("keys", T.BinaryType()),
                        T.StructField("sizes", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                        T.StructField("tokens", T.BinaryType())])
_SHARED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("keys", T.BinaryType()),
                        T.StructField("sizes", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
                        T.StructField("df", T.BinaryType())])
_INDEX = T.StructType([T.StructField("token", T.LongType()), T.StructField("key", T.LongType()),
                       T.StructField("n", T.IntegerType())])


def _need(n, num: int, den: int):
    """Shingles a set of ``n`` shares with any partner, at least."""
    return -(-num * n // den)


def shingle_sets(raw: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash) of distinct shingles, sorted by both."""
    w = common.Words(raw, lower=True)
    h = w.hashes()
    many, at = common.gram_spans(w.first, size)
    owner = [np.repeat(np.arange(len(many)), many)]
    grams = [common.gram_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)]
    count = w.counts()
    for short in range(1, size):                    # texts of 1 .. size-1 words
        who = np.flatnonzero(count == short)
        if len(who):
            g = h[w.first[who]]
            for j in range(1, short):
                g = common.joined(g, h[w.first[who] + j])
            owner.append(who)
            grams.append(common.joined(g, np.full(len(g), _END) + np.uint64(short)))
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[new], grams[new]


def _set_keys(owner: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, first positions, set hashes) of ``n`` texts."""
    size = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(grams ^ _END), dtype=np.uint64)])
    return size, first, common.mixed(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))


def _find_sets(size: int):
    def run(batches):
        for part, raw in common.slices(batches, "_x"):
            owner, grams = shingle_sets(raw, size)
            n, first, key = _set_keys(owner, grams, len(raw))
            # shingles that many sets of this slice hold: candidates for the hot list
            some = np.zeros(len(raw), bool)
            some[np.unique(key, return_index=True)[1]] = True
            keep = some[owner]
            found, count = np.unique(grams[keep], return_counts=True)
            hot = count >= max(8, some.sum() // 100)
            note = np.column_stack([found[hot], count[hot].astype(np.uint64)]).tobytes()
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n.astype(np.int64)), common.i64(key), part.column(1),
                pa.array([note] + [None] * (len(raw) - 1), pa.binary())], names=_SETS.names)
    return run


def _spread(tokens: np.ndarray, keys: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Part of each shingle; hot ones are dealt by set as well."""
    where = tokens
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        where = np.where(hot[at] == tokens, common.joined(tokens, keys), tokens)
    return (common.mixed(where ^ _END) % np.uint64(parts)).astype(np.int32)


def _pack(size: int, hot: np.ndarray, parts: int):
    def run(batches):
        for part, raw in common.slices(batches, "_x", 2 * common.SLICE_BYTES):
            owner, grams = shingle_sets(raw, size)
            n, first, key = _set_keys(owner, grams, len(raw))
            some = np.zeros(len(raw), bool)
            some[np.unique(key, return_index=True)[1]] = True
            keep = some[owner]                          # of equal sets in the slice one
            owner, grams = owner[keep], grams[keep]
            if not len(owner):
                continue
            to = _spread(grams, key[owner], hot, parts)
            order = np.lexsort((owner, to))
            to, owner, grams = to[order], owner[order], grams[order]
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
            cols: list[list] = [[], [], [], [], []]
            for a, b in zip(edge[:-1], edge[1:]):
                who, count = np.unique(owner[a:b], return_counts=True)
                for c, v in zip(cols, (int(to[a]), key[who].tobytes(), n[who].astype(np.uint32).tobytes(),
                                       count.astype(np.uint32).tobytes(), grams[a:b].tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=_PACKED.names)
    return run


def _blob(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in table[name].to_pylist()] or [np.zeros(0, kind)])


def _count_shared(hot: np.ndarray, parts: int):
    """Of one part: shingles that several sets hold, regrouped by set."""
    def run(table: pa.Table) -> pa.Table:
        count = _blob(table, "counts", np.uint32)
        key = np.repeat(_blob(table, "keys", np.uint64), count)
        n = np.repeat(_blob(table, "sizes", np.uint32), count)
        token = _blob(table, "tokens", np.uint64)
        order = np.lexsort((key, token))
        key, n, token = key[order], n[order], token[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])       # equal sets count once
        key, n, token = key[new], n[new], token[new]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
        run_len = np.diff(np.append(start, len(token)))
        df = np.repeat(run_len, run_len).astype(np.uint32)
        if len(hot) and len(token):
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            df[hot[at] == token] = np.iinfo(np.uint32).max              # last in the order, whatever the part saw
        many = df > 1
        key, n, token, df = key[many], n[many], token[many], df[many]
        to = (common.mixed(key) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        key, n, token, df, to = key[order], n[order], token[order], df[order], to[order]
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(0, int)
        spans = list(zip(edge[:-1], edge[1:]))
        return pa.Table.from_arrays(
            [pa.array([int(to[a]) for a, _ in spans], pa.int32())]
            + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, n, token, df)],
            names=_SHARED.names)
    return run


def _choose_index(num: int, den: int):
    """Of one part of sets: the index shingles under the order by rarity."""
    def run(table: pa.Table) -> pa.Table:
        key, n = _blob(table, "keys", np.uint64), _blob(table, "sizes", np.uint32).astype(np.int64)
        token, df = _blob(table, "tokens", np.uint64), _blob(table, "df", np.uint32)
        order = np.lexsort((token, df, key))
        key, n, token = key[order], n[order], token[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        shared = np.diff(np.append(start, len(key)))
        size = n[start]
        left = np.maximum(shared - _need(size, num, den) + 1, 0)       # the prefix less the shingles of one set only
        take = np.arange(len(key)) - np.repeat(start, shared) < np.repeat(left, shared)
        return pa.Table.from_arrays([common.i64(token[take]), common.i64(key[take]),
                                     pa.array(n[take].astype(np.int32))], names=_INDEX.names)
    return run


def _bag_rows(size: int, out: T.StructType):
    def run(batches):
        for part, raw in common.slices(batches, "_x"):
            owner, grams = shingle_sets(raw, size)
            n, first, _ = _set_keys(owner, grams, len(raw))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                names=out.names)
    return run


def overlap(x: np.ndarray, y: np.ndarray, num: int, den: int) -> int:
    """Size of the intersection of two sorted sets, or -1 if the sizes or the
    orders by hash exclude a link."""
    a, b = len(x), len(y)
    if not a or not b or den * min(a, b) < num * max(a, b):
        return -1
    p, q = a - _need(a, num, den) + 1, b - _need(b, num, den) + 1
    for one, two in ((x[:p], y[:q]), (x[a - p:], y[b - q:])):
        at = np.minimum(np.searchsorted(two, one), len(two) - 1)
        if not (two[at] == one).any():
            return -1
    at = np.minimum(np.searchsorted(y, x), b - 1)
    return int((y[at] == x).sum())


def shared_counts(row: np.ndarray, token: np.ndarray, m: int) -> np.ndarray:
    """(m, m) numbers of tokens that two of ``m`` sets share; ``row`` and
    ``token`` list the sets' entries."""
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    df = np.diff(np.append(start, len(token)))
    out = np.zeros((m, m), np.float32)
    for k in range(2, 17):                              # tokens of few sets: their pairs
        at = start[df == k]
        if len(at):
            who = row[at[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            for lo in range(0, len(who), 1 << 15):
                w = who[lo:lo + (1 << 15)]
                np.add.at(out, (w[:, i].ravel(), w[:, j].ravel()), 1)
    out += out.T
    many = np.flatnonzero(df > 16)                      # the others: a product of 0/1 matrices
    for lo in range(0, len(many), 2048):
        part = many[lo:lo + 2048]
        x = np.zeros((m, len(part)), np.float32)
        at = np.repeat(start[part] - (np.cumsum(df[part]) - df[part]), df[part]) + np.arange(int(df[part].sum()))
        x[row[at], np.repeat(np.arange(len(part)), df[part])] = 1
        out += x @ x.T
    return out


def chunk_links(bags: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs (i < j) of a chunk of sorted sets."""
    m = len(bags)
    n = np.array([len(b) for b in bags])
    row = np.repeat(np.arange(m), n)
    token = np.concatenate(bags)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    prefix = n - _need(n, num, den) + 1
    pass_ = den * np.minimum(n[:, None], n[None]) >= num * np.maximum(n[:, None], n[None])
    pass_ &= np.triu(np.ones((m, m), bool), 1)
    for inside in (at < prefix[row], at >= (n - prefix)[row]):          # both orders by hash
        if not pass_.any():
            break
        pass_ &= shared_counts(row[inside], token[inside], m) > 0
    if not pass_.any():
        return np.zeros(0, int), np.zeros(0, int)
    both = shared_counts(row, token, m)
    i, j = np.nonzero(pass_)
    c = both[i, j].astype(np.int64)
    linked = den * c >= num * (n[i] + n[j] - c)
    return i[linked], j[linked]


def _chunk_rows(num: int, den: int):
    """Of one part: a spanning forest of the links of every chunk in it."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("key", "ascending")])
        chunk, key, bag = table["chunk"].to_numpy(), table["key"].to_numpy(), table["bag"].to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edge[:-1], edge[1:]):
            if hi - lo < 2:
                continue
            i, j = chunk_links([np.frombuffer(x, np.uint64) for x in bag[lo:hi]], num, den)
            label = np.arange(hi - lo)
            join_labels(label, i, j)
            moved = np.flatnonzero(label != np.arange(hi - lo))
            a.append(key[lo:hi][moved])
            b.append(key[lo:hi][label[moved]])
        return pa.Table.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def _verify_rows(num: int, den: int):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bx", "by"))
            good = np.zeros(len(x), bool)
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                c = overlap(p, q, num, den)
                good[i] = c > 0 and den * c >= num * (len(p) + len(q) - c)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return run


def _verified(pairs: DataFrame, bags: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of pairs of keys."""
    one = pairs.join(bags.select(F.col("key").alias("a"), F.col("bag").alias("bx")), "a")
    both = one.join(bags.select(F.col("key").alias("b"), F.col("bag").alias("by")), "b").select("a", "b", "bx", "by")
    return both.mapInArrow(_verify_rows(num, den), "a long, b long")


def shingle_classes(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``_id``, ``n_shingles``, ``_key`` (hash of the set), ``_t`` (hash of the text) of every row."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("_x"))
    return common.stored(keyed.mapInArrow(_find_sets(size), _SETS), "sets")


def index(docs: DataFrame, sets: DataFrame, text: str, size: int, num: int, den: int) -> DataFrame:
    """``token``, ``key``, ``n``: the index shingles of sets that have any."""
    spark = docs.sparkSession
    notes = (sets.where(F.col("_hot").isNotNull()).select("_hot")
             .mapInArrow(_note_rows, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
             .orderBy(F.desc("count"), "token").limit(HOT).toArrow())
    hot = np.sort(notes["token"].to_numpy().astype(np.int64).view(np.uint64))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // PART + 1)
    packed = docs.select(F.col(text).alias("_x")).mapInArrow(_pack(size, hot, parts), _PACKED)
    shared = packed.groupBy("part").applyInArrow(_count_shared(hot, parts), _SHARED)
    return common.stored(shared.groupBy("part").applyInArrow(_choose_index(num, den), _INDEX), "index")


def _note_rows(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([common.i64(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)],
                                         names=["token", "count"])


def links(docs: DataFrame, sets: DataFrame, text: str, size: int, num: int, den: int, doc_id: str) -> DataFrame:
    """Edges ``a``, ``b`` between keys, enough for every component; every
    pair of linked sets is in one component of them."""
    ix = index(docs, sets, text, size, num, den)
    # the text of a set: that of its smallest id, or one without id if no row of it has one
    first = F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_t"))
    reps = (sets.where("n_shingles > 0").groupBy("_key").agg(first.alias("_r"))
            .select(F.col("_key").alias("key"), F.col("_r._id").alias("_id"), F.col("_r._t").alias("_t")))
    named = ix.select("key").distinct().join(reps, "key")
    bag = T.StructType([T.StructField("key", T.LongType()), T.StructField("bag", T.BinaryType())])
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("_x"))
    own = own.where(F.col("_id").isNotNull()).unionByName(own.where(F.col("_id").isNull()).dropDuplicates(["_t"]))
    own = own.alias("o").join(named.alias("n"), F.expr("o._id <=> n._id AND o._t = n._t")).select("n.key", "o._x")
    bags = common.stored(own.mapInArrow(_bag_rows(size, bag), bag), "bags")

    # two rounds of blocks: the most frequent index shingle, and one of about that frequency
    deal = F.greatest(F.ceil(F.col("c") / CHUNK), F.ceil(F.col("s") / CHUNK_SHINGLES)).alias("m")
    sizes = common.stored(ix.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).where("c > 1")
                          .select("token", "c", deal), "sizes")
    by_set = ix.join(sizes, "token").groupBy("key").agg(
        F.max("n").alias("n"), F.max(F.struct("c", F.col("token").alias("t"), "m")).alias("x"),
        F.max(F.struct(F.floor(F.log2("c")), F.xxhash64(F.lit(1), "token"), F.col("token").alias("t"), "m")).alias("y"))

    def chunk(block, turn: int):
        salt = F.pmod(F.xxhash64(F.lit(turn), "key"), block["m"])
        return F.xxhash64(F.lit(turn), block["t"], salt)

    blocks = common.stored(by_set.select("key", "n", chunk(F.col("x"), 1).alias("chunk1"), chunk(F.col("y"), 2).alias("chunk2")), "blocks")
    many, held = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // CHUNK + 1, held // CHUNK_SHINGLES + 1)
    blocks = blocks.drop("n")
    in_block = bags.join(blocks, "key")
    rounds = [in_block.select(F.pmod(F.col(c), F.lit(parts)).alias("part"), F.col(c).alias("chunk"), "key", "bag")
              .groupBy("part").applyInArrow(_chunk_rows(num, den), "a long, b long") for c in ("chunk1", "chunk2")]
    comp = common.stored(components(rounds[0].unionByName(rounds[1]), "a", "b"), "comp")

    # what is left: pairs under one index shingle, in no chunk together, of different components
    known = common.stored(
        ix.join(blocks, "key").join(comp.withColumnRenamed("node", "key"), "key", "left")
        .select("token", "key", "n", "chunk1", "chunk2", F.coalesce("component", "key").alias("c")), "known")
    open_ = common.stored(
        known.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("chunk1").alias("k0"),
                                   F.max("chunk1").alias("k1")).where("c0 < c1 AND k0 < k1").select("token"), "open")
    rest = known.join(open_, "token")
    own_open = rest.groupBy("key").agg(F.collect_list("token").alias("tokens"))
    rest = common.stored(rest.join(own_open, "key"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    # each pair once: under the smallest open shingle that both have
    pairs = (x.join(y, F.expr("x.token = y.token AND x.key > y.key AND x.c <> y.c"
                              " AND x.chunk1 <> y.chunk1 AND x.chunk2 <> y.chunk2"
                              f" AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)"
                              " AND x.token = array_min(array_intersect(x.tokens, y.tokens))"))
             .select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))
    late = _verified(pairs, bags, num, den)
    # the components so far are stars, so these edges and the late ones are all
    return comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, num: int = NUM,
            den: int = DEN) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the
    smallest id reachable by links (itself without links)."""
    sets = shingle_classes(docs, doc_id, text, size)
    comp = common.stored(components(links(docs, sets, text, size, num, den, doc_id), "a", "b"), "classes")
    named = (sets.where("n_shingles > 0").groupBy("_key").agg(F.min("_id").alias("_least"))
             .join(comp.withColumnRenamed("node", "_key"), "_key", "left")
             .select("_key", "_least", F.coalesce("component", "_key").alias("_c")))
    least = named.groupBy("_c").agg(F.min("_least").alias("component_id"))
    by_key = named.join(least, "_c").select("_key", "component_id")
    linked = sets.where("n_shingles > 0").join(by_key, "_key").select("_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("_id", doc_id)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, that with the smallest id; of equal
    rows one, while rows without id and other texts under that id stay."""
    keep = classes(docs, doc_id, text, **how).where(F.col(doc_id) == F.col("component_id")).select(
        F.col(doc_id).alias("_keep")).distinct()
    named = docs.where(F.col(doc_id).isNotNull())
    kept = named.join(keep, F.col(doc_id).cast("long") == F.col("_keep"), "left_semi")
    mark = common.free_name(docs.columns, "_hash")
    kept = kept.withColumn(mark, F.xxhash64(F.col(text))).dropDuplicates([doc_id, mark]).drop(mark)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))


#: The result over ``documents`` as DuckDB SQL: intersections of all sets that share a shingle.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE list_distinct(
  list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' '))) END AS s FROM w),
cells AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM cells AS a JOIN cells AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets AS p ON p.doc_id = a JOIN sets AS q ON q.doc_id = b
  WHERE {DEN} * n >= {NUM} * (len(p.s) + len(q.s) - n)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""
