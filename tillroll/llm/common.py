"""Shared helpers: the cluster's shared folder, bounded Arrow slices, and
vectorised words, word hashes and n-gram hashes.

Words are maximal runs of bytes other than space and \\t..\\r.  Hashes are 64
bits, mixed block by block; two different words or n-grams collide with a
chance of about 2**-64 per pair, which the operators accept unless their
docstring says otherwise.  Token ids are never looked up by a hash alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy step works on (a single longer text goes alone).
SLICE_BYTES = 2 << 20


# ------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor sees.

    A scratch folder is made only for a single-machine session that names
    none (tests); on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-llm-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


#: Folders that this process has written and not removed.
_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """Path of a folder of its own in the shared folder, for :func:`release`."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables stored so far (after the first ``since``): for a
    caller whose results are written, since results read them until then."""
    from tillroll.session import remove_folder
    while len(_WRITTEN) > since:
        remove_folder(spark, _WRITTEN.pop())


def settled(spark: SparkSession, make, tag: str) -> DataFrame:
    """The DataFrame that ``make()`` gives, stored; what was stored on the way
    to it is removed."""
    mark = len(_WRITTEN)
    out = stored(make(), tag)
    own = _WRITTEN.pop()
    release(spark, mark)
    _WRITTEN.append(own)
    return out


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken, wish: str) -> str:
    """``wish``, or ``wish`` with underscores if the input already has it."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def per_worker(key, make):
    """``make()``, kept in the Python worker for its later tasks under ``key``.

    One object per name (``key[0]``): a new key replaces the old one.  This
    package is shipped by value, so the holder is a module of its own.
    """
    import sys
    import types
    holder = sys.modules.setdefault("tillroll_llm_per_worker", types.ModuleType("tillroll_llm_per_worker"))
    kept = holder.__dict__.setdefault("kept", {})
    if kept.get(key[0], (None,))[0] != key:
        kept[key[0]] = (key, make())
    return kept[key[0]][1]


def one_blas_thread() -> None:
    """Products in this Python worker run on one thread: Spark runs a task per
    core, and threads that wait for each other only spend the others' time.
    Where the library offers no such setting, nothing changes."""
    import ctypes

    def once():
        try:
            with open("/proc/self/maps") as maps:
                paths = {line.split()[-1] for line in maps if "openblas" in line}
        except OSError:
            return True
        for path in paths:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break
        return True
    per_worker(("blas",), once)


# ------------------------------------------------------------- Arrow slices
def binary(column) -> pa.Array:
    """A text column as large_binary; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], text: str,
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(batch, its text as large_binary) in pieces of about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = binary(batch.column(batch.schema.get_field_index(text)))
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
        lo = 0
        while lo < len(col):
            hi = int(np.searchsorted(ends, ends[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), len(col))
            yield batch.slice(lo, hi - lo), col.slice(lo, hi - lo)
            lo = hi


# ------------------------------------------------------------------- words
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (spreads every bit)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of a slice of texts: ``start``/``end`` byte positions in
    ``data`` and ``first``, the index of each text's first word (n + 1)."""

    def __init__(self, texts: pa.Array, lower: bool):
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0]: off[-1]] if raw is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data = data = _LOWER[data] if lower else data
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        before &= ~edge[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        after &= ~edge[1:]
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.solid = solid
        self.offsets = off

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """One uint64 per word."""
        size = self.end - self.start
        return span_hashes(self.data[self.solid], np.cumsum(size) - size)


def span_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One uint64 per span of ``data``; spans begin at ``start`` (the first
    at 0) and leave nothing out.  Blocks of 8 bytes are mixed with their
    place in the span before they are added, so no regular pattern of bytes
    (as with a polynomial modulo 2**64) makes two spans collide."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(start, len(data)))
    blocks = (size + 7) >> 3
    begin = np.cumsum(blocks) - blocks
    place = np.arange(len(data)) + np.repeat(begin * 8 - start, size)
    padded = np.zeros(int(blocks.sum()) * 8, np.uint8)
    padded[place] = data
    index = np.arange(len(padded) // 8, dtype=np.uint64) - np.repeat(begin, blocks).astype(np.uint64)
    word = mixed(padded.view("<u8") + mixed((index + np.uint64(1)) * _ODD[1]))
    return mixed(np.add.reduceat(word, begin) + size.astype(np.uint64) * _ODD[2])


# ------------------------------------------------- spans that tokenizers split
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_SIGN = np.zeros(256, bool)
_ASCII_SIGN[33:127] = True
_ASCII_SIGN &= ~_ASCII_LETTER


def sign_cuts(data: np.ndarray) -> np.ndarray:
    """Where an ASCII digit or sign follows a Latin letter: every pattern
    that matches runs of letters ends a piece there."""
    letter = _ASCII_LETTER[data]
    accented = np.zeros(len(data), bool)            # U+00E0 .. U+00FF but the division sign
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), bool)
    cut[1:] = _ASCII_SIGN[data[1:]] & (letter | accented)[:-1]
    return cut


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the spans, one span after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class IdTable:
    """Ids of spans, encoded once per distinct span and kept, within a bound,
    under the span's bytes for later slices.  When half of the bound is
    reached, a new generation starts and the one before the last goes; spans
    that come again move on, so frequent ones stay."""

    def __init__(self, encode_many, most: int):
        self.encode_many, self.most = encode_many, most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a span of each kind, kind of each span): grouped by hash, told
        apart by their bytes where different ones share it."""
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        first, back = order[new], np.empty(len(hashes), np.int64)
        back[order] = np.cumsum(new) - 1
        same_as = first[back]
        other = np.flatnonzero(same_as != np.arange(len(hashes)))
        size = (end - start)[other]
        equal = size == (end - start)[same_as[other]]
        other, size = other[equal], size[equal]
        if equal.all() and (data[_spread(start[other], size)] == data[_spread(start[same_as[other]], size)]).all():
            return first, back
        raw = data.tobytes()
        kinds: dict[bytes, int] = {}
        back = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(start.tolist(), end.tolist())])
        return np.unique(back, return_index=True)[1], back

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray,
                hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each span)."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, back = self.distinct(data, start, end, hashes)
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        got = list(map(self.known.get, keys))
        lack = [i for i, g in enumerate(got) if g is None]
        new = []
        for i, ids in zip(lack, map(self.older.get, [keys[i] for i in lack])):
            if ids is None:
                new.append(i)
            else:
                got[i] = self.known[keys[i]] = ids
        for i, ids in zip(new, self.encode_many([keys[i] for i in new])):
            got[i] = ids
            if len(ids) <= 256:
                self.known[keys[i]] = ids
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        count = size[back]
        at = np.repeat((np.cumsum(size) - size)[back] - (np.cumsum(count) - count), count)
        return flat[at + np.arange(len(at))], count


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered pair hash of two uint64 arrays."""
    return mixed(a * _ODD[1] + (b ^ _ODD[2]) * _ODD[0])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive entries (len(h) - n + 1 of them), by doubling.

    Entries of different texts may be mixed in one window; callers drop the
    windows that cross a border.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size, g = 1, h
    while size * 2 <= n:
        g = joined(g[: len(g) - size], g[size:])
        size *= 2
    if size < n:
        step = n - size
        g = joined(g[: len(g) - step], g[step:])
    return g


def gram_spans(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words start at ``first``: number of ``n``-word windows
    of each text, and the positions of all those windows."""
    many = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.cumsum(many) - many
    at = np.arange(int(many.sum())) - np.repeat(begin, many) + np.repeat(first[:-1], many)
    return many, at


def windowed_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive entries, by doubling."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    if size < n:
        x = np.minimum(x[: len(x) - (n - size)], x[n - size:])
    return x


def i64(h: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark longs (same bits)."""
    return pa.array(h.view(np.int64))
