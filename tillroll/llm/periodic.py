"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period p (words p apart
are identical), at least ``min_len`` and ``min_periods * p`` long, that no
neighbouring word extends keeping period p.

Every run with 2**k <= p < 2**(k+1) holds an aligned block of 2**k words and
that block's copy p words later, since it is three periods long (runs of p < 8
hold an aligned block of 8 words and its copy).  So per level k each aligned
block asks for its occurrences in the window of starts that follows it.

- Blocks are named by prefix doubling over the suffixes whose first 8 words
  come more than once in the text; the same doubling sorts them, and a block's
  equal suffixes are one interval of that (sparse) suffix array.
- A wavelet tree over the suffix array answers the range successor: the first
  (second, ...) start in the interval that lies in the window.
- A window is no longer than the block, so three or more occurrences are one
  arithmetic progression, whose difference is the block's own period.  The
  block and its copy then lie in two stretches of that short period, which
  begin, or end, exactly p apart: two candidates.  One or two occurrences are
  candidates themselves.

Candidates become stretches of equal words p apart, extended step by step and
merged as they meet; a multiple of the smallest period gives the same stretch
and loses to it.  Words are compared by exact numbers, not by hashes: hashes
only set apart 8-word starts that come once.

The work is within each task, over whole texts, in slices of bounded size (a
longer text goes alone); there is no shuffle.  Memory is a small multiple of
the slice, or of the longest text.

Cases.  Null and empty texts have no words and no run.  Ids may be null or
repeated; every row has its own result.  Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_LEN, MIN_PERIODS = 24, 3
BASE = 3                       #: level of the shortest block, 8 words
_CELLS = 1 << 21               #: cells that one vectorised comparison holds


# ---------------------------------------------------------------- wavelet tree
class Wavelet:
    """Wavelet tree, level by level, over a permutation of 0 .. n - 1."""

    def __init__(self, values: np.ndarray):
        self.depth = max(int(len(values) - 1).bit_length(), 1)
        self.zeros, self.before = [], []
        for bit in range(self.depth - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.before.append(np.concatenate([[0], np.cumsum(one)]))      # ones before each place
            self.zeros.append(len(values) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are smaller than x (x may be any n up to 2**depth)."""
        over = x >> self.depth > 0
        count = np.where(over, hi - lo, 0)
        for level, (zeros, before) in enumerate(zip(self.zeros, self.before)):
            one = (x >> (self.depth - 1 - level) & 1).astype(bool)
            a, b = before[lo], before[hi]
            count += np.where(one & ~over, (hi - lo) - (b - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of [lo, hi) with ``rank`` smaller ones (0 <= rank < hi - lo)."""
        value = np.zeros(len(lo), np.int64)
        for zeros, before in zip(self.zeros, self.before):
            a, b = before[lo], before[hi]
            left = (hi - lo) - (b - a)
            one = rank >= left
            rank = np.where(one, rank - left, rank)
            value = value * 2 + one
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return value


# ---------------------------------------------------------------- suffix array
def _numbers(*columns: np.ndarray) -> np.ndarray:
    """Equal rows get equal numbers (exact; columns below 2**31)."""
    key = columns[0]
    for c in columns[1:]:
        key = np.unique((key.astype(np.int64) << 31) | c, return_inverse=True)[1]
    return key


def _suspects(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts whose 8-word gram comes more than once in its text (by hash, so
    a few others may be among them)."""
    size = 1 << BASE
    many, at = common.gram_spans(first, size)
    if not len(at):
        return at
    text = np.repeat(np.arange(len(many)), many).astype(np.uint64)
    h = common.joined(common.gram_hashes(common.mixed(ids.astype(np.uint64)), size)[at], text)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return at[twice]


class Suffixes:
    """The sorted suffixes that start at ``starts`` and, per level, the
    intervals of the aligned blocks among them."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, starts: np.ndarray):
        n, m = len(ids), len(starts)
        owner = np.searchsorted(first, starts, "right") - 1
        self.begin, self.end = first[owner], first[owner + 1]
        pairs = np.concatenate([starts + k for k in range(0, 1 << BASE, 2)])
        name = _numbers(ids[pairs], ids[pairs + 1])
        name = name.reshape(-1, m)
        two = _numbers(np.concatenate([name[0], name[2]]), np.concatenate([name[1], name[3]])).reshape(2, m)
        name = _numbers(_numbers(two[0], two[1]), owner)
        order = np.argsort(name, kind="stable")
        place = np.empty(m, np.int64)                    # of each start in the suffix array: its group's first
        edge = np.append(True, np.diff(name[order]) != 0)
        place[order] = np.flatnonzero(edge)[np.cumsum(edge) - 1]
        where = np.full(n, -1, np.int64)                 # word -> index among the starts
        where[starts] = np.arange(m)
        self.blocks = []                                 # (level, index of the start, lo, hi)
        level = BASE
        longest = int((self.end - self.begin).max()) if m else 0
        while m:
            size = np.bincount(place, minlength=m)
            open_ = order[size[place[order]] > 1]        # in suffix-array order
            if not len(open_):
                break
            ask = open_[((starts[open_] - self.begin[open_]) & ((1 << level) - 1)) == 0]
            self.blocks.append((level, ask, place[ask], place[ask] + size[place[ask]]))
            if MIN_PERIODS << (level + 1) > longest:
                break
            later = starts[open_] + (1 << level)
            inside = later + (1 << level) <= self.end[open_]
            index = np.where(inside, where[np.minimum(later, n - 1)], -1)
            # a later half that is no start of the array, or reaches beyond the text, equals no other
            second = np.where(index >= 0, place[index], m + np.arange(len(open_)))
            again = np.lexsort((second, place[open_]))
            group, second = place[open_][again], second[again]
            fresh = np.append(True, (np.diff(group) != 0) | (np.diff(second) != 0))
            new = np.append(True, np.diff(group) != 0)
            at = group + np.arange(len(group)) - np.flatnonzero(new)[np.cumsum(new) - 1]      # places of the sorted ones
            order[at] = open_[again]
            place = place.copy()
            place[open_[again]] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            level += 1
        self.order = order


# ---------------------------------------------------------------- comparisons
def _equal_for(ids, i, j, step, most):
    """For how many words t = 0, 1, .. (``most`` at most) is ids[i + step t] ==
    ids[j + step t]; i, j, most are arrays, every place in range."""
    done = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    width = 32
    while len(live):
        rest = []
        for part in np.array_split(live, len(live) * width // _CELLS + 1):
            t = done[part, None] + np.arange(width)
            ok = t < most[part, None]
            t = np.minimum(t, most[part, None] - 1) * step
            ok &= ids[i[part, None] + t] == ids[j[part, None] + t]
            run = np.where(ok.all(axis=1), width, ok.argmin(axis=1))
            done[part] += run
            rest.append(part[(run == width) & (done[part] < most[part])])
        live = np.concatenate(rest)
        width = min(width * 2, 4096)
    return done


def _stretch(ids, start, size, period, begin, end, most):
    """Bounds of the stretch of ``period`` around [start, start + size), looking
    ``most`` words to either side."""
    left = _equal_for(ids, start - 1, start - 1 + period, -1, np.minimum(start - begin, most))
    right = _equal_for(ids, start + size, start + size - period, 1, np.minimum(end - start - size, most))
    return start - left, start + size + right, left < most, right < most


def _candidates(ids, suffixes: Suffixes, starts) -> list[tuple]:
    """(start, size, period, begin, end) of blocks with a copy ``period`` later."""
    tree = Wavelet(suffixes.order)
    out = []
    for level, ask, lo, hi in suffixes.blocks:
        size = 1 << level
        windows = [(size, 2 * size)] if level > BASE else [(1, size), (size, 2 * size)]
        for near, far in windows:
            from_, to = np.searchsorted(starts, starts[ask] + near), np.searchsorted(starts, starts[ask] + far)
            rank, beyond = tree.below(lo, hi, from_), tree.below(lo, hi, to)
            count = beyond - rank

            def nth(k, some):
                return starts[tree.smallest(lo[some], hi[some], rank[some] + k)]

            def give(some, period):
                if len(some):
                    out.append((starts[ask[some]], np.full(len(some), size), period,
                                suffixes.begin[ask[some]], suffixes.end[ask[some]]))
            if near == 1:                                # at most seven starts: each is a candidate
                for k in range(size - 1):
                    some = np.flatnonzero(count > k)
                    give(some, nth(k, some) - starts[ask[some]])
                continue
            for k in (0, 1):
                some = np.flatnonzero((count > k) & (count < 3))
                give(some, nth(k, some) - starts[ask[some]])
            some = np.flatnonzero(count >= 3)
            if not len(some):
                continue
            block, copy = starts[ask[some]], nth(0, some)
            short = nth(1, some) - copy
            begin, end = suffixes.begin[ask[some]], suffixes.end[ask[some]]
            l0, r0, sure_l0, sure_r0 = _stretch(ids, block, size, short, begin, end, 4 * size)
            l1, r1, sure_l1, sure_r1 = _stretch(ids, copy, size, short, begin, end, 4 * size)
            for period, sure in ((l1 - l0, sure_l0 & sure_l1), (r1 - r0, sure_r0 & sure_r1)):
                ok = sure & (period >= size) & (period < 2 * size)
                ok[ok] = (block + period + size <= end)[ok]
                ok[ok] = _equal_for(ids, block[ok], block[ok] + period[ok], 1, np.full(int(ok.sum()), size)) == size
                give(some[ok], period[ok])
    return out


def _merged(x, y, p):
    """Stretches [x, y) of equal period that touch, as one."""
    order = np.lexsort((x, p))
    x, y, p = x[order], y[order], p[order]
    new = np.append(True, np.diff(p) != 0)
    group = np.cumsum(new) - 1
    # running maximum of the ends within a period: periods are set apart by an offset
    wide = int(y.max()) + 1
    top = np.maximum.accumulate(y + group * wide) - group * wide
    fresh = new.copy()
    fresh[1:] |= x[1:] > top[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(x)) - 1
    return x[at], top[last], p[at]


def find(ids: np.ndarray, first: np.ndarray, min_len: int = MIN_LEN, min_periods: int = MIN_PERIODS):
    """Runs of texts whose words have the numbers ``ids`` and begin at
    ``first``: arrays (start in ``ids``, length, period), sorted by start, period."""
    none = np.zeros(0, np.int64)
    starts = _suspects(ids, first)
    if not len(starts):
        return none, none, none
    found = _candidates(ids, Suffixes(ids, first, starts), starts)
    if not found:
        return none, none, none
    x, size, p, begin, end = (np.concatenate(c) for c in zip(*found))
    # words i and i + p are equal for i in [x, y); limits of a text hold for all its stretches
    owner_end = first[1:]
    y = x + size
    x, y, p = _merged(x, y, p)
    live = np.ones(len(x), bool)
    reach = 64
    while live.any():
        own = np.searchsorted(first, x, "right") - 1
        b, e = first[own], owner_end[own]
        most = np.where(live, reach, 0)
        left = _equal_for(ids, x - 1, x - 1 + p, -1, np.minimum(x - b, most))
        right = _equal_for(ids, y, y + p, 1, np.minimum(e - p - y, most))
        grown = live & ((left == most) | (right == most))
        x, y = x - left, y + right
        keys = set(zip(x[grown].tolist(), p[grown].tolist()))
        x, y, p = _merged(x, y, p)
        # a merged stretch goes on if one of its parts may
        live = np.zeros(len(x), bool)
        if keys:
            kx, kp = (np.array(c) for c in zip(*sorted(keys)))
            order = np.lexsort((x, p))                   # as _merged left them
            wide = int(max(x.max(), kx.max())) + 1
            at = np.searchsorted(p[order] * wide + x[order], kp * wide + kx, "right") - 1
            live[order[at]] = True
        reach = min(reach * 2, 1 << 16)
    length = y + p - x
    long_ = (length >= min_len) & (length >= min_periods * p)
    x, length, p = x[long_], length[long_], p[long_]
    order = np.lexsort((p, length, x))                   # equal stretches: the smallest period first
    x, length, p = x[order], length[order], p[order]
    if len(x):
        keep = np.append(True, (np.diff(x) != 0) | (np.diff(length) != 0))
        x, length, p = x[keep], length[keep], p[keep]
    order = np.lexsort((p, x))
    return x[order], length[order], p[order]


# ---------------------------------------------------------------- Spark
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def word_numbers(words: common.Words) -> np.ndarray:
    """Equal words of a slice get equal numbers, by their bytes."""
    size = words.end - words.start
    ends = np.append(0, np.cumsum(size))
    data = words.data[words.solid]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def collapsed(words: common.Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by single spaces."""
    size = (words.end - words.start)[keep]
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + step] = words.data[np.repeat(words.start[keep], size) + step]
    raw = out.tobytes()
    ends = np.append(at, len(raw))[np.searchsorted(np.flatnonzero(keep), words.first)]
    return [raw[a:max(b - 1, a)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _dropped(n: int, start, length, period) -> np.ndarray:
    """Words after the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) > 0


def _detector(text: str, min_len: int, min_periods: int):
    def run(batches):
        for batch, texts in common.slices(batches, text):
            words = common.Words(texts, lower=False)
            start, length, period = find(word_numbers(words), words.first, min_len, min_periods)
            own = np.searchsorted(words.first, start, "right") - 1
            kept = collapsed(words, ~_dropped(len(words), start, length, period))
            ends = np.searchsorted(own, np.arange(len(texts) + 1))
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start - words.first[own]), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name != text]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(words.counts()), runs, pa.array(kept, pa.binary()).cast(pa.string())],
                names=names + ["n_words", "runs", "collapsed"])
    return run


def runs(df: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",), min_len: int = MIN_LEN,
         min_periods: int = MIN_PERIODS) -> DataFrame:
    """``columns`` of every row, with ``n_words``, ``runs`` (array of start,
    length, period; by start, then period) and ``collapsed``: the text without
    the words that follow a run's first period."""
    if min_periods < MIN_PERIODS or min_len < MIN_LEN:
        raise ValueError(f"runs need {MIN_PERIODS} periods and {MIN_LEN} words or more")
    schema = T.StructType([df.schema[c] for c in columns] + [
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("collapsed", T.StringType())])
    return df.select(*columns, F.col(text).alias("_text")).mapInArrow(_detector("_text", min_len, min_periods), schema)


def strongest(found: Column) -> Column:
    """The run of greatest length / period (exact); ties: smallest start, then period."""
    wide = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    rest = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.when(F.size(found) > 0, F.aggregate(rest, found[0], lambda a, b: F.when(
        wide(b["length"], a["period"]) > wide(a["length"], b["period"]), b).otherwise(a)))
