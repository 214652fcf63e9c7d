"""Byte-level BPE encoding and decoding with a public rank file.

Method.  The bytes of a piece are mapped to Latin-1 characters; the trie of
an Aho-Corasick automaton gives the longest vocabulary entry that starts at
a position.  The encoder walks from left to right with those longest matches
and backtracks: a token may follow
another only if the two are *compatible*, i.e. merging the bytes of both
by rank gives exactly the two tokens back.  Compatibility is memoised per
pair, a position found to be a dead end is never entered again, so the walk
is linear in the piece, and its result equals that of the merges.

Cases.  Null text encodes as the empty text (no ids).  Empty text: no ids.
A piece of any length is encoded whole.  Repeated rows are encoded each;
no row is joined to another.  Extra columns pass through; a column of the
input named like an output column is replaced.  An empty table gives an
empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Cached pieces (all at most 64 bytes long) and token pairs per worker.
CACHE_PIECES, CACHE_PAIRS = 400_000, 2_000_000
#: The pattern that the public rank files go with (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes looked ahead for the longest match; longer than any token of the public files.
LONGEST = 256


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token bytes, id) of a rank file; the file has one line per token."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


class Encoder:
    """Encodes single pieces of bytes; pieces share no merges."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        import ahocorasick
        if max((len(b) for b, _ in ranks), default=0) > LONGEST:
            raise ValueError(f"tokens of over {LONGEST} bytes")
        self.rank = dict(ranks)
        self.bytes_of = {i: b for b, i in ranks}
        self.size = {i: len(b) for b, i in ranks}
        self.pair: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        # Latin-1 text of every path of the trie -> the longest token on it
        self.on_path: dict[str, int] = {}
        self.trie = ahocorasick.Automaton()
        words = {b.decode("latin-1"): i for b, i in ranks}
        for w, i in words.items():
            self.trie.add_word(w, i)
            found = -1
            for k in range(1, len(w) + 1):
                found = words.get(w[:k], found)
                self.on_path[w[:k]] = found
        self.trie.make_automaton()

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by rank; only for the bytes of one token."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is the last step to ``token``; a byte
        is its own two halves, (-1, -1) marks a token no merge ever makes."""
        known = self.halves.get(token)
        if known is None:
            b = self.bytes_of[token]
            if len(b) == 1:
                known = (token, token)
            elif self.merged(b) != [token]:
                known = (-1, -1)
            else:
                parts = [b[i:i + 1] for i in range(len(b))]
                while len(parts) > 2:
                    at = min((r, i) for i in range(len(parts) - 1)
                             if (r := self.rank.get(parts[i] + parts[i + 1])) is not None)[1]
                    parts[at:at + 2] = [parts[at] + parts[at + 1]]
                known = (self.rank[parts[0]], self.rank[parts[1]])
            self.halves[token] = known
        return known

    def fits(self, one: int, two: int) -> bool:
        """Whether the bytes of both merge to exactly these two tokens.

        Undoes merges from the border outwards, the later one first: were two
        neighbours at the border mergeable before the merge just undone, the
        border would not have survived.
        """
        if self.split(one)[0] < 0 or self.split(two)[0] < 0:
            return False
        rank, of, limit = self.rank, self.bytes_of, 1 << 62
        while True:
            both = rank.get(of[one] + of[two])
            if both is not None and both < limit:
                return False
            inner, outer = self.split(one)[1], self.split(two)[0]
            if one == inner and two == outer:
                return True
            if two == outer or one != inner and one > two:
                limit, one = one, inner
            else:
                limit, two = two + 1, outer

    def next_shorter(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix; -1 if none."""
        known = self.shorter.get(token)
        if known is None:
            b = self.bytes_of[token]
            known = self.on_path[b[:-1].decode("latin-1")] if len(b) > 1 else -1
            self.shorter[token] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        reach, on_path, size, pair = self.trie.longest_prefix, self.on_path, self.size, self.pair
        longest: dict[int, int] = {}
        closed: set[int] = set()
        out: list[int] = []
        pos, last = 0, -1
        token = longest[0] = on_path[text[:reach(text[:LONGEST])]]
        while True:
            end = pos + size[token]
            if end not in closed:
                if last < 0:
                    good = self.split(token)[0] >= 0
                else:
                    key = last << 32 | token
                    good = pair.get(key)
                    if good is None:
                        if len(pair) >= CACHE_PAIRS:
                            pair.clear()
                        good = pair[key] = self.fits(last, token)
                if good:
                    out.append(token)
                    if end == n:
                        return out
                    pos, last = end, token
                    token = longest.get(pos, -1)
                    if token < 0:
                        ahead = text[pos: pos + LONGEST]
                        token = longest[pos] = on_path[ahead[:reach(ahead)]]
                    continue
            shorter = self.next_shorter(token)
            if shorter >= 0:
                token = shorter
                continue
            if last < 0:
                raise ValueError("a byte is missing from the vocabulary")
            closed.add(pos)         # no way on from here
            token = out.pop()       # its end is closed now, so a shorter one is tried
            pos -= size[token]
            last = out[-1] if out else -1


class TextEncoder:
    """Whole texts: pieces by a pattern, each distinct span encoded once.

    For the public pattern the spans are found on the bytes of a slice of
    texts at once: a piece never crosses the place before a word's space, the
    ends of other white space, or the place where a sign or digit follows a
    letter.  Texts with white space beyond ASCII are split by the pattern.
    """

    def __init__(self, ranks, pattern: str):
        import regex
        self.encoder = Encoder(ranks)
        self.find = regex.compile(pattern).findall
        self.plain = pattern == PATTERN
        self.table = common.IdTable(lambda spans: [self.pieces(s.decode("utf-8", "replace")) for s in spans], CACHE_PIECES)
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> bytes:
        """The text split by the pattern."""
        out, cache = [], self.cache
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = np.array(self.encoder.encode(piece.encode("utf-8")), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (large_binary) as little-endian uint32."""
        if not self.plain:
            return [self.pieces(t.decode("utf-8", "replace")) for t in texts.to_pylist()]
        w = common.Words(texts, lower=False)
        data, off = w.data, w.offsets
        begin = np.zeros(len(data) + 1, bool)
        begin[off] = True                                    # texts
        begin[:-1] |= common.sign_cuts(data) & w.solid
        begin[w.end] = True                                  # white space after a word
        at = w.start[~begin[w.start] | (begin[w.start] & ~np.isin(w.start, off))]
        at = at[at > 0]
        spaced = data[at - 1] == 32
        begin[at[~spaced]] = True                            # a word after other white space,
        begin[at - 1] = True                                 # whose last character stands alone
        begin[len(data)] = False
        start = np.flatnonzero(begin)
        # a word's space belongs to it
        end = np.append(start[1:], len(data))
        ids, count = self.table.look_up(data, start, end, common.span_hashes(data, start))
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = upto[np.searchsorted(start, off)]
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        out = [raw[4 * a:4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        for i in np.unique(np.searchsorted(off, np.flatnonzero(_wide_space(data)), "right") - 1).tolist():
            out[i] = self.pieces(texts[i].as_py().decode("utf-8", "replace"))
        return out


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII, or what some count as such, begins."""
    one = np.append(data[1:], 0)
    two = np.append(data[2:], [0, 0])[: len(data)]
    e2 = (data == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)))
                           | ((one == 0x81) & (two == 0x9F)))
    return (((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC2) & ((one == 0x85) | (one == 0xA0)) | e2
            | (data == 0xE1) & (one == 0x9A) & (two == 0x80) | (data == 0xE3) & (one == 0x80) & (two == 0x80))


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
           ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit ids as binary, the compact
    form) and ``n_tokens``; every other column, ``text`` included, stays."""
    ranks = read_ranks(ranks_path)
    key = hash(tuple(ranks))
    out = _with(df.schema, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()))
    keep = [f.name for f in out.fields[:-2]]

    def run(batches):
        enc = common.per_worker(("bpe", key, pattern), lambda: TextEncoder(ranks, pattern))
        for part, raw in common.slices(batches, text):
            got = enc.encode(raw)
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(got, pa.binary()), pa.array([len(g) // 4 for g in got], pa.int64())],
                names=[*keep, ids, n_tokens])

    return df.mapInArrow(run, out)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the tokens in ``ids``.

    Null ids decode to no bytes.  An id outside the vocabulary is an error.
    """
    ranks = read_ranks(ranks_path)
    out = _with(df.schema, T.StructField(decoded, T.BinaryType()))
    keep = [f.name for f in out.fields[:-1]]

    def run(batches):
        table = dict((i, b) for b, i in ranks)
        for part, raw in common.slices(batches, ids):
            got = [b"".join(map(table.__getitem__, np.frombuffer(b, "<u4").tolist())) for b in raw.to_pylist()]
            cols = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(got, pa.binary())], names=[*keep, decoded])

    return df.mapInArrow(run, out)
