"""Packing of tokenised texts into training sequences by vector bin packing.

Each sequence has three limits at once: tokens, segments, and tokens that
bear loss.  The dot-product heuristic fills one sequence at a time: of the
pieces that fit, the one with the largest weighted dot product between its
demands and what is left of the sequence goes in.  When nothing fits any
more, the piece with the largest product is cut, so that its head fills the
sequence and its tail goes back; a text longer than a sequence first gives
whole sequences of its own.  Only the last sequence of a block, and those
that end at the segment or loss limit, need padding.

Packing is local to a Spark partition and works on blocks of ``BLOCK``
pieces, so memory is bounded, nothing is shuffled, and a lost task is
redone alone.  ``sequence_id`` is the partition's number times 2**40 plus a
running number.

Cases.  Null and empty texts have the end token only.  Null ids of rows,
ties and repeated rows are ordinary rows; pieces carry the row's id.  An
empty table gives no pieces.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Pieces that compete for a sequence; a bound on memory, not on results.
BLOCK = 4096
CACHE_CHUNKS = 600_000
#: New words that the tokenizer gets as one text.
WORDS_AT_ONCE = 128

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("loss_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType())])


class ChunkTokenizer:
    """Ids of whole texts with bounded caches.

    Runs between ASCII white space are looked up whole; the vocabulary's
    splitting never crosses that.  New runs of plain Latin text are
    normalised and split by the vocabulary's own pattern, so that only new
    words reach the tokenizer, many in one text with spaces between them: an
    id that ends a word tells where the next one starts.  Any other run goes
    there whole and by itself.
    """

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.table = common.IdTable(self.many, CACHE_CHUNKS)
        self.find = self.spaced = None
        plan = json.loads(tokenizer_json)
        steps = [n["type"] for n in (plan.get("normalizer") or {}).get("normalizers", [])]
        splits = (plan.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.special = {a["content"][:2] for a in plan.get("added_tokens", [])}
        if steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and splits[0].get("invert") \
                and splits[1]["type"] == "ByteLevel" and not splits[1].get("add_prefix_space"):
            self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall
            self.odd = regex.compile("|".join(["[^\\0-\u024f]", *map(regex.escape, sorted(self.special))])).search
            suffix, words = plan["model"].get("end_of_word_suffix"), self.tok.get_vocab()
            if suffix and not splits[1].get("use_regex", True) \
                    and all(c in words and c + suffix in words for c in pre_tokenizers.ByteLevel.alphabet()):
                self.closes = np.zeros(max(words.values()) + 1, bool)
                self.closes[[i for w, i in words.items() if w.endswith(suffix)]] = True
                at_space = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
                self.spaced = Tokenizer.from_str(json.dumps(plan | {
                    "normalizer": None, "added_tokens": [],
                    "pre_tokenizer": plan["pre_tokenizer"] | {"pretokenizers": [at_space, splits[1]]}}))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each of these words in normal form."""
        out = []
        texts = [words[lo:lo + WORDS_AT_ONCE] for lo in range(0, len(words), WORDS_AT_ONCE)]
        got = self.spaced.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False) if self.spaced else [None] * len(texts)
        for text, e in zip(texts, got):
            ids = np.array(e.ids if e else (), "<u4")
            edge = (np.flatnonzero(self.closes[ids]) + 1).tolist() if e else []
            if len(edge) == len(text):
                raw = ids.tobytes()
                out += [raw[4 * a:4 * b] for a, b in zip([0] + edge, edge)]
            else:
                out += self.alone(text)
        return out

    def alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each run.

        Up to U+024F there is nothing to compose, and lower case does not
        depend on the neighbours, so ``lower`` is the vocabulary's whole
        normalisation there.
        """
        text = b" ".join(chunks).decode("utf-8", "replace")     # a run holds no space
        texts = text.split(" ")
        if not chunks or self.find is None:
            return self.alone(texts[:len(chunks)])
        whole = [i for i, t in enumerate(texts) if self.odd(t)] if self.odd(text) else []
        low = text.lower().split(" ")
        split = {i: self.find(t) for i, t in enumerate(low) if not t.isalpha()}
        for i in whole:
            split[i], low[i] = [], ""
        todo = list(dict.fromkeys([t for t in low if t.isalpha()] + [p for ps in split.values() for p in ps]))
        known = dict(zip(todo, self.words(todo)))
        out = list(map(known.get, low))
        for i, ps in split.items():
            out[i] = b"".join([known[p] for p in ps])
        for i, ids in zip(whole, self.alone([texts[i] for i in whole])):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (large_binary) as little-endian uint32."""
        w = common.Words(texts, lower=False)
        cut = common.sign_cuts(w.data) if self.find is not None else np.zeros(len(w.data), bool)
        if self.special and cut.any():
            # the words that may hold a special token stay whole
            first = np.frombuffer("".join(sorted({s[0] for s in self.special})).encode(), np.uint8)
            odd = np.isin(w.data, first)
            if odd.any():
                which = np.searchsorted(w.start, np.flatnonzero(odd & w.solid), "right") - 1
                for k in np.unique(which).tolist():
                    cut[w.start[k]:w.end[k]] = False
        begin = np.zeros(len(w.data), bool)
        begin[w.start] = True
        begin |= cut & w.solid
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(w.data))
        word = np.searchsorted(w.start, start, "right") - 1
        end = np.minimum(end, w.end[word]) if len(start) else end[:0]
        size = end - start
        hashes = common.span_hashes(w.data[w.solid], np.cumsum(size) - size)
        ids, count = self.table.look_up(w.data, start, end, hashes)
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = upto[np.searchsorted(word, w.first)]
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def pack_block(tokens: np.ndarray, loss: np.ndarray, max_tokens: int, max_segments: int,
               max_loss: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pack items of ``tokens`` tokens, of which all (``loss`` true) or none
    bear loss.

    Returns rows (item, start, length, bin, offset) and, per item, how many
    tokens are placed: unless ``last``, items that no full sequence took
    stay for the next block.
    """
    most = np.array([max_tokens, max_segments, max_loss], float)
    left = tokens.astype(np.int64).copy()
    rows: list[tuple[int, int, int, int, int]] = []
    n_bin = 0
    reach = min(max_tokens, max_loss)
    for i in np.flatnonzero(left >= np.where(loss, reach, max_tokens)):       # whole sequences of one text
        size = reach if loss[i] else max_tokens
        while left[i] >= size:
            rows.append((int(i), int(tokens[i] - left[i]), size, n_bin, 0))
            left[i] -= size
            n_bin += 1
    alive = np.flatnonzero(left > 0)
    total = np.array([left[alive].sum(), len(alive), left[alive][loss[alive]].sum()], float)
    weight = total / most
    weight /= max(weight.sum(), 1e-12)
    while len(alive):
        if not last and left[alive].sum() < 2 * max_tokens:
            break
        room = most.copy()
        offset = 0
        while len(alive) and room[0] >= 1 and room[1] >= 1:
            size = left[alive]
            heavy = loss[alive]
            reachable = np.where(heavy, min(room[0], room[2]), room[0])
            score = (weight[0] * size / most[0] * room[0] / most[0] + weight[1] / most[1] * room[1] / most[1]
                     + weight[2] * np.where(heavy, size, 0) / most[2] * room[2] / most[2])
            fits = size <= reachable
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1.0)))
            else:
                at = int(np.argmax(np.where(reachable >= 1, score, -1.0)))
                if reachable[at] < 1:
                    break
            i, take = int(alive[at]), int(min(size[at], reachable[at]))
            rows.append((i, int(tokens[i] - left[i]), take, n_bin, offset))
            offset += take
            left[i] -= take
            room -= (take, 1, take if loss[i] else 0)
            if not left[i]:
                alive = np.delete(alive, at)
        n_bin += 1
    return rows, tokens - left


def pack(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", loss: str | None = None,
         end_id: int | None = 2, max_tokens: int = 4096, max_segments: int = 256,
         max_loss: int | None = None) -> DataFrame:
    """Pieces (``PIECES``, with their ids) of all texts, packed.

    ``loss`` names a boolean column: whether a row's tokens bear loss (null:
    no); without it all do.  ``end_id`` is appended to each text's ids.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    key = hash(vocabulary)
    max_loss = max_loss or max_tokens
    cols = [doc_id, text] + ([loss] if loss else [])

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark runs a task per core
        tok = common.per_worker(("tokenizer", key), lambda: ChunkTokenizer(vocabulary))
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple] = []              # (doc_id, first token, ids, loss, all tokens)

        def flush(last: bool):
            nonlocal next_id, held
            size = np.array([len(h[2]) // 4 for h in held], np.int64)
            bears = np.array([h[3] for h in held], bool)
            rows, done = pack_block(size, bears, max_tokens, max_segments, max_loss, last)
            out: list[list] = [[] for _ in PIECES]
            for i, start, length, seq, offset in rows:
                d, base, ids, b, whole = held[i]
                piece = ids[4 * start: 4 * (start + length)]
                for c, v in zip(out, (d, base + start, length, zlib.crc32(piece), whole, length if b else 0,
                                      next_id + seq, offset, piece)):
                    c.append(v)
            next_id += max((r[3] for r in rows), default=-1) + 1
            held = [(h[0], h[1] + int(k), h[2][4 * int(k):], h[3], h[4])
                    for h, k, n in zip(held, done, size) if k < n]
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=PIECES.names)

        pending = 0
        for part, raw in common.slices(batches, text):
            ids = [e + end for e in tok.encode(raw)]
            who = part.column(0).to_pylist()
            bears = [bool(x) for x in part.column(2).to_pylist()] if loss else [True] * len(ids)
            for d, e, b in zip(who, ids, bears):
                if e:
                    held.append((d, 0, e, b, len(e) // 4))
                    pending += len(e)
                if len(held) >= BLOCK or pending >= 16 << 20:
                    yield flush(False)
                    pending = sum(len(h[2]) for h in held)
        if held:
            yield flush(True)

    return df.select(*cols).mapInArrow(run, PIECES)
