"""Operator 5: byte-level BPE by corpus-level merge replay.

The corpus is first reduced to its distinct pre-tokens: each task emits those it meets, once each, and an aggregate counts in how many tasks each occurs. Pre-tokens that
are tokens need no merges. What recurs is replayed once for the whole corpus (``recurring``): dealt by word into shards, each with an inverted index that
holds, for each rank, the places in its words where two neighbours join to the token of that rank; the least pending rank is popped, applied to all
its words at once, and only the touched neighbours are looked up again. A pop merges all places of a word from the left, every other one where they
overlap, up to the first that makes a pair of a lower rank: that one comes first, exactly as in a word-by-word encoder.

The words found in most tasks, as many as fit ``SENT`` bytes, are then sent to all tasks, which look them up. Text never leaves its task. A word that is not sent (it occurs
in one task alone, or in fewer than those that fill the bound) is replayed by the same index among the new words of its group of shards (``GROUP`` bytes of
text, in Arrow batches cut at ``SHARD_BYTES`` or one document); a worker remembers about ``KNOWN`` words. Words are compared as 63-bit hashes.

Null and empty texts have no ids. Rows are independent: repeated ids or rows and extra columns don't matter. ``path`` names a rank file. Encoding
reads the documents twice and runs the first pass when it is called.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import cut_lineage
from .decontaminate import pieces
from .pretokens import Words, pretokens

SHARD_BYTES, GROUP, KNOWN, SENT = 4 << 20, 24 << 20, 1 << 20, 16 << 20
#: Fixed value: the pattern whose pre-tokens module ``pretokens`` cuts with numpy; others are matched by ``regex``.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
U64 = np.uint64


class Vocabulary:
    """A rank file: tokens by rank, and the rank of every pair of tokens that joins to a token."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(ranks.values()) + 1
        self.split = regex.compile(pattern)
        self.ranks = ranks
        self.tokens = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        length = np.array([len(t) for t in self.tokens], np.int64)
        self.length, self.at = length, np.cumsum(length) - length
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: Words | None = None
        self.corpus = None

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair joins to, or -1."""
        out = np.full(len(left), -1, np.int32)
        for a in range(0, len(left) if len(self.pair) else 0, A.BLOCK):
            key = (left[a : a + A.BLOCK].astype(np.int64) << 32) | right[a : a + A.BLOCK]
            k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            out[a : a + A.BLOCK] = np.where(self.pair[k] == key, self.joined[k], -1)
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and the n + 1 offsets."""
        size = np.array([len(w) for w in words], np.int64)
        total = int(size.sum())
        kind = np.int32 if total < 2**31 - 2 else np.int64
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        token = np.append(self.byte_ids[raw], -1).astype(np.int32)
        after, before = np.arange(1, total + 2, dtype=kind), np.arange(-1, total, dtype=kind)
        last = np.cumsum(size)[size > 0] - 1
        first = last - size[size > 0] + 1
        after[last], before[first] = total, total  # place ``total`` is no token
        alive = np.ones(total + 1, bool)
        alive[total] = False
        rank = np.full(total + 1, -1, np.int32)
        rank[: max(total - 1, 0)] = self.join(token[: max(total - 1, 0)], token[1:total])
        rank[last] = -1
        index: dict[int, list] = {}  # places, some as arrays
        heap: list[int] = []

        def put(ranks, places):
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, np.int64)
            for q, some in zip(ranks[cut].tolist(), np.split(places, cut[1:]) if len(cut) else (), strict=True):
                if q in index:
                    index[q].append(some)
                else:
                    index[q] = [some]
                    heapq.heappush(heap, q)

        some = np.flatnonzero(rank >= 0).astype(kind)
        put(rank[some], some)
        while heap:
            r = heapq.heappop(heap)
            places = np.concatenate(index.pop(r))
            places = np.unique(places[alive[places] & (rank[places] == r)])
            if not len(places):
                continue
            places, later = self._turn(places, r, word, token, before, after, total)
            if len(later):
                index[r] = [later]
                heapq.heappush(heap, r)
            gone = after[places]
            end = after[gone]
            token[places] = r
            alive[gone] = False
            after[places] = end
            before[end] = places
            has = end < total
            rank[places] = -1
            rank[places[has]] = self.join(token[places[has]], token[end[has]])
            prior = before[places]
            has = prior < total
            prior = prior[has]
            rank[prior] = self.join(token[prior], token[places[has]])
            touched = np.r_[places, prior]
            ranks = rank[touched]
            if (ranks >= 0).any():
                put(ranks[ranks >= 0], touched[ranks >= 0])
        alive = alive[:-1]
        return token[:-1][alive], np.r_[0, np.cumsum(np.bincount(word[alive], minlength=len(words)))]

    def _turn(self, places, r, word, token, before, after, total) -> tuple[np.ndarray, np.ndarray]:
        """Which places of rank r merge now, and which wait. In a row of overlapping places every other one merges, as from the left; in each word all up to the
        first whose merge makes a pair of a lower rank, which has to come before the rest."""
        chain = np.r_[True, after[places[:-1]] != places[1:]]
        head = np.flatnonzero(chain)
        all_places = places
        places = places[(np.arange(len(places)) - head[np.cumsum(chain) - 1]) % 2 == 0]
        end, prior = after[after[places]], before[places]
        right = np.where(end < total, self.join(np.full(len(places), r, np.int32), token[end]), -1)
        left_token = np.where(np.r_[False, end[:-1] == places[1:]], r, token[prior])  # the neighbour on the left may have merged just before
        left = np.where(prior < total, self.join(left_token, np.full(len(places), r, np.int32)), -1)
        stop = ((left >= 0) & (left < r)) | ((right >= 0) & (right < r))
        if not stop.any():
            return places, places[:0]
        new = np.r_[True, word[places][1:] != word[places][:-1]]
        begins = np.flatnonzero(new)[np.cumsum(new) - 1]
        stops = np.cumsum(stop) - stop  # stops before this place, in all words
        places = places[stops == stops[begins]]
        return places, np.setdiff1d(all_places, places)  # those that overlap a merged one are dropped when their turn comes

    def cut(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, the start and end of each pre-token in them, and the n + 1 offsets into these by text."""
        if self.split.pattern == CUT:
            buf, off = A.flat(column)
            start, at = pretokens(buf, off)
            return buf, start[:-1], start[1:], at
        rows = [[w.encode() for w in self.split.findall(t)] if t else [] for t in column.to_pylist()]
        edge = np.r_[0, np.cumsum([len(w) for r in rows for w in r], dtype=np.int64)]
        return np.frombuffer(b"".join(w for r in rows for w in r), np.uint8), edge[:-1], edge[1:], np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]

    def unknown(self, known: Words, h: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Hashes and bytes of the words that aren't known, once each."""
        new = np.flatnonzero(known.find(h) < 0)
        keys, first = np.unique(h[new], return_index=True)
        at = new[first]
        return keys, [buf[x:y].tobytes() for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)]

    def tokens_known(self) -> Words:
        """A table of known words that holds the tokens themselves."""
        known, words = Words(), list(self.ranks)
        known.learn(hashes_of(words), np.array([self.ranks[w] for w in words]), np.arange(len(words) + 1))
        return known

    def know(self, sent: Recurring | None) -> Words:
        """The worker's table of known words, begun anew for another corpus or where it has grown too large."""
        if self.known is None or self.corpus != (sent and sent.corpus) or self.known.n > KNOWN + (len(sent.hashes) if sent else 0):
            self.known, self.corpus = self.tokens_known(), sent and sent.corpus
            if sent:
                self.known.learn(sent.hashes, sent.ids, sent.at)
        return self.known

    def encode_all(self, columns: list, sent: Recurring | None = None):
        """The ids of all texts of a column on end, and the n + 1 offsets, for one column after the other; the words that aren't known yet share one index."""
        known = self.know(sent)
        hashed, new = [], {}
        for column in columns:
            buf, start, end, at = self.cut(column)
            h = A.span_hashes(buf, start, end) | U64(1)
            hashed.append((h, at))
            keys, words = self.unknown(known, h, buf, start, end)
            new.update(zip(keys.tolist(), words, strict=True))
        if new:
            known.learn(np.array(list(new), U64), *self.replay(list(new.values())))
        size, first = np.diff(known.flat_at), known.flat_at[:-1]
        while hashed:
            h, at = hashed.pop(0)
            flow = known.find(h)
            done = np.r_[0, np.cumsum(size[flow])]
            yield A.gather(known.flat_ids, first[flow], size[flow]), done[at]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and the n + 1 offsets."""
        return next(self.encode_all([pa.array(texts, pa.string())]))

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts on end, and the n + 1 offsets."""
        size = self.length[ids]
        return A.gather(self.bytes, self.at[ids], size), np.r_[0, np.cumsum(size)][off]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _groups(shards):
    """Some shards at a time, ``GROUP`` of them at most in bytes."""
    group, size = [], 0
    for shard in shards:
        if group and size + shard.nbytes > GROUP:
            yield group
            group, size = [], 0
        group.append(shard)
        size += shard.nbytes
    if group:
        yield group


def hashes_of(words: list[bytes]) -> np.ndarray:
    edge = np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]
    return A.span_hashes(np.frombuffer(b"".join(words), np.uint8), edge[:-1], edge[1:]) | U64(1)


class Recurring(NamedTuple):
    """Words that are sent to all tasks: hashes, ids on end and the n + 1 offsets into these."""

    corpus: str
    hashes: np.ndarray
    ids: np.ndarray
    at: np.ndarray


def recurring(docs: DataFrame, text_col: str, path: str, pattern: str) -> DataFrame:
    """word, ids (32-bit, little-endian) and n, the number of tasks that met it (a task counts a word again after ``KNOWN`` others): all pre-tokens of the
    corpus that more than one met and that are no tokens themselves."""

    def meet(batches):
        v = vocabulary(path, pattern)
        seen = v.tokens_known()
        for piece in pieces(batches, text_col, SHARD_BYTES):
            if seen.n > KNOWN:
                seen = v.tokens_known()
            buf, start, end, _ = v.cut(piece[text_col])
            keys, words = v.unknown(seen, A.span_hashes(buf, start, end) | U64(1), buf, start, end)
            seen.learn(keys, np.zeros(0, np.int32), np.zeros(len(keys) + 1, np.int64))
            yield pa.record_batch({"word": pa.array(words, pa.binary())})

    def replayed(batches):
        v = vocabulary(path, pattern)
        for group in _groups(batches):
            whole = pa.Table.from_batches(group)
            ids, at = v.replay(whole["word"].to_pylist())
            raw = pa.py_buffer(np.ascontiguousarray(ids, "<i4").tobytes())
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer((4 * at).astype(np.int64).tobytes()), raw]).cast(pa.binary())
            yield from pa.table({"word": whole["word"], "ids": rows, "n": whole["n"]}).to_batches()

    met = docs.select(text_col).mapInArrow(meet, "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return met.mapInArrow(replayed, "word binary, ids binary, n long")


def most_common(words: DataFrame, bound: int | None = None) -> Recurring:
    """The words that most tasks met, in whole powers of two of that number, as many as ``bound`` bytes hold."""
    bound = SENT if bound is None else bound
    level = F.floor(F.log2("n"))
    words = cut_lineage(words)
    total, least = 0, None
    for r in words.groupBy(level.alias("level")).agg(F.sum(F.length("ids") + 16).alias("size")).orderBy(F.desc("level")).collect():  # 63 rows at most
        total += r["size"]
        if total > bound:
            break
        least = r["level"]
    got = words.where(level >= least).select("word", "ids").toArrow() if least is not None else pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    flat, off = A.flat(got["ids"])
    return Recurring(uuid.uuid4().hex, hashes_of(got["word"].to_pylist()), np.frombuffer(flat.tobytes(), "<i4"), off // 4)


def encode_with(docs: DataFrame, finish, schema, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """finish(batch, ids, offsets, vocabulary) gives the output batch of each shard. Runs the pass over the corpus's words when it is called."""
    files = default_files() if path is None or pattern is None else ("", "")
    path, pattern = path or files[0], pattern or files[1]
    sent = docs.sparkSession.sparkContext.broadcast(most_common(recurring(docs, text_col, path, pattern)))

    def encode(batches):
        v = vocabulary(path, pattern)
        for group in _groups(pieces(batches, text_col, SHARD_BYTES)):
            A.frugal()
            for ids, off in v.encode_all([piece[text_col] for piece in group], sent.value):
                yield finish(group.pop(0), ids, off, v)

    return docs.mapInArrow(encode, schema)


def bpe_encode(docs: DataFrame, text_col: str = "text", **files) -> DataFrame:
    """The documents with their ids in a column ``ids``, and ``n_tokens``; columns of those names are replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    docs = docs.drop("ids", "n_tokens")
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def finish(batch, ids, off, v):
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
        return pa.record_batch([*(batch[c] for c in names), lists, pa.array(np.diff(off), pa.int64())], [*names, "ids", "n_tokens"])

    return encode_with(docs, finish, schema, text_col, **files)


def bpe_decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with the bytes of their ids in a column ``decoded``."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    files = default_files() if path is None or pattern is None else ("", "")
    path, pattern = path or files[0], pattern or files[1]
    names, schema = encoded.columns, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def decode(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            tokens = [None if x is None else b"".join(v.tokens[i] for i in x) for x in batch[ids_col].to_pylist()]
            yield pa.record_batch([*(batch[c] for c in names), pa.array(tokens, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(decode, schema)


def _digest(batch, ids, off, v):
    back, at = v.decode(ids, off)
    raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(np.ascontiguousarray(back))
    cut = lambda data, o, k: [hashlib.sha256(data[k * a : k * b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
    return pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "n_tokens": pa.array(np.diff(off), pa.int64()), "ids_sha256": pa.array(cut(raw, off, 4), pa.string()), "decoded_sha256": pa.array(cut(back, at, 1), pa.string())})


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_with(docs, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
