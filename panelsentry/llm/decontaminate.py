"""Operator 1: benchmark decontamination with suffix arrays of training shards.

Each shard of training text (an Arrow batch of at most ``SHARD_BYTES`` or one document) gets a word-level suffix array; every test suffix is
searched in it by bisection, which gives all locations of its longest verbatim matches. Suffixes that share no first words with any test
suffix can't match and are left out of the array before it is sorted. Training text never moves: the test side is sent to it as an index of about seven times
its text, in parts of at most ``TEST_BYTES`` of text (one part as a rule); with more parts each is a job of its own, and their matches are added up. Words
are compared as 64-bit hashes, ten or so in a row for each match.

Null and empty texts have no words and match nothing. Rows with the same item_id are one item; a null item_id is the item "null". Each
document row is judged on its own, repeated or not. Extra columns are ignored by the query and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import cut_lineage

WIDTH, PREFIX = 10, 4
SHARD_BYTES, TEST_BYTES, AT_ONCE = 8 << 20, 8 << 20, 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[0:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False


def pieces(batches, text_col: str, limit: int = SHARD_BYTES):
    """Record batches cut so that their texts hold at most ``limit`` bytes, or are one text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text_col].cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(batch) else np.zeros(0, np.int64)
        at, done = 0, 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            done = int(size[to - 1])
            at = to


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    buf, off = A.flat(column)
    buf = LOWER[buf]
    start, end, at = A.words_of(buf, off, WORD)
    return A.span_hashes(buf, start, end), at


class TestSet:
    """All test windows of some items, as places in their word ids, and the first words that a matching suffix needs."""

    __test__ = False

    def __init__(self, items: pa.Table, width: int) -> None:
        h, at = word_hashes(items["text"])
        self.names = ["null" if x is None else str(x) for x in items["item_id"].to_pylist()]
        self.width = width
        self.vocabulary = np.unique(h)
        self.ids = np.r_[np.searchsorted(self.vocabulary, h) + 1, np.zeros(width, np.int64)].astype(np.int32)
        words = np.diff(at)
        n = np.minimum(words, width)
        count = np.where(n > 0, words - n + 1, 0)
        self.item = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.first = (np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        self.start, self.size = at[:-1][self.item] + self.first, n[self.item].astype(np.int32)
        self.prefix = {}  # by number of first words: their distinct hashes, a filter of them, the windows and the hash of each
        for p in np.unique(np.minimum(self.size, PREFIX)).tolist():
            window = np.flatnonzero(np.minimum(self.size, PREFIX) == p)
            keys, code = np.unique(A.sequence_hashes(h, p)[self.start[window]], return_inverse=True)
            seen = np.zeros(1 << 20, bool)
            seen[keys & np.uint64((1 << 20) - 1)] = True
            self.prefix[p] = keys, seen, window.astype(np.int32), code.astype(np.int32)

    def rows(self, window: np.ndarray) -> np.ndarray:
        """The word ids of some windows; 0 beyond their end."""
        along = np.arange(self.width)[None, :]
        return np.where(along < self.size[window][:, None], self.ids[self.start[window][:, None] + along], 0)


def _text_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort like the rows."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def matches(h: np.ndarray, at: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the shard and test windows that start there, verbatim."""
    some, live = np.zeros(len(h), bool), np.zeros(len(tests.start), bool)
    for n, (keys, seen, windows, code) in tests.prefix.items():
        g = A.sequence_hashes(h, n)
        maybe = np.flatnonzero(seen[g & np.uint64((1 << 20) - 1)])
        k = np.minimum(np.searchsorted(keys, g[maybe]), len(keys) - 1)
        hit = keys[k] == g[maybe]
        some[maybe[hit]] = True
        here = np.zeros(len(keys), bool)
        here[k[hit]] = True
        live[windows[here[code]]] = True
    suffix, live = np.flatnonzero(some), np.flatnonzero(live)
    none = np.zeros(0, np.int64)
    if not len(suffix):
        return none, none
    end = at[np.searchsorted(at, suffix, "right")]
    keys = np.empty(len(suffix), f"S{4 * tests.width}")
    for a in range(0, len(suffix), AT_ONCE):
        place = suffix[a : a + AT_ONCE, None] + np.arange(tests.width)[None, :]
        x = h[np.minimum(place, len(h) - 1)]
        k = np.minimum(np.searchsorted(tests.vocabulary, x), len(tests.vocabulary) - 1)
        rows = np.where((place < end[a : a + AT_ONCE, None]) & (tests.vocabulary[k] == x), k + 1, 0)
        keys[a : a + AT_ONCE] = _text_keys(rows * np.cumprod(rows > 0, axis=1, dtype=np.int64))  # nothing matches beyond the first unknown word
    order = np.argsort(keys, kind="stable")
    array, suffix = keys[order], suffix[order]
    found = [(none, none)]
    for a in range(0, len(live), AT_ONCE):
        some = live[a : a + AT_ONCE]
        rows = tests.rows(some)
        lo = np.searchsorted(array, _text_keys(rows), "left")
        hi = np.searchsorted(array, _text_keys(np.where(np.arange(tests.width)[None, :] < tests.size[some][:, None], rows, 0xFFFFFFFF)), "right")
        count = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(count)), count)
        found.append((suffix[np.repeat(lo, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)], some[window]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def longest(position: np.ndarray, window: np.ndarray, doc: np.ndarray, tests: TestSet) -> tuple[np.ndarray, ...]:
    """Windows in a row on one diagonal as one match: document row, item row, first word in the document, first word in the item, words."""
    item, first, size = tests.item[window], tests.first[window], tests.size[window]
    diagonal = position - first
    order = np.lexsort((position, diagonal, item, doc))
    p, i, d, f, s = position[order], item[order], doc[order], first[order], size[order]
    new = np.r_[True, (p[1:] != p[:-1] + 1) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (diagonal[order][1:] != diagonal[order][:-1])] if len(p) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    run = np.diff(np.r_[head, len(p)])
    return d[head], i[head], p[head], f[head], run - 1 + s[head]


def _parts(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The items in parts of about ``limit`` bytes, none of them fetched yet."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _each_part(spark: SparkSession, parts: list[DataFrame], width: int, job) -> DataFrame:
    """job(sent) for each part of the benchmark, in one table. One part is one lazy job; of several only one is held at a time, by the driver and by tasks,
    and its result is written to the shared folder before the next one is fetched."""
    out = None
    for part in parts:
        sent = spark.sparkContext.broadcast(TestSet(part.toArrow(), width))
        one = job(sent)
        if len(parts) > 1:
            one = cut_lineage(one)
            sent.unpersist()
        out = one if out is None else out.unionByName(one)
    return out


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))
MATCH = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))


def _search(source: DataFrame, sent) -> DataFrame:
    """doc_id, n_words, spans, items and matches of each row of doc_id and text, with what else the row has."""
    more = [c for c in source.columns if c not in ("doc_id", "text")]

    def search(batches):
        tests = sent.value
        for batch in pieces(batches, "text"):
            h, at = word_hashes(batch["text"])
            n = len(batch)
            spans, items, found = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            if len(tests.start) and len(h):
                position, window = matches(h, at, tests)
                doc = np.searchsorted(at, position, "right") - 1
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, position, 1)
                np.add.at(edge, position + tests.size[window], -1)
                cover = np.cumsum(edge[:-1]) > 0
                for i in np.unique(doc).tolist():
                    a, b = int(at[i]), int(at[i + 1])
                    turn = np.flatnonzero(np.diff(np.r_[False, cover[a:b], False].astype(np.int8)))
                    spans[i] = [{"first": x, "size": y - x} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
                for d, i, p, f, s in zip(*(x.tolist() for x in longest(position, window, doc, tests)), strict=True):
                    found[d].append({"item": tests.names[i], "doc_word": p - int(at[d]), "item_word": f, "n_words": s})
                items = [sorted({m["item"] for m in x}) for x in found]
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), **{c: batch[c] for c in more}, "n_words": pa.array(np.diff(at), pa.int64()), "spans": pa.array(spans, SPAN), "items": pa.array(items, pa.list_(pa.string())), "matches": pa.array(found, MATCH)})

    own = "".join(f"{c} long, " for c in more)
    return source.mapInArrow(search, f"doc_id long, {own}n_words long, spans array<struct<first:long,size:long>>, items array<string>, matches array<struct<item:string,doc_word:long,item_word:long,n_words:long>>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, test_bytes: int = TEST_BYTES) -> DataFrame:
    """For each document row: n_words, spans (first, size: words under test windows), items, and matches (item, doc_word, item_word, n_words).

    With several parts of the benchmark, rows alike in id and text are found again by a hash of both: they are judged alike."""
    parts = _parts(benchmark, test_bytes)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(parts) == 1:
        return _each_part(docs.sparkSession, parts, width, lambda sent: _search(source, sent))
    keyed = source.withColumns({"row": F.xxhash64("doc_id", "text"), "also": F.hash("text", "doc_id").cast("long")})
    found = _each_part(docs.sparkSession, parts, width, lambda sent: _search(keyed, sent))
    lists = {c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("spans", "items", "matches")}  # rows alike give one set a part
    whole = found.groupBy("doc_id", "row", "also").agg(F.count("*").alias("times"), F.first("n_words").alias("n_words"), *lists.values())
    return whole.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"), "matches", F.explode(F.sequence(F.lit(1), F.expr(f"times div {len(parts)}"))).alias("k")).drop("k")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH, test_bytes: int = TEST_BYTES) -> DataFrame:
    """The documents that hold no test window, with all their columns. With one part of the benchmark nothing is shuffled; with several the hashes of hit texts are."""

    def clean(batch, column, tests):
        h, at = word_hashes(batch[column])
        out = np.ones(len(batch), bool)
        if len(tests.start) and len(h):
            out[np.searchsorted(at, matches(h, at, tests)[0], "right") - 1] = False
        return out

    def job(source, column, schema, hit):
        def run(sent):
            def each(batches):
                for batch in pieces(batches, column):
                    good = clean(batch, column, sent.value)
                    yield batch.filter(pa.array(~good if hit else good)).select(schema.names)

            return source.mapInArrow(each, schema)

        return run

    parts = _parts(benchmark, test_bytes)
    if len(parts) == 1:
        return _each_part(docs.sparkSession, parts, width, job(docs, text_col, docs.schema, False))
    keys = {"row": F.xxhash64(text_col), "also": F.hash(text_col)}
    texts = docs.select(F.col(text_col).alias("text"), *(v.alias(k) for k, v in keys.items()))
    hit = _each_part(docs.sparkSession, parts, width, job(texts, "text", texts.select(*keys).schema, True)).distinct()
    row = F.struct(*docs.columns).alias("row_")
    return docs.select(row, *(v.alias(k) for k, v in keys.items())).join(hit, list(keys), "left_anti").select("row_.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, benchmark)
    # parts of a benchmark may cover the same words: distinct words are counted
    n_hit = F.when(F.size("spans") <= 1, F.coalesce(F.try_element_at("spans", F.lit(1))["size"], F.lit(0))).otherwise(
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1)))))
    )
    return found.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item, w, least({WIDTH}, len(w)) AS n, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
dk AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item FROM dk JOIN iw USING (n, k)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""
