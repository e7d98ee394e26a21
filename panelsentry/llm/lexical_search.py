"""Operator 11: ranked lexical search by the best position algorithm.

Documents stay where they are. A first pass counts N, L and each query term's documents; a second one makes an impact list for each query term of each shard
(``SHARD_BYTES`` of text, or one document): its documents by falling impact. An item's lists are read side by side. Whatever document is met first in one
list is looked up in all others at once (direct access), which gives its whole score and marks its position in every list; each list's best position is the end of
its seen positions without a hole, so it lies at or beyond what was read in order. No unseen document can score more than the impacts that follow the best
positions add up to; reading stops when that sum is strictly below the k-th best score, so that ties by id are all seen. A task carries its k best of each
item from shard to shard, as the first bar of the next one; a window that keeps k rows an item before and after its shuffle puts tasks together.

Terms are compared as 64-bit hashes. Queries are sent in parts of at most ``QUERY_BYTES`` of text, or one item, each part in jobs of its own.

Null and empty texts have no terms: such documents don't count in N, such items have no rows. Rows with one item_id (null too) are one item, with the terms of
all of them. Document rows are documents of their own, repeated or not; a null doc_id sorts last among equal scores. Terms in all documents may weigh nothing and are
not read. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays as A
from .components import cut_lineage
from .decontaminate import pieces, word_hashes

TOP, SHARD_BYTES, QUERY_BYTES, STEP = 20, 24 << 20, 1 << 20, 8
LENGTH_SHARE = 25  # of 100: how much a document's length counts against an average one
SIEVE = np.uint64((1 << 20) - 1)


class Queries:
    """The terms of some items: numbered distinct hashes, and each item's terms and how often it has them."""

    def __init__(self, items: pa.Table) -> None:
        h, at = word_hashes(items["text"])
        self.vocabulary = np.unique(h)
        self.seen = np.zeros(int(SIEVE) + 1, bool)
        self.seen[self.vocabulary & SIEVE] = True
        numbers = np.searchsorted(self.vocabulary, h)
        rows: dict = {}
        for k, name in enumerate(items["item_id"].to_pylist()):
            rows.setdefault(name, []).append(numbers[at[k] : at[k + 1]])
        self.kind = items["item_id"].type
        self.names = list(rows)
        self.terms = [np.unique(np.concatenate(v), return_counts=True) for v in rows.values()]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are query terms, and their numbers."""
        where = np.flatnonzero(self.seen[h & SIEVE]) if len(self.vocabulary) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, h[where]), max(len(self.vocabulary) - 1, 0))
        same = self.vocabulary[k] == h[where] if len(where) else np.zeros(0, bool)
        return where[same], k[same]


class Lists:
    """The impact lists of one shard; documents are numbers below ``n_docs``, terms those of the queries."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, length: np.ndarray, n_all: int, l_all: int, n_terms: int) -> None:
        self.n_docs = len(length)
        self.key, tf = np.unique(term * self.n_docs + doc, return_counts=True)
        self.doc = self.key % max(self.n_docs, 1)
        self.impact = impacts(tf.astype(np.int64), length[self.doc], n_all, l_all)
        of = self.key // max(self.n_docs, 1)
        self.start = np.searchsorted(of, np.arange(n_terms + 1))
        self.order = np.lexsort((-self.impact, of))  # by term, then by falling impact
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order)) - self.start[of]

    def best(self, terms: np.ndarray, weight: np.ndarray, bar: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of all that can be among the k best and reach ``bar``, and how many positions were read in order."""
        start, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        live = size > 0
        terms, weight, start, size = terms[live], weight[live], start[live], size[live]
        base = np.r_[0, np.cumsum(size)]
        seen, met = np.zeros(int(base[-1]), bool), np.zeros(self.n_docs, bool)
        place = np.zeros(len(terms), np.int64)  # best positions
        docs, scores, read, step = [], [], 0, STEP
        while len(terms):
            some = np.minimum(read + step, size) - np.minimum(read, size)
            of = np.repeat(np.arange(len(terms)), some)
            at = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some) + read
            new = self.doc[self.order[start[of] + at]]
            new = np.unique(new[~met[new]])
            met[new] = True
            want = (terms[:, None] * self.n_docs + new).ravel()
            j = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[j] == want
            scores.append(weight @ np.where(hit, self.impact[j], 0).reshape(len(terms), len(new)))
            docs.append(new)
            seen[(np.repeat(base[:-1], len(new)) + self.rank[j])[hit]] = True
            read, step = read + step, step * 2
            ceiling = 0
            for i in range(len(terms)):
                a = int(place[i])
                while a < size[i]:  # on to the first hole
                    ahead = seen[base[i] + a : min(base[i] + a + 4096, base[i + 1])]
                    hole = int(np.argmin(ahead))
                    if not ahead[hole]:
                        a += hole
                        break
                    a += len(ahead)
                place[i] = a
                if a < size[i]:
                    ceiling += int(weight[i]) * int(self.impact[self.order[start[i] + a]])
            found = np.concatenate(scores)
            if len(found) >= k:
                bar = max(bar, int(np.partition(found, len(found) - k)[len(found) - k]))
            if ceiling < bar or ceiling == 0:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        good = found >= max(bar, 1)
        return np.concatenate(docs)[good], found[good], read


def impacts(tf: np.ndarray, length: np.ndarray, n_all: int, l_all: int) -> np.ndarray:
    """A term's part of a score before its weight, in whole numbers: more with tf, less with the document's length against the average."""
    most = int(length.max(initial=0)) * max(n_all, 1) * LENGTH_SHARE
    length = length.astype(object) if most >= 1 << 63 else length.astype(np.int64)
    m = (100 - LENGTH_SHARE + (LENGTH_SHARE * length * n_all) // max(l_all, 1)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _count(docs: DataFrame, sent) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each query term."""

    def count(batches):
        q = sent.value
        n_all = l_all = 0
        df = np.zeros(len(q.vocabulary), np.int64)
        for piece in pieces(batches, "text"):
            h, at = word_hashes(piece["text"])
            size = np.diff(at)
            n_all, l_all = n_all + int((size > 0).sum()), l_all + len(h)
            where, term = q.find(h)
            doc = np.searchsorted(at, where, "right") - 1
            df += np.bincount(np.unique(term * len(piece) + doc) // max(len(piece), 1), minlength=len(df))
        some = np.flatnonzero(df)
        if n_all:
            yield pa.record_batch({"term": pa.array(np.r_[-2, -1, some], pa.int64()), "n": pa.array(np.r_[n_all, l_all, df[some]], pa.int64())})

    sums = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a query term: bounded by QUERY_BYTES
    got = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(sent.value.vocabulary))], np.int64)


def _search(docs: DataFrame, sent, n_all: int, l_all: int, df: np.ndarray, top: int, item_type: str) -> DataFrame:
    weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def search(batches):
        q = sent.value
        ids, scores = [np.zeros(0, object)] * len(q.names), [np.zeros(0, np.int64)] * len(q.names)
        plans = [(t[weight[t] > 0], (weight[t] * n)[weight[t] > 0]) for t, n in q.terms]
        for piece in pieces(batches, "text", SHARD_BYTES):
            A.frugal()
            h, at = word_hashes(piece["text"])
            where, term = q.find(h)
            del h
            lists = Lists(np.searchsorted(at, where, "right") - 1, term, np.diff(at), n_all, l_all, len(q.vocabulary))
            names = None
            for k, (terms, w) in enumerate(plans):
                doc, score, _ = lists.best(terms, w, int(scores[k][-1]) if len(scores[k]) >= top else 0, top)
                if not len(doc):
                    continue
                names = np.array(piece["doc_id"].cast(pa.int64()).to_pylist(), object) if names is None else names
                i, s = np.concatenate([ids[k], names[doc]]), np.concatenate([scores[k], score])
                order = sorted(range(len(s)), key=lambda x: (-s[x], i[x] is None, i[x] or 0))[:top]
                ids[k], scores[k] = i[order], s[order]
        size = [len(s) for s in scores]
        if sum(size):
            item = pa.array([n for n, m in zip(q.names, size, strict=True) for _ in range(m)], q.kind)
            yield pa.record_batch({"item_id": item, "doc_id": pa.array(np.concatenate(ids).tolist(), pa.int64()), "score": pa.array(np.concatenate(scores), pa.int64())})

    return docs.mapInArrow(search, f"item_id {item_type}, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item. Counting runs a job at once; with several parts of the items each part's result is
    written to the shared folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col("text" if text_col not in items.columns else text_col).alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    n = max(1, -(-int(total) // query_bytes))
    out = None
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        sent = spark.sparkContext.broadcast(Queries(part.toArrow()))
        one = _search(docs, sent, *_count(docs, sent), top, items.schema["item_id"].dataType.simpleString())
        one = one if n == 1 else cut_lineage(one)
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search(docs, items)


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
g AS (SELECT t, r, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))) AS part FROM p JOIN w USING (t), s),
f AS (SELECT item_id, r, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN g USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM f WHERE score > 0) WHERE rank <= {TOP}"""
