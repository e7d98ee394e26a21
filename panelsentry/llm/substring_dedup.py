"""Operator 6: word-level repeats, inside and across documents, by suffix automata and matching statistics.

Contexts of module ``repeats`` are the reference: each bucket builds one suffix automaton of its reference shard and streams its contexts
through it; wherever the longest suffix that occurs twice reaches the threshold, the window is covered. The reference here is the corpus itself
and has no size bound, so shards are co-partitioned with the contexts that can match them in place of being broadcast.

Null and empty texts have no words; equal rows repeat each other; extra columns are kept by ``substring_dedup`` as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from . import arrays as A
from .repeats import Texts, Units, covered, shards_of

WIDTH = 35
SHARD = 256
HOT = 10_000  # runs of one owner that an automaton may hold: 700,000 words, about 0.3 GB


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of integers that counts occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, sequence: list[int]) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                count[last] += 1
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(1)
            p = last
            while p != -1:
                at = nxt[p]
                q = at.get(c)
                if q is not None:
                    link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
                    break
                at[c] = cur
                p = link[p]
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Adds up occurrences along the suffix links; afterwards ``count`` is complete."""
        count, link = self.count, self.link
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            if link[v] > 0:
                count[link[v]] += count[v]

    def matching(self, sequence: list[int], times: int) -> list[int]:
        """For each place the length of the longest string that ends there and occurs ``times`` times or more in the reference."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v, n, out = 0, 0, []
        for c in sequence:
            while v and (c not in nxt[v]):
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            u, m = v, n
            while u and count[u] < times:
                u = link[u]
                m = length[u]
            out.append(m)
        return out


def _kernel(buf, off, ids, known, units):
    """Windows that occur at least twice among the distinct contexts, or lie in a context that does: what the automata of the reference shards say."""
    c, first, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shard in shards_of(buf, off, units, SHARD):  # contexts that share a window share their owner, so they are in one shard
        if known[shard].all():
            continue
        size = off[shard + 1] - off[shard]
        text = A.gather(buf, off[shard], size)
        start, end, at = A.words_of(text, np.r_[0, np.cumsum(size)], ~A.SPACE)
        words = A.span_hashes(text, start, end)
        sequences = [words[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        automaton = SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        automaton.close()
        for i, s in zip(shard.tolist(), sequences, strict=True):
            if not known[i]:
                hit = np.array(automaton.matching(s, 2)) >= units.width
                if hit.any():
                    turn = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    c.append(np.full(len(turn) // 2, i))
                    first.append(turn[::2] - units.width + 1)
                    count.append(turn[1::2] - turn[::2])
    return np.concatenate(c), np.concatenate(first), np.concatenate(count)


def repeated_words(docs: DataFrame, finish, schema, id_col: str = "doc_id", text_col: str = "text", columns=None, width: int = WIDTH, gram: int = 8) -> DataFrame:
    """finish(table, texts, covered) over all documents; covered marks each word under a window of ``width`` words that starts elsewhere too."""
    return covered(docs, Units(True, width, min(gram, width)), _kernel, finish, schema, id_col, text_col, columns, HOT)


def kept_texts(t: Texts, cover: np.ndarray) -> list[bytes]:
    """The words that stay, joined by one space, of each text."""
    keep = ~cover
    start, size = t.start[keep], (t.end - t.start)[keep]
    n = np.r_[0, np.cumsum(keep)]
    flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    if len(size):
        flat[np.arange(int(size.sum())) + np.repeat(to - (np.cumsum(size) - size), size)] = A.gather(t.buf, start, size)
    to = np.r_[to, len(flat)]
    a, b = to[n[t.units[:-1]]], to[n[t.units[1:]]]
    raw = flat.tobytes()
    return [raw[x : max(x, y - 1)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents, without the words under repeated windows; texts with none stay as they are, null stays null."""
    names = docs.columns
    schema = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType, True) for f in docs.schema])

    def finish(table: pa.Table, t: Texts, cover: np.ndarray) -> pa.Table:
        hit = np.r_[0, np.cumsum(cover)]
        changed = hit[t.units[1:]] > hit[t.units[:-1]]
        old = table["text"].to_pylist()
        new = [x.decode() if yes else o for yes, x, o in zip(changed.tolist(), kept_texts(t, cover), old, strict=True)]
        row = pa.concat_arrays(table["row"].chunks) if table["row"].num_chunks else pa.array([], table["row"].type)
        return pa.table([pa.array(new, pa.string()) if c == text_col else row.field(k) for k, c in enumerate(names)], names)

    return repeated_words(docs, finish, schema, id_col, text_col, names, width)


def _digest(table: pa.Table, t: Texts, cover: np.ndarray) -> pa.Table:
    hit = np.r_[0, np.cumsum(cover)]
    a, b = t.units[:-1], t.units[1:]
    sha = [hashlib.sha256(x).hexdigest() for x in kept_texts(t, cover)]
    return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(b - a, pa.int64()), "n_removed": pa.array(hit[b] - hit[a], pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_words(docs, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP6_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {WIDTH - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH} + 2)) AS s FROM dw WHERE len(w) >= {WIDTH})),
twice AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WIDTH})) AS p FROM win SEMI JOIN twice USING (k)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)"""
