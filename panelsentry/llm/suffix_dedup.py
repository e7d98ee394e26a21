"""Operator 2: byte-level repeats across documents by the interval tree of an enhanced suffix array.

``maximal_repeats`` sorts suffixes, takes the common prefixes of neighbours and scans them with a stack: each interval whose members differ in
the byte before them (left extension) is a maximal repeat, reported with all its occurrences. ``repeated_bytes`` runs it over a corpus: the
contexts of module ``repeats`` hold every 50-byte string that can occur twice, so their suffixes are all that need sorting.

Null and empty texts have no bytes and come back with zeros; equal rows share a doc_id and never cover each other; a null doc_id counts as
the largest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .repeats import Texts, Units, covered, shards_of

WIDTH = 50
SORTED_AT_ONCE, LISTED_AT_ONCE = 1 << 16, 1 << 17


def suffix_order(buf: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at ``at`` and stop before ``end`` (``depth`` bytes at most), and the common prefix of neighbours."""
    step = 1 << 13
    padded = np.r_[buf, np.zeros(depth + 8, np.uint8)]
    words = -(-depth // 8)
    keys = np.empty((words, len(at)), np.uint64)
    for a in range(0, len(at), step):
        part = at[a : a + step]
        m = padded[part[:, None] + np.arange(8 * words)[None, :]]
        m[np.arange(8 * words)[None, :] >= np.minimum(end[a : a + step] - part, depth)[:, None]] = 0
        keys[:, a : a + step] = m.view(">u8").astype(np.uint64).T
    size = np.minimum(end - at, depth)
    order = np.lexsort((size, *keys[::-1]))
    lcp = np.zeros(len(at), np.int64)
    alive = np.ones(max(len(at) - 1, 0), bool)
    for k in range(words):
        x = keys[k][order]
        diff = x[1:] ^ x[:-1]
        same = diff == 0
        lead = np.zeros(len(diff), np.int64)
        for s in range(1, 8):
            lead += (diff >> np.uint64(64 - 8 * s)) == 0
        lcp[1:] += np.where(alive, np.where(same, 8, lead), 0)
        alive &= same
    s = size[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(s[1:], s[:-1]))
    return order, lcp


def interval_tree(lcp: np.ndarray, left: np.ndarray, ids: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """All left-diverse intervals with a common prefix of ``least`` or more: (length, first, last, least id), by a stack scan.

    left: the byte before each suffix in sorted order; a negative number is unlike every other.
    """
    out, stack = [], []
    prefix, before, owner = lcp.tolist(), left.tolist(), ids.tolist()
    n = len(prefix)
    for i in range(1, n + 1):
        depth = prefix[i] if i < n else 0
        first = i - 1
        char, low = before[i - 1], owner[i - 1]
        while stack and stack[-1][0] > depth:
            length, first, c, d = stack.pop()
            if c != char or c < 0:
                char = -1
            low = min(low, d)
            if char < 0:
                out.append((length, first, i - 1, low))
        if depth >= least:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                if top[2] != char or char < 0:
                    top[2] = -1
                top[3] = min(top[3], low)
            else:
                stack.append([depth, first, char, low])
        elif stack:
            stack.clear()
    return out


def maximal_repeats(buf: np.ndarray, off: np.ndarray, ids: np.ndarray, least: int, depth: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """All maximal repeats of ``least`` bytes or more in the given strings, some at a time: group (counted anew each time), string, first byte,
    length and the group's least id, a row for each occurrence."""
    size = np.diff(off)
    starts = np.maximum(size - least + 1, 0)
    which = np.repeat(np.arange(len(size), dtype=np.int32), starts)
    at = off[:-1][which] + np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
    if not len(at):
        return
    # suffixes whose first bytes occur once are no one's neighbours; equal ones go into one array, which holds about SORTED_AT_ONCE
    h = np.empty(len(at), np.uint64)
    for a in range(0, len(at), A.BLOCK):
        some = at[a : a + A.BLOCK]
        h[a : a + A.BLOCK] = A.gram_hashes(buf[some[0] : some[-1] + least], least)[some - some[0]]
    order = np.argsort(h, kind="stable").astype(np.int32 if len(at) < 2**31 else np.int64)
    h = h[order]
    new = np.r_[True, h[1:] != h[:-1]]
    group = np.diff(np.r_[np.flatnonzero(new), len(order)])
    order = order[np.repeat(group > 1, group)]
    ends = np.cumsum(group[group > 1])
    at, which = at[order], which[order]
    del h, order, new, group
    a = 0
    while a < len(at):
        b = int(ends[min(np.searchsorted(ends, a + SORTED_AT_ONCE), len(ends) - 1)])
        yield from _tree_of(buf, off, ids, at[a:b], which[a:b], least, depth)
        a = b


def _tree_of(buf, off, ids, at, which, least, depth):
    """The maximal repeats among some suffixes, some of them at a time."""
    end = off[1:][which]
    order, lcp = suffix_order(buf, at, end, depth or int((end - at).max()))
    at, which = at[order], which[order]
    inner = at > off[:-1][which]
    left = np.where(inner, buf[np.maximum(at - 1, 0)].astype(np.int64), -1)
    nodes = np.array(interval_tree(lcp, left, ids[which], least), np.int64).reshape(-1, 4)
    begin = at - off[:-1][which]
    total = np.cumsum(nodes[:, 2] - nodes[:, 1] + 1)
    a = 0
    while a < len(nodes):  # nested intervals list their members again, so some at a time
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LISTED_AT_ONCE, "right")))
        part = nodes[a:b]
        members = part[:, 2] - part[:, 1] + 1
        group = np.repeat(np.arange(len(part)), members)
        row = np.arange(len(group)) - np.repeat(np.cumsum(members) - members, members) + part[group, 1]
        yield group, which[row], begin[row], part[group, 0], part[group, 3]
        a = b


def _kernel(buf, off, ids, known, units):
    """Windows that also start in a document with a smaller id."""
    out = [(np.zeros(0, np.int64),) * 3]
    for shard in shards_of(buf, off, units):
        size = off[shard + 1] - off[shard]
        string, first, count = _covered(A.gather(buf, off[shard], size), np.r_[0, np.cumsum(size)], ids[shard], units.width)
        out.append((shard[string], first, count))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _covered(buf, off, ids, width):
    n = np.maximum(np.diff(off) - width + 1, 0)
    base = np.r_[0, np.cumsum(n)]
    edge = np.zeros(int(base[-1]) + 1, np.int32)
    for _, string, first, length, low in maximal_repeats(buf, off, ids, width):
        mine = low < ids[string]
        at = base[string[mine]] + first[mine]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length[mine] - width + 1, -1)
    hit = np.cumsum(edge[:-1], dtype=np.int32) > 0
    new = np.zeros(len(hit) + 1, bool)
    new[base] = True
    begins = np.flatnonzero(hit & (new[:-1] | ~np.r_[False, hit[:-1]])) if len(hit) else base[:0]
    ends = np.flatnonzero(hit & (new[1:] | ~np.r_[hit[1:], False])) + 1 if len(hit) else base[:0]
    string = np.searchsorted(base, begins, "right") - 1
    return string, begins - base[string], ends - begins


def repeated_bytes(docs: DataFrame, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", columns=None, width: int = WIDTH) -> DataFrame:
    """finish(table, texts, covered) over all documents; covered marks each byte under a ``width``-byte string that starts in a smaller document too."""
    return covered(docs, Units(False, width, min(16, width - 8)), _kernel, finish, schema, id_col, text_col, columns)


def _digest(table: pa.Table, t: Texts, cover: np.ndarray) -> pa.Table:
    kept = np.r_[np.int32(0), np.cumsum(~cover, dtype=np.int32)]
    rise = np.r_[np.int32(0), np.cumsum(cover & ~np.r_[False, cover[:-1]], dtype=np.int32)] if len(cover) else np.zeros(1, np.int32)
    a, b = t.off[:-1], t.off[1:]
    joins = np.zeros(len(a), np.int64)  # a run that began in the text before counts here too
    inner = (a > 0) & (a < b)
    joins[inner] = cover[a[inner]] & cover[a[inner] - 1]
    n_bytes, n_kept = b - a, kept[b] - kept[a]
    left = memoryview(np.ascontiguousarray(t.buf[~cover]))
    sha = [hashlib.sha256(left[x:y]).hexdigest() for x, y in zip(kept[a].tolist(), kept[b].tolist(), strict=True)]
    return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_bytes - n_kept, pa.int64()), "n_spans": pa.array(rise[b] - rise[a] + joins, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_bytes(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Bytes as two hexadecimal digits each; texts in pieces, so that no slice starts far into a long one.
OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS i, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
piece AS (SELECT r, i, n, c, h[2 * c + 1:2 * (c + 512 + {WIDTH - 1})] AS h FROM (SELECT *, unnest(range(0, n - {WIDTH - 1}, 512)) AS c FROM d WHERE n >= {WIDTH})),
win AS MATERIALIZED (SELECT r, i, c + o AS s, md5_number(h[2 * o + 1:2 * o + {2 * WIDTH}]) AS k FROM (SELECT *, unnest(range(0, least(512, n - {WIDTH - 1} - c))) AS o FROM piece)),
least_id AS (SELECT k, min(i) AS m FROM win GROUP BY k HAVING min(i) < max(i)),
hit AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM win JOIN least_id USING (k) WHERE i > m),
run AS (SELECT r, s, sum(CASE WHEN s <= before + {WIDTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS g FROM hit),
gone AS MATERIALIZED (SELECT r, g, min(s) AS a, max(s) + {WIDTH} AS b FROM run GROUP BY ALL),
kept AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM gone UNION ALL SELECT r, max(b), NULL FROM gone GROUP BY r),
rest AS (SELECT r, string_agg(h[2 * f + 1:2 * coalesce(t, n)], '' ORDER BY f) AS x FROM kept JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN sums USING (r) LEFT JOIN rest USING (r)"""
