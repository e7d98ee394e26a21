"""Finding long verbatim repeats over a whole corpus without shipping every suffix.

Every window of W units (bytes or words) is owned by the least hash among its k-grams, so equal windows have equal owners. A row of windows
with one owner is a run, about one for each W / 2 units. Four steps, each a plain Spark exchange:

1. each bucket of documents lists its owners once; 2. buckets of owners say which ones occur more than once; 3. only the runs of those send
their bytes (a context) to the owner's bucket, each distinct context once a document bucket; 4. there a kernel looks for repeats and sends
covered windows back to the documents. Steps 1, 3 and the finish read the same exchange of documents. No step holds more than one
bucket, of ``BUCKET`` bytes at most on average whatever the number of partitions; a context that many documents share costs one row a bucket, so hot passages
don't pile up in one task. An owner whose runs hold more units than ``hot`` runs of two windows' width is dealt out by whole windows in place of the owner, and equality of windows
decides them; so a kernel holds at most ``hot * 2 * width`` units of one owner. Two buckets exchange one packed row, if any: rows are never more than one an owner and bucket, so they grow with the text however many buckets there are. Documents are dealt by id and text, so
many rows under one id are spread; only rows alike in both meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

RUN = 192
SHARD = 8192  # contexts that a kernel sees at once, or all of one owner
SMALL = 48  # more buckets than twice the shuffle partitions, so that few partitions don't mean large buckets
BUCKET = 32 << 20  # bytes of text in a bucket at most, however few partitions there are
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64


@dataclass(frozen=True)
class Units:
    """What a window is made of: ``width`` units, owned by grams of ``gram`` units."""

    words: bool
    width: int
    gram: int

    @property
    def reach(self) -> int:
        return self.width - self.gram + 1


@dataclass
class Texts:
    """The texts of one bucket as units: where each unit starts and ends in the bytes, and where each text starts in the units."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None
    units: np.ndarray
    ids: np.ndarray

    @property
    def count(self) -> int:
        return int(self.units[-1])


def texts_of(table: pa.Table, u: Units) -> Texts:
    buf, off = A.flat(table["text"])
    ids = table["doc_id"].fill_null(NO_ID).to_numpy() if len(table) else np.zeros(0, np.int64)
    if not u.words:
        return Texts(buf, off, None, None, off, ids)
    start, end, units = A.words_of(buf, off, ~A.SPACE)
    return Texts(buf, off, start, end, units, ids)


def gram_hashes(t: Texts, u: Units) -> np.ndarray:
    if u.words:
        return A.sequence_hashes(A.span_hashes(t.buf, t.start, t.end), u.gram)
    return A.gram_hashes(t.buf, u.gram)


SLICE = 1 << 20


def slices(t: Texts):
    """Some whole texts at a time, with the numbers of their first text and unit: what is made of a bucket needn't be held for all of it."""
    i = 0
    while i < len(t.off) - 1:
        j = max(i + 1, int(np.searchsorted(t.off, t.off[i] + SLICE, "right")) - 1)
        a, b, x, y = int(t.off[i]), int(t.off[j]), int(t.units[i]), int(t.units[j])
        cut = (lambda v: None if v is None else v[x:y] - a)  # noqa: B023
        yield Texts(t.buf[a:b], t.off[i : j + 1] - a, cut(t.start), cut(t.end), t.units[i : j + 1] - x, t.ids[i:j]), i, x
        i = j


def runs_of(t: Texts, u: Units) -> tuple[np.ndarray, ...]:
    """First window, count of windows, owner and text of each run, and whether its owner occurs twice in it (words only). Texts are read some at a time."""
    found = []
    for part, i, x in slices(t):
        lo, n, owner, text, twice = _runs(part, u)
        found.append((lo + x, n, owner, text + i, twice))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _runs(t, u)


def _runs(t: Texts, u: Units) -> tuple[np.ndarray, ...]:
    h = gram_hashes(t, u)
    m = A.sliding_min(h, u.reach)
    none = np.zeros(0, np.int64)
    if not len(m):
        return none, none, np.zeros(0, U64), none, np.zeros(0, bool)
    size = np.diff(t.units)
    windows = np.maximum(size - u.width + 1, 0)
    has = np.flatnonzero(windows)
    first, last = t.units[:-1][has], t.units[:-1][has] + windows[has]
    cut = np.empty(len(m) + 1, bool)
    cut[0], cut[-1] = True, True
    np.not_equal(m[1:], m[:-1], out=cut[1:-1])
    cut[first] = True
    cut[last] = True
    lo = np.flatnonzero(cut)
    n = np.diff(lo)
    lo = lo[:-1]
    text = np.searchsorted(last, lo, "right")
    inside = text < len(first)
    inside[inside] = first[text[inside]] <= lo[inside]
    lo, n, text = lo[inside], n[inside], has[text[inside]]
    if len(n) and n.max() > RUN:
        pieces = -(-n // RUN)
        at = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        n = np.minimum(np.repeat(n, pieces) - at * RUN, RUN)
        lo, text = np.repeat(lo, pieces) + at * RUN, np.repeat(text, pieces)
    owner = m[lo]
    twice = np.zeros(len(lo), bool)
    if u.words and len(lo):
        width = n + u.reach - 1
        edges = np.cumsum(width) - width
        same = A.gather(h, lo, width) == np.repeat(owner, width)
        twice = np.add.reduceat(same.astype(np.int32), edges) > 1
    return lo, n, A.mix(owner), text, twice  # least hashes are small ones: unmixed, the first bucket of owners would get half of ``reach`` times its share


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if len(table) else table


def _listed(t: Texts, u: Units, runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owners in order, how many runs of two windows' width their runs come to, and whether this bucket alone has a repeat."""
    lo, n, owner, text, twice = runs
    order = np.argsort(owner, kind="stable")
    keys = owner[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    worth = -(-(n[order] + u.width - 1) // (2 * u.width))
    count = np.add.reduceat(worth, first) if len(first) else first
    if u.words:
        several = (np.diff(np.r_[first, len(keys)]) > 1) | np.logical_or.reduceat(twice[order], first) if len(first) else np.zeros(0, bool)
    else:
        ids = t.ids[text[order]]
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    return keys[first], count, several


def buckets_of(docs: DataFrame, text_col: str, more: int = 0) -> int:
    """Buckets of documents: two a shuffle partition and ``more``, and so many that none holds over ``BUCKET`` bytes of text on average."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + more, -(-int(total) // BUCKET))


def shards_of(buf: np.ndarray, off: np.ndarray, u: Units, most: int = SHARD):
    """Contexts in order of owner, some at a time: about ``most``, or all of one owner. Contexts of different owners share no window."""
    owner = owners_of(buf, off[:-1], np.diff(off), u)
    order = np.argsort(owner, kind="stable")
    ends = np.r_[np.flatnonzero(owner[order][1:] != owner[order][:-1]) + 1, len(order)]
    a = 0
    while a < len(order):
        b = int(ends[min(np.searchsorted(ends, a + most), len(ends) - 1)])
        yield order[a:b]
        a = b


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, "Units"], tuple[np.ndarray, np.ndarray, np.ndarray]]


def covered(docs: DataFrame, units: Units, kernel: Kernel, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, hot: int = 100_000) -> DataFrame:
    """finish(table, texts, covered) for some documents at a time; covered has a boolean for each unit: a repeated window lies over it. The table has
    doc_id, text and, with ``columns``, a struct ``row`` of those.

    kernel(buf, offsets, least id, occurs elsewhere, units) gets distinct contexts and returns windows to cover: context, first, count. ``hot`` bounds
    what it holds of one owner.
    """
    buckets = buckets_of(docs, text_col, SMALL)
    whole = [F.struct(*(docs[c] for c in columns)).alias("row")] if columns else []  # so that no name can clash
    dealt = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *whole, F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(buckets)).cast("int").alias("__b"))

    def listing(key, table):
        A.frugal()
        table = _sorted(table)
        t = texts_of(table, units)
        keys, count, several = _listed(t, units, runs_of(t, units))
        hashes, edges = A.bucket_runs(keys, buckets)
        rows = list(zip(hashes.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        six = A.six_bytes(keys)
        more = np.minimum(count, 2**32 - 1).astype(np.uint32)
        return pa.table({
            "__h": pa.array([i for i, _, _ in rows], pa.int32()),
            "__b": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([six[6 * a : 6 * b].tobytes() for _, a, b in rows], pa.binary()),
            "several": pa.array([np.packbits(several[a:b]).tobytes() for _, a, b in rows], pa.binary()),
            "count": pa.array([A.pack(more[a:b]) for _, a, b in rows], pa.binary()),
        })

    def asking(key, table):
        A.frugal()
        parts = [A.from_six(np.frombuffer(x, np.uint8)) for x in table["keys"].to_pylist()]
        sizes = [len(p) for p in parts]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table["several"].to_pylist(), sizes, strict=True)]
        count = [A.unpack(x, np.uint32)[0] for x in table["count"].to_pylist()]
        keys, several, count = np.concatenate(parts), np.concatenate(several), np.concatenate(count).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        group = np.diff(np.r_[first, len(k)])
        yes = (group > 1) | np.logical_or.reduceat(several[order], first)
        many = np.add.reduceat(count[order], first) > hot
        answer = np.empty(len(k), np.uint8)
        answer[order] = np.repeat(yes.astype(np.uint8) + 2 * (yes & many), group)
        out, at = [], 0
        for n in sizes:
            a = answer[at : at + n]
            out.append(np.r_[np.packbits(a & 1), np.packbits(a >> 1)].tobytes())
            at += n
        return pa.table({"__b": table["__b"], "__h": table["__h"], "bits": pa.array(out, pa.binary())})

    def sending(key, left, right):
        A.frugal()
        left = _sorted(left)
        t = texts_of(left, units)
        lo, n, owner, text, twice = runs_of(t, units)
        keys, _, _ = _listed(t, units, (lo, n, owner, text, twice))
        hashes, edges = A.bucket_runs(keys, buckets)
        answer = np.zeros(len(keys), np.uint8)
        for h, bits in zip(np.searchsorted(hashes, right["__h"].to_numpy()).tolist(), right["bits"].to_pylist(), strict=True):
            a, b = int(edges[h]), int(edges[h + 1])
            raw = np.frombuffer(bits, np.uint8)
            half = len(raw) // 2
            answer[a:b] = np.unpackbits(raw[:half], count=b - a) + 2 * np.unpackbits(raw[half:], count=b - a)
        said = answer[np.searchsorted(keys, owner)] if len(keys) else np.zeros(0, np.uint8)
        chosen = np.flatnonzero(said)
        lo, n, owner, text, said = (x[chosen] for x in (lo, n, owner, text, said))
        if (hottest := said > 1).any():  # hot owners: each window is a context of its own, dealt by its content
            times = np.where(hottest, n, 1)
            at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            hottest = np.repeat(hottest, times)
            lo, owner, text = np.repeat(lo, times) + at, np.repeat(owner, times), np.repeat(text, times)
            n = np.where(hottest, 1, np.repeat(n, times))
        a, b = _bytes_of(t, units, lo, n)
        content = context_hashes(t, units, lo, n, a, b)
        owner = np.where(hottest, A.mix(content), owner) if len(owner) else owner
        ids = t.ids[text] if len(text) else np.zeros(0, np.int64)
        order = np.lexsort((lo, ids, content))
        same = np.r_[False, content[order][1:] == content[order][:-1]] if len(order) else np.zeros(0, bool)
        lead = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        lead_of = order[lead]
        elsewhere = np.zeros(len(lead), bool)
        if units.words:
            elsewhere = np.diff(np.r_[lead, len(order)]) > 1
            certain = order[elsewhere[group]] if len(order) else order
        else:
            later = ids[order] > ids[lead_of][group] if len(order) else np.zeros(0, bool)
            certain = order[later]
        rest = lead_of if units.words else order[~later]  # repeats inside the least document get its answer
        if not units.words:
            elsewhere = np.zeros(len(rest), bool)
        row = {"__h": [], "__b": [], "meta": [], "bytes": []}
        me = key[0].as_py()
        by = np.argsort(owner[rest], kind="stable")
        rest, elsewhere = rest[by], elsewhere[by]
        hashes, cuts = A.bucket_runs(owner[rest], buckets)
        for h in range(len(hashes)):
            pick = rest[cuts[h] : cuts[h + 1]]
            row["__h"].append(int(hashes[h]))
            row["__b"].append(me)
            mark = elsewhere[cuts[h] : cuts[h + 1]] + 2 * hottest[pick].astype(np.uint8)
            row["meta"].append(A.pack(ids[pick], lo[pick], n[pick].astype(np.uint8), (b - a)[pick].astype(np.int32), mark))
            row["bytes"].append(A.pack(A.gather(t.buf, a[pick], (b - a)[pick])))
        if len(certain):  # decided here; it only travels on to the last step
            row["__h"].append(me)
            row["__b"].append(me)
            row["meta"].append(None)
            row["bytes"].append(A.pack(np.sort(lo[certain]), n[certain][np.argsort(lo[certain], kind="stable")].astype(np.uint8)))
        return pa.table({"__h": pa.array(row["__h"], pa.int32()), "__b": pa.array(row["__b"], pa.int32()), "meta": pa.array(row["meta"], pa.binary()), "bytes": pa.array(row["bytes"], pa.binary())})

    def judging(key, table):
        A.frugal()
        out = {"__b": [], "spans": []}
        metas, texts, where = [], [], []
        for b, meta, data in zip(table["__b"].to_pylist(), table["meta"].to_pylist(), table["bytes"].to_pylist(), strict=True):
            if meta is None:
                out["__b"].append(b)
                out["spans"].append(data)
            else:
                metas.append(A.unpack(meta, np.int64, np.int64, np.uint8, np.int32, np.uint8))
                texts.append(A.unpack(data, np.uint8)[0])
                where.append(np.full(len(metas[-1][0]), b))
        if metas:
            ids, lo, n, size, mark = (np.concatenate(x) for x in zip(*metas, strict=True))
            elsewhere = (mark & 1).astype(bool)
            where, buf = np.concatenate(where), np.concatenate(texts)
            metas.clear()
            texts.clear()
            off = np.r_[0, np.cumsum(size, dtype=np.int64)]
            content = A.span_hashes(buf, off[:-1], off[1:])
            order = np.lexsort((lo, ids, content))
            same = np.r_[False, content[order][1:] == content[order][:-1]]
            lead = np.flatnonzero(~same)
            group = np.cumsum(~same) - 1
            leads = order[lead]
            many = np.diff(np.r_[lead, len(order)])
            if units.words:
                known = np.logical_or.reduceat(elsewhere[order], lead) | (many > 1)
                sure = order[known[group] & ~elsewhere[order]]  # the others were decided where they came from
            else:
                known = np.zeros(len(lead), bool)
                sure = order[same & (ids[order] > ids[leads][group])]
            cold = np.flatnonzero(mark[leads] < 2)  # a window of a hot owner only ever equals whole contexts
            ctx_buf = A.gather(buf, off[leads[cold]], size[leads[cold]])
            ctx_off = np.r_[0, np.cumsum(size[leads[cold]], dtype=np.int64)]
            del buf, content
            c, first, count = kernel(ctx_buf, ctx_off, ids[leads[cold]], known[cold], units)
            c = cold[c]
            peers = ids[order] == ids[leads][group]  # the least document may hold a context more than once
            peer, its = order[peers], group[peers]
            begin, times = np.searchsorted(its, c), np.bincount(its, minlength=len(leads))[c]
            first, count = np.repeat(first, times), np.repeat(count, times)
            c = peer[np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            span_b, span_lo, span_n = np.r_[where[sure], where[c]], np.r_[lo[sure], lo[c] + first], np.r_[n[sure].astype(np.int64), count]
            by = np.lexsort((span_lo, span_b))
            span_b, span_lo, span_n = span_b[by], span_lo[by], span_n[by]
            cut = np.flatnonzero(np.r_[True, span_b[1:] != span_b[:-1]]) if len(span_b) else []
            for x, y in zip(cut, np.r_[cut[1:], len(span_b)] if len(span_b) else [], strict=True):
                out["__b"].append(int(span_b[x]))
                out["spans"].append(A.pack(span_lo[x:y], span_n[x:y].astype(np.uint8)))
        return pa.table({"__b": pa.array(out["__b"], pa.int32()), "spans": pa.array(out["spans"], pa.binary())})

    def ending(key, left, right):
        A.frugal()
        left = _sorted(left)
        t = texts_of(left, units)
        spans = [A.unpack(data, np.int64, np.uint8) for data in right["spans"].to_pylist()]
        lo = np.concatenate([x for x, _ in spans] or [np.zeros(0, np.int64)])
        n = np.concatenate([x for _, x in spans] or [np.zeros(0, np.uint8)])
        order = np.argsort(lo, kind="stable")
        lo, n = lo[order], n[order]
        left = left.drop_columns(["__b"])
        done = []
        for part, i, x in slices(t):
            a, b = np.searchsorted(lo, (x, x + part.count))
            edge = np.zeros(part.count + 1, np.int32)
            np.add.at(edge, lo[a:b] - x, 1)
            np.add.at(edge, lo[a:b] - x + n[a:b] + units.width - 1, -1)
            done.append(finish(left.slice(i, len(part.off) - 1), part, np.cumsum(edge[:-1], dtype=np.int32) > 0))
        return pa.concat_tables(done) if done else finish(left, t, np.zeros(0, bool))

    owners = dealt.groupBy("__b").applyInArrow(listing, "__h int, __b int, keys binary, several binary, count binary")
    answers = owners.groupBy("__h").applyInArrow(asking, "__b int, __h int, bits binary")
    contexts = dealt.groupBy("__b").cogroup(answers.groupBy("__b")).applyInArrow(sending, "__h int, __b int, meta binary, bytes binary")
    spans = contexts.groupBy("__h").applyInArrow(judging, "__b int, spans binary")
    return dealt.groupBy("__b").cogroup(spans.groupBy("__b")).applyInArrow(ending, schema)


def owners_of(buf: np.ndarray, start: np.ndarray, size: np.ndarray, u: Units) -> np.ndarray:
    """The owner of each context: all its windows have the same, so the first one's."""
    out = [np.zeros(0, U64)]
    for a in range(0, len(start), 4096):
        n = size[a : a + 4096]
        text, off = A.gather(buf, start[a : a + 4096], n), np.r_[0, np.cumsum(n, dtype=np.int64)]
        if u.words:
            s, e, off = A.words_of(text, off, ~A.SPACE)
            grams = A.sequence_hashes(A.span_hashes(text, s, e), u.gram)
        else:
            grams = A.gram_hashes(text, u.gram)
        out.append(np.minimum.reduceat(A.gather(grams, off[:-1], np.full(len(n), u.reach)), np.arange(len(n)) * u.reach))
    return np.concatenate(out)


def _bytes_of(t: Texts, u: Units, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the context of each run starts and ends in the bytes."""
    last = lo + n + u.width - 2
    return (t.start[lo], t.end[last]) if u.words else (lo, last + 1)


def context_hashes(t: Texts, u: Units, lo: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each context: of its bytes, or of its words however they are spaced."""
    if not len(lo):
        return np.zeros(0, U64)
    if not u.words:
        size = b - a
        return A.span_hashes(A.gather(t.buf, a, size), np.cumsum(size) - size, np.cumsum(size))
    h = A.span_hashes(t.buf, t.start, t.end)
    size = n + u.width - 1
    at = np.cumsum(size) - size
    inner = np.arange(int(size.sum()), dtype=np.uint64) - np.repeat(at, size).astype(np.uint64)
    mixed = A.mix(A.gather(h, lo, size) + inner * A.M1)
    return A.mix(np.add.reduceat(mixed, at) + size.astype(np.uint64))
