"""Operator 4: exact Jaccard join of shingle sets, size-aware: subsets for small sets, inverted lists for large ones.

Documents with equal sets are one class, found by an aggregate; only the least document of each class goes on. Sets of at most ``boundary``
shingles are light: at a similarity of 0.9 they and any set that links with them can only differ by one element, so each emits itself and its subsets
of one element less, as do sets one larger, and equal keys are links. Larger sets are heavy: two of size a and b that link differ in at most (a + b) / 19 elements, so if shingles are
dealt by hash into a good many parts more than that, so many parts are the same in both: each set emits its parts as keys for its size class and the
one below, inverted lists of keys are scanned, and pairs that meet often enough are candidates. Empty parts are emitted only by sets with more of them
than there are spare parts; a set with fewer needs as many meetings less. The boundary is where the histogram of set sizes makes the keys of both kinds cheapest.

Candidates are checked on whole sets: a set travels once to each bucket that holds partners of it. Lists longer than ``LIST`` are checked as blocks
by one matrix product in place of pairs, long ones by pairs of blocks, and return a spanning star of each group found. Components come from alternating
stars in Spark. Nothing but a histogram of at most ``LIGHT`` + 1 sizes reaches the driver.

Null texts and texts without words have the empty set and link with nothing. Rows with the same doc_id are judged each; links count for the id.
A null doc_id is larger than all others and comes back as null. Extra columns are ignored by the query and kept by ``keep_one_of_each``,
which chooses among rows, not ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import components, cut_lineage
from .decontaminate import LOWER
from .repeats import NO_ID, _sorted, buckets_of

SHINGLE, PERCENT = 3, 90
LIGHT, SPARE, LIST, BLOCK, CHECK_COST = 18, 3, 24, 512, 8
SURE = 1000
U64 = np.uint64


def shingle_sets(column, rows: np.ndarray | None = None, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, or of the texts in the given rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    buf, off = A.flat(column if rows is None else column.take(pa.array(rows)))
    buf = LOWER[buf]
    start, end, at = A.words_of(buf, off, ~A.SPACE)
    h = A.span_hashes(buf, start, end)
    g = A.sequence_hashes(h, shingle)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(g[a : b - shingle + 1]))
        elif b > a:
            out.append(A.sequence_hashes(h[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def size_classes(largest: int, percent: int) -> list[int]:
    """Where size classes start: sets that link are in one class or in neighbours."""
    edges = [1]
    while edges[-1] <= 2 * largest + 2:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return edges


def parts_of(edges: list[int], j: int, percent: int) -> tuple[int, int]:
    """Parts of scheme j, for pairs whose smaller set is in class j: one more than they can differ by, and the spare ones. Spare are well over as many as a
    set of that class is likely to leave empty."""
    most = edges[j + 1] - 1 + edges[j + 2] - 1
    parts = most * (100 - percent) // (100 + percent) + 1
    spare = SPARE + math.ceil(2.5 * (parts + SPARE) * math.exp(-edges[j] / (parts + SPARE)))
    return parts + spare, spare


def keys_of(sets: list[np.ndarray], boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of the sets, the index of the set of each, and its kind: 0 part, 1 whole, 2 subset; and in how few lists a heavy set must meet a partner."""
    size = np.array([len(s) for s in sets], np.int64)
    keys, owner, kind, meet = [], [], [], np.ones(len(sets), np.int64)
    for i in np.flatnonzero((size > 0) & (size <= boundary + 1)).tolist():
        s = A.mix(sets[i])
        whole = np.sum(s, dtype=U64)
        if size[i] <= boundary:
            keys.append(A.mix(np.array([whole + U64(size[i])])))
            owner.append(np.array([i]))
            kind.append(np.ones(1, np.uint8))
        if (size[i] - 1) * 100 >= percent * size[i]:
            keys.append(A.mix(whole - s + U64(size[i] - 1)))
            owner.append(np.full(len(s), i))
            kind.append(np.full(len(s), 2, np.uint8))
    heavy = np.flatnonzero(size > boundary)
    if len(heavy):
        edges = size_classes(int(size.max()), percent)
        cls = np.searchsorted(edges, size[heavy], "right") - 1
        flat = np.concatenate([sets[i] for i in heavy.tolist()])
        where = np.repeat(np.arange(len(heavy)), size[heavy])
        value = A.mix(flat ^ U64(0x5851F42D4C957F2D))
        least = np.full(len(heavy), np.iinfo(np.int64).max)
        for below in (0, 1):
            scheme = np.maximum(cls - below, 0)
            plan = [parts_of(edges, j, percent) for j in range(int(scheme.max()) + 1)]
            parts, spare = np.array(plan, np.int64)[scheme].T
            base = np.cumsum(parts) - parts
            slot = base[where] + (flat % parts[where].astype(U64)).astype(np.int64)
            total = np.zeros(int(parts.sum()), U64)
            np.add.at(total, slot, value)
            full = np.bincount(slot, minlength=len(total))
            of = np.repeat(np.arange(len(heavy)), parts)
            part = np.arange(len(total)) - base[of]
            empties = np.bincount(of, weights=full == 0, minlength=len(heavy)).astype(np.int64)
            least = np.minimum(least, spare + 1 - empties)
            emit = ((full > 0) | (empties > spare)[of]) & ~((below == 1) & (cls[of] == 0))
            key = A.mix(total + A.mix((scheme[of].astype(U64) << U64(32)) + part.astype(U64) + U64(1)))
            keys.append(key[emit])
            owner.append(heavy[of[emit]])
            kind.append(np.zeros(int(emit.sum()), np.uint8))
        meet[heavy] = np.maximum(least, 1)
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint8), meet
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(kind), meet


def _summed(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their summed weights."""
    order = np.lexsort((b, a))
    a, b, weight = a[order], b[order], weight[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(weight, first) if len(a) else weight


def _rows(out: dict[int, dict[str, bytes]], kinds: tuple[str, ...]) -> pa.Table:
    """A row a bucket, with a packed column a kind."""
    return pa.table({"__b": pa.array(list(out), pa.int32()), **{k: pa.array([x.get(k) for x in out.values()], pa.binary()) for k in kinds}})


def choose_boundary(histogram: dict[int, int], percent: int) -> int:
    """The size up to which sets are light, where keys and checks cost least; at most the sizes whose links, also with heavy sets, are of one element."""
    most = max(b for b in range(LIGHT + 1) if b * 100 // percent <= b + 1)
    edges = size_classes(LIGHT + 2, percent)

    def heavy(n):
        j = int(np.searchsorted(edges, n, "right")) - 1
        return parts_of(edges, j, percent)[0] + parts_of(edges, max(j - 1, 0), percent)[0] + CHECK_COST

    cost = {b: sum(c * (n + 1 if n <= b else heavy(n)) for n, c in histogram.items() if n <= LIGHT) for b in range(most + 1)}
    return min(cost, key=lambda b: (cost[b], -b))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(b) < len(a):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[k] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning star of each group of sets that links connect."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = shared[code]
    col, row = new[code[keep]], row[keep]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for a in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(col, (a, a + 2048))
        m = np.zeros((len(sets), 2048), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    left, out = np.ones(len(sets), bool), []
    for i in np.argsort(ids, kind="stable").tolist():
        if left[i]:
            reach = np.zeros(len(sets), bool)
            front = np.array([i])
            while len(front):
                reach[front] = True
                front = np.flatnonzero(link[front].any(0) & ~reach)
            left &= ~reach
            out += [(int(ids[i]), int(ids[k])) for k in np.flatnonzero(reach).tolist() if k != i]
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, by_row: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (their place __b and i, id, n, mark and digest of the text), classes (n, mark and r, the least row) and labels of what links connect: ids or,
    by row, places of the classes' least rows in one number."""
    buckets = buckets_of(docs, text_col)
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(buckets)).cast("int").alias("__b"))
    ids_in = lambda t: t["doc_id"].fill_null(NO_ID).to_numpy()
    nodes_in = lambda key, t: (key[0].as_py() << 32) + np.arange(len(t)) if by_row else ids_in(t)

    def summing(key, table):
        table = _sorted(table)
        sets = shingle_sets(table["text"], None, shingle)
        total = np.array([int(np.sum(A.mix(s), dtype=U64)) if len(s) else 0 for s in sets], U64)
        total = A.mix(total + np.array([len(s) for s in sets], U64)).astype(np.int64)
        n = len(sets)
        return pa.table({"__b": pa.array(np.full(n, key[0].as_py()), pa.int32()), "i": pa.array(np.arange(n), pa.int32()), "id": pa.array(ids_in(table), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "mark": pa.array(total, pa.int64()), "digest": table["digest"]})

    rows = dealt.withColumn("digest", F.xxhash64("text")).groupBy("__b").applyInArrow(summing, "__b int, i int, id long, n long, mark long, digest long")
    rows = cut_lineage(rows)
    classes = rows.where("n > 0").groupBy("n", "mark").agg(F.min(F.struct("id", "__b", "i")).alias("r"))
    heads = classes.select("r.__b", "r.i", "n")
    histogram = {r[0]: r[1] for r in heads.where(F.col("n") <= LIGHT).groupBy("n").count().collect()}
    boundary = choose_boundary(histogram, percent)

    def emitting(key, left, right):
        left = _sorted(left)
        mine = np.sort(right["i"].to_numpy())
        keys, owner, kind, _ = keys_of(shingle_sets(left["text"], mine, shingle), boundary, percent)
        order = np.argsort(keys, kind="stable")
        keys, owner, kind = keys[order], mine[owner[order]], kind[order]
        hashes, edges = A.bucket_runs(keys, buckets)
        low = keys.astype("<u4")  # the high bits are in the bucket's number; a chance collision is one meeting too many
        spans = list(zip(hashes.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.table({
            "__h": pa.array([h for h, _, _ in spans], pa.int32()), "__b": pa.array([key[0].as_py()] * len(spans), pa.int32()),
            "keys": pa.array([low[a:b].tobytes() for _, a, b in spans], pa.binary()),
            "rest": pa.array([A.pack(owner[a:b].astype(np.int32), kind[a:b]) for _, a, b in spans], pa.binary()),
        })

    def pairing(key, table):
        parts = [np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]
        rest = [A.unpack(x, np.int32, np.uint8) for x in table["rest"].to_pylist()]
        bucket = np.repeat(table["__b"].to_numpy(), [len(p) for p in parts]).astype(np.int64)
        keys, at, kind = np.concatenate(parts), np.concatenate([x[0] for x in rest]).astype(np.int64), np.concatenate([x[1] for x in rest])
        node = (bucket << 32) | at
        order = np.lexsort((node, keys))
        keys, node, kind = keys[order], node[order], kind[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[first, len(keys)])
        a, b, weight, homes, members, seen = [], [], [], [], [], []
        for f, c in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            x, k = node[f : f + c], kind[f : f + c]
            if k.any():  # a whole set and the subsets of larger ones that equal it
                for whole in np.unique(x[k == 1]).tolist():
                    others = x[k == 2]
                    a.append(np.full(len(others), whole))
                    b.append(others)
                    weight.append(np.full(len(others), SURE))
                x = x[k == 0]
            x = np.unique(x)
            if len(x) > 1:
                seen.append(x)
            if 2 <= len(x) <= LIST:
                i, j = np.triu_indices(len(x), 1)
                a.append(x[i])
                b.append(x[j])
                weight.append(np.ones(len(i), np.int64))
            elif len(x) > LIST:
                blocks = np.array_split(x, -(-len(x) // BLOCK))
                for i in range(len(blocks)):
                    for j in range(i + 1, len(blocks)) if len(blocks) > 1 else (i,):
                        both = np.unique(np.r_[blocks[i], blocks[j]])
                        # lists of like members meet under their least one; blocks of a longer list have homes of their own
                        home = int(x[0]) if len(blocks) == 1 else int(keys[f]) + (key[0].as_py() << 40) + i * 65537 + j
                        members.append(both)
                        homes.append(np.full(len(both), int(A.mix(np.array([home], U64))[0] >> U64(1))))
        out: dict[int, dict[str, bytes]] = {}

        def put(of, kind, *cols):
            order = np.argsort(of, kind="stable")
            of = of[order]
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for s, e in zip(cut.tolist(), np.r_[cut[1:], len(of)].tolist(), strict=True):
                out.setdefault(int(of[s]), {})[kind] = A.pack(*(c[order[s:e]] for c in cols))

        if a:
            x, y, times = _summed(np.minimum(np.concatenate(a), np.concatenate(b)), np.maximum(np.concatenate(a), np.concatenate(b)), np.concatenate(weight))
            put(x >> 32, "pairs", x & 0xFFFFFFFF, y, times)
        if homes:
            m = np.concatenate(members)
            put(m >> 32, "homes", m & 0xFFFFFFFF, np.concatenate(homes), np.ones(len(m), np.int64))
            m, _, times = _summed(*(2 * [np.concatenate(seen)]), np.ones(sum(map(len, seen)), np.int64))
            put(m >> 32, "lists", m & 0xFFFFFFFF, m, times)
        return _rows(out, ("pairs", "homes", "lists"))

    def sending(key, left, right):
        left = _sorted(left)
        ids = nodes_in(key, left)
        got = [np.concatenate([np.zeros((3, 0), np.int64), *(np.stack(A.unpack(x, np.int64, np.int64, np.int64)) for x in right[c].to_pylist() if x)], 1) for c in ("pairs", "homes", "lists")]
        (i, j, times), (member, home, _), (one, _, met) = got
        i, j, times = _summed(i, j, times)
        need = np.unique(np.r_[i, member])
        found = shingle_sets(left["text"], need, shingle) if len(need) else []
        sets = dict(zip(need.tolist(), found, strict=True))
        # partners meet in many lists: fewer meetings can't be a link (a pair that shares a long list is checked there)
        meet = np.ones(len(left) + 1, np.int64)
        meet[need] = keys_of(found, boundary, percent)[3] if len(need) else 1
        enough = times >= meet[i]
        pairs = np.stack([i[enough], j[enough]], 1)
        lists = np.bincount(one, weights=met, minlength=len(left) + 1).astype(np.int64)
        homes = np.unique(np.stack([member, home], 1)[lists[member] >= meet[member]], axis=0)
        out: dict[int, dict[str, bytes]] = {}

        def put(bucket, kind, mine, other):
            for b in np.unique(bucket).tolist():
                m, o = mine[bucket == b], other[bucket == b]
                sent, index = np.unique(m, return_inverse=True)
                out.setdefault(int(b), {})[kind] = (A.pack(ids[sent], np.array([len(sets[i]) for i in sent.tolist()], np.int64), np.concatenate([sets[i] for i in sent.tolist()]), index.astype(np.int64), o))

        put(pairs[:, 1] >> 32, "pairs", pairs[:, 0], pairs[:, 1] & 0xFFFFFFFF)
        put(homes[:, 1] % buckets, "homes", homes[:, 0], homes[:, 1])
        return _rows(out, ("pairs", "homes"))

    def checking(key, left, right):
        left = _sorted(left)
        ids = nodes_in(key, left)
        got, groups = [], {}
        for c, data in ((c, x) for c in ("pairs", "homes") for x in right[c].to_pylist() if x):
            i, n, flat, index, other = A.unpack(data, np.int64, np.int64, U64, np.int64, np.int64)
            sets = np.split(flat, np.cumsum(n)[:-1])
            if c == "homes":
                for x, home in zip(index.tolist(), other.tolist(), strict=True):
                    groups.setdefault(home, []).append((int(i[x]), sets[x]))
            else:
                got += [(int(i[x]), sets[x], o) for x, o in zip(index.tolist(), other.tolist(), strict=True)]
        need = np.unique([o for _, _, o in got]).astype(np.int64)
        mine = dict(zip(need.tolist(), shingle_sets(left["text"], need, shingle) if len(need) else [], strict=True))
        links = [(i, int(ids[o])) for i, s, o in got if linked(s, mine[o], percent)]
        for members in groups.values():
            parts = [members[x : x + 2 * BLOCK] for x in range(0, len(members), 2 * BLOCK)]
            for x in range(len(parts)):
                for y in range(x + 1, len(parts)) if len(parts) > 1 else (x,):
                    both = parts[x] + parts[y] if x < y else parts[x]
                    links += block_links(np.array([m[0] for m in both]), [m[1] for m in both], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    postings = dealt.groupBy("__b").cogroup(heads.groupBy("__b")).applyInArrow(emitting, "__h int, __b int, keys binary, rest binary")
    candidates = postings.groupBy("__h").applyInArrow(pairing, "__b int, pairs binary, homes binary, lists binary")
    sets = dealt.groupBy("__b").cogroup(candidates.groupBy("__b")).applyInArrow(sending, "__b int, pairs binary, homes binary")
    links = dealt.groupBy("__b").cogroup(sets.groupBy("__b")).applyInArrow(checking, "a long, b long")
    return rows, classes, components(links)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (least document with the same set) and component_id, a row for each document row."""
    rows, classes, labels = _classes(docs, id_col, text_col, shingle, percent, False)
    classes = classes.select("n", "mark", F.col("r.id").alias("class_id"))
    classes = classes.join(labels, classes["class_id"] == labels["node"], "left").select("n", "mark", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    whole = rows.select("id", "n", "mark").join(classes, ["n", "mark"], "left")
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return whole.select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("class_id").alias("class_id"), F.coalesce(known("component_id"), known("id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, unnamed: bool = True) -> DataFrame:
    """One row of each component, with all its columns: that of the least id, then of the least text, of rows alike in both the one least as JSON. Rows link
    by their own texts, whatever other rows have their id; rows without shingles stay. Rows without an id stay too if ``unnamed``."""
    rows, classes, labels = _classes(docs, id_col, text_col, shingle, percent, True)
    classes = classes.select("n", "mark", F.expr("shiftleft(cast(r.__b as bigint), 32) + r.i").alias("at"))
    group = classes.join(labels, classes["at"] == labels["node"], "left").select("n", "mark", F.coalesce("component", "at").alias("group"))
    known = rows.where("n > 0" + (f" AND id <> {NO_ID}" if unnamed else ""))
    alike = cut_lineage(known.groupBy("id", "digest", "n", "mark").agg(F.count("*").alias("times")).join(group, ["n", "mark"]).select("group", "id", "digest", "times"))
    first = alike.groupBy("group", "id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")).groupBy("group").agg(F.min(F.struct("id", "digest", "other")).alias("r"))
    first = cut_lineage(first.select("group", "r.*"))
    best = first.where("digest = other").select("id", "digest")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("digest"), F.struct(*docs.columns).alias("row"))
    ties = first.where("digest <> other")
    if not ties.isEmpty():  # several texts under the least id: their own order decides
        some = alike.join(ties.select("group", "id"), ["group", "id"], "left_semi").select("group", "id", "digest")
        best = best.unionByName(keyed.select("id", "digest", F.col(f"row.`{text_col}`").alias("text")).join(some, ["id", "digest"]).groupBy("group").agg(F.min_by(F.struct("id", "digest"), "text").alias("r")).select("r.*"))
    marked = alike.join(best.withColumn("stay", F.lit(1)), ["id", "digest"], "left")
    changed = cut_lineage(marked.where("stay IS NULL OR times > 1").select("id", "digest", "stay"))
    whole = keyed.join(changed, ["id", "digest"], "left_anti")
    one = keyed.join(changed.where("stay = 1"), ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return whole.select("row.*").unionByName(one.select("row.*"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + {SHINGLE - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS s FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= {PERCENT} * (p.n + q.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = doc_id"""
