"""Operator 8: exact top-k inner products by M-trees.

A vector x is lifted to (x, sqrt(M^2 - |x|^2)), with M the greatest norm, and a query q to (q, 0); then a smaller Euclidean distance is a
greater inner product, so a metric tree applies. The root's entries are sampled pivots, one for ``tree`` vectors and at most ``PIVOTS``. Each vector belongs
to its nearest pivot; a ball of more than ``tree`` vectors is cut into rings by the stored distance to the pivot, and a ring of many vectors (copies are
all as far away) into trees by id. Each tree is bulk-loaded into nested pages of at most ``PAGE`` entries with covering radii and parent distances.

A query first searches its most promising tree, whose k-th score is its bound; then it goes to all trees that pivot distance and ring don't rule out.
Inside a tree a block of queries is searched at once: each query goes to its best entry first, then to the others in order; an entry whose stored parent
distance shows, by the triangle inequality, that it can't reach a query's k-th score is skipped without a distance computation. Bounds only ever
skip what is strictly worse. A task holds one tree and one batch of queries; only pivots and rings, of bounded number, are broadcast.

Vectors that are null or hold a null or non-finite component (or one that 256 times overflows) take no part. Vectors of unequal length count as padded
with zeros. Scores are exact integers; one that doesn't fit a long is given, and ranked, as the nearest long. A query never meets rows of its own id;
repeated rows are candidates each; each distinct vector of an id is a query of its own. Ties go to the smaller vec_id. Extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays as A

PIVOTS, RINGS, PAGE, TREE, K, BLOCK = 1024, 16, 64, 4096, 5, 1024
LONG = np.iinfo(np.int64)
EXACT = 2.0**52  # whole numbers up to here are exact in sums of doubles, in any order


def _matrix(column, width: int) -> np.ndarray:
    """Lists of numbers as rows of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    size = np.diff(off)
    out = np.zeros((len(size), width))
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return np.array(flat[off[0] : off[-1]]).reshape(-1, width)
    for i, (a, n) in enumerate(zip(off[:-1].tolist(), size.tolist(), strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _reach(both: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The best score of a query (both: its squared norm + M^2) at this distance or more."""
    return (both[:, None] - np.square(np.maximum(distance, 0))) / 2 + (1e-7 * both + 1e-6)[:, None]  # rounding allowed for


class Queries:
    """Some queries with their k best candidates so far; ``floor``: scores below it don't matter."""

    def __init__(self, own: np.ndarray, x: np.ndarray, floor: np.ndarray, top: float, k: int) -> None:
        self.own, self.x, self.k = own, x, k
        self.norm = (x * x).sum(1)
        self.y = np.c_[x, np.zeros(len(x))]
        self.both = self.norm + top
        self.floor = floor.astype(np.float64).copy()
        self.score = np.full((len(x), k), LONG.min, np.int64)
        self.id = np.full((len(x), k), LONG.max, np.int64)
        self.full = np.zeros((len(x), k), bool)

    def scores(self, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of some queries with some vectors, and which of them can matter."""
        with np.errstate(over="ignore", invalid="ignore"):
            s = self.x[rows] @ x.T
            size = np.sqrt(self.norm[rows])[:, None] * np.sqrt((x * x).sum(1))[None, :]
        vague = ~(size < EXACT)
        if not vague.any():
            return s.astype(np.int64), s >= self.floor[rows][:, None]
        wrong = np.where(vague, size * (4.0 * x.shape[1] * 2.0**-53), 0.0)
        use = ~(np.maximum(s + wrong, LONG.min) < self.floor[rows][:, None])
        out = np.where(vague, 0, np.nan_to_num(s)).astype(np.int64)
        for i, j in zip(*np.nonzero(vague & use), strict=True):
            exact = sum(int(a) * int(b) for a, b in zip(self.x[rows[i]].tolist(), x[j].tolist(), strict=True))
            out[i, j] = min(max(exact, LONG.min), LONG.max)
        return out, use & (out >= self.floor[rows][:, None])

    def offer(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Vectors, in order of id, as candidates of some queries."""
        s, use = self.scores(rows, x)
        use &= ids[None, :] != self.own[rows][:, None]
        some = np.flatnonzero(use.any(1))
        if not len(some):
            return
        rows, s, use = rows[some], s[some], use[some]
        if s.shape[1] > self.k:
            best = np.argsort(np.where(use, -s.astype(np.float64), np.inf), axis=1, kind="stable")[:, : self.k] if abs(s).max() < EXACT else np.lexsort((~s, ~use), axis=1)[:, : self.k]
            s, use, new = np.take_along_axis(s, best, 1), np.take_along_axis(use, best, 1), ids[best]
        else:
            new = np.broadcast_to(ids, s.shape)
        score, ids, full = np.c_[self.score[rows], s], np.c_[self.id[rows], new], np.c_[self.full[rows], use]
        order = np.lexsort((ids, ~score, ~full), axis=1)[:, : self.k]  # ~ turns the order of whole numbers round and can't overflow
        self.score[rows], self.id[rows], self.full[rows] = (np.take_along_axis(v, order, 1) for v in (score, ids, full))
        last = self.score[rows, -1]
        worst = np.where(self.full[rows, -1] & (last > LONG.min), last.astype(np.float64) - np.where(abs(last.astype(np.float64)) < EXACT, 0, 2048.0), -np.inf)
        self.floor[rows] = np.maximum(self.floor[rows], worst)


class Page:
    """Entries of one routing object: vectors (leaf) or pages, each with its distance to that object; a page also with its covering radius."""

    __slots__ = ("ids", "pages", "parent", "radius", "rows", "x")

    def __init__(self, x: np.ndarray, parent: np.ndarray, ids=None, pages=None, radius=None) -> None:
        self.x, self.parent, self.ids, self.pages, self.radius = x, parent, ids, pages, radius


class MTree:
    """A paged M-tree over whole-number vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, page: int = PAGE) -> None:
        self.page, self.computed = page, 0
        self.x, self.ids = x.astype(np.float64), ids
        self.y = _lift(self.x, top)
        self.route = self.y.mean(0)
        self.root = self._grow(np.arange(len(x)), self.route)

    def _leaf(self, at: np.ndarray, away: np.ndarray) -> Page:
        order = np.argsort(self.ids[at], kind="stable")
        return Page(self.x[at[order]], away[order], ids=self.ids[at[order]])

    def _grow(self, at: np.ndarray, route: np.ndarray) -> Page:
        """A page over the vectors at ``at``, under a routing object: heads far from one another, and each vector with its nearest head."""
        away = _away(self.y[at], route[None, :])[:, 0]
        if len(at) <= self.page:
            return self._leaf(at, away)
        y = self.y[at]
        heads, near, owner = [], np.full(len(at), np.inf), np.zeros(len(at), np.int64)
        nxt = int(np.argmax(away))
        while len(heads) < min(self.page, -(-2 * len(at) // self.page)):
            d = _away(y, y[nxt : nxt + 1])[:, 0]
            d[nxt] = 0
            closer = d < near
            owner[closer], near[closer] = len(heads), d[closer]
            heads.append(nxt)
            nxt = int(np.argmax(near))
            if not near[nxt] > 0:
                break
        groups = [np.flatnonzero(owner == j) for j in range(len(heads))]
        if max(len(g) for g in groups) == len(at):  # nothing but copies
            groups = np.array_split(np.arange(len(at)), -(-len(at) // self.page))
            heads = [int(g[0]) for g in groups]
        route_of = y[heads]
        pages = [self._leaf(at[g], _away(y[g], r[None, :])[:, 0]) if len(g) <= self.page else self._grow(at[g], r) for g, r in zip(groups, route_of, strict=True)]
        radius = np.array([float(_away(y[g], r[None, :]).max()) for g, r in zip(groups, route_of, strict=True)])
        return Page(route_of, away[heads], pages=pages, radius=radius)

    def search(self, own: int, q: np.ndarray, top: float, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, id) of one query, best first; ``least``: scores below it don't matter."""
        one = Queries(np.array([own]), q[None, :].astype(np.float64), np.array([least]), top, k)
        self.search_all(one)
        return [(s, i) for s, i, f in zip(one.score[0].tolist(), one.id[0].tolist(), one.full[0].tolist(), strict=True) if f]

    def search_all(self, q: Queries) -> None:
        """Offers all that can matter to the queries."""
        rows = np.arange(len(q.own))
        if len(self.ids):
            self._visit(self.root, q, rows, _away(q.y, self.route[None, :])[:, 0])
            self.computed += len(rows)

    def _visit(self, page: Page, q: Queries, rows: np.ndarray, away: np.ndarray) -> None:
        apart = np.abs(away[:, None] - page.parent[None, :])
        if page.pages is None:
            may = ~(_reach(q.both[rows], apart) < q.floor[rows][:, None])
            r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if len(r):
                self.computed += len(r) * len(c)
                q.offer(rows[r], page.ids[c], page.x[c])
            return
        bound = _reach(q.both[rows], apart - page.radius[None, :])  # from stored distances alone
        may = ~(bound < q.floor[rows][:, None])
        r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(r):
            return
        rows, may = rows[r], may[np.ix_(r, c)]
        self.computed += len(r) * len(c)
        d = _away(q.y[rows], page.x[c])
        bound = np.where(may, _reach(q.both[rows], d - page.radius[c][None, :]), -np.inf)
        best = np.argmax(bound, axis=1)
        for turn in (0, 1):
            for j in np.argsort(-bound.max(0), kind="stable").tolist():
                go = np.flatnonzero(((best == j) == (turn == 0)) & may[:, j] & ~(bound[:, j] < q.floor[rows]))
                if len(go):
                    self._visit(page.pages[c[j]], q, rows[go], d[go, j])


def whole_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and q = floor(256 x), as doubles, of the vectors that take part."""
    whole = F.transform(vec_col, lambda x: F.when(F.abs(x.cast("double") * 256) < 2.0**62, F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))
    q = table.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))
    return q.where(F.forall("q", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def _rings(stats: list, tree: int) -> dict[str, np.ndarray]:
    """Rings of each pivot, in order: pivot, lo, hi and the number of trees; stats: pivot, rows, least, greatest and quantiles of the distance."""
    out = []
    for pivot, n, least, most, cuts in stats:
        rings = min(RINGS, -(-n // tree))
        share: dict[float, float] = {}
        for j in range(1, rings):
            k = round(j * RINGS / rings)
            share[cuts[k - 1]] = k / RINGS  # equal quantiles: copies; their ring holds all of them
        edges, mass = [least, *share, most], [0.0, *share.values(), 1.0]
        for j in range(len(edges) - 1):
            out.append((pivot, edges[j], edges[j + 1], max(1, -(-int(n * (mass[j + 1] - mass[j])) // tree))))
    return {c: np.array(v) for c, v in zip(("pivot", "lo", "hi", "trees"), zip(*out, strict=True), strict=True)}


def _flush(queue: list, tree: "MTree | None", top: float, k: int):
    own, of, x, floor = (np.concatenate(v) for v in zip(*queue, strict=True))
    q = Queries(own, x, floor, top, k)
    if tree is not None:
        tree.search_all(q)
    i, j = np.nonzero(q.full)
    return pa.record_batch({"query_id": pa.array(own[i]), "of": pa.array(of[i]), "vec_id": pa.array(q.id[i, j]), "score": pa.array(q.score[i, j])})


def top_k(table: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, tree: int = TREE) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query with rows of other ids."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows, asked = whole_vectors(table, id_col, vec_col), whole_vectors(queries, id_col, vec_col).distinct().withColumn("of", F.xxhash64("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    top, size, n = rows.agg(F.max(norm), F.max(F.size("q")), F.count(F.lit(1))).first()
    wide = asked.agg(F.max(F.size("q"))).first()[0]
    if top is None or wide is None:
        return spark.createDataFrame([], schema)
    top, width = float(top) * (1 + 1e-12), max(int(size), int(wide))
    sample = rows.orderBy(F.xxhash64("vec_id", "q")).limit(max(1, min(pivots, -(-n // tree)))).toArrow()
    p_y = _lift(_matrix(sample["q"], width), top)

    def nearest(x):
        d = _away(_lift(x, top), p_y)
        d = np.where(np.isnan(d), np.inf, d)
        near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
        return near, d[np.arange(len(d)), near]

    def assign(batches):
        for batch in batches:
            near, away = nearest(_matrix(batch["q"], width))
            yield pa.record_batch({"pivot": pa.array(near, pa.int32()), "away": pa.array(away, pa.float64())})

    cuts = F.percentile_approx("away", [j / RINGS for j in range(1, RINGS)], 1000)
    stats = rows.mapInArrow(assign, "pivot int, away double").groupBy("pivot").agg(F.count("*"), F.min("away"), F.max("away"), cuts).orderBy("pivot").collect()  # a row a pivot
    rings = _rings([tuple(r) for r in stats], tree)
    first = np.cumsum(rings["trees"]) - rings["trees"]
    begins = np.searchsorted(rings["pivot"], np.arange(len(p_y) + 1))

    def place(batches):
        for batch in batches:
            near, away = nearest(_matrix(batch["q"], width))
            ring = np.zeros(len(near), np.int64)
            for p in np.unique(near).tolist():
                a, b = begins[p], begins[p + 1]
                mine = near == p
                ring[mine] = a + np.minimum(np.searchsorted(rings["hi"][a:b], away[mine], "left"), b - a - 1)
            salt = (A.mix(batch["vec_id"].to_numpy().astype(np.uint64)) % rings["trees"][ring].astype(np.uint64)).astype(np.int64)
            yield pa.record_batch({"tree": pa.array(first[ring] + salt), "vec_id": batch["vec_id"], "q": batch["q"]})

    def reaches(x):
        """The best score of each query in each ring."""
        y = np.c_[x, np.zeros(len(x))]
        d = _away(y, p_y)[:, rings["pivot"]]
        return _reach((y * y).sum(1) + top, np.maximum(np.maximum(d - rings["hi"], rings["lo"] - d), 0))

    def sends(choose):
        def send(batches):
            for whole in batches:
                for a in range(0, len(whole), 256):
                    batch = whole.slice(a, 256)
                    row, to, floor = choose(batch, reaches(_matrix(batch["q"], width)))
                    out = batch.take(pa.array(row))
                    yield pa.record_batch({"tree": pa.array(to, pa.int64()), "vec_id": out["vec_id"], "of": out["of"], "q": out["q"], "floor": pa.array(floor, pa.float64())})

        return send

    def home(batch, reach):
        ring = np.argmax(np.nan_to_num(reach, nan=np.inf), axis=1)
        salt = A.mix(batch["vec_id"].to_numpy().astype(np.uint64)) % rings["trees"][ring].astype(np.uint64)
        return np.arange(len(batch)), first[ring] + salt.astype(np.int64), np.full(len(batch), -np.inf)

    def others(batch, reach):
        floor = batch["floor"].fill_null(-np.inf).to_numpy()
        i, ring = np.nonzero(~(reach < floor[:, None]))
        times = rings["trees"][ring]
        row = np.repeat(i, times)
        to = np.repeat(first[ring], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        other = to != home(batch, reach)[1][row]
        return row[other], to[other], floor[row[other]]

    def search(batches):
        at, open_tree, xs, ids, queue = None, None, [], [], []
        for batch in batches:
            trees, kind = batch["tree"].to_numpy(), batch["kind"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (trees[1:] != trees[:-1]) | (kind[1:] != kind[:-1])]) if len(batch) else []
            for a, b in zip(cut, np.r_[cut[1:], len(batch)] if len(batch) else [], strict=True):
                part = batch.slice(a, b - a)
                if trees[a] != at:
                    if queue:
                        yield _flush(queue, open_tree, top, k)
                    at, open_tree, xs, ids, queue = trees[a], None, [], [], []
                if kind[a] == 0:
                    xs.append(_matrix(part["q"], width))
                    ids.append(part["vec_id"].to_numpy())
                    continue
                if open_tree is None and xs:
                    open_tree = MTree(np.concatenate(ids), np.concatenate(xs), top)
                    xs, ids = [], []
                queue.append((part["vec_id"].to_numpy(), part["of"].to_numpy(), _matrix(part["q"], width), part["floor"].to_numpy()))
                if sum(len(x[0]) for x in queue) >= BLOCK:
                    yield _flush(queue, open_tree, top, k)
                    queue = []
        if queue:
            yield _flush(queue, open_tree, top, k)

    placed = rows.mapInArrow(place, "tree long, vec_id long, q array<double>").select("tree", F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("of"), "q", F.lit(0.0).alias("floor"))

    def found(sent):
        both = placed.unionByName(sent.withColumn("kind", F.lit(1))).repartition("tree").sortWithinPartitions("tree", "kind")
        return both.mapInArrow(search, "query_id long, of long, vec_id long, score long")

    to_trees = "tree long, vec_id long, of long, q array<double>, floor double"
    near = found(asked.mapInArrow(sends(home), to_trees))
    floors = near.groupBy("query_id", "of").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("floor"))
    known = asked.join(floors, (asked["vec_id"] == floors["query_id"]) & (asked["of"] == floors["of"]), "left").select("vec_id", asked["of"], "q", F.when(F.abs("floor") < EXACT, F.col("floor")).otherwise(F.col("floor") - 2048.0).alias("floor"))
    all_found = near.unionByName(found(known.mapInArrow(sends(others), to_trees)))
    order = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
