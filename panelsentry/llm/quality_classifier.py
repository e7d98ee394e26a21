"""Operator 7: quality by co-training on two views, text content and page metadata.

Each view has a logistic model with class-ratio weights for each head (quality, toxic). It starts from at most ``LABELLED`` labelled documents, picked by
hash order; over ``ROUNDS`` rounds each view judges every unlabelled document and hands the ``EACH`` of each class that it is surest of to the
other view's training set. A fifth of the labelled documents is held out to calibrate each view; calibrated evidence of both views is added up.
Documents are scored where they lie; only the fixed-size weights are broadcast, and what the driver learns from is bounded by rows and by ``WIDTH`` features a
row. Content features are the words of the whole text, their first letters, and its style (shares of capitals and signs, word length, variety).

A document goes if its toxicity is above one half or its quality below. Null and empty texts have no words and are scored by style and
metadata alone; null metadata is a value of its own. Labels that are null, or without a document, don't count; several labels of one
document train once each. With fewer than two classes of a head that head says nothing; without labels everything stays. Repeated rows
score alike; extra columns are kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import cut_lineage
from .decontaminate import LOWER, WORD, pieces

LABELLED, ROUNDS, EACH, SURE = 12_000, 2, 300, 0.97
WIDTH, META_WIDTH, STEPS = 1 << 18, 1 << 12, 150
HEADS = ("quality", "toxic")
META = ("lang", "source", "n_chars")
U64 = np.uint64


@dataclass
class Rows:
    """Sparse rows of feature numbers: features on end, and the n + 1 offsets."""

    feature: np.ndarray
    off: np.ndarray

    def take(self, rows: np.ndarray) -> "Rows":
        size = np.diff(self.off)[rows]
        return Rows(A.gather(self.feature, self.off[:-1][rows], size), np.r_[0, np.cumsum(size)])

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1, dtype=np.int32), np.diff(self.off))


def _sums(at: np.ndarray, weight: np.ndarray | None, size: int, of: np.ndarray | None = None) -> np.ndarray:
    """Sums of weights (ones; or weight[of]) by place, some at a time, so that no wide copy of all is made."""
    out = np.zeros(size)
    for a in range(0, len(at), 1 << 18):
        some = slice(a, a + (1 << 18))
        out += np.bincount(at[some], weights=None if weight is None else weight[some] if of is None else weight[of[some]], minlength=size)
    return out


def _distinct(doc: np.ndarray, feature: np.ndarray, n: int) -> Rows:
    both = np.unique((doc.astype(np.int64) << 32) | feature.astype(np.int64))
    return Rows((both & 0xFFFFFFFF).astype(np.int32), np.searchsorted(both >> 32, np.arange(n + 1)))


def content_features(column, active: np.ndarray | None = None) -> Rows:
    """Distinct features of each text; with ``active``, only those that a model uses."""
    raw, off = A.flat(column)
    n = len(off) - 1
    buf = LOWER[raw]
    start, end, at = A.words_of(buf, off, WORD)
    doc = np.repeat(np.arange(n), np.diff(at))
    size = end - start
    out_doc, out = [], []

    def put(d, h):
        f = (h >> U64(64 - 18)).astype(np.int64)
        if active is not None:
            on = active[f]
            d, f = d[on], f[on]
        out_doc.append(d)
        out.append(f)

    words_h = A.span_hashes(buf, start, end)
    put(doc, words_h)
    for k in (4, 5, 6):
        some = size > k
        put(doc[some], A.mix(A.span_hashes(buf, start[some], start[some] + k) + U64(k)))
    is_sign = (np.arange(256) > 32) & (np.arange(256) < 127) & ~WORD & ~((np.arange(256) >= 65) & (np.arange(256) <= 90))
    s_start, s_end, s_at = A.words_of(raw, off, is_sign)
    put(np.repeat(np.arange(n), np.diff(s_at)), A.mix(A.span_hashes(raw, s_start, s_end) + U64(99)))
    # style: shares and means in coarse steps, a feature a step
    length = np.maximum(np.diff(off), 1)
    words = np.maximum(np.diff(at), 1)

    def per_text(mask):
        c = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return c[off[1:]] - c[off[:-1]]

    steps = [
        np.minimum(per_text((raw >= 65) & (raw <= 90)) * 40 // length, 40),
        np.minimum(per_text(is_sign[raw]) * 40 // length, 40),
        np.minimum(np.bincount(doc, weights=size, minlength=n).astype(np.int64) * 2 // words, 40),
        np.minimum(np.log2(words * 1.0).astype(np.int64) * 2, 40),
    ]
    same = np.r_[False, (words_h[1:] == words_h[:-1]) & (doc[1:] == doc[:-1])] if len(doc) else np.zeros(0, bool)
    steps.append(np.bincount(doc, weights=same, minlength=n).astype(np.int64) * 20 // words)
    for k, s in enumerate(steps):
        put(np.arange(n), A.mix(A.mix(s.astype(U64) + U64(1000 * (k + 1)))))
    return _distinct(np.concatenate(out_doc), np.concatenate(out), n)


def meta_features(table, columns=META) -> Rows:
    n = len(table)
    out_doc, out = [], []
    for k, c in enumerate(columns):
        column = table[c]
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            v = np.nan_to_num(column.cast(pa.float64()).to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.cast(pa.float64()).to_numpy(), nan=-1.0)
            h = np.where(v < 0, 99, np.log2(np.maximum(v, 0) + 1)).astype(np.int64).astype(U64)
        else:
            buf, off = A.flat(column.cast(pa.string()))
            h = A.span_hashes(buf, off[:-1], off[1:])
        out_doc.append(np.arange(n))
        out.append((A.mix(h + U64(7919 * (k + 1))) >> U64(64 - 12)).astype(np.int64))
    return _distinct(np.concatenate(out_doc), np.concatenate(out), n) if out else Rows(np.zeros(0, np.int32), np.zeros(n + 1, np.int64))


class View:
    """A logistic model over presence features, scaled by their class ratio, with a calibrated margin."""

    def __init__(self, width: int, least: int, ratio: float, sure: float = 0.0) -> None:
        self.width, self.least, self.ratio, self.sure = width, least, ratio, sure
        self.weight, self.bias, self.slope, self.shift = np.zeros(width), 0.0, 0.0, 0.0

    def fit(self, rows: Rows, y: np.ndarray, steps: int = STEPS) -> None:
        owner, f = rows.owner, rows.feature
        seen = _sums(f, None, self.width)
        hits = _sums(f, y, self.width, owner)
        yes, no = max(y.sum(), 1), max((1 - y).sum(), 1)
        r = np.log((hits + 0.5) / (yes + 1)) - np.log((seen - hits + 0.5) / (no + 1))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        sure = np.abs(hits - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
        r[(seen < self.least) | (np.abs(r) < self.ratio) | (sure < self.sure)] = 0  # rare features that side with a class by chance
        on = r[f] != 0
        owner, f = owner[on], f[on]
        ids = np.flatnonzero(_sums(f, None, self.width))
        place = np.zeros(self.width, np.int32)
        place[ids] = np.arange(len(ids))
        code, scale = place[f], r[ids]
        w, b, g2, gb = np.full(len(ids), 0.3), float(np.log(yes / no)), np.full(len(ids), 1e-6), 1e-6
        n = len(y)
        code, owner = code.astype(np.int64), owner.astype(np.int64)
        has, first = np.unique(owner, return_index=True)  # rows in order; features in order by a permutation
        order = np.argsort(code, kind="stable")
        by_code, begin = owner[order], np.searchsorted(code[order], np.arange(len(ids)))
        for _ in range(steps if len(ids) else 0):
            z = np.full(n, b)
            z[has] += np.add.reduceat((w * scale)[code], first)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.add.reduceat(e[by_code], begin) * scale + 1e-5 * w
            g2 += g * g
            w -= 0.15 * g / np.sqrt(g2)
            gb += e.sum() ** 2
            b -= 0.3 * e.sum() / np.sqrt(gb)
        self.weight = np.zeros(self.width)
        self.weight[ids], self.bias = w * scale, b

    def margin(self, rows: Rows) -> np.ndarray:
        return self.bias + _sums(rows.owner, self.weight, len(rows.off) - 1, rows.feature)

    def calibrate(self, rows: Rows, y: np.ndarray) -> None:
        """Platt scaling, with the targets drawn in from 0 and 1."""
        z = self.margin(rows)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b, damp = 0.1, 0.0, 1e-3

        def loss(a, b):
            x = a * z + b
            return (np.logaddexp(0, x) - target * x).sum() + 5e-4 * a * a

        for _ in range(60):  # Newton steps, damped until the loss falls
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
            v = p * (1 - p)
            h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h + damp * np.diag(np.diag(h)), g)
            if loss(a - step[0], b - step[1]) < loss(a, b):
                a, b, damp = a - float(step[0]), b - float(step[1]), damp / 3
            else:
                damp *= 10
        self.slope, self.shift = max(a, 0.0), b

    def evidence(self, rows: Rows) -> np.ndarray:
        return np.clip(self.slope * self.margin(rows) + self.shift, -12, 12)


@dataclass
class Head:
    views: tuple[View, View]
    prior: float

    def logit(self, content: Rows, meta: Rows) -> np.ndarray:
        return self.views[0].evidence(content) + self.views[1].evidence(meta) - self.prior


def joined(parts: list[Rows]) -> Rows:
    size = np.concatenate([np.diff(r.off) for r in parts])
    return Rows(np.concatenate([r.feature for r in parts]), np.r_[0, np.cumsum(size)])


class Learner:
    """One head: labelled rows of both views, some held out for calibration, and what each view was told by the other one."""

    def __init__(self, rows: tuple[Rows, Rows], y: np.ndarray, held: np.ndarray) -> None:
        known = y >= 0
        check = held & known
        if len(set(y[check].tolist())) < 2 or len(set(y[known & ~held].tolist())) < 2:
            check, held = known, np.zeros(len(y), bool)
        self.rows, self.learn, self.check = rows, np.flatnonzero(known & ~held), np.flatnonzero(check)
        self.y, self.truth = y[self.learn].astype(np.float64), y[self.check].astype(np.float64)
        self.told: list[dict[tuple[int, int], tuple[np.ndarray, int]]] = [{}, {}]
        share = y[known].mean()
        self.head = Head((View(WIDTH, 3, 1.0, 5.0), View(META_WIDTH, 20, 0.2, 3.0)), float(np.log(share / (1 - share))))

    def fit(self) -> None:
        for v, view in enumerate(self.head.views):
            told = list(self.told[v].values())
            feature, size = [f for f, _ in told], [len(f) for f, _ in told]
            more = Rows(np.concatenate([np.zeros(0, np.int32), *feature]), np.r_[0, np.cumsum(size, dtype=np.int64)])
            view.fit(joined([self.rows[v].take(self.learn), more]), np.r_[self.y, [float(k) for _, k in told]])
            view.calibrate(self.rows[v].take(self.check), self.truth)
            A.frugal()


def _features(batches, id_col: str, text_col: str, own: list[str], keep: list[str]):
    """Both views' features of each row, with its id and other columns."""
    for batch in pieces(batches, text_col):
        c, m = content_features(batch[text_col]), meta_features(batch, own)
        lists = [pa.ListArray.from_arrays(pa.array(r.off, pa.int32()), pa.array(r.feature, pa.int32())) for r in (c, m)]
        yield pa.record_batch([batch[id_col].cast(pa.int64()), *lists, *(batch[k] for k in keep)], ["id", "content", "meta", *keep])


def _rows(table: pa.Table, name: str) -> Rows:
    column = table[name].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return Rows(column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64) - int(column.offsets[0].as_py() if len(column) else 0))


def pseudo_labels(docs: DataFrame, marked: DataFrame, heads: dict[str, Head | None], most: int, id_col: str, text_col: str, meta) -> list[tuple]:
    """What each view is surest of among all unlabelled documents: head, view, label, (id, digest), features of both views; at most ``most`` of each kind.

    Every document is scored by each view where it lies; small rows of evidence leave out the labelled ones, and the surest of each kind are looked up again."""
    live = [(h, v) for h, x in heads.items() if x is not None for v in (0, 1)]
    names = [f"{h}_{v}" for h, v in live]

    def finish(batch, evidence):
        return pa.record_batch([batch[id_col].cast(pa.int64()), batch["digest__"], *(pa.array(evidence[h][v]) for h, v in live)], ["id", "digest", *names])

    own = [c for c in meta if c in docs.columns]
    read = docs.select(F.col(id_col), F.col(text_col), *own, F.xxhash64(text_col).alias("digest__"))
    scored = _score(read, heads, finish, "id long, digest long, " + ", ".join(f"{n} double" for n in names), text_col, meta, raw=True)
    pool = cut_lineage(scored.join(marked.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_anti"))
    kinds = [(h, v, y, F.col(f"{h}_{v}") if y else -F.col(f"{h}_{v}")) for h, v in live for y in (0, 1)]
    tops = [pool.where(sure > float(np.log(SURE / (1 - SURE)))).orderBy(F.desc(sure), F.xxhash64("id", "digest")).limit(most).select(F.lit(k).alias("kind"), "id", "digest", sure.alias("sure")) for k, (_, _, _, sure) in enumerate(kinds)]
    picked = reduce(DataFrame.unionByName, tops).toArrow().to_pylist()  # at most 8 times ``most`` small rows
    if not picked:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted({(r["id"], r["digest"]) for r in picked}, key=str), "id__ long, digest__ long")
    hits = read.join(F.broadcast(wanted), F.col(id_col).cast("long").eqNullSafe(F.col("id__")) & (read["digest__"] == wanted["digest__"])).select(id_col, text_col, *own, read["digest__"].alias("digest"))
    got = hits.mapInArrow(lambda b: _features(b, id_col, text_col, own, ["digest"]), "id long, content array<int>, meta array<int>, digest long").dropDuplicates(["id", "digest"]).toArrow()
    views = _rows(got, "content"), _rows(got, "meta")
    at = {k: i for i, k in enumerate(zip(got["id"].to_pylist(), got["digest"].to_pylist(), strict=True))}
    out = []
    for r in sorted(picked, key=lambda r: (r["kind"], -r["sure"], r["id"] is None, r["id"] or 0, r["digest"])):
        h, v, y, _ = kinds[r["kind"]]
        i = at[r["id"], r["digest"]]
        out.append((h, v, y, (r["id"], r["digest"]), tuple(x.feature[x.off[i] : x.off[i + 1]] for x in views)))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta=META, labelled: int = LABELLED, each: int = EACH, rounds: int = ROUNDS) -> dict[str, Head | None]:
    """A head for each column of ``HEADS``: from at most ``labelled`` labelled rows, and over ``rounds`` rounds from the ``each`` documents of the whole unlabelled corpus
    that the other view is surest of, by class."""
    marks = labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    some = marks.select(F.col(id_col).alias("__id"), *(F.coalesce(F.col(h), F.lit(-1)).cast("long").alias(h) for h in HEADS)).orderBy(F.xxhash64("__id", F.lit(11))).limit(labelled)
    own = [c for c in meta if c in docs.columns and c not in HEADS]
    # at most ``labelled`` rows, so broadcasting them is safe; an id may hold many rows, so what comes back is bounded again
    read = docs.select(id_col, text_col, *own).join(F.broadcast(some), F.col(id_col) == F.col("__id")).drop("__id")
    whole = read.mapInArrow(lambda b: _features(b, id_col, text_col, own, list(HEADS)), "id long, content array<int>, meta array<int>, quality long, toxic long")
    got = whole.orderBy(F.xxhash64("id", F.lit(11)), F.xxhash64("content", *HEADS)).limit(labelled).toArrow()
    rows = _rows(got, "content"), _rows(got, "meta")
    got = got.drop_columns(["content", "meta"])
    held = A.mix(got["id"].to_numpy().astype(U64)) % U64(5) == 0 if got.num_rows else np.zeros(0, bool)
    learners: dict[str, Learner | None] = {}
    for h in HEADS:
        y = got[h].to_numpy() if got.num_rows else np.zeros(0, np.int64)
        learners[h] = Learner(rows, y, held) if len(set(y[y >= 0].tolist())) > 1 else None
    heads = {h: None if x is None else x.head for h, x in learners.items()}
    for k in range(rounds + 1):
        for x in learners.values():
            if x is not None:
                x.fit()
        if k == rounds or not any(heads.values()):
            return heads
        new = {(h, v, y): 0 for h in HEADS for v in (0, 1) for y in (0, 1)}
        for h, v, y, key, views in pseudo_labels(docs, marks, heads, each * (k + 1), id_col, text_col, meta):
            told = learners[h].told[1 - v]  # the other view learns it, unless it was told so before
            if key not in told and new[h, v, y] < each:
                told[key] = views[1 - v], y
                new[h, v, y] += 1


def score_documents(docs: DataFrame, heads: dict[str, Head | None], id_col: str = "doc_id", text_col: str = "text", meta=META) -> DataFrame:
    """All columns of docs with p_quality, p_toxic, score (their product of good) and keep; columns of those names are replaced."""
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    docs = docs.drop("p_quality", "p_toxic", "score", "keep")
    names = docs.columns
    schema = StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in ("p_quality", "p_toxic", "score")), StructField("keep", BooleanType())])

    def finish(batch, good, bad, keep):
        return pa.record_batch([*(batch[c] for c in names), pa.array(good), pa.array(bad), pa.array(good * (1 - bad)), pa.array(keep)], [*names, "p_quality", "p_toxic", "score", "keep"])

    return _score(docs, heads, finish, schema, text_col, meta)


def _score(docs: DataFrame, heads: dict[str, Head | None], finish, schema, text_col: str, meta, raw: bool = False) -> DataFrame:
    """finish(batch, quality, toxicity, keep) for all documents; if ``raw``, finish(batch, evidence of each head's views)."""
    own = [c for c in meta if c in docs.columns]
    flat = lambda v: (v.weight.astype(np.float32), v.bias, v.slope, v.shift)
    light = {h: None if x is None else (*flat(x.views[0]), *flat(x.views[1]), x.prior) for h, x in heads.items()}
    sent = docs.sparkSession.sparkContext.broadcast(light)  # fixed size: a weight a feature number

    def score(batches):
        ready: dict[str, Head | None] = {}
        active = np.zeros(WIDTH, bool)
        for h, x in sent.value.items():
            ready[h] = None
            if x is not None:
                a, b = View(WIDTH, 0, 0), View(META_WIDTH, 0, 0)
                a.weight, a.bias, a.slope, a.shift, b.weight, b.bias, b.slope, b.shift, prior = x
                ready[h] = Head((a, b), prior)
                active |= a.weight != 0
        for batch in pieces(batches, text_col):
            content, m = content_features(batch[text_col], active), meta_features(batch, own)
            if raw:
                yield finish(batch, {h: (x.views[0].evidence(content), x.views[1].evidence(m)) for h, x in ready.items() if x is not None})
                continue
            p = {h: np.full(len(batch), 1.0 if h == "quality" else 0.0) if x is None else 1 / (1 + np.exp(-np.clip(x.logit(content, m), -30, 30))) for h, x in ready.items()}
            yield finish(batch, p["quality"], p["toxic"], (p["quality"] >= 0.5) & (p["toxic"] <= 0.5))

    return docs.mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return _score(docs, train(docs, labels), lambda batch, good, bad, keep: batch.filter(pa.array(keep)), docs.schema, "text", META)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs.select("doc_id", "text", *META), train(docs, labels)).select("doc_id", "p_quality", "p_toxic", "score", "keep")
