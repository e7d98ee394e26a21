"""Operator 13: best-fit packing of tokenised documents by a grouping genetic algorithm.

Tasks encode their documents, cut those that are too long, and deal the pieces, in the order in which they read them, into chunks of at most ``CHUNK`` pieces that don't fill a
sequence. Each chunk is a packing problem that ``ISLANDS`` islands work on, tasks of their own. An island breeds packings: crossover injects whole
well-filled bins of one parent into the other, bins that hold a document twice are dissolved, and the documents that lost their bin are put back best fit,
longest first. After each epoch every island's elite migrates to the next island of its chunk. A chunk is done when it needs no more bins than its tokens (or its
large pieces) ask for. Then the emptiest bins of every chunk are released, and what they hold is dealt into chunks again, about ``KEEP`` times fewer, level by level, until one
chunk is left: so the corpus ends with a few bins to fill, not each chunk. Chunks, populations and levels are written to the shared folder;
nothing is drawn from a clock or an order of arrival, so a lost task gives the same rows again.

Null and empty texts are the closing id alone. A text of more than ``CAPACITY`` ids is cut into pieces of that many; the first one may be shorter. Rows are documents of
their own, repeated or without doc_id too. The tokenizer's own tokens in a text are what the library makes of them. Ties take the first bin by number. An empty table
gives no rows; other columns are not read. ``sequence_id`` says the level, task, chunk and bin, and is unique.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .components import cut_lineage
from .decontaminate import pieces
from .pretokens import encoder

CAPACITY, EOS = 1024, 2
CHUNK, KEEP = 2048, 16  # pieces a chunk; one bin of so many is released
ISLANDS, EPOCHS, POPULATION, BIRTHS, PATIENCE = 3, 2, 5, 8, 5
TEXT_BYTES = 4 << 20
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
CHUNK_SCHEMA = "chunk long, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids_crc32 array<long>"
KINDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()}


def best_fit(size: np.ndarray, items: np.ndarray, bin_of: np.ndarray, room: list[int], capacity: int) -> None:
    """Puts items (places in size) into the bins that leave the least room, in the order given; opens bins where none has room. bin_of and room are changed."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b in range(len(room) - 1, -1, -1):
        by_room[room[b]].append(b)
    mask = sum(1 << r for r, bins in enumerate(by_room) if bins)
    for i, s in zip(items.tolist(), size[items].tolist(), strict=True):
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(r)
        room[b] = r = r - s
        by_room[r].append(b)
        mask |= 1 << r
        bin_of[i] = b


def bound(size: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by all tokens, or by pieces so large that no two of them share one, with what their room can't take of the others."""
    count = np.bincount(size, minlength=capacity + 1)
    at, held = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    small = np.arange(1, capacity // 2 + 1)  # pieces below it don't count; those above capacity - small stay alone
    half, half_sum = at[capacity - small] - at[capacity // 2], held[capacity - small] - held[capacity // 2]
    rest = held[capacity // 2] - held[small - 1]
    need = at[capacity] - at[capacity - small] + half + np.maximum(0, -(-(rest - (half * capacity - half_sum)) // capacity))
    return max(-(-int(size.sum()) // capacity), int(need.max(initial=0)))


def fitness(size: np.ndarray, bin_of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones: the sum of squared fills."""
    fill = np.bincount(bin_of, size)
    return -len(fill), float(np.sum((fill / capacity) ** 2))


def crossover(size: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child with well-filled bins of ``a``, the bins of ``b`` that hold none of their documents, and the others best fit."""
    fill = np.bincount(a, size)
    n = len(fill)
    share = rng.uniform(0.3, 0.8)
    full = fill >= capacity
    chance = np.where(full, share + 0.2, share * (fill / capacity) ** 8)
    given = rng.random(n) < chance
    taken = given[a]
    dissolved = np.zeros(int(b.max(initial=-1)) + 1, bool)
    dissolved[b[taken]] = True
    fills_b = np.bincount(b, size)
    dissolved |= (fills_b < capacity) & (rng.random(len(fills_b)) < 0.3)  # some that aren't full, as a mutation
    kept = ~taken & ~dissolved[b]
    child = np.full(len(size), -1, np.int64)
    child[taken] = (np.cumsum(given) - 1)[a[taken]]
    alive = np.zeros(len(dissolved), bool)
    alive[b[kept]] = True
    child[kept] = int(given.sum()) + (np.cumsum(alive) - 1)[b[kept]]
    placed = child >= 0
    room = (capacity - np.bincount(child[placed], size[placed], minlength=int(given.sum() + alive.sum()))).astype(np.int64).tolist()
    lost = np.flatnonzero(~placed)
    best_fit(size, lost[np.lexsort((rng.random(len(lost)), -size[lost]))], child, room, capacity)
    return child


def evolve(size: np.ndarray, population: list[np.ndarray], island: int, seed: int, capacity: int) -> list[np.ndarray]:
    """One epoch of an island: its packings, best first. No packings yet: it starts with best fit by falling size, and others from disturbed orders."""
    rng = np.random.default_rng([seed & 0x7FFFFFFF, seed >> 31 & 0x7FFFFFFF, island, len(population)])
    least = bound(size, capacity)
    score = lambda x: fitness(size, x, capacity)
    if not population:
        for k in range(POPULATION):
            noise = 0.0 if k == 0 else 0.1 * (k + island)
            order = np.lexsort((rng.random(len(size)) if island else np.zeros(len(size)), -size * (1 + noise * rng.random(len(size)))))
            bin_of, room = np.full(len(size), -1, np.int64), []
            best_fit(size, order, bin_of, room, capacity)
            population.append(bin_of)
            if len(room) <= least:
                return [bin_of]
    ranked = sorted(((score(x), k, x) for k, x in enumerate(population)), key=lambda y: (y[0], -y[1]), reverse=True)[:POPULATION]
    idle = born = 0
    while born < BIRTHS and idle < PATIENCE and -ranked[0][0][0] > least and len(ranked) > 1:
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(size, ranked[min(i, j)][2], ranked[max(i, j)][2], capacity, rng)
        s = score(child)
        born += 1
        idle = 0 if s > ranked[0][0] else idle + 1
        if s > ranked[-1][0] and all(s != r[0] for r in ranked):
            ranked[-1] = (s, POPULATION + born, child)
            ranked.sort(key=lambda y: (y[0], -y[1]), reverse=True)
    return [x for _, _, x in ranked]


def _cut(ends: np.ndarray, ids: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """The pieces of documents with ids[ends[k]:ends[k + 1]]: document, number, start, length, checksum."""
    n = np.diff(ends)
    k = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), k)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    first = n - (k - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[doc], capacity)
    raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
    at = (ends[doc] + start) * 4
    return doc, piece, start, length, np.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)], np.int64)


def _deal(tables, capacity: int, chunk: int):
    """Tables of pieces as rows of ``CHUNK_SCHEMA``: a new chunk begins after ``chunk`` pieces that don't fill a sequence, or eight times as many of all."""
    number = TaskContext.get().partitionId() << 18
    held: list[pa.Table] = []
    small = rows = 0

    def row():
        nonlocal number, held, small, rows
        t = pa.concat_tables(held).combine_chunks()
        out = pa.record_batch([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks() if not isinstance(t[c].combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(t[c].chunks)) for c in KINDS)], ["chunk", *KINDS])
        number, held, small, rows = number + 1, [], 0, 0
        return out

    for t in tables:
        light = np.cumsum(t["length"].to_numpy() < capacity)
        at = 0
        while at < len(t):
            done = int(light[at - 1]) if at else 0
            to = min(int(np.searchsorted(light, done + chunk - small, "left")) + 1, at + 8 * chunk - rows, len(t))
            held.append(t.slice(at, to - at))
            small, rows, at = small + int(light[to - 1]) - done, rows + to - at, to
            if small >= chunk or rows >= 8 * chunk:
                yield row()
    if held:
        yield row()


def _encoded(docs: DataFrame, path: str, eos: int, capacity: int, chunk: int) -> DataFrame:
    def run(batches):
        e = encoder(path, eos)

        def tables():
            for piece in pieces(batches, "text", TEXT_BYTES):
                A.frugal()
                ids, ends = e.encode(piece["text"])
                doc, *rest = _cut(ends, ids, capacity)
                yield pa.table([piece["doc_id"].take(pa.array(doc)), *(pa.array(v, t) for v, t in zip(rest, list(KINDS.values())[1:], strict=True))], list(KINDS))

        yield from _deal(tables(), capacity, chunk)

    return docs.mapInArrow(run, CHUNK_SCHEMA)


STATE = "chunk long, island int, length array<int>, bins int, least int, fill double, packings array<binary>"


def _epoch(state: DataFrame, capacity: int) -> DataFrame:
    """An epoch on every island: chunk, island, length, packings (best first, may be empty) and elite, a packing from another island, or null."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                size = np.array(r["length"], np.int64)
                size = size[size < capacity]
                packings = [np.frombuffer(x, np.int16).astype(np.int64) for x in r["packings"]]
                if r["elite"] is not None:
                    packings = [*packings[: POPULATION - 1], np.frombuffer(r["elite"], np.int16).astype(np.int64)]
                packings = evolve(size, packings, r["island"], r["chunk"], capacity)
                n, fill = fitness(size, packings[0], capacity)
                out.append({"chunk": r["chunk"], "island": r["island"], "length": r["length"], "bins": -n, "least": bound(size, capacity), "fill": fill, "packings": [x.astype(np.int16).tobytes() for x in packings]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("island", pa.int32()), ("length", pa.list_(pa.int32())), ("bins", pa.int32()), ("least", pa.int32()), ("fill", pa.float64()), ("packings", pa.list_(pa.binary()))]))

    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by a count: breeding is worth more tasks than its bytes
    return state.repartition(parts, "chunk", "island").mapInArrow(run, STATE)


def _packings(chunks: DataFrame, capacity: int) -> DataFrame:
    """chunk, packing: the best of all islands."""
    start = chunks.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "length", F.array().cast("array<binary>").alias("packings"), F.lit(None).cast("binary").alias("elite"))
    state = cut_lineage(_epoch(start, capacity))
    known = state
    for _ in range(EPOCHS - 1):
        undone = state.groupBy("chunk").agg(F.min("bins").alias("b"), F.max("least").alias("l")).where("b > l").select("chunk")
        live = state.join(undone, "chunk", "left_semi")
        came = live.select("chunk", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("packings")[0].alias("elite"))
        state = cut_lineage(_epoch(live.join(came, ["chunk", "island"]).select("chunk", "island", "length", "packings", "elite"), capacity))
        known = known.unionByName(state)
    return known.groupBy("chunk").agg(F.min_by(F.col("packings")[0], F.struct("bins", -F.col("fill"), "island")).alias("packing"))


def _settle(chunks: DataFrame, packings: DataFrame, level: int, last: bool, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset; both null in the emptiest bins of each chunk, unless this level is the last."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                number = batch["chunk"][k].as_py()
                columns = {c: batch[c][k].values for c in KINDS}
                length = columns["length"].to_numpy(zero_copy_only=False).astype(np.int64)
                small = length < capacity
                bin_of = np.zeros(len(length), np.int64)
                bin_of[small] = np.frombuffer(batch["packing"][k].as_py(), np.int16)
                used = int(bin_of[small].max(initial=-1)) + 1
                bin_of[~small] = used + np.arange(int((~small).sum()))
                fill = np.bincount(bin_of, length)
                freed = np.zeros(len(fill), bool)
                if not last:
                    order = np.argsort(fill, kind="stable")[: max(1, used // KEEP)]
                    freed[order[fill[order] < capacity]] = True
                order = np.argsort(bin_of, kind="stable")
                done = np.cumsum(length[order]) - length[order]
                begins = np.cumsum(fill).astype(np.int64) - fill.astype(np.int64)
                offset = np.empty(len(length), np.int64)
                offset[order] = done - begins[bin_of[order]]
                out = freed[bin_of]
                yield pa.record_batch([*columns.values(), pa.array((level << 57) + (number << 15) + bin_of, pa.int64(), mask=out), pa.array(offset, pa.int64(), mask=out)], [*KINDS, "sequence_id", "offset"])

    return chunks.join(packings, "chunk").mapInArrow(run, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece. path: a tokenizer file; chunk: below 32,768. It runs jobs at once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = cut_lineage(_encoded(docs, path, eos, capacity, chunk))
    levels = max(1, math.ceil(math.log(max(chunks.count(), 1), KEEP)) + 1)
    out = None
    for level in range(levels):
        last = level == levels - 1
        put = cut_lineage(_settle(chunks, _packings(chunks, capacity), level, last, capacity))
        stay = put.where(F.col("sequence_id").isNotNull())
        out = stay if out is None else out.unionByName(stay)
        rest = put.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
        n = 0 if last else rest.count()
        if not n:
            break
        chunks = cut_lineage(rest.repartition(-(-n // chunk)).mapInArrow(lambda batches: _deal((pa.Table.from_batches([b]) for b in batches), capacity, chunk), CHUNK_SCHEMA))
    return out


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
