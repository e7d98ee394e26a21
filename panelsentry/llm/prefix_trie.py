"""Operator 12: prefix trie of conversations by hashes of blocks of turns.

Turns stream through tasks in the order of their conversation. Every ``BLOCK`` turns in a row give one row: the digest of all before, the digest that it ends with,
and its turns' digests and sizes; texts go no further. Conversations are grouped by these digests, block after block. Where all members of a prefix go on
with one and the same block, the nodes inside it have the same members, so they are read off one row. Only where siblings diverge are the distinct blocks
(not the conversations) cut at turns, and equal prefixes of turns are added up.

Sums over subtrees need no walk up the tree: a node belongs to its smallest member, so each conversation owns a tail of its own path. What a subtree sums is then
what its members own altogether, less what the node's smallest member owns above it: a sum by node, and a running sum along the path of
one conversation, taken in stretches of ``STRETCH`` turns and then over stretches.

Turns are ordered by turn (null first), then role and text; null role or text is empty. Rows without conv_id take no part. Repeated rows are turns of their own. A
conversation without turns is a member of the root alone. An empty table has no nodes, not even the root. Texts of any length are read one batch at a time; other
columns are not read. A node's ``ends_sha256`` is one running hash by contract, so the ids that end at one node are streamed by one task, in order.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import cut_lineage

BLOCK, STRETCH, ROWS = 4, 1024, 8192
FAMILY, HEAD = 5, 9  # of the rebuilding that the query asks for
ROOT = b"\0" * 16
SIZES = [f"size_{j}" for j in range(1, BLOCK + 1)]
BLOCK_SCHEMA = "conv_id long, k int, before binary, block binary, turns binary, " + ", ".join(f"{s} long" for s in SIZES) + ", ends boolean"


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def own_turns(rows):
    """Rows (group, conv_id, role, text) in order as turns: conv_id, and role and text; the layout of plain conversations."""
    for _, conv, role, text in rows:
        yield conv, (role, text)


def rebuilt_turns(rows):
    """The turns of rebuilt conversations from rows in order of family, its base conversation first: the base's first turns, then the own ones after as
    many. A conversation without turns gives (conv_id, None)."""
    family = conv = None
    head: list = []
    h = i = given = 0
    for group, c, role, text in rows:
        if c != conv:
            if conv is not None and not given:
                yield conv, None
            if group != family:
                family, head = group, []
            conv, i, h = c, 0, crc32(str(c).encode()) % HEAD
            first = [] if c == group else head[:h]
            given = len(first)
            for turn in first:
                yield c, turn
        if c == family:
            if i < HEAD - 1:
                head.append((role, text))
        if c == family or i >= h:
            given += 1
            yield c, (role, text)
        i += 1
    if conv is not None and not given:
        yield conv, None


def _blocks(turns):
    """Rows of ``BLOCK_SCHEMA`` from turns in order of conversation."""
    conv, before, digests, sizes, k, last = None, ROOT, [], [], 0, None

    def close(ends):
        data = b"".join(digests)
        return [conv, k, before, _digest(before + data) if digests else before, data, *sizes, *[None] * (BLOCK - len(sizes)), ends]

    for c, turn in turns:
        if c != conv:
            if conv is not None:
                yield close(True)
            conv, before, digests, sizes, k = c, ROOT, [], [], 0
        elif len(digests) == BLOCK:
            row = close(False)
            yield row
            before, digests, sizes, k = row[3], [], [], k + 1
        if turn is not None:
            role, text = turn
            digests.append(_digest(len(role).to_bytes(8, "little") + role + text))
            sizes.append(len(text))
    if conv is not None:
        yield close(True)


def block_rows(turns: DataFrame, layout) -> DataFrame:
    """A row for each conversation and block. turns: grp, conv_id, role, text (binary), sorted within partitions and whole by grp; layout: rows to turns."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]] for c in BLOCK_SCHEMA.split(", ")]

    def run(batches):
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("grp", "conv_id", "role", "text")), strict=True))
        some = []
        for row in _blocks(layout(rows)):
            some.append(row)
            if len(some) == ROWS:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*some, strict=True), types, strict=True)], names)
                some = []
        if some:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*some, strict=True), types, strict=True)], names)

    return turns.mapInArrow(run, BLOCK_SCHEMA)


def in_order(conversations: DataFrame, group) -> DataFrame:
    """The turns of each group in one place and in order, the group's own conversation first."""
    t = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("role", "text")))
    t = t.withColumn("grp", group)
    return t.repartition("grp").sortWithinPartitions("grp", F.col("conv_id") != F.col("grp"), "conv_id", F.asc_nulls_first("turn"), "role", "text").select("grp", "conv_id", "role", "text")


def _prefix(j) -> F.Column:
    """The digest at the j-th turn of a block."""
    whole = F.sha2(F.concat("before", F.substring("turns", F.lit(1), j * 16)), 256)
    return F.when(j == 0, F.col("before")).otherwise(F.substring(F.unhex(whole), F.lit(1), F.lit(16)))


def _nodes(blocks: DataFrame, sums: dict[str, str]) -> DataFrame:
    """id, parent, depth, size and the sums of each node. blocks: distinct blocks with their sums and ``kids``, how many blocks follow what is before; sums: how
    each column is put together (sum or min)."""
    put = [getattr(F, how)(c).alias(c) for c, how in sums.items()]
    root = blocks.where("k = 0").groupBy(F.col("before").alias("id")).agg(*put).select("id", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), *sums)
    m = (F.octet_length("turns") / 16).cast("int")
    cut = blocks.where(F.octet_length("turns") > 0).select("*", F.explode(F.sequence(F.lit(1), m)).alias("j"))
    cut = cut.select(_prefix(F.col("j")).alias("id"), _prefix(F.col("j") - 1).alias("parent"), (F.col("k").cast("long") * BLOCK + F.col("j")).alias("depth"), F.element_at(F.array(*SIZES), F.col("j")).alias("size"), "kids", *sums)
    lone = cut.where("kids = 1").drop("kids")  # one block for all: its nodes have its members
    split = cut.where("kids > 1").groupBy("id", "parent", "depth", "size").agg(*put)
    return root.unionByName(lone.select(*root.columns)).unionByName(split.select(*root.columns))


def _ends(blocks: DataFrame) -> DataFrame:
    """id, ends_sha256: a running hash of the ids that end at a node, in order; no node's ids are held at once."""

    def run(batches):
        node, h, out = None, None, []
        for b in batches:
            for i, c in zip(b["id"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if i != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h = i, hashlib.sha256(b"%d" % c)
                else:
                    h.update(b",%d" % c)
            if len(out) >= ROWS:
                yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in ((0, pa.binary()), (1, pa.string()))], ["id", "ends_sha256"])
                out = []
        if node is not None:
            out.append((node, h.hexdigest()))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in ((0, pa.binary()), (1, pa.string()))], ["id", "ends_sha256"])

    ends = blocks.where("ends").select(F.col("block").alias("id"), "conv_id")
    return ends.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(run, "id binary, ends_sha256 string")


def trie(each: DataFrame) -> DataFrame:
    """The nodes of the rows of ``block_rows``, as ``prefix_trie`` returns them. Blocks are written to the shared folder, which runs jobs at once."""
    each = cut_lineage(each)
    keys = ["k", "before", "block", "turns", *SIZES]
    distinct = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    kids = distinct.where(F.octet_length("turns") > 0).groupBy("before").agg(F.count(F.lit(1)).alias("kids"))
    blocks = cut_lineage(distinct.join(kids, "before", "left"))
    members = {"n_convs": "sum", "conv_id": "min"}
    nodes = cut_lineage(_nodes(blocks, members).withColumn("own", (F.col("n_convs") - 1) * F.col("size")))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "id", "left").na.fill(0, ["n_children"])
    # what each conversation owns: nodes of which it is the smallest member; at most one of them is a leaf
    owned = nodes.groupBy("conv_id").agg(F.sum("own").alias("own"), F.count_if(F.col("n_children") == 0).alias("n_leaves")).where("own > 0 or n_leaves > 0")
    below = each.join(owned, "conv_id").groupBy("block").agg(F.sum("own").alias("own"), F.sum("n_leaves").alias("n_leaves"))
    sums = _nodes(blocks.drop("n_convs", "conv_id").join(below, "block", "left").na.fill(0, ["own", "n_leaves"]), {"own": "sum", "n_leaves": "sum"}).select("id", F.col("own").alias("of_members"), "n_leaves")
    # and what it owns above a node: whole stretches before, then the nodes before in the same stretch
    part = F.floor(F.col("depth") / STRETCH).alias("part")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = nodes.groupBy("conv_id", part).agg(F.sum("own").alias("own")).select("conv_id", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("far"))
    near = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.select("*", part).withColumn("near", F.coalesce(F.sum("own").over(near), F.lit(0))).join(stretches, ["conv_id", "part"])
    nodes = nodes.join(sums, "id").join(_ends(each), "id", "left")
    up = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(up, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("of_members") - F.col("far") - F.col("near")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of turns: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of
    text that members share, over the subtree) and ends_sha256 (of the ids that end there). conversations: conv_id, turn, role, text."""
    return trie(block_rows(in_order(conversations, F.col("conv_id")), own_turns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(block_rows(in_order(conversations, F.col("conv_id") - F.col("conv_id") % FAMILY), rebuilt_turns))


# the checksum of the id's digits, a bit at a time
_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295), 4294967295)"
OP12_SQL = f"""
WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM c)),
b AS (SELECT h.conv_id, 0 AS own, i, role, text FROM h JOIN c ON c.conv_id = h.base AND i < h UNION ALL SELECT c.conv_id, 1, i, role, text FROM h JOIN c ON c.conv_id = h.conv_id AND i >= h),
t AS (SELECT conv_id AS c, row_number() OVER w AS d, md5(octet_length(encode(role)) || ':' || role || text) AS m, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
p AS (SELECT c, d, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k, size FROM t UNION ALL SELECT conv_id, 0, 'root', 0 FROM h),
n AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY k, d),
u AS (SELECT n.*, p.k AS up FROM n LEFT JOIN p ON p.c = n.c AND p.d = n.d - 1),
a AS (SELECT up AS k, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT p.k, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * n.size) AS BIGINT) AS saved_tokens FROM n LEFT JOIN a USING (k) JOIN p ON p.c = n.c AND p.d <= n.d GROUP BY p.k),
e AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY k)
SELECT u.c AS conv_id, CAST(u.d AS BIGINT) AS depth, o.c AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u LEFT JOIN a ON a.k = u.k JOIN s ON s.k = u.k LEFT JOIN e ON e.k = u.k LEFT JOIN n o ON o.k = u.up"""
