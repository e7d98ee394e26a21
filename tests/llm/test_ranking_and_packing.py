"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = "the of and in to is at on it was for be an by or ser tion ing ble her".split()
DOCS = "doc_id long, text string, rank int, score long, item_id string, chunk long, length int"
ITEMS = "item_id long, text string, doc_id long"
TURNS = "conv_id long, turn long, role string, text string, depth int, k int, grp string"


def save(path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def corpus(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "X"]) for _ in range(n))
    texts = [None, "", " ,;: ", "The", "the THE the", "Été 日本 x9 the", say(5000), "the " * 3000, "a" * 20_000] + [say(rng.randint(1, 120)) for _ in range(150)] + ["same words of it"] * 12
    return [(None if k % 41 == 7 else k * 13 % 180, t, 1, 2, "x", 3, 4) for k, t in enumerate(texts)] + [(5, "of it", 1, 2, "x", 3, 4)] * 2


def top_of(got, want):
    return {k: sorted(((r[1], r[2], r[3]) for r in got if r[0] == k), key=str) for k in {r[0] for r in got}} == {k: sorted(((r[1], r[2], r[3]) for r in want if r[0] == k), key=str) for k in {r[0] for r in want}}


def brute_11(rows, items, top=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in word.findall(t or "")]
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n_all, l_all = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(list)
    for i, t, *_ in items:
        asked[i] += terms(t)
    out = []
    for item, q in asked.items():
        found = []
        for i, c in docs:
            if c:
                m = 75 + (25 * c.total() * n_all) // l_all
                s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in q if t in c)
                if s > 0:
                    found.append((s, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(found[:top])]
    return out


ASKED = [(1, "the sers of it", 9), (2, "The THE the tion tion", 9), (2, "her", 9), (3, None, 9), (4, "", 9), (None, "日本 été same", 9), (5, "nowhere", 9), (6, "same words of it", 9), (6, "same words of it", 9), (7, " ".join(WORDS * 3), 9), (8, "x9 x9", 9)]


@pytest.mark.parametrize(("shard", "part", "step"), [(24 << 20, 1 << 20, 8), (3000, 60, 1)])
def test_11_brute_force(spark, monkeypatch, shard, part, step):
    from panelsentry.llm import lexical_search as L

    monkeypatch.setattr(L, "SHARD_BYTES", shard)
    monkeypatch.setattr(L, "STEP", step)
    rows = corpus()
    for top in (20, 3):
        got = L.lexical_search(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(ASKED, ITEMS), top, query_bytes=part)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert top_of([tuple(r) for r in got.collect()], brute_11(rows, ASKED, top))


def test_11_stops_early_and_strictly():
    """Lists by falling impact are not read to their end, and equal scores at the bar are all seen."""
    from panelsentry.llm.lexical_search import Lists, impacts

    rng = np.random.default_rng(5)
    n = 4000
    tf = [rng.geometric(0.02, n) for _ in range(4)]
    doc, term = np.concatenate([np.repeat(np.arange(n), t) for t in tf]), np.repeat(np.arange(4), [t.sum() for t in tf])
    length = np.full(n, 300)
    lists = Lists(doc, term, length, n, n * 300, 4)
    weight = np.array([5000, 40, 30, 20])
    want = sum(int(w) * impacts(t.astype(np.int64), length, n, n * 300) for w, t in zip(weight, tf, strict=True))
    docs, scores, read = lists.best(np.arange(4), weight, 0, 20)
    assert read < n / 4
    bar = np.sort(want)[-20]
    assert set(np.flatnonzero(want >= bar)) <= set(docs.tolist()) and all(want[d] == s for d, s in zip(docs.tolist(), scores.tolist(), strict=True))
    same = Lists(np.arange(n), np.zeros(n, np.int64), length, n, n * 300, 1)
    assert len(same.best(np.array([0]), np.array([7]), 0, 20)[0]) == n  # all tie


def test_11_query_and_empty(spark, tmp_path):
    import duckdb

    from panelsentry.llm import lexical_search as L

    rows = corpus()
    d = save(tmp_path / "a", documents=spark.createDataFrame(rows, DOCS), benchmark=spark.createDataFrame(ASKED, ITEMS))
    got = [tuple(r) for r in L.op11_lexical_search(spark, d).collect()]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    assert top_of(got, con.execute(L.OP11_SQL).fetchall()) and top_of(got, brute_11(rows, ASKED))
    for k, (docs, items) in enumerate(((rows, []), ([], ASKED), ([(1, None, 1, 2, "x", 3, 4)], ASKED))):
        d = save(tmp_path / f"e{k}", documents=spark.createDataFrame(docs, DOCS), benchmark=spark.createDataFrame(items, ITEMS))
        assert L.op11_lexical_search(spark, d).count() == 0


# 12


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute_12(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(v) if len(convs[c]) == len(k)) for k, v in members.items()}
    return sorted(((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in members.items()), key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        first = rng.choice("abc")
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{first} é {rng.choice('xy') if rng.random() < 0.3 else t}", 1, 2, "g") for t in range(rng.choice([1, 2, 4, 5, 8, 9, 12, 13]))]
    rows += [(200 + c, t, "user", f"same {t}", 1, 2, "g") for c in range(40) for t in range(8 if c % 3 else 5)]
    rows += [(300, t, "user", f"long {t}", 1, 2, "g") for t in range(70)] + [(301, t, "user", f"long {t}", 1, 2, "g") for t in range(66)]
    rows += [(400, None, None, None, 1, 2, "g"), (400, None, "user", "b", 1, 2, "g"), (400, 1, "user", None, 1, 2, "g"), (400, 1, "user", None, 1, 2, "g"), (None, 1, "user", "lost", 1, 2, "g"), (403, 0, "user", "", 1, 2, "g"), (-7, 0, "user", "n", 1, 2, "g"), (-5, 0, "user", "m", 1, 2, "g")]
    return rows + [(c, 0, "user", "t" * 100_000, 1, 2, "g") for c in (500, 505)] + [(c, 0, "u", "only", 1, 2, "g") for c in range(601, 640) if c % 5]


@pytest.mark.parametrize("stretch", [1024, 4])
def test_12_brute_force(spark, monkeypatch, stretch):
    from pyspark.sql import functions as F

    from panelsentry.llm import prefix_trie as T

    monkeypatch.setattr(T, "STRETCH", stretch)
    monkeypatch.setattr(T, "ROWS", 7)
    rows = conversations()
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), TURNS)
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    got = T.prefix_trie(df)
    assert got.columns == NODE
    assert sorted(map(tuple, got.collect()), key=str) == brute_12({c: [t[2:] for t in sorted(v)] for c, v in own.items()})
    got = T.trie(T.block_rows(T.in_order(df, F.col("conv_id") - F.col("conv_id") % T.FAMILY), T.rebuilt_turns))
    assert sorted(map(tuple, got.collect()), key=str) == brute_12(rebuild(rows))


def test_12_query_and_empty(spark, tmp_path):
    import duckdb

    from panelsentry.llm import prefix_trie as T

    rows = conversations()
    d = save(tmp_path / "a", conversations=spark.createDataFrame(rows, TURNS))
    got = sorted(map(tuple, T.op12_prefix_trie(spark, d).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{d}/conversations.parquet/*.parquet')")
    assert got == sorted(con.execute(f"select {', '.join(NODE)} from ({T.OP12_SQL})").fetchall(), key=str) == brute_12(rebuild(rows))
    d = save(tmp_path / "e", conversations=spark.createDataFrame([(None, 1, "user", "x", 1, 2, "g")], TURNS))
    assert T.op12_prefix_trie(spark, d).count() == 0


# 13


def test_13_pretokens_are_the_librarys():
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelsentry.llm.pretokens import Encoder

    path = P.path("byte_bpe_50k.json")
    e, t = Encoder(path, 2), Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = [*"abcstdrevlmABC'''  \n\t12٣,.!é日ß　 \u0085\x1c\x00😀́'", "'s", "'re", " '", "'ll", "<|endoftext|>", "  ", "\r\n"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20)] + [None, ""]
        ids, off = e.encode(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], x
    other = Encoder(P.path("word_bpe_49k.json"), 2)  # of another kind: whole texts
    ids, off = other.encode(pa.array(["Some Words here", None]))
    assert ids.tolist() == [*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode("Some Words here", add_special_tokens=False).ids, 2, 2]


def packed(rows, docs, capacity=1024):
    """Checks rows against the documents' ids and returns the number of sequences."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, text, *_ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r[:5] for r in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append((r[6], r[3]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r[3] for r in want) // capacity)


@pytest.mark.parametrize("chunk", [2048, 40])
def test_13_packs_all(spark, tmp_path, chunk):
    from panelsentry.llm import best_fit_packing as B

    rows = corpus() + [(None, None, 1, 2, "x", 3, 4)] * 30
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [tuple(r) for r in B.pack_documents(df, chunk=chunk).collect()]
    used, least = packed(got, rows)
    assert used <= least + 2
    if chunk == 2048:
        q = B.op13_best_fit_packing(spark, save(tmp_path / "a", documents=df))
        assert q.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        packed([tuple(r) for r in q.collect()], rows)
        assert B.op13_best_fit_packing(spark, save(tmp_path / "e", documents=df.limit(0))).count() == 0


def test_13_islands_improve_and_bound_holds():
    from panelsentry.llm import best_fit_packing as B

    rng = np.random.default_rng(1)
    for trial in range(20):
        size = rng.integers(1, 30, 9)
        best = brute_bins(sorted(size.tolist(), reverse=True), 30)
        assert B.bound(size, 30) <= best
        got = B.evolve(size, [], 0, trial, 30)[0]
        assert len(set(got.tolist())) in (best, best + 1) and np.bincount(got, size).max() <= 30
    size = rng.permutation(np.concatenate([[a, b, 1000 - a - b] for a, b in rng.integers(200, 450, (80, 2))]))  # 80 full bins of three
    order = np.argsort(-size, kind="stable")
    first, room = np.full(len(size), -1), []
    B.best_fit(size, order, first, room, 1000)
    population = []
    for _ in range(12):
        population = B.evolve(size, population, 1, 7, 1000)
    assert sorted(np.bincount(population[0], size).astype(int).tolist()) and B.fitness(size, population[0], 1000) > B.fitness(size, first, 1000)
    child = B.crossover(size, population[0], first, 1000, rng)
    assert (child >= 0).all() and np.bincount(child, size).max() <= 1000 and len(set(child.tolist())) == child.max() + 1


def brute_bins(size, capacity, bins=()):
    if not size:
        return len(bins)
    out = brute_bins(size[1:], capacity, (*bins, size[0]))
    for k, b in enumerate(bins):
        if b + size[0] <= capacity and b not in bins[:k]:
            out = min(out, brute_bins(size[1:], capacity, (*bins[:k], b + size[0], *bins[k + 1 :])))
    return out
