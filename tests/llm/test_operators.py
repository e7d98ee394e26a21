"""The ten operators on odd tables against brute force."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = "the of and in to is at on it was for be an by or ser tion ing ble her".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __b string, node long, ids string, row string, keep string"


def made(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, base, small = say(60), say(120), say(12)
    texts = [None, "", " \n\t ", "one", "two words", "ONE", passage, base, base, base + " more", base.replace(" the ", " a ", 1), small, small + " x", small, "a " * 400, "ab" * 500, "é" * 90, "日本 語 " * 40, say(3000) + " " + passage]
    texts += [say(20) + "  " + passage + "\n" + say(15) for _ in range(6)] + [say(rng.randint(1, 80)) for _ in range(20)] + [passage.upper(), "x" * 49, "x" * 50, "x" * 120]
    rows = [(i * 7 % 101, t, rng.choice(["en", None]), "src0", None if t is None else len(t), "b", i, "i", "r", "k") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, base, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tables(spark, tmp_path, docs, **more):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in more.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


LAST = 1 << 62


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# 1


def brute_1(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add("null" if item is None else str(item))
    out = []
    for i, text, *_ in rows:
        w = word.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    found |= windows[tuple(w[s : s + n])]
                    hit[s : s + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


COLUMNS_1 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def items():
    rows = made()
    return [(1, rows[6][1][:200]), (2, "One"), (10, rows[18][1][3000:3090]), (3, None), (4, ""), (None, rows[6][1][50:260]), (1, "two words"), (9, "!!")]


def test_1_decontaminate(spark, docs, tmp_path):
    from panelsentry.llm.decontaminate import contamination, decontaminate, op1_decontaminate

    bench = spark.createDataFrame(items(), "item_id long, text string")
    d = tables(spark, tmp_path, docs, benchmark=bench)
    want = brute_1(made(), items())
    assert rows_of(op1_decontaminate(spark, d), *COLUMNS_1) == want
    clean = {x[0] for x in want} - {x[0] for x in want if x[5]}
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == clean
    assert decontaminate(docs, bench).columns == docs.columns and decontaminate(docs, bench, test_bytes=200).count() == decontaminate(docs, bench).count()
    split = contamination(docs, bench, test_bytes=200).collect()  # the benchmark in parts
    assert sorted((str(r.doc_id), r.n_words, len(r["items"])) for r in split) == sorted((str(x[0]), x[1], x[3]) for x in want)


def test_1_longest_matches(spark, docs):
    from panelsentry.llm.decontaminate import contamination

    long = made()[18][1]
    bench = spark.createDataFrame([(5, "zzz " + long[3000:3300])], "item_id long, text string")
    found = [m for r in contamination(docs, bench).where("n_words > 2000").collect() for m in r["matches"]]
    words = long.split()
    assert any(m["n_words"] >= len(long[3000:3300].split()) - 2 for m in found)
    for m in found:
        got = words[m["doc_word"] : m["doc_word"] + m["n_words"]]
        assert got == ("zzz " + long[3000:3300]).split()[m["item_word"] : m["item_word"] + m["n_words"]]


def test_1_empty(spark, docs, empty, tmp_path):
    from panelsentry.llm.decontaminate import op1_decontaminate

    none = spark.createDataFrame([], "item_id long, text string")
    assert op1_decontaminate(spark, tables(spark, tmp_path / "a", empty, benchmark=none)).count() == 0
    got = op1_decontaminate(spark, tables(spark, tmp_path / "b", docs, benchmark=none)).collect()
    assert len(got) == len(made()) and not any(r.contaminated for r in got)


# 2 and 6


def brute_2(rows, width=50):
    first, out = {}, []
    for i, t in sorted(((LAST if r[0] is None else r[0], (r[1] or "").encode()) for r in rows)):
        for s in range(len(t) - width + 1):
            first.setdefault(t[s : s + width], i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        me = LAST if i is None else i
        hit = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < me:
                hit[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if hit[k] and not (k and hit[k - 1]))
        out.append((i, len(b), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(b, hit) if not h)).hexdigest()))
    return sorted(out, key=str)


def brute_6(rows, width=35):
    count = Counter()
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for _, w in texts:
        count.update(tuple(w[s : s + width]) for s in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        hit = bytearray(len(w))
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                hit[s : s + width] = b"\1" * width
        out.append((i, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit) if not h)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [200_000, 2])
def test_2_repeats(spark, docs, hot, monkeypatch):
    from panelsentry.llm import repeats, suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 64)
    out = repeats.covered(docs, repeats.Units(False, 50, 16), suffix_dedup._kernel, suffix_dedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot=hot)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_2(made())


@pytest.mark.parametrize("hot", [200_000, 2])
def test_6_repeats(spark, docs, hot):
    from panelsentry.llm import repeats, substring_dedup

    out = repeats.covered(docs, repeats.Units(True, 35, 8), substring_dedup._kernel, substring_dedup._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", hot=hot)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_6(made())


def test_6_one_owner_of_very_many_contexts(spark):
    """A phrase between unlike words in 25,000 documents owns more runs than an automaton may hold: none holds them, and what repeats is found."""
    import pyarrow as pa

    from panelsentry.llm import arrays as A
    from panelsentry.llm import repeats as R
    from panelsentry.llm import substring_dedup as S

    rng = np.random.default_rng(12)
    spell = lambda n: [f"{x:x}" for x in rng.integers(0, 2**32, n).tolist()]
    some = spell(200_000)
    joined = np.frombuffer(" ".join(some).encode(), np.uint8)
    start, end, _ = A.words_of(joined, np.array([0, len(joined)]), ~A.SPACE)
    least = int(np.argmin(A.sequence_hashes(A.span_hashes(joined, start, end), 8)))
    phrase = some[least : least + 8]  # owns nearly every window it lies in
    words = [spell(29) + phrase + spell(29) for _ in range(25_000)]
    words[7] = list(words[3])
    words[11] = spell(4) + words[12][10:50] + spell(4)
    words[13] = words[14][:36] + spell(9)
    words[21], words[22] = spell(50), spell(50)
    words[22][5:45] = words[21][3:43]  # a repeat that the phrase doesn't own
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    u, most = R.Units(True, 35, 8), 2 * 35 * S.HOT

    def kernel(buf, off, ids, known, units):
        size = np.diff(off)
        held = np.unique(R.owners_of(buf, off[:-1], size, units), return_inverse=True)[1]
        assert not len(held) or np.bincount(held, weights=size // 2).max() <= most  # a word and its space are two bytes at least
        return S._kernel(buf, off, ids, known, units)

    t = R.texts_of(pa.table({"doc_id": [i for i, _ in rows], "text": [x for _, x in rows]}), u)
    _, n, owner, _, _ = R.runs_of(t, u)
    assert np.unique(owner, return_counts=True)[1].max() > 2 * S.HOT
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = R.covered(docs, u, kernel, S._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", hot=S.HOT)
    want = brute_6(rows)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert {r[0]: r[2] for r in want if r[2]} == {3: 66, 7: 66, 11: 40, 12: 40, 13: 36, 14: 36, 21: 40, 22: 40}


def test_2_6_owners_are_dealt_evenly():
    """Owners are least hashes, so small ones: buckets that go by their high bits get equal shares all the same."""
    import pyarrow as pa

    from panelsentry.llm import arrays as A
    from panelsentry.llm import repeats as R

    random = np.random.default_rng(9)
    text = "".join(map(chr, random.choice([*range(97, 123), 32, 32, 32, 32, 32], 700_000)))
    for u in (R.Units(False, 50, 16), R.Units(True, 35, 8)):
        t = R.texts_of(pa.table({"doc_id": [1], "text": [text]}), u)
        owner = R.runs_of(t, u)[2]
        _, edges = A.bucket_runs(np.sort(owner), 40)
        assert len(owner) > 5000 and np.diff(edges).max() < 1.5 * len(owner) / 40 and len(edges) == 41


def test_2_6_queries_and_empty(spark, docs, empty, tmp_path):
    from panelsentry.llm.substring_dedup import op6_substring_dedup, substring_dedup
    from panelsentry.llm.suffix_dedup import op2_suffix_dedup

    d = tables(spark, tmp_path / "a", docs)
    assert rows_of(op2_suffix_dedup(spark, d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_2(made())
    assert rows_of(op6_substring_dedup(spark, d), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_6(made())
    e = tables(spark, tmp_path / "b", empty)
    assert op2_suffix_dedup(spark, e).count() == 0 and op6_substring_dedup(spark, e).count() == 0
    out = substring_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(made())
    got = {r.node: r.text for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == " \n\t " and got[14] == ""


def test_2_interval_tree_reports_all_maximal_repeats():
    from panelsentry.llm.suffix_dedup import maximal_repeats

    rng = random.Random(3)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        off = np.r_[0, np.cumsum([len(t) for t in texts])]
        got = set()
        for group, string, first, length, _ in maximal_repeats(np.frombuffer(b"".join(texts), np.uint8), off, np.arange(4), 8):
            for g in np.unique(group):
                m = group == g
                got.add((int(length[m][0]), frozenset(zip(string[m].tolist(), first[m].tolist()))))
        want = set()
        places = defaultdict(set)
        for k, t in enumerate(texts):
            for s in range(len(t)):
                for e in range(s + 8, len(t) + 1):
                    places[t[s:e]].add((k, s))
        for x, at in places.items():
            left = {texts[k][s - 1 : s] if s else (k, s) for k, s in at}
            right = {texts[k][s + len(x) : s + len(x) + 1] or (k, s) for k, s in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(x), frozenset(at)))
        assert got == want


def test_6_automaton_counts():
    from panelsentry.llm.substring_dedup import SuffixAutomaton

    rng = random.Random(4)
    for _ in range(30):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 14))] for _ in range(4)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        a.close()
        for t in texts:
            for k, n in enumerate(a.matching(t, 2)):
                longest = max((m for m in range(k + 2) if m == 0 or sum(u[s : s + m] == t[k + 1 - m : k + 1] for u in texts for s in range(len(u) - m + 1)) >= 2), default=0)
                assert n == longest


def test_slices_and_blocks_do_not_matter(monkeypatch):
    """What is made some at a time equals what is made at once: tiny slices, blocks and shards, in this process."""
    import pyarrow as pa

    from panelsentry.llm import arrays as A
    from panelsentry.llm import repeats as R
    from panelsentry.llm import substring_dedup, suffix_dedup

    table = pa.table({"doc_id": pa.array([r[0] for r in made()], pa.int64()), "text": [r[1] for r in made()]})

    def all_of():
        out = []
        for u, kernel in ((R.Units(False, 50, 16), suffix_dedup._kernel), (R.Units(True, 35, 8), substring_dedup._kernel)):
            t = R.texts_of(table, u)
            runs = R.runs_of(t, u)
            a, b = R._bytes_of(t, u, runs[0], runs[1])
            content = R.context_hashes(t, u, runs[0], runs[1], a, b)
            _, lead = np.unique(content, return_index=True)
            found = kernel(A.gather(t.buf, a[lead], (b - a)[lead]), np.r_[0, np.cumsum((b - a)[lead])], t.ids[runs[3][lead]], np.zeros(len(lead), bool), u)
            cells = {(int(c), int(f) + k) for c, f, n in zip(*found) for k in range(int(n))}
            out.append((*(x.tolist() for x in runs), content.tolist(), cells))
        return out

    whole = all_of()
    for module, name, value in ((A, "BLOCK", 2048), (R, "SLICE", 300), (R, "SHARD", 2), (substring_dedup, "SHARD", 2), (suffix_dedup, "SORTED_AT_ONCE", 16), (suffix_dedup, "LISTED_AT_ONCE", 16)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(substring_dedup, "shards_of", lambda b, o, u, n=2: R.shards_of(b, o, u, 2))
    monkeypatch.setattr(suffix_dedup, "shards_of", lambda b, o, u, n=2: R.shards_of(b, o, u, 2))
    assert all_of() == whole and any(x[-1] for x in whole)


def test_documents_larger_than_a_shard(spark, tmp_path):
    """Two equal documents of 9 MB, larger than any shard or slice, among short ones; each operator's result is known beforehand."""
    from panelsentry.llm.byte_bpe import op5_byte_bpe
    from panelsentry.llm.decontaminate import op1_decontaminate
    from panelsentry.llm.jaccard_join import op4_jaccard_join
    from panelsentry.llm.substring_dedup import op6_substring_dedup
    from panelsentry.llm.suffix_dedup import op2_suffix_dedup

    rng = np.random.default_rng(3)
    words = [f"{x:x}" for x in rng.integers(0, 2**40, 900_000).tolist()]
    long = " ".join(words)
    rows = [(1, long), (2, long), (3, "short one"), (4, " ".join(words[500_000:500_060])), (5, None)]
    d = tables(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"), benchmark=spark.createDataFrame([(7, " ".join(words[700_000:700_040]))], "item_id long, text string"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    one = {r.doc_id: r for r in op1_decontaminate(spark, d).collect()}
    assert [(one[i].n_words, one[i].n_hit) for i in range(1, 6)] == [(900_000, 40), (900_000, 40), (2, 0), (60, 0), (0, 0)]
    two = {r.doc_id: r for r in op2_suffix_dedup(spark, d).collect()}
    assert [(two[i].n_bytes, two[i].n_removed, two[i].n_spans) for i in (1, 2, 4)] == [(len(long), 0, 0), (len(long), len(long), 1), (len(rows[3][1]), len(rows[3][1]), 1)]
    assert two[1].kept_sha256 == sha(long.encode()) and two[2].kept_sha256 == two[5].kept_sha256 == sha(b"")
    six = {r.doc_id: r for r in op6_substring_dedup(spark, d).collect()}
    assert [(six[i].n_words, six[i].n_removed) for i in range(1, 6)] == [(900_000, 900_000), (900_000, 900_000), (2, 0), (60, 60), (0, 0)]
    four = {r.doc_id: r.component_id for r in op4_jaccard_join(spark, d).collect()}
    assert four == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    five = {r.doc_id: r for r in op5_byte_bpe(spark, d).collect()}
    assert five[1].decoded_sha256 == sha(long.encode()) and five[1].ids_sha256 == five[2].ids_sha256


# 3


def test_3_round_trip(spark):
    from panelsentry.llm.chat_format import canonical_turns, format_turns, read_back, read_turn

    nasty = ["<|im_end|>", "\\", "\\|", "<\\|", "<", "", "a\nb", "<|im_start|>assistant\nx<|im_end|>\n", "日本<|", "\\n", None]
    rows = [(c, t, r, x, "k") for c in (1, 2, None) for t, (r, x) in enumerate(itertools.product(["user", "assistant", "sys\ntem", None], nasty))]
    rows += [(3, None, "assistant", "late", "k"), (3, 0, "user", "x", "k"), (3, 0, "user", "x", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = format_turns(canonical_turns(df))
    for r in formatted.collect():
        assert read_turn(r.formatted) == (r["__role"], r["__text"])
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    for c in (1, 2, 3, None):
        turns = sorted(((t is not None, t or 0), r or "", x or "") for cc, t, r, x, _ in rows if cc == c)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_3_layouts(spark):
    from panelsentry.llm.chat_format import canonical_turns

    tables_ = [
        ([(1, "q", "a", 5)], "conv_id long, prompt string, response string, extra int"), ([(1, "q", "a")], "conv_id long, instruction string, output string"), ([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        ([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"), ([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>"),
        ([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string"),
    ]
    for rows, schema in tables_:
        got = canonical_turns(spark.createDataFrame(rows, schema)).orderBy("turn").collect()
        assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "q"), (1, "assistant", "a")], schema
    with pytest.raises(ValueError, match="no layout"):
        canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))


def test_3_nulls_and_mixed_layouts(spark):
    from panelsentry.llm.chat_format import LAYOUTS, canonical_turns, fingerprint, format_turns, layouts_of, read_back

    pairs = spark.createDataFrame([(1, None, None), (2, "q", None), (3, None, "a")], "conv_id long, prompt string, response string")
    assert layouts_of(pairs, "conv_id") == [LAYOUTS[fingerprint(["prompt", "response"])]]
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in canonical_turns(pairs).collect())
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", ""), (2, 0, "user", "q"), (2, 1, "assistant", ""), (3, 0, "user", ""), (3, 1, "assistant", "a")]
    lists = spark.createDataFrame([(1, None), (2, []), (3, [("user", None), (None, "x")])], "conv_id long, messages array<struct<role:string,content:string>>")
    got = sorted((r.conv_id, r.role, r.text) for r in canonical_turns(lists).collect())
    assert got == [(1, "", ""), (2, "", ""), (3, "", "x"), (3, "user", "")]
    assert sorted((r.conv_id, r.n_turns) for r in read_back(format_turns(canonical_turns(lists))).collect()) == [(1, 1), (2, 1), (3, 2)]
    mixed = spark.createDataFrame([(1, "p", "r", None, None, None, "s"), (2, None, None, "i", "o", None, "s"), (3, None, None, None, None, [("human", "h")], "s"), (4, None, None, None, None, None, "s")],
                                  "conv_id long, prompt string, response string, instruction string, output string, conversations array<struct<from:string,value:string>>, source string")
    got = {(r.conv_id, r.role, r.text) for r in canonical_turns(mixed).collect()}
    assert got == {(1, "user", "p"), (1, "assistant", "r"), (2, "user", "i"), (2, "assistant", "o"), (3, "user", "h")} | {(4, r.role, "") for r in canonical_turns(mixed).where("conv_id = 4").collect()}


def test_3_empty(spark, tmp_path):
    from panelsentry.llm.chat_format import op3_chat_format

    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in op3_chat_format(spark, str(tmp_path)).collect()] == [-1]


# 4


def brute_4(rows, shingle=3, percent=90):
    sets = []
    for r in rows:
        w = lower(r[1]).encode().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    at = list(range(len(rows)))
    ids = [LAST if r[0] is None else r[0] for r in rows]

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)), key=lambda k: (ids[k], k))
            at[y] = x
    return sorted([(r[0], len(sets[k]), None if ids[find(k)] == LAST else ids[find(k)]) for k, r in enumerate(rows)], key=str)


@pytest.mark.parametrize(("limit", "size"), [(24, 3), (2, 5)])
def test_4_similar(spark, limit, size, monkeypatch):
    from panelsentry.llm import jaccard_join as J

    monkeypatch.setattr(J, "LIST", limit)
    rng = random.Random(size)
    rows = [r[:2] for r in made()]
    for n in (9, 10, 11, 18, 19, 20, 25, 40, 200):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n + size - 1)]
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = [f"v{rng.randint(0, 99)}"] * rng.randint(0, 1)
            rows.append((200 + len(rows), " ".join(w)))
    percent = 90 if size == 3 else 80
    out = J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_4(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_4_lone_pairs(spark, size, percent):
    """Each set and the largest one around it that links, with no third text between them: 18 in 20 at 90 %, 8 in 10 at 80 %."""
    from panelsentry.llm import jaccard_join as J

    rows = []
    for n in range(1, 45):
        for most in (n * 100 // percent, n * 100 // percent + 1):
            words = [f"w{n}x{most}x{k}" for k in range(most + size - 1)]
            rows += [(len(rows), " ".join(words[: n + size - 1])), (len(rows) + 1, " ".join(words))]
    out = J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size, percent=percent)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_4(rows, size, percent)


def test_4_query_and_empty(spark, docs, empty, tmp_path):
    from panelsentry.llm.jaccard_join import keep_one_of_each, op4_jaccard_join

    want = brute_4(made())
    assert rows_of(op4_jaccard_join(spark, tables(spark, tmp_path / "a", docs)), "doc_id", "n_shingles", "component_id") == want
    assert op4_jaccard_join(spark, tables(spark, tmp_path / "b", empty)).count() == 0
    kept = keep_one_of_each(docs)
    gone = {x[0] for x in want if x[0] is not None and x[0] != x[2]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x[0] for x in want} - gone


# 5


def test_5_byte_bpe(spark, docs, empty, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    from panelsentry.llm.byte_bpe import bpe_decode, bpe_encode, op5_byte_bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in made():
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r[1] or "").encode())))
    assert rows_of(op5_byte_bpe(spark, tables(spark, tmp_path / "a", docs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert op5_byte_bpe(spark, tables(spark, tmp_path / "b", empty)).count() == 0
    back = bpe_decode(bpe_encode(docs)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == len(made())


def test_5_long_words(spark):
    """One pre-token of 200,000 equal letters in linear time, and odd words against the same encoder."""
    tiktoken = pytest.importorskip("tiktoken")
    import time

    import public_tokenizers as P

    from panelsentry.llm.byte_bpe import vocabulary

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for letters in ("a", "ab", "aab", "etin", "the", "\u00e9e", "=-", " \n", "abcdefghijklmnopqrstuvwxyz") for _ in range(60)]
    v = vocabulary(path, P.PATTERN)
    for t in texts:
        ids, _ = v.encode([t])
        assert ids.tolist() == enc.encode_ordinary(t), t
    ids, off = v.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [enc.encode_ordinary(t) for t in texts]
    began = time.perf_counter()
    for long in ("a" * 200_000, "ab" * 100_000, " " * 100_000 + "x"):
        ids, off = v.encode([long, None, "b"])
        back, at = v.decode(ids, off)
        assert back.tobytes() == (long + "b").encode() and at.tolist() == [0, len(long), len(long), len(long) + 1]
    assert time.perf_counter() - began < 30


def test_5_any_ranks(tmp_path):
    """Rank files in which a merge can make a pair of a lower rank, against merging one pair at a time."""
    from panelsentry.llm.byte_bpe import Vocabulary

    def merged(w, ranks):
        parts = [w[i : i + 1] for i in range(len(w))]
        while w not in ranks and (some := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]):
            i = min(some)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[w]] if w in ranks else [ranks[p] for p in parts]

    rng = random.Random(5)
    for trial in range(40):
        tokens = [bytes([i]) for i in range(256)] + sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(0, 40))})
        rng.shuffle(tokens)
        (tmp_path / f"{trial}").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        v = Vocabulary(str(tmp_path / f"{trial}"), "[abc]+")
        texts = ["".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 40))) for _ in range(80)]
        ids, off = v.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [merged(t.encode(), v.ranks) for t in texts]


def test_5_words_of_the_corpus(spark, docs, empty, monkeypatch):
    """What recurs is replayed once for all tasks, the most common are sent within a bound, and what is sent isn't replayed again."""
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P
    import regex
    from pyspark.sql import functions as F

    from panelsentry.llm import byte_bpe as B

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    words = ["".join(rng.choice("qxzjv\u00e9") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    texts = [" ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(40)) for _ in range(40)] + [None, "", "alone-in-one-task-zqzq"]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6, "doc_id")
    parts = some.select(F.spark_partition_id().alias("p"), "text").collect()
    met = defaultdict(set)
    for r in parts:
        for w in regex.findall(P.PATTERN, r.text or ""):
            met[w.encode()].add(r.p)
    want = {w: (enc.encode_ordinary(w.decode()), len(p)) for w, p in met.items() if len(p) > 1 and w not in ranks}
    table = B.recurring(some, "text", path, P.PATTERN)
    got = {bytes(r.word): (np.frombuffer(r.ids, "<i4").tolist(), r.n) for r in table.collect()}
    assert got == want and 50 < len(want) < len(met)
    whole = B.most_common(table)
    assert len(whole.hashes) == len(want)
    few = B.most_common(table, sum(4 * len(i) + 16 for i, n in want.values() if n >= 4))
    assert sorted(few.hashes.tolist()) == sorted(B.hashes_of([w for w, (_, n) in want.items() if n >= 4]).tolist()) and 0 < len(few.hashes) < len(want)
    assert len(B.most_common(table, 0).hashes) == 0 and len(B.most_common(B.recurring(empty, "text", path, P.PATTERN)).hashes) == 0
    v, replayed = B.Vocabulary(path, P.PATTERN), []
    replay = v.replay
    monkeypatch.setattr(v, "replay", lambda w: (replayed.extend(w), replay(w))[1])
    import pyarrow as pa

    for sent in (whole, few, None):
        replayed.clear()
        ids, off = next(v.encode_all([pa.array(texts)], sent))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [enc.encode_ordinary(t or "") for t in texts]
        known = set() if sent is None else set(sent.hashes.tolist())
        assert sorted(replayed) == sorted(w for w in met if w not in ranks and int(B.hashes_of([w])[0]) not in known)


def test_5_many_words_in_one_text():
    """More distinct words than the table of known words begins with."""
    import public_tokenizers as P
    import pyarrow as pa

    from panelsentry.llm import byte_bpe as B
    from panelsentry.llm.pretokens import SLOTS, Encoder

    text = " ".join(f"{x:x}" for x in np.random.default_rng(4).integers(0, 2**48, 2 * SLOTS).tolist())
    v = B.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids, off = v.encode([text, None])
    back, _ = v.decode(ids, off)
    assert back.tobytes() == text.encode() and v.known.n > SLOTS // 2
    assert v.encode([text])[0].tolist() == ids.tolist()
    other, ends = Encoder(P.path("byte_bpe_50k.json"), 2).encode(pa.array([text, None]))
    assert ends.tolist()[1] - 1 > 2 * SLOTS and other[-2:].tolist() == [2, 2]


# 7


def labelled(n=600):
    rng = random.Random(8)
    bad = ["grubby", "vile", "foul"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) + rng.choice(["a", "o", "i"]) for _ in range(rng.randint(8, 90))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if junk:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en", f"src{i % 4}", None, 1, "mine"))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels + [(10**6, 1, 0), (5, None, None), (None, 1, 1)]


def test_7_quality(spark):
    from panelsentry.llm.quality_classifier import keep_good, score_documents, train

    rows, marks = labelled()
    docs = spark.createDataFrame(rows + [(9001, None, None, None, None, None, None), (9002, "", "xx", "", -1, 0, "")], "doc_id long, text string, lang string, source string, n_chars long, score int, keep string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_documents(docs, train(docs, labels)).collect()}
    held = [i for i in range(600) if i % 3 == 0]
    right = sum(got[i].keep == (i % 5 != 0 and i % 7 != 0) for i in held)
    assert right >= 0.97 * len(held) and len(got) == 602
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_7_without_labels(spark, docs, empty):
    from panelsentry.llm.quality_classifier import keep_good

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert keep_good(docs, none).count() == len(made()) and keep_good(docs, one).count() == len(made())
    assert keep_good(empty, none).count() == 0



def test_7_calibration_is_the_best_sigmoid():
    """Platt scaling, with its small weight on the slope, against a plain search over slope and shift; margins are of usual, large, tiny and no spread."""
    from panelsentry.llm.quality_classifier import Rows, View

    rng = np.random.default_rng(2)
    for n, spread, noise in ((200, 1.0, 1.0), (200, 40.0, 20.0), (60, 0.01, 0.01), (50, 0.0, 0.0)):
        y = (np.arange(n) % 3 == 0).astype(np.float64)
        z = spread * (2 * y - 1) + noise * rng.standard_normal(n)
        view = View(n, 0, 0)
        view.weight = z
        view.calibrate(Rows(np.arange(n, dtype=np.int32), np.arange(n + 1)), y)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        loss = lambda a, b: float((np.logaddexp(0, a * z + b) - target * (a * z + b)).sum() + 5e-4 * a * a)  # noqa: E731, B023
        unit = max(float(np.abs(z).mean()), 1e-9)
        best = min(loss(a / unit, b) for a in np.linspace(0, 12, 121) for b in np.linspace(-4, 4, 81))
        assert view.slope >= 0 and loss(view.slope, view.shift) <= best + 0.05


def test_7_pseudo_labels_are_the_surest_of_the_unlabelled(spark, monkeypatch):
    """What each view hands on, against a plain pass over all unlabelled rows, repeated rows and equal texts under two ids among them."""
    from pyspark.sql import functions as F

    from panelsentry.llm import quality_classifier as Q

    monkeypatch.setattr(Q, "SURE", 0.7)  # so few rows make no view surer
    rows, marks = labelled(200)
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (7001, rows[6][1], "en", "src0", None, 1, "x"), (7002, rows[6][1], "en", "src0", None, 1, "x"), (7003, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, score int, keep string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    heads = Q.train(docs, labels, rounds=0)
    assert all(heads.values())
    own = ["lang", "source", "n_chars"]
    held = docs.join(labels.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").withColumn("digest", F.xxhash64("text")).toArrow()
    content, meta = Q.content_features(held["text"]), Q.meta_features(held, own)
    keys = list(zip(held["doc_id"].to_pylist(), held["digest"].to_pylist()))
    got = defaultdict(list)
    for h, v, y, key, views in Q.pseudo_labels(docs, labels, heads, 10_000, "doc_id", "text", Q.META):
        got[h, v, y].append(key)
        i = keys.index(key)
        for rows_, mine in ((content, views[0]), (meta, views[1])):
            assert mine.tolist() == rows_.feature[rows_.off[i] : rows_.off[i + 1]].tolist()
    edge = np.log(Q.SURE / (1 - Q.SURE))
    some = 0
    for h, head in heads.items():
        for v, evidence in enumerate((head.views[0].evidence(content), head.views[1].evidence(meta))):
            for y in (0, 1):
                sure = evidence if y else -evidence
                clear = {k for k, s in zip(keys, sure) if s > edge + 1e-4}
                assert clear <= set(got[h, v, y]) <= {k for k, s in zip(keys, sure) if s > edge - 1e-4}
                few = [k for a, b, c, k, _ in Q.pseudo_labels(docs, labels, heads, 3, "doc_id", "text", Q.META) if (a, b, c) == (h, v, y)] if clear and v == 0 else []
                rank = dict(zip(keys, sure))
                if few:
                    assert len(few) == min(3, len(got[h, v, y])) and min(rank[k] for k in few) >= sorted((rank[k] for k in got[h, v, y]), reverse=True)[len(few) - 1] - 1e-4
                some += len(clear)
    assert some > 0


def test_7_repeated_labels_and_long_texts(spark):
    """Repeated labels, ids with many rows, a text of 2 MB and tied scores crash nothing; equal rows score alike."""
    from panelsentry.llm.quality_classifier import score_documents, train

    rows, marks = labelled(240)
    long = " ".join(f"{k * 7919 % 65521:x}" for k in range(400_000))
    rows = rows + [rows[4], rows[4]] + [(5000, long, "en", "src1", len(long), 1, "x"), (5000, long, "en", "src1", len(long), 1, "x")]
    marks = marks + marks[:40] + [(marks[0][0], 1 - marks[0][1], 1 - marks[0][2]), (5000, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, keep string")
    out = score_documents(docs, train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    got = defaultdict(set)
    found = out.select("doc_id", "p_quality", "p_toxic", "keep").collect()
    for r in found:
        got[r.doc_id].add((r.p_quality, r.p_toxic, r.keep))
    assert len(found) == len(rows) and all(len(x) == 1 for x in got.values())
    assert all(0 <= q <= 1 and 0 <= t <= 1 for x in got.values() for q, t, _ in x)


# 8


def brute_8(rows, k=5):
    live = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in live if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in live if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("pivots", "tree"), [(48, 4096), (3, 20)])
def test_8_top_k(spark, pivots, tree):
    from panelsentry.llm.mtree_search import top_k

    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).round(3).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(120)]
    rows += [(2000, None), (2050, [None, 1.0]), (2100, [float("nan"), 1.0]), (2150, [float("inf")]), (2200, []), (2250, [1.0, 2.0]), (3, rows[3][1]), (None, [1.0] * 6)]
    t = spark.createDataFrame([(*r, 1, "f") for r in rows], "vec_id long, embedding array<float>, tree int, floor string")
    got = rows_of(top_k(t, t.where("vec_id % 50 = 0"), pivots=pivots, tree=tree), "query_id", "rank", "vec_id", "score")
    assert got == brute_8(rows)


@pytest.mark.parametrize(("pivots", "tree"), [(48, 4096), (4, 10)])
def test_8_large_values_and_ids_with_several_vectors(spark, pivots, tree):
    """Components of 2^19 and more, scores at the ends of a long and beyond, and two vectors under one id among the queries."""
    from panelsentry.llm.mtree_search import top_k

    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(4) * 2.0 ** rng.integers(0, 40)).tolist()) for i in range(400)]
    rows += [(401, [600000.0, 1.0]), (402, [1.0, 2.0]), (403, [3e38, -3e38]), (404, [-3e38, 3e38]), (450, [1.0, 1.0]), (450, [-1.0, 1.0]), (500, [1.0, 1.0]), (500, [1.0, 1.0]), (403, [1e30])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(top_k(t, t.where("vec_id % 50 = 0"), pivots=pivots, tree=tree), "query_id", "rank", "vec_id", "score")
    live = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = []
    for q, x in {(i, tuple(v)) for i, v in live if i % 50 == 0}:
        best = sorted((-min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1), i) for i, y in live if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want, key=str)


def test_8_empty_and_bounds(spark):
    from panelsentry.llm.mtree_search import MTree, top_k

    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, none).count() == 0
    alone = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(alone, alone).count() == 0
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-4, 4, (400, 8)) + 100 * rng.integers(-3, 3, (1, 8)) for _ in range(12)])
    tree = MTree(np.arange(len(x)), x, int((x * x).sum(1).max()))
    tree.search(-1, x[7], int((x * x).sum(1).max()), 5, -np.inf)
    assert tree.computed < len(x) / 2  # stored distances spare most computations on clustered data


# 9


PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Shop</a></li></ul></nav><!-- ad --><div class="ad">Buy {0} now.</div><article><h1>Head {0}</h1><p><b>One &amp; {0}<br>two<p>Three   {0}\nfour</p></article><footer>&copy; {0} site</footer></body></html>'


def test_9_extract(spark, tmp_path):
    from panelsentry.llm.html_extract import op9_html_extract

    rows = [(i, f"http://h{i}", PAGE.format(f"w{i}"), "x") for i in range(60)] + [(100, None, None, "x"), (101, "u", "", "x"), (102, "u", "<article", "x"), (103, "u", PAGE.format("long " * 30_000), "x"), (0, "http://h0", PAGE.format("w0"), "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op9_html_extract(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 60:
            w = f"w{r.page_id}"
            assert r.text == f"Head {w}\nOne & {w} two\nThree {w} four" and r.n_chars == len(r.text)
    by = {r.page_id: r for r in got}
    assert by[100].text == by[101].text == "" and by[103].n_chars > 400_000 and by[103].text.endswith("four")


def test_9_pages_without_article_markup(spark):
    """Only div and p, no telling names: menus and footers are on all pages, stories on one."""
    from panelsentry.llm.html_extract import extract, train

    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice("aeiou") for _ in range(n))
    rows, want = [], {}
    for i in range(80):
        story = [say(rng.randint(12, 40)) for _ in range(rng.randint(2, 6))]
        want[i] = "\n".join(story)
        rows.append((i, f"http://h/{i}", "<html><body><div><a href=/>Home</a></div><div><a href=/s>Shop and more</a></div><div>" + "".join(f"<p>{t}</p>" for t in story) + "</div><div>All rights are kept by the owners of this site and its many friends</div></body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(pages, train(pages)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 76


def stories(seed, n):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + rng.choice("aeiou") for _ in range(k))
    return [[say(rng.randint(12, 40)) for _ in range(rng.randint(2, 6))] for _ in range(n)]


@pytest.mark.parametrize("frame", ['<body class="has-sidebar">{}</body>', '<body class="single no-comments">{}</body>', '<body class="page sidebar header-fixed"><div class="with-sidebar layout">{}</div></body>', '<body><form id="aspnetForm" action=".">{}</form></body>'])
@pytest.mark.parametrize("marked", [True, False])
def test_9_names_of_the_frame_say_nothing(spark, frame, marked):
    """Classes on body, a wrapper that speaks of a sidebar, and a form around the whole page leave the article what it is."""
    from panelsentry.llm.html_extract import extract, train

    told = stories(11, 60)
    tag = "article" if marked else "div"
    rows = [(i, "u", "<html>" + frame.format(f"<nav><a href=/>Home</a> <a href=/s>Shop</a></nav><{tag}>" + "".join(f"<p>{t}</p>" for t in s) + f"</{tag}><footer>All rights are kept by the owners of this site</footer>") + "</html>") for i, s in enumerate(told)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    got = {r.page_id: r.text for r in extract(pages, train(pages)).collect()}
    assert sum(got[i] == "\n".join(s) for i, s in enumerate(told)) >= 57


#: Whole pages as unlike generators write them; the story's paragraphs go where [] stands.
TEMPLATES = [
    '<html><head><title>t</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><main><article>[p]</article></main><aside><p>See these other pieces</p></aside><footer>Legal lines</footer></body></html>',
    '<html><body class="post-template-default single has-sidebar"><div id="page"><div id="masthead" class="site-header"><a href=/>Blog</a></div><div id="content"><article class="post type-post"><div class="entry-content">[p]</div></article><div id="secondary" class="widget-area"><a href=/a>Recent</a></div></div></div></body></html>',
    '<html><body><table><tr><td class="menu"><a href=/1>One</a><br><a href=/2>Two</a></td><td><article>[p]</article></td></tr></table></body></html>',
    '<html><body><form method="post" id="form1"><div class="topbar"><a href=/>Portal</a></div><div role="main"><article>[p]</article></div><div class="copyright">Owned by them</div></form></body></html>',
    '<!doctype html><html lang=en><body class="no-comments"><div class="cookie-notice"><p>We use cookies here</p><button>Yes</button></div><article itemscope>[p]</article><section class="comments"><div class="comment"><p>I liked what you wrote there very much indeed my friend and so did all</p></div></section></body></html>',
    "<HTML><BODY><DIV ALIGN=center><A HREF=/>Index</A></DIV><ARTICLE>[P]</ARTICLE><HR><FOOTER><A HREF=/>Back</A></FOOTER></BODY></HTML>",
    '<html><body><div class="wrapper with-header"><div class="header"><p>Daily</p></div><article><div class="ad"><p>Buy this thing right now</p></div>[p]<div class="share"><a href=/x>Share</a></div></article></div></body></html>',
    '<html><body><article><section>[p]</section><aside class="related"><p>Other things that you may want to read as well today</p></aside></article></body></html>',
    '<html><body><script>if(a<b){x="</p>"}</script><div><nav class="breadcrumbs"><a href=/>Top</a></nav><article>[p]</article></div><script>y=1<2</script></body></html>',
    '<html><body class="layout-2col sidebar-left"><article class="h-entry is-footer-hidden">[p]</article><div class="sidebar"><p>About the one who writes these pages for you all</p></div></body></html>',
]


def test_9_templates_of_many_makers(spark):
    from panelsentry.llm.html_extract import extract, train

    told = stories(13, 200)
    rows = []
    for i, s in enumerate(told):
        page = TEMPLATES[i % 10]
        tag = "P" if "[P]" in page else "p"
        rows.append((i, "u", page.replace(f"[{tag}]", "".join(f"<{tag}>{t}</{tag}>" for t in s))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    seen, unseen = pages.where("page_id < 100"), pages.where("page_id >= 100")
    got = {r.page_id: r.text for r in extract(unseen, train(seen)).collect()}
    wrong = [i for i in got if got[i] != "\n".join(told[i])]
    assert len(wrong) <= 3, [(i % 10, got[i][:200]) for i in wrong]


def test_9_broken_and_nested_pages_take_no_long_time():
    import time

    from panelsentry.llm.html_extract import blocks_of

    story = "<article><p>One two</p></article>"
    pages = ["<a" * 300_000, '<a "' * 200_000, "<a '\">" * 120_000, "<div>" * 150_000, "<p><ul>" + "<div>x" * 60_000, '<a "x>" ' * 100_000, '<svg "' * 120_000, "<ul><li>x" * 50_000, "<" * 600_000, "<a>x" * 150_000]
    for page in pages:
        began = time.time()
        blocks_of(page)
        assert time.time() - began < 10, page[:20]
    for a, want in (("<a b", ["<a b"]), ("<p title='a>b'>x</p>", ["x"]), ('<p title="<b>">x</p>', ["x"]), ("<p title=it's>x</p>", ["x"]), ('<p "a>x</p>', ["x"]), ("a < b <c", ["a < b <c"]), ("<a href='1'><div>in</a>out</div>", ["inout"])):
        assert [b[1] for b in blocks_of(a)] == want, a
    deep = blocks_of("<div>" * 5000 + story)
    assert [b[1] for b in deep] == ["One two"] and len(deep[0][0]) == 256 and deep[0][0][-2] == "article"


def test_9_code_is_no_markup():
    from panelsentry.llm.html_extract import blocks_of

    story = "<article><p>One two</p><p>three</p></article>"
    for before in (
        "<script>for(i=0;i<n;i++){f()}</script>", "<SCRIPT a='>'>x='<!--'</Script >", "<style>a<b{}/*<!--*/</style>", "<script>s='</scripts>'+\"<p title='\"</script>", "<iframe><p 'x</iframe>",
        "<template><p>no</p><template>no</template>no</template>", "<svg><svg/><text>no</text><script>a<b;'</svg>'</script><svg><g/></svg></svg>", "<object data=x>", "<noscript>", "<svg>", "<iframe src=x>", "<template>", "<iframe>" * 3 + "<svg>" * 3,
    ):
        for page in (before + story, "<script>a<b</script>" + before + story + "<script>c<d</script>", story.replace("two", before + "two")):
            assert [b[1] for b in blocks_of(page)] == ["One two", "three"], page
    assert [b[1] for b in blocks_of("<noscript><p>a</p></noscript><object><p>b</p></object>" + story + "<script>no <p>no")] == ["a", "b", "One two", "three"]
    assert len(blocks_of("<svg>" * 100_000 + "<iframe>" * 100_000 + story)) == 2


def test_9_gradients_and_empty(spark, tmp_path):
    from panelsentry.llm.html_extract import BiLSTM, op9_html_extract

    rng = np.random.default_rng(0)
    net = BiLSTM(5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = BiLSTM.pad([rng.standard_normal((n, 5)) for n in (4, 2)])
    y = rng.integers(0, 2, mask.shape).astype(np.float32)

    def loss():
        z = net.logits(x, mask)[0]
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    before = {k: v.copy() for k, v in net.p.items()}
    state: dict = {}
    net.step(x, mask, y, 0.0, state)
    grads = {k: state[k][0] / 0.1 for k in before}
    total = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    for name in ("wf", "wb", "cf", "o"):
        flat = before[name].ravel()
        for k in rng.integers(0, flat.size, 4):
            net.p = {n: v.copy() for n, v in before.items()}
            net.p[name].ravel()[k] += 1e-3
            up = loss()
            net.p[name].ravel()[k] -= 2e-3
            slope = (up - loss()) / 2e-3
            assert abs(slope - grads[name].ravel()[k]) < 5e-3 * max(1.0, total), name
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op9_html_extract(spark, str(tmp_path)).count() == 0


# 10


def test_10_urls(spark, tmp_path):
    from panelsentry.llm.url_filter import op10_url_filter

    want = {
        None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://A.Net/x?y": ("a.net", "/x", "net/", "block"), "x://net": ("net", "", None, "allow"), "http://www.example.net/en/1#f": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"), "http://b.org/fr/?": ("b.org", "/fr/", "org/fr/", "allow"), "http://b.org/en": ("b.org", "/en", None, "allow"), "http://u.net#/x": ("u.net", "", None, "allow"),
    }
    rows = [(i, u, None, "block") for i, u in enumerate(want)]
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op10_url_filter(spark, str(tmp_path))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == dict(enumerate(want.values()))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_10_distrust_flows_back(spark):
    from panelsentry.llm.url_filter import judge_urls

    to = lambda h, n: f'<a href="http://{h}/x">l</a>' * n
    rows = [(1, "http://bad.net/a", ""), (2, "http://bad.net", ""), (3, "http://friend.io/a", to("bad.net", 9)), (4, "http://far.io/a", to("good.org", 5)), (5, "http://good.org/fr/x", to("far.io", 3))]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), margin=30).collect()}
    assert got[3].bad > 0 and got[3].verdict == "block" and got[4].good > 0 and got[4].verdict == "allow"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(none).count() == 0


def test_10_only_href_is_a_link(spark):
    """Attributes that end in href aren't links; repeated rows and columns of clashing names change no verdict."""
    from panelsentry.llm.url_filter import host_edges, judge_urls

    html = ['<a data-href="http://bad.net/x">l</a>', '<a class="c" href="http://bad.net/x">l</a>', "<a title='t'href=//bad.net/x>l</a>", '<a xlink:href="http://bad.net">', "<a\nHREF = 'http://bad.net'>", '<abbr href="http://bad.net">', None]
    pages = spark.createDataFrame([(f"h{k}.io", x) for k, x in enumerate(html)], "host string, html string")
    assert {(r.source, r.target, r.links) for r in host_edges(pages).collect()} == {(f"h{k}.io", "bad.net", 1) for k in (1, 2, 4)}
    rows = [(k, f"http://h{k}.io/a", x, "host", 5, "to", "rule") for k, x in enumerate(html)] * 2 + [(9, "http://bad.net/a", "", "", 0, "", "")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string, good int, to string, rule string"), margin=10).collect()
    assert len(got) == len(rows) and {r.page_id: r.verdict for r in got} == {0: "allow", 1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 9: "block"}


def test_10_sql_on_linked_hosts(spark, tmp_path):
    """The query's SQL goes on to the same ranks, on random links with and without a scheme."""
    duckdb = pytest.importorskip("duckdb")
    from panelsentry.llm.url_filter import OP10_SQL, op10_url_filter

    rng = random.Random(11)
    hosts = [f"h{k}.{rng.choice(['io', 'net', 'org'])}" for k in range(40)]
    link = lambda: f'<a class="x" href={rng.choice([chr(34), chr(39), ""])}{rng.choice(["http://", "//", "HTTPS://"])}{rng.choice(hosts)}/p>l</a>'
    rows = [(k, f"http://{rng.choice(hosts)}/{rng.choice(['fr/', 'en/', ''])}x", "".join(link() for _ in range(rng.randint(0, 4)))) for k in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.execute("SELECT page_id, host, path, rule, verdict FROM (" + OP10_SQL + ")").fetchall())
    got = sorted(tuple(r) for r in op10_url_filter(spark, str(tmp_path)).collect())
    assert got == want and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_10_converges(spark):
    """Ranks against the solved equations, on chains of more than four links, a ring, a hub and links without a scheme."""
    from panelsentry.llm.url_filter import SCALE, judge_urls

    links = [("c0.io", "bad.net", 1)] + [(f"c{k + 1}.io", f"c{k}.io", 1) for k in range(8)] + [(f"r{k}.io", f"r{(k + 1) % 5}.io", 2) for k in range(5)] + [("r0.io", "good.org", 1), ("good.org", "r2.io", 3)]
    links += [(f"far{k}.io", "c1.io", 1) for k in range(2)] + [("gather.io", f"far{k}.io", 1) for k in range(2)] + [("fifth.io", "c2.io", 1)] + [(f"other{k}.io", "c2.io", 1) for k in range(3)]
    html = defaultdict(str)
    for k, (a, b, n) in enumerate(links):
        html[a] += f'<a href="{("http:", "")[k % 2]}//{b}/x">l</a>' * n
    hosts = sorted({h for a, b, _ in links for h in (a, b)})
    rows = [(k, f"http://{h}/fr/x" if h == "good.org" else f"http://{h}/a", html[h]) for k, h in enumerate(hosts)]
    got = {r.host: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        m[at[b], at[a]] += n
    for column, seed, move in (("good", "good.org", m / np.maximum(m.sum(0), 1)), ("bad", "bad.net", m.T / np.maximum(m.sum(1), 1))):
        own = np.array([0.15 * (h == seed) for h in hosts])
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * move, own) * SCALE
        assert max(abs(getattr(got[h], column) - want[at[h]]) for h in hosts) < 40, column
        assert (np.array([getattr(got[h], column) > 0 for h in hosts]) == (want > 1)).all()
    assert got["fifth.io"].verdict == "allow" and got["c0.io"].verdict == "block"


# pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, marks = labelled()
    passage = " ".join(f"p{k}" for k in range(55))
    more = [(2000, "intro words here " + passage + " then more of it"), (2001, "other start of text " + passage + " and a new end"), (2002, "x " + " ".join(f"q{k}" for k in range(30)) + " y"), (2003, "dup " + " ".join(f"d{k}" for k in range(80))), (2004, "dup " + " ".join(f"d{k}" for k in range(79)) + " z")]
    docs = spark.createDataFrame([r[:5] for r in rows] + [(i, t, "en", "src1", len(t)) for i, t in more] + [(None, None, None, None, None), (2003, more[3][1], "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    d = tables(spark, tmp_path, docs, labels=spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, " ".join(f"Q{k}" for k in range(30)))], "item_id long, text string"))
    names = set()
    stage_docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stage_docs, d)
        assert out.columns == docs.columns, name
        names.add(name)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert 2002 not in got and 2004 not in got and 2003 in got
    assert got[2000].text == "intro words here then more of it" and got[2001].text == "other start of text and a new end"
    assert not any(i in got for i in range(0, 600, 35))
    assert all(r.n_tokens == len(r["ids"]) for r in got.values())
    nothing = tables(spark, tmp_path / "e", docs.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, nothing).count() == 0


def brute_pipeline(rows, items):
    """(doc_id, text) of what the stages after the classifier keep of rows (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = lower(t).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    left, kept = set(range(len(rows))), []
    while left:
        group, front = set(), [left.pop()]
        while front:
            group.add(a := front.pop())
            near = {b for b in left if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0}
            left -= near
            front += near
        kept.append(min((rows[k] for k in group), key=lambda r: (LAST if r[0] is None else r[0], r[1] or "")))
    texts = [(i, t, (t or "").split()) for i, t in kept]
    count = Counter(tuple(w[s : s + 35]) for _, _, w in texts for s in range(len(w) - 34))
    out = []
    for i, t, w in texts:
        hit = {k for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        t = " ".join(x for k, x in enumerate(w) if k not in hit) if hit else t
        if not brute_1([(i, t)], items)[0][5]:
            out.append((i, t))
    return sorted(out, key=str)


def test_pipeline_rows(spark, tmp_path):
    """The whole pipeline against brute force: repeated rows, copies without an id, one id for unlike texts, lone copies with two words more."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    say = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows, marks = labelled()
    passage, same = say("p", 50), say("d", 80)
    more = [(2000, "intro here " + passage + " then more of it"), (2001, "other start " + passage + " and a new end"), (2002, "x " + say("q", 30) + " y"), (2003, same), (2003, same), (2004, same + " z"), (None, same), (None, say("e", 60)), (None, say("e", 60)), (None, say("e", 60) + " z"), (None, say("f", 40)), (None, say("g", 40)), (None, None), (None, None)]
    more += [(2005, say("h", 40)), (2005, say("i", 40)), (2006, say("i", 40) + " z"), (2007, ""), (2007, ""), (2007, say("k", 9)), (2008, say("m", 12)), (2009, say("m", 14)), (2010, say("n", 60)), (2010, say("n", 60).upper())]
    docs = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in [r[:2] for r in rows] + more], "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, say("Q", 30))]
    for name, labels in (("a", marks), ("b", [])):
        d = tables(spark, tmp_path / name, docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
        good = corpus_pipeline.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        want = brute_pipeline([(r.doc_id, r.text) for r in good.collect()], items)
        assert rows_of(corpus_pipeline.run(spark, d), "doc_id", "text") == want
    assert [t for i, t in want if i == 2003] == [same] and sum(i is None for i, _ in want) == 5 and [i for i, _ in want].count(2005) == 2
