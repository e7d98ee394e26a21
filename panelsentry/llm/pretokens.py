"""Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library, fast: texts are cut into pre-tokens with numpy, and the library itself encodes each distinct
pre-token once a worker. Tokenizers of other kinds encode whole texts."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from . import arrays as A

OTHER, LETTER, NUMBER, SPACE = range(4)
SLOTS, KNOWN = 1 << 16, 1 << 20  # of the table of known words at first, and how many it takes before it starts anew
U64 = np.uint64


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(first, last)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                out[first + m.start() : first + m.end()] = kind
    return out


def pretokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of texts on end (and the end of all), and the n + 1 offsets into them by text.

    A pre-token is a run of letters, numbers or other signs with the space before it, an English contraction at its apostrophe, or white space: all of a run at a
    text's end, else the run without its last character, and that one alone unless it is a space that the next run takes."""
    if not len(buf):
        return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    text = np.searchsorted(lead, off)  # in characters
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = kinds()[cp]
    first = np.zeros(n + 1, bool)
    first[text] = True  # a text starts here, or all end
    run = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run |= first
    i = np.flatnonzero(run[:n])
    word = kind[i] != SPACE
    after_space = ~first[i] & (kind[i - 1] == SPACE)
    joined = after_space & (cp[i - 1] == 0x20)
    start = np.zeros(n + 3, bool)
    start[i[~word]] = True
    start[i[word & ~joined]] = True
    start[i[word & after_space] - 1] = True
    mark = i[word & ~joined & (cp[i] == 0x27)]
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        c1 = cp[mark + 1]
        has = (mark + 2 < n) & ~first[np.minimum(mark + 2, n)]
        c2 = np.where(has, cp[np.minimum(mark + 2, n - 1)], 0)
        pair = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        size = np.where(np.isin(c1, [ord(x) for x in "stmd"]), 1, np.where(pair, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + 1 + size
        start[rest[~run[np.minimum(rest, n)]]] = True
    at = np.flatnonzero(start[:n])
    return np.r_[lead[at], len(buf)], np.searchsorted(at, text)


class Words:
    """Known pre-tokens by hash (not 0), with their ids on end, in a table that doubles when it is half full. Word 0 has the ids ``first`` and no hash, if there are any."""

    def __init__(self, first=()) -> None:
        self.keys, self.values = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32)
        self.n = int(len(first) > 0)
        self.flat_ids, self.flat_at = np.array(first, np.int32), np.array([0, len(first)][: self.n + 1], np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each known word, or -1."""
        out, last = np.full(len(h), -1, np.int32), len(self.keys) - 1
        left, slot = np.arange(len(h)), (h & U64(last)).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            same = key == h[left]
            out[left[same]] = self.values[slot[same]]
            more = ~same & (key != 0)
            left, slot = left[more], (slot[more] + 1) & last
        return out

    def learn(self, h: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Words that aren't known yet, with distinct hashes; their ids on end and the n + 1 offsets."""
        self.flat_ids, self.flat_at = np.r_[self.flat_ids, ids.astype(np.int32)], np.r_[self.flat_at, self.flat_at[-1] + at[1:]]
        size = len(self.keys)
        while 2 * (self.n + len(h)) > size:
            size *= 2
        if size > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, values = self.keys[old], self.values[old]
            self.keys, self.values = np.zeros(size, U64), np.zeros(size, np.int32)
            self._place(keys, values)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        last = len(self.keys) - 1
        left, slot = np.arange(len(h)), (h & U64(last)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            placed = self.keys[slot] == h[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & last


class Encoder:
    """Ids of whole texts, each followed by ``eos``."""

    def __init__(self, path: str, eos: int) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.tokenizer, self.eos = Tokenizer.from_file(path), eos
        self.own = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        cut = settings.get("pre_tokenizer") or {}
        self.by_words = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and settings.get("normalizer") is None
        self.words = Words([eos])

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and the n + 1 offsets; null is empty."""
        buf, off = A.flat(column)
        if not self.by_words:
            got = [[*e.ids, self.eos] for e in self.tokenizer.encode_batch([buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
            return np.array([x for ids in got for x in ids], np.int32), np.r_[0, np.cumsum([len(x) for x in got], dtype=np.int64)]
        if self.words.n > KNOWN:
            self.words = Words([self.eos])
        w = self.words
        start, at = pretokens(buf, off)
        h = A.span_hashes(buf, start[:-1], start[1:]) | U64(1)
        word = w.find(h)
        new = np.flatnonzero(word < 0)
        if len(new):
            keys, where = np.unique(h[new], return_index=True)
            got = [e.ids for e in self.tokenizer.encode_batch([buf[a:b].tobytes().decode() for a, b in zip(start[new[where]].tolist(), start[new[where] + 1].tolist(), strict=True)], add_special_tokens=False)]
            sizes = np.r_[0, np.cumsum([len(x) for x in got], dtype=np.int64)]
            w.learn(keys, np.fromiter((x for ids in got for x in ids), np.int32, int(sizes[-1])), sizes)
            word[new] = w.find(h[new])
        flow = np.insert(word, at[1:], 0)  # word 0 is the end of a text
        size = np.diff(w.flat_at)[flow]
        done = np.r_[0, np.cumsum(size)]
        ids, ends = A.gather(w.flat_ids, w.flat_at[:-1][flow], size), done[np.r_[0, at[1:] + np.arange(1, len(at))]]
        raw = buf.tobytes()
        marked = [k for k in range(len(off) - 1) if any(x in raw[off[k] : off[k + 1]] for x in self.own)] if any(x in raw for x in self.own) else []
        for k in reversed(marked):  # a text with the tokenizer's own tokens in it is the library's work
            own = np.array([*self.tokenizer.encode(raw[off[k] : off[k + 1]].decode(), add_special_tokens=False).ids, self.eos], np.int32)
            more = len(own) - int(ends[k + 1] - ends[k])
            ids = np.concatenate([ids[: ends[k]], own, ids[ends[k + 1] :]])
            ends[k + 1 :] += more
        return ids, ends


@lru_cache(maxsize=1)
def encoder(path: str, eos: int) -> Encoder:
    return Encoder(path, eos)
