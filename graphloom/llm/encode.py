"""Encoding of a corpus with a public byte-level BPE (problem 7).

Speculate and verify: the longest vocabulary entry at each place is proposed as token; a sequence of tokens is the exact encoding if
every token encodes to itself and every adjacent pair does, so all adjacent pairs of a batch of words are tested at once on arrays.
Only words with an incompatible pair are merged exactly.

Scale: one narrow pass over the texts, no shuffle. Words repeat, so each Python worker keeps what it has encoded, bounded
by CACHE_WORDS. Very long words are merged in O(n log n).
"""

from __future__ import annotations

import heapq
import json
import os

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.session import spread

CACHE_WORDS = 200_000
#: Words above this many bytes are encoded but not kept.
CACHE_BYTES = 64
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the published word pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Encoder:
    """The vocabulary of one tokenizer file, with what it takes to propose, verify and merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.n = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pair = {}
        split_left, split_right = np.arange(self.n), np.arange(self.n)
        rank = np.full(self.n, -1)
        for at, (a, b) in enumerate(merges):
            token = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = (at, token)
            if rank[token] < 0:
                split_left[token], split_right[token], rank[token] = vocab[a], vocab[b], at
        self.left, self.right, self.rank = split_left, split_right, rank
        keys = np.array([a * self.n + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.pair.values()])[order]
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        known = {c: b for b, c in enumerate(letters)}
        # a token encodes to itself if its parts do and nothing merges across them before its own merge
        made = np.flatnonzero(rank >= 0)
        whole = self.compatible(split_left[made], split_right[made], rank[made] * 2)
        valid = rank < 0
        for token, ok in sorted(zip(made.tolist(), whole.tolist()), key=lambda t: rank[t[0]]):
            valid[token] = ok and valid[split_left[token]] and valid[split_right[token]]
        self.longest = ahocorasick.Automaton()
        for text, token in vocab.items():
            if all(c in known for c in text) and valid[token] and (len(text) == 1 or rank[token] >= 0):
                raw = "".join(chr(known[c]) for c in text)
                self.longest.add_word(raw, (token, len(raw)))
        self.longest.make_automaton()
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.counts = {"words": 0, "merged": 0}

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := self.pair.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.pair[a, b][1]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if p := self.pair.get((ids[i], ids[nxt[i]])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[nxt[i]]))
            if prev[i] >= 0 and (p := self.pair.get((ids[prev[i]], ids[i]))):
                heapq.heappush(heap, (p[0], prev[i], ids[prev[i]], ids[i]))
        return [t for t, ok in zip(ids, alive) if ok]

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether their bytes side by side encode to just these two, as far as merges before a given one go.

        The last merges inside both tokens are undone from the latest on; a merge across the border that would have come before
        the one undone would have won.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max) if before is None else before.astype(np.int64)
        # ties of one rank go to the leftmost place: across the border comes after a merge inside the left token, before one inside the right
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.key_rank[at] * 2, np.iinfo(np.int64).max)
            bad = across < limit[live]
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = live[~done], x[~done], y[~done], rx[~done], ry[~done]
            left = rx > ry  # of one rank in both, the right one was merged later
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
            limit[live] = np.where(left, rx * 2, ry * 2 + 1)
        return ok

    def encode_words(self, words: list[str]) -> None:
        """Adds words to the cache: proposes greedily, verifies all adjacent pairs at once, merges what fails."""
        tokens, starts, raws = [], [0], []
        for w in words:
            raw = w.encode("utf-8").decode("latin-1")
            raws.append(raw)
            tokens += [t for _, (t, _) in self.longest.iter_long(raw)]
            starts.append(len(tokens))
        flat, cut = np.array(tokens, np.int64), np.array(starts)
        fails = np.zeros(len(words), bool)
        if len(flat) > 1:
            inner = np.ones(len(flat) - 1, bool)
            inner[cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < len(flat))] - 1] = False
            spots = np.flatnonzero(inner)
            pairs, back = np.unique(flat[spots] * self.n + flat[spots + 1], return_inverse=True)
            ok = self.compatible(pairs // self.n, pairs % self.n)[back] if len(pairs) else np.ones(0, bool)
            fails[np.searchsorted(cut, spots[~ok], side="right") - 1] = True
        self.counts["words"] += len(words)
        self.counts["merged"] += int(fails.sum())
        for i, w in enumerate(words):
            self.cache[w] = tuple(self.merge(raws[i].encode("latin-1"))) if fails[i] else tuple(tokens[starts[i] : starts[i + 1]])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; [] for empty and null."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = {w for ws in split for w in ws if w not in self.cache}
        self.encode_words(list(new))
        cache = self.cache
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += cache[w]
            out.append(ids)
        for w in new:
            if len(w) > CACHE_BYTES:
                del cache[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker; from the file that was sent along where the worker's own disk has none."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _ENCODERS[path]


_sent: set[tuple[str, str]] = set()


def sent(path: str) -> str:
    """The path of a vocabulary file, sent to the executors once an application where these are no threads of the driver."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext.master.startswith("local[") and (key := (spark.sparkContext.applicationId, path)) not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)
    return path


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.json")


def _chunks(texts: pd.Series, characters: int = 4_000_000):
    """Slices of a batch whose texts have about so many characters in all."""
    sizes = texts.str.len().fillna(0).cumsum() // characters
    for _, part in texts.groupby(sizes, sort=False):
        yield part.tolist()


def token_ids(text: Column, path: str | None = None) -> Column:
    """The ids of a text, an array of int; [] for empty and null. Text that looks like a special token is plain text."""
    path = sent(path or vocabulary())

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([np.array(x, np.int32) for part in _chunks(texts) for x in enc.encode(part)])

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of ids of a text; 0 for empty and null."""
    path = sent(path or vocabulary())

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([len(x) for part in _chunks(texts) for x in enc.encode(part)], dtype="int32")

    return count(text)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): one row for each row of documents, repeated rows too; an empty table gives no rows, extra columns are ignored."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), path).alias("ids"))
