"""Problem 7: byte-pair encoding of a corpus over an index of pair occurrences."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How text falls into words before any merge (a fixed value of the vocabulary).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words remembered in one worker; beyond that the memory is emptied and begun again, which changes no result.
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 bytes stand for themselves, the others, in order, for the code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)}


class PairIndexEncoder:
    """Merges all words of a batch at once: every mergeable pair maps to its positions, and the active
    ranks are applied in ascending order, each to all its positions from left to right.

    A merge makes pairs that contain the new token, whose ranks are later than its own, so one ascending pass
    over a heap of active ranks gives the same ids as merging word by word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.of_byte = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.rank, self.made = {}, []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.made.append(vocab[a + b])
        self.words = regex.compile(WORDS)
        self.known: dict[str, list[int]] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        of_byte, rank, made = self.of_byte, self.rank, self.made
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([of_byte[b] for b in w.encode("utf-8", "surrogatepass")])
            sym.append(-1)  # a wall between words
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (r := rank.get(a << 32 | b)) is not None:
                where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            new = made[r]
            places = where.pop(r)
            places.sort()
            for i in places:
                j = nxt[i]
                if j >= n or sym[i] < 0 or sym[j] < 0 or rank.get(sym[i] << 32 | sym[j]) != r:
                    continue
                sym[i] = new
                sym[j] = -2
                k = nxt[i] = nxt[j]
                if k < n:
                    prev[k] = i
                    if sym[k] >= 0 and (s := rank.get(new << 32 | sym[k])) is not None:
                        if s not in where:
                            where[s] = []
                            heapq.heappush(active, s)
                        where[s].append(i)
                h = prev[i]
                if h >= 0 and sym[h] >= 0 and (s := rank.get(sym[h] << 32 | new)) is not None:
                    if s not in where:
                        where[s] = []
                        heapq.heappush(active, s)
                    where[s].append(h)
        out = []
        for a in starts:
            ids = []
            while sym[a] != -1:
                ids.append(sym[a])
                a = nxt[a]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; NULL and the empty text give no ids."""
        split = [self.words.findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self.merge(fresh)))
        return [[i for w in words for i in known[w]] for words in split]


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """The encoder of a vocabulary file, read once a worker."""
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def tokenizer_file(name: str = "byte_bpe_50k") -> str:
    """Where the public vocabulary lies: LECTERN_TOKENIZERS, else the installed package of vocabularies."""
    folder = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, f"{name}.json")


def encode_corpus(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>), one row per input row, by the byte-level BPE at ``path``.

    Narrow: whole texts, no shuffle. Strings that look like special tokens are ordinary text; NULL and empty
    texts give an empty list; repeated rows give repeated rows. The words of a batch are merged together, and a
    worker remembers the words it has merged."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 1000):
                yield pd.DataFrame({key: batch[key].iloc[i : i + 1000], "ids": enc.encode(texts[i : i + 1000])})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text")).mapInPandas(run, f"`{key}` {kind}, ids array<int>")
