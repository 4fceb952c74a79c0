"""Problem 8: passages of held-out texts inside training documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lookalikes import latin, plain
from lectern.runtime import settle

#: Words of a verbatim seed, words of training text in one suffix array, characters of held-out text matched in one pass.
SEED, SHARD, PASS = 6, 1_000_000, 8_000_000
#: A passage: words of the item in a row, share of them that may differ, and how many of them must be no stock phrase.
PASSAGE, ALTERED, OWN = 25, 0.15, 0.6 * 25
#: Different held-out texts, and share of them, in which a seed must stand to count as a stock phrase.
STOCK, STOCK_SHARE = 5, 0.02
#: Words of an item that are aligned at once; a longer item is aligned in stretches that overlap by half.
STRETCH = 512
#: Words by which insertions and omissions may shift one end of a passage against the other.
DRIFT = 8
#: Words looked at on each side of a short verbatim match, differences there, and words of the item that a passage must keep.
REACH, WRONG, KEPT = 33, 3, PASSAGE - 1 - 3

_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬]\s*\n\s*(?=[^\W\d_])")
_MARKS = re.compile(r"[^\w\s]|_")


def words(text: str) -> list[str]:
    """Lower-case words without marks; a word broken over lines is joined."""
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _MARKS.sub("", latin(plain(text)).lower()).split()


class SuffixArray:
    """Suffixes of a shard of training text in order of their first ``depth`` words, by prefix doubling."""

    def __init__(self, ids: np.ndarray, depth: int = 32):
        self.ids = ids
        n = len(ids)
        rank = ids.astype(np.int64)
        step = 1
        order = np.argsort(rank, kind="stable")
        while step < depth:
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:]
            key = (rank << 32) | (after + 1)
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            step *= 2
        self.order = order

    def bound(self, tests: np.ndarray, right: bool) -> np.ndarray:
        """For each row of ``tests`` (ids of its first words) the first suffix not before it, or after all that begin with it: one binary search for all."""
        n = len(self.ids)
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), n, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, n - 1)]
            less = np.zeros(len(tests), bool)
            same = np.ones(len(tests), bool)
            for k in range(tests.shape[1]):
                place = at + k
                own = np.where(place < n, self.ids[np.minimum(place, n - 1)], -1)
                less |= same & (own < tests[:, k])
                same &= own == tests[:, k]
            go = (less | same if right else less) & open_
            lo = np.where(go, mid + 1, lo)
            hi = np.where(~go & open_, mid, hi)
        return lo

    def longest(self, place: np.ndarray, test: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words from ``place`` in the shard equal those from ``start`` in ``test``."""
        length = np.zeros(len(place), np.int64)
        alive, k = np.arange(len(place)), 0
        while len(alive):
            a, b = place[alive] + k, start[alive] + k
            alive, a, b = (x[(a < len(self.ids)) & (b < len(test))] for x in (alive, a, b))
            alive = alive[self.ids[a] == test[b]]
            length[alive] += 1
            k += 1
        return length


class HeldOut:
    """The held-out items as one array of word ids, with a wall between items and stock phrases marked: the seeds of
    ``stock_seeds``, or where that is None those that stand in many of these texts. Copies of a text count once, and an item
    that stock phrases leave without a single passage is marked nowhere, so that no item is lost however often it is held out."""

    def __init__(self, items: list[tuple[int, str]], stock_seeds: np.ndarray | None = None):
        self.vocab: dict[str, int] = {}
        self.items, ids, owner = [], [], []
        for item, text in items:
            w = words(text)
            self.items.append(item)
            ids += [self.vocab.setdefault(x, len(self.vocab) + 2) for x in w] + [1]
            owner += [len(self.items) - 1] * (len(w) + 1)
        self.ids, self.owner = np.array(ids, np.int64), np.array(owner, np.int64)
        self.start = np.searchsorted(self.owner, np.arange(len(self.items))) if len(owner) else np.zeros(0, np.int64)
        n = max(0, len(self.ids) - SEED + 1)
        windows = np.lib.stride_tricks.sliding_window_view(self.ids, SEED) if n else np.zeros((0, SEED), np.int64)
        self.at = np.flatnonzero((windows != 1).all(1)) if n else np.zeros(0, np.int64)
        self.tests = windows[self.at]
        stock = np.zeros(len(self.ids), bool)
        if len(self.at) and stock_seeds is not None:
            for k in range(SEED):
                stock[self.at[np.isin(self.codes(), stock_seeds)] + k] = True
        elif len(self.at):
            _, which = np.unique(self.tests, axis=0, return_inverse=True)
            which = which.ravel()
            texts: dict[bytes, int] = {}
            text = np.array([texts.setdefault(self.item_words(i).tobytes(), i) for i in range(len(self.items))])
            pairs = np.unique(np.stack([which, text[self.owner[self.at]]], 1), axis=0)
            often = np.bincount(pairs[:, 0])[which] >= stock_from(len(texts))
            for k in range(SEED):
                stock[self.at[often] + k] = True
        for i in np.unique(self.owner[stock]) if stock.any() else ():
            own = slice(self.start[i], self.start[i] + len(self.item_words(i)))
            free = np.concatenate(([0], np.cumsum(~stock[own])))
            if (free[PASSAGE:] - free[:-PASSAGE]).max(initial=0) < OWN:
                stock[own] = False
        self.stock = stock

    def codes(self) -> np.ndarray:
        """A hash of the words of each seed, the same in every task."""
        word = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in self.vocab], np.uint64)
        out = np.zeros(len(self.tests), np.uint64)
        for k in range(SEED):
            out = out * np.uint64(0x9E3779B97F4A7C15) + word[self.tests[:, k] - 2]
        return out.view(np.int64)

    def item_words(self, i: int) -> np.ndarray:
        end = self.start[i + 1] if i + 1 < len(self.items) else len(self.ids)
        return self.ids[self.start[i] : end - 1]


def stock_from(n_texts: int) -> float:
    """In how many of so many different texts a stock phrase stands at least."""
    return max(STOCK, STOCK_SHARE * n_texts)


def aligned(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each (item, document, stock marks of the item): words of the item, differences and plain words matched of the
    best local alignment, in which a match counts 1 and a difference -3. All pairs are aligned side by side, word by word of the item."""
    rows, cols = max(len(a) for a, _, _ in pairs), max(len(b) for _, b, _ in pairs)
    item, doc = np.full((len(pairs), rows), -1, np.int64), np.full((len(pairs), cols), -2, np.int64)
    dull = np.ones((len(pairs), rows), bool)
    for p, (a, b, m) in enumerate(pairs):
        item[p, : len(a)], doc[p, : len(b)], dull[p, : len(m)] = a, b, m
    # of each cell its alignment's score, and beside it where that began in the item, its differences and its plain matches
    shape = (len(pairs), cols + 1)
    score, start, wrong, good = np.zeros(shape, np.float32), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    best, found = np.zeros(len(pairs), np.float32), np.zeros((len(pairs), 3), np.int64)
    for i in range(rows):
        hit = doc == item[:, i : i + 1]
        live = score[:, :-1] > 0
        diag, up = score[:, :-1] + np.where(hit, np.float32(1), np.float32(-3)), score[:, 1:] - 3
        take = diag >= up
        s = np.where(take, diag, up)
        st = np.where(take, np.where(live, start[:, :-1], i), start[:, 1:])
        wr = np.where(take, np.where(live, wrong[:, :-1], 0) + ~hit, wrong[:, 1:] + 1)
        gd = np.where(take, np.where(live, good[:, :-1], 0) + (hit & ~dull[:, i : i + 1]), good[:, 1:])
        for _ in range(2):  # words that the document adds
            add = np.zeros(s.shape, bool)
            add[:, 1:] = s[:, :-1] - 3 > s[:, 1:]
            if not add.any():
                break
            r, c = np.nonzero(add)
            s[r, c], st[r, c], wr[r, c], gd[r, c] = s[r, c - 1] - 3, st[r, c - 1], wr[r, c - 1] + 1, gd[r, c - 1]
        dead = s <= 0
        score[:, 1:], start[:, 1:], wrong[:, 1:], good[:, 1:] = np.where(dead, 0, s), np.where(dead, i + 1, st), np.where(dead, 0, wr), np.where(dead, 0, gd)
        k = score.argmax(1)
        every = np.arange(len(pairs))
        top = score[every, k]
        better = top > best
        if better.any():
            e, k = every[better], k[better]
            best[e] = top[e]
            found[e] = np.stack([i - start[e, k] + 1, wrong[e, k], good[e, k]], 1)
    return found


def promising(held: HeldOut, ids: np.ndarray, place: np.ndarray, first: np.ndarray, length: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Whether each verbatim match, with what the item and the shard share in REACH words before and after it, at offsets
    within WRONG of its own, has the words of a passage. Looser than the alignment, so that none of WRONG differences is lost."""
    hits, plain_ = length.copy(), rare.copy()
    own = held.owner[first]
    for step in (*range(-REACH, 0), *range(REACH)):
        move = step if step < 0 else length + step
        at, there = np.clip(first + move, 0, len(held.ids) - 1), place + move
        same = np.zeros(len(first), bool)
        for shift in range(-WRONG, WRONG + 1):
            same |= ids[np.clip(there + shift, 0, len(ids) - 1)] == held.ids[at]
        same &= (held.owner[at] == own) & (at == first + move)
        hits += same
        plain_ += same & ~held.stock[at]
    return (hits >= KEPT) & (plain_ >= OWN)


def stretches(n: int, runs: list[tuple[int, int]], low: int) -> Iterator[tuple[int, int]]:
    """(first, last) words of an item of ``n`` words that are aligned for the verbatim runs, (place in the item, offset), of a band
    of offsets from ``low``: all of it, or of a long one the stretches that hold a run."""
    if n <= STRETCH:
        yield 0, n
        return
    own = np.array([p for p, o in runs if abs(o - low) <= 2 * DRIFT])
    for a in range(0, n - STRETCH // 2, STRETCH // 2):
        if ((own >= a) & (own < a + STRETCH)).any():
            yield a, min(n, a + STRETCH)


def shard_matches(held: HeldOut, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(document, item, word of the document, word of the item, words) of all passages that a shard holds: the indices of both, and
    where their longest verbatim match begins and how long it is."""
    sizes = np.array([len(d) + 1 for d in docs])
    ids = np.concatenate([np.append(d, 0) for d in docs]) if docs else np.zeros(0, np.int64)
    if not len(held.at) or len(ids) < SEED:
        return []
    array = SuffixArray(ids, 8)
    lo, hi = array.bound(held.tests, False), array.bound(held.tests, True)
    n = hi - lo
    test = np.repeat(np.arange(len(n)), n)
    place = array.order[np.repeat(lo, n) + np.arange(len(test)) - np.repeat(np.cumsum(n) - n, n)]
    first = held.at[test]
    # of a verbatim match only its first seed is kept, with its full length
    before = (place > 0) & (first > 0) & (ids[np.maximum(place - 1, 0)] == held.ids[np.maximum(first - 1, 0)]) & (ids[np.maximum(place - 1, 0)] > 1)
    place, first = place[~before], first[~before]
    length = array.longest(place, held.ids, first)
    starts = np.cumsum(sizes) - sizes
    doc, item = np.searchsorted(starts, place, "right") - 1, held.owner[first]
    stock = np.concatenate(([0], np.cumsum(held.stock)))
    rare = length - (stock[np.minimum(first + length, len(held.stock))] - stock[first])
    offset = place - starts[doc] - (first - held.start[item])
    # most passages keep 12 words in verbatim runs whose offsets differ by their insertions and omissions only; bands of
    # offsets overlap, so that none falls between two. One of fewer than 30 words with 3 differences may keep a single run of
    # 6, and one with stock phrases few rare words in runs: matches of no such band are looked at one by one
    key = doc * len(held.items) + item
    tried: dict[int, list[int]] = {}
    sure = np.unique(key[(length >= PASSAGE) & (rare >= OWN)])  # a verbatim passage needs no alignment
    banded = np.isin(key, sure)
    for shift in (0, DRIFT):
        band = (key << 24) + (offset + (1 << 22) + shift) // (2 * DRIFT)
        order = np.argsort(band, kind="stable")
        cuts = np.flatnonzero(np.diff(band[order], prepend=-1))
        if len(cuts):
            total, plain_ = np.add.reduceat(length[order], cuts), np.add.reduceat(rare[order], cuts)
            low = np.minimum.reduceat(offset[order], cuts)
            enough = (total >= 12) & (plain_ >= 6)
            banded[order] |= np.repeat(enough, np.diff(np.append(cuts, len(order))))
            for c in np.flatnonzero(enough & ~np.isin(key[order[cuts]], sure)):
                tried.setdefault(int(key[order[cuts[c]]]), []).append(int(low[c]))
    alone = np.flatnonzero(~banded)
    if len(alone):
        for c in alone[promising(held, ids, place[alone], first[alone], length[alone], rare[alone])]:
            tried.setdefault(int(key[c]), []).append(int(offset[c]))
    jobs = []
    by_key = np.argsort(key, kind="stable")
    for k, lows in tried.items():
        d, i = divmod(k, len(held.items))
        own, last = held.item_words(i), None
        mine = by_key[slice(*np.searchsorted(key, [k, k + 1], sorter=by_key))] if len(own) > STRETCH else ()
        runs = [(int(first[x] - held.start[i]), int(offset[x])) for x in mine]
        for low in sorted(lows):
            if last is None or low - last > DRIFT:
                last = low
                for a, b in stretches(len(own), runs, low):
                    jobs.append((d, i, own[a:b], docs[d][max(0, low + a - DRIFT) : max(0, low + b + 3 * DRIFT)], held.stock[held.start[i] + a : held.start[i] + b]))
    jobs.sort(key=lambda j: (len(j[2]), len(j[3])))
    out = {divmod(int(k), len(held.items)) for k in sure}
    for n in range(0, len(jobs), 256):
        some = jobs[n : n + 256]
        for (d, i, *_), (span, wrong, good) in zip(some, aligned([j[2:] for j in some])):
            if span >= PASSAGE - 1 and wrong <= max(3, ALTERED * span) and good >= OWN:
                out.add((d, i))
    order = np.lexsort((place, -length, key))
    lead = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
    best = dict(zip(key[lead].tolist(), lead.tolist()))
    found = []
    for d, i in sorted(out):
        x = best[d * len(held.items) + i]
        found.append((d, i, int(place[x] - starts[d]), int(first[x] - held.start[i]), int(length[x])))
    return found


def seeds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pass, seed, text): the seeds of each text, and a hash of its words."""
    for batch in batches:
        held = HeldOut(list(zip(batch["item_id"], batch["text"])), np.zeros(0, np.int64))
        own = held.owner[held.at]
        text = np.array([int.from_bytes(hashlib.blake2b(" ".join(words(t)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in batch["text"]], np.int64)
        yield pd.DataFrame({"pass": batch["pass"].to_numpy()[own], "seed": held.codes(), "text": text[own]}).drop_duplicates()


def passages(documents: DataFrame, heldout: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, doc_word, item_word, n_words): the documents that hold a passage of a held-out item, and where, counted in words
    from 0, their longest verbatim match lies in both, and its words.

    Narrow over the documents: each task packs its texts, whole, into shards of SHARD words (a longer text is a shard of
    its own), sorts the shard's suffixes, binary-searches every held-out suffix, and aligns the item where verbatim matches add
    up. The held-out side is sent in passes of at most PASS characters, so what is broadcast is bounded whatever its
    size; stock phrases are counted over all different texts before, copies of a text once. Long items are aligned in stretches. NULL and empty texts hold nothing; rows that repeat a key give their passages once."""
    total = heldout.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = int(total // PASS) + 1
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.where(F.col(key).isNotNull() & (F.length("text") > 0)).select(key, "text")
    out = []
    items = heldout.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(passes)).alias("pass")).distinct()
    if passes > 1:
        seeds = settle(items.mapInPandas(seeds_of, "pass long, seed long, text long").distinct())
        least = stock_from(seeds.select("text").distinct().count())
        often = settle(seeds.groupBy("seed").agg(F.countDistinct("text").alias("n")).where(F.col("n") >= least))
    for p in range(passes):
        rows = items.where(F.col("pass") == p)
        stock = np.array([r.seed for r in seeds.where(F.col("pass") == p).join(often, "seed", "left_semi").select("seed").distinct().collect()], np.int64) if passes > 1 else None
        shared = documents.sparkSession.sparkContext.broadcast((sorted((r.item_id, r.text) for r in rows.collect()), stock))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = HeldOut(*shared.value)
            get = held.vocab.get
            keys: list = []
            texts: list[np.ndarray] = []
            size = 0

            def flush() -> pd.DataFrame:
                found = shard_matches(held, texts)
                return pd.DataFrame([(keys[d], held.items[i], *where) for d, i, *where in found], columns=[key, "item_id", "doc_word", "item_word", "n_words"])

            for batch in batches:
                for k, t in zip(batch[key], batch["text"]):
                    ids = np.array([get(w, 0) for w in words(t)], np.int64)
                    if size and size + len(ids) > SHARD:
                        yield flush()
                        keys, texts, size = [], [], 0
                    keys.append(k)
                    texts.append(ids)
                    size += len(ids) + 1
            yield flush()

        out.append(docs.mapInPandas(run, f"`{key}` {kind}, item_id int, doc_word int, item_word int, n_words int"))
    best = F.max_by(F.struct("doc_word", "item_word", "n_words"), F.struct("n_words", -F.col("doc_word"), -F.col("item_word")))
    return reduce(DataFrame.unionByName, out).groupBy(key, "item_id").agg(best.alias("m")).select(key, "item_id", "m.*")


def leaks(documents: DataFrame, heldout: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id): the documents that hold a passage of a held-out item, as ``passages`` finds them."""
    return passages(documents, heldout, key).select(key, "item_id")


def leaked_items(documents: DataFrame, heldout: DataFrame) -> DataFrame:
    """(item_id, split, n_documents, longest) of the items that leaked, with the words of their longest verbatim match."""
    found = passages(documents, heldout).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest"))
    return heldout.select("item_id", F.coalesce("split", F.lit("")).alias("split")).distinct().join(found, "item_id")


def without_leaks(documents: DataFrame, heldout: DataFrame) -> DataFrame:
    """The documents that hold no held-out passage, all columns as they are."""
    return documents.join(leaks(documents, heldout).select("doc_id").distinct(), "doc_id", "left_anti")
