"""Problem 4: repairing the text of scanned pages.

Facts about a paper (which edge lines repeat, how its pages are numbered) are found with grouped
counts, never by gathering a paper; each page is then repaired alone, given those facts and the word
that the pages before and after lend it."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import latest_by
from lectern.runtime import settle

# What a scanner makes of what is printed, "misread: printed".
MISREAD = """
0: o
1: i l
5: s
6: b
9: g
@: a
¢: c
|: l
rn: m
vv: w
cl: d
ri: n
ii: u ü
c: e
f: t e
b: h
h: li
m: rn
d: cl
"""
BREAKS = "-‐‑¬­"

#: Lines that an edge of a page has, pages a block of a paper holds, most words of the vocabulary that is sent to the tasks.
EDGE, BLOCK, WORDS = 4, 256, 300_000
#: How often a word must stand, and how many times as often as another, for that one to be a misreading of it; up to how often a word
#: that can be no word may stand; more than how often each part of a word with a hyphen of its own stands alone.
PRINTED, TIMES, ODD, ALONE = 5, 8, 3, 4
#: Different words and lines that a task counts before it hands the counts on.
HELD = 300_000

_PRINTED = {a.strip(): b.split() for a, _, b in (x.partition(":") for x in MISREAD.strip().splitlines())}
_HARD = "01569@¢|"
_STRIP = ".,;:()[]{}\"'?!“”‘’«»¿¡~–—*•"
_WORD_STRIP = _STRIP + "-/%#&@\\|"
_FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "9": "g", "6": "b", "@": "a", "¢": "e", "c": "e", "f": "t", "h": "b"})
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUMBER = r"[0-9lIO|oSbBgi]*[0-9][0-9lIO|oSbBgi]*|[lIO|]{1,3}|[ivxlcdmIVXLCDM]+"
_PAGE_NO = re.compile(rf"[\W_]*(?:(\w{{1,6}})[\s.:]+)?[\W_]*({_NUMBER})[\W_]*(?:(?:\w{{1,3}}|/)\s+({_NUMBER}))?[\W_]*")
_PAGE_WORDS = {"page", "p", "pg", "pp", "seite", "s", "página", "pagina", "pág", "folio"}
_LEADING, _TRAILING = re.compile(r"^\W*([0-9lIO|]+)\s{2,}(?=\S)"), re.compile(r"\|\s*([0-9lIO|]+)\W*$")
_NO_LETTERS, _NOT_AZ = re.compile(r"[\W\d_]+"), re.compile("[^a-z]+")
_DIGITS = str.maketrans("lI|iOoSbBg", "1111005689")


def fold(text: str) -> str:
    """A form in which what scanners confuse is the same: for comparing lines, not for reading."""
    text = text.lower()
    for pair, one in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("li", "h")):
        text = text.replace(pair, one)
    return _NO_LETTERS.sub("", text.translate(_FOLD))


def numeral(word: str) -> int | None:
    """The value of an arabic numeral, misread digits allowed, or of a roman one."""
    if any(c.isdigit() for c in word) or set(word) <= set("lIO|"):
        digits = word.translate(_DIGITS)
        return int(digits) if digits.isdigit() and len(digits) < 7 else None
    low = word.lower()
    if not low or not _ROMAN.fullmatch(low) or low != word and low.upper() != word:
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    return sum(-value[a] if value[a] < value.get(b, 0) else value[a] for a, b in zip(low, low[1:] + " "))


def page_value(line: str) -> int | None:
    """The number of a line that holds nothing else but words for "page" or marks around it."""
    m = _PAGE_NO.fullmatch(line.strip())
    if not m or m.group(1) and fold(m.group(1)) not in {fold(w) for w in _PAGE_WORDS}:
        return None
    return numeral(m.group(2))


def edge_number(line: str) -> int | None:
    """The number that a header or footer carries beside other text."""
    m = _LEADING.search(line) or _TRAILING.search(line)
    return numeral(m.group(1)) if m else None


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def edge_keys(line: str) -> list[int]:
    """Three keys of a line, each of two of its thirds: lines that differ within one third share a key."""
    text = fold(_TRAILING.sub("", _LEADING.sub("", line)))
    if len(text) < 6:
        return []
    a, b = len(text) // 3, 2 * len(text) // 3
    x, y, z = text[:a], text[a:b], text[b:]
    return [digest(k) for k in (f"{x}|{y}|", f"{x}||{z}", f"|{y}|{z}")]


def norm(line: str) -> str:
    """Lower-case letters only."""
    return _NOT_AZ.sub("", line.lower())


def scanned(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text), once a page: the latest scan. Pages without key or text drop out."""
    rows = pages.where("doc_id is not null and page_number is not null and text is not null").select("doc_id", "page_number", "text", "scanned_at")
    return latest_by(rows, ["doc_id", "page_number"], "scanned_at", ["text"]).drop("scanned_at")


def tallied(texts: DataFrame) -> DataFrame:
    """(word, key, n, inside) of distinct page texts: the words, and how often each stands; and the lines, by a hash of their letters, that
    stand at an edge of a page and inside pages too, and how often. Copies of a page are to count once. Words broken at a line's end
    do not count. Counted within the tasks before the shuffle; every word is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        outer: Counter[str] = Counter()
        inner: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            bare: Counter[str] = Counter()
            for t, n in words.items():
                bare[t.strip(_WORD_STRIP)] += n
            rows = [(True, w, n, 0) for w, n in bare.items() if any(map(str.isalpha, w))]
            rows += [(False, f"{digest(k):x}", outer[k], inner[k]) for k in {*outer, *inner}]
            for c in (words, outer, inner):
                c.clear()
            return pd.DataFrame(rows, columns=["word", "key", "n", "inside"])

        for batch in batches:
            for text in batch["text"]:
                lines = [x for x in text.split("\n") if x.strip()]
                broken = False
                for x in lines:
                    tokens = x.lower().split()
                    if broken:
                        del tokens[0]
                    if broken := bool(tokens) and len(tokens[-1]) > 1 and tokens[-1][-1] in BREAKS:
                        tokens.pop()
                    words.update(tokens)
                outer.update(k for x in (*lines[:EDGE], *lines[EDGE:][-EDGE:]) if (k := norm(x)))
                inner.update(k for x in lines[EDGE:-EDGE] if (k := norm(x)))
            if len(words) + len(outer) + len(inner) > HELD:
                yield flush()
        yield flush()

    counts = texts.mapInPandas(run, "word boolean, key string, n long, inside long").groupBy("word", "key").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    return counts.where("word or n > 0 and inside > 1 and inside > 0.25 * n")


def readings(word: str) -> Iterator[set[str]]:
    """What a word may have been in print, the likelier first: its signs that stand in no word read as letters; then one, then two
    confusions of letters undone."""
    tries = {word}
    hard = [c for c in _HARD if c in word]
    for c in hard:
        tries = {t.replace(c, p) for t in tries for p in _PRINTED[c]}
        if c == "1" and word.count("1") > 1:
            tries |= set(_each(word, "1"))
    if hard:
        tries = {t for t in tries if not any(c in _HARD for c in t)} or tries
    yield tries if hard else set()
    ring = tries
    for _ in range(1 if len(word) < 6 else 2):
        ring = {t[:i] + p + t[i + len(a) :] for t in ring for a, ps in _SOFT for i in _finds(t, a) for p in ps}
        yield ring


def readable(word: str) -> bool:
    """Whether a word can be a misreading at all: three signs or more, a letter among them, no quantity."""
    return len(word) >= 3 and any(map(str.isalpha, word)) and not re.fullmatch(r"\d+e\d+|\d+[a-z]{1,3}\d?", word)


def odd(word: str, n: int) -> str | None:
    """The reading of a word that stands at most ODD times and has signs that no word has there."""
    if any(c in _HARD for c in word) and len(word) >= 4 and n <= ODD and re.search(r"[@¢|]|[^\W\d_][0-9][^\W\d_]|^[0-9][^\W\d_]{3,}|[^\W\d_]{3,}[015]$", word) and not re.fullmatch(r".*[a-z]\d+", word):
        return max(next(readings(word)))
    return None


class Repairer:
    """Word decisions by the corpus vocabulary: ``words`` are the frequent words with their counts, ``more`` what is known of others that
    the page at hand asks for, (count, printed form)."""

    def __init__(self, words: dict[str, int]):
        self.words, self.known, self.more = words, {}, {}
        # what is said of a token is the same on every page
        self.judged: dict[str, str | None] = {}
        self.asked: dict[str, frozenset[str]] = {}

    def count(self, word: str) -> int:
        n = self.words.get(word)
        return n if n is not None else self.more.get(word, (0, None))[0]

    def printed(self, word: str) -> str | None:
        """What a misread word (lower case, no punctuation around it) was in print; None if it isn't misread."""
        if word in self.more:
            return self.more[word][1]
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = self._printed(word)
        return self.known[word]

    def _printed(self, word: str) -> str | None:
        if not readable(word):
            return None
        words, n = self.words, self.words.get(word, 0)
        for some in readings(word):
            best = max(some, key=lambda t: (words.get(t, 0), t), default="")
            if words.get(best, 0) >= max(PRINTED, TIMES * n):
                return best
        return odd(word, n)

    def asks(self, tokens: list[str]) -> set[str]:
        """The words, and parts of words, of tokens of which the frequent words tell nothing."""
        out: set[str] = set()
        for t in tokens:
            some = self.asked.get(t)
            if some is None:
                low = t.strip(_STRIP).lower()
                parts = [low, *(re.split("[-/]", low) if "-" in low or "/" in low else ())] if low not in self.words else []
                if len(self.asked) > 500_000:
                    self.asked.clear()
                some = self.asked[t] = frozenset(w for w in parts if w not in self.words and readable(w))
            if some:
                out |= some
        return out

    def asks_broken(self, token: str, follows: str) -> set[str]:
        """The same of the words that a token at a line's end may make with the next."""
        a, b = token[:-1].strip(_STRIP), follows.strip(_STRIP)
        part, first = re.split(r"[-‐‑]", a)[-1], re.split(r"[-‐‑/]", b)[0]
        return self.asks([part, first, part + first, f"{part}-{first}", a + b, f"{a}-{b}", token[:-1] + follows])

    def token(self, token: str) -> str | None:
        """The printed form of a token, or None; a token's hyphenated parts are judged one by one."""
        if token not in self.judged:
            if len(self.judged) > 500_000:
                self.judged.clear()
            self.judged[token] = self._token(token)
        return self.judged[token]

    def _token(self, token: str) -> str | None:
        core = token.strip(_STRIP)
        if not core or core.isdigit():
            return None
        if re.fullmatch(r"[0-9lIO|.]*", core) and sum(c.isdigit() for c in core) >= 2 and not core.replace(".", "").isdigit():
            return core.translate(_DIGITS)
        low = core.lower()
        found = self.printed(low)
        if found is None and ("-" in low or "/" in low):
            parts = re.split(r"([-/])", low)
            fixed = [p if p.isdigit() else (self.printed(p) or p) for p in parts]
            found = "".join(fixed) if fixed != parts else None
        return found

    def broken(self, token: str, follows: str) -> bool:
        """Whether a token that ends in a break mark is one word with the token that follows."""
        mark, a, b = token[-1], token[:-1].strip(_STRIP), follows.strip(_STRIP)
        part = re.split(r"[-‐‑]", a)[-1]
        if not part or not b or not part[-1].isalnum() or not b[0].isalnum():
            return False
        if b[0].isdigit():
            return False
        first = re.split(r"[-‐‑/]", b)[0]
        joined, apart = (part + first).lower(), f"{part}-{first}".lower()
        whole, own = self.count(joined), self.count(apart)
        if not whole and (p := self.printed(joined)):
            whole = self.count(p)
        if not own and (p := self.token(apart)):
            own = self.count(p)
        full = self.count(f"{a}{b}".lower()), self.count(f"{a}-{b}".lower())
        whole, own = max(whole, full[0]), max(own, full[1])
        if whole or own:
            return whole > own
        if mark in "¬­":
            return True
        if b[0].isupper():
            return False
        return not (self.count(part.lower()) > ALONE and self.count(first.lower()) > ALONE)


def _finds(text: str, part: str) -> list[int]:
    return [i for i in range(len(text) - len(part) + 1) if text.startswith(part, i)]


def _each(word: str, sign: str) -> list[str]:
    """All readings of a word in which each ``sign`` is read on its own; past ten signs of one word, which are no word, only the first reading."""
    out, left = [""], 10
    for c in word:
        left -= c == sign
        out = [o + p for o in out for p in (_PRINTED[c][: 1 if left < 0 else None] if c == sign else _PRINTED.get(c, [c])[:1] if c in _HARD else [c])]
    return out


_SOFT = [(a, ps) for a, ps in _PRINTED.items() if a not in _HARD]


def edges_of(pages: DataFrame, shared) -> DataFrame:
    """A row a line at an edge of pages made by ``scanned``: its place, number, keys, first and last token; and, of side 2, a row a word of a page,
    in ``head``, of which the frequent words ``shared`` tell nothing."""
    made: list[Repairer] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Repairer(shared.value))
        for batch in batches:
            rows = []
            for doc, page, text in zip(batch["doc_id"], batch["page_number"], batch["text"]):
                lines = [(n, x) for n, x in enumerate(text.split("\n"), 1) if x.strip()]
                for side, part in ((0, lines[:EDGE]), (1, lines[::-1][:EDGE])):
                    for depth, (n, x) in enumerate(part):
                        words = x.split()
                        last = words[-1] if words[-1][-1] in BREAKS and len(words[-1]) > 1 else None
                        bare = page_value(x)
                        rows.append((doc, page, n, side, depth, bare is not None, bare if bare is not None else edge_number(x), f"{digest(norm(x)):x}", edge_keys(x) if bare is None else [], words[0], last))
                tokens = [x.split() for _, x in lines]
                asked = made[0].asks(dict.fromkeys(t for x in tokens for t in x))
                for x, y in zip(tokens, tokens[1:]):
                    if x[-1][-1] in BREAKS and len(x[-1]) > 1:
                        asked |= made[0].asks_broken(x[-1], y[0])
                rows += [(doc, page, 0, 2, 0, False, None, None, None, w, None) for w in sorted(asked)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "line_no", "side", "depth", "bare", "value", "norm", "keys", "head", "tail"])

    return pages.mapInPandas(run, "doc_id string, page_number int, line_no int, side int, depth int, bare boolean, value int, norm string, keys array<bigint>, head string, tail string")


def page_facts(edges: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, page_number, page_no array<int>, running array<int>, head, tail) of the lines of ``edges_of``.

    Page numbers: lines of a number whose distance from the page's place returns on another page of the paper (a paper may count anew within). Running lines:
    edge lines that return on another page of the paper, compared with tolerance (``edge_keys``), unless the corpus holds such lines
    inside pages too (``common``, by norm); or edge lines that carry the page's number. Only lines with nothing but noise between them and
    the edge count. ``head`` is the first token of the page's text, ``tail`` its last one if it ends in a break mark."""
    place = F.col("value") - F.col("page_number")
    more = F.min("page_number") < F.max("page_number")  # on more than one page
    offsets = edges.where("value is not null").groupBy("doc_id", place.alias("gap")).agg(more.alias("numbered")).where("numbered")
    keyed = edges.select("doc_id", "page_number", "line_no", F.explode("keys").alias("key"))
    again = keyed.groupBy("doc_id", "key").agg(more.alias("again")).where("again").drop("again")
    hits = keyed.join(again, ["doc_id", "key"], "left_semi").select("doc_id", "page_number", "line_no").distinct().withColumn("again", F.lit(True))
    rows = edges.withColumn("gap", place).join(offsets, ["doc_id", "gap"], "left").join(hits, ["doc_id", "page_number", "line_no"], "left").join(common.select("norm").withColumn("common", F.lit(True)), "norm", "left")
    numbered = F.coalesce("numbered", F.lit(False))
    returns = F.coalesce(F.col("again") & F.col("common").isNull(), F.lit(False))
    rows = rows.withColumn("kind", F.when(F.col("bare") & numbered, 1).when(~F.col("bare") & (numbered | returns), 2).otherwise(0))
    by = rows.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("side", "depth", "line_no", "kind", "head", "tail")).alias("e"))  # at most 2 * EDGE entries

    def side(n: int) -> Column:
        return F.array_sort(F.filter("e", lambda x: x.side == n))

    def until(a: Column) -> Column:
        """The depth of the first line of text."""
        return F.coalesce(F.array_min(F.transform(F.filter(a, lambda x: x.kind == 0), lambda x: x.depth)), F.lit(EDGE))

    by = by.select("doc_id", "page_number", side(0).alias("a"), side(1).alias("b"))
    by = by.select("*", until(F.col("a")).alias("an"), until(F.col("b")).alias("bn"))
    noise = F.concat(F.filter("a", lambda x: x.depth < F.col("an")), F.filter("b", lambda x: x.depth < F.col("bn")))
    pick = lambda k: F.array_distinct(F.transform(F.filter(noise, lambda x: x.kind == k), lambda x: x.line_no))
    return by.select("doc_id", "page_number", pick(1).alias("page_no"), pick(2).alias("running"), F.get("a", "an").getField("head").alias("head"), F.get("b", "bn").getField("tail").alias("tail"))


def lexicon(asked: DataFrame, counts: DataFrame, shared, floor: float) -> DataFrame:
    """(w, n, printed) of the words asked for that are not among the frequent words ``shared``, all of which stand more than ``floor`` times:
    how often each stands, and what it was in print if it is misread. Exact: readings that are too rare to be frequent words
    are joined with the counts of all words."""
    made: list[Repairer] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Repairer(shared.value))
        words = made[0].words
        for batch in batches:
            rows = []
            for w, n in zip(batch["w"], batch["n"]):
                enough = max(PRINTED, TIMES * n)
                for stage, some in enumerate(readings(w)):
                    best = max(some, key=lambda t: (words.get(t, 0), t), default="")
                    if words.get(best, 0) >= enough:
                        rows.append((w, n, stage, best, words[best]))
                        break
                    if floor >= enough:
                        rows += [(w, n, stage, t, None) for t in some]
                rows.append((w, n, 9, odd(w, n), 0))
            yield pd.DataFrame(rows, columns=["w", "n", "stage", "printed", "m"])

    own = asked.select("w").distinct().join(counts.select(F.col("key").alias("w"), "n"), "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    tried = own.mapInPandas(run, "w string, n long, stage int, printed string, m long")
    sure = tried.where("m is not null")
    if floor >= PRINTED:
        tried = settle(tried)
        rare = counts.where((F.col("n") >= PRINTED) & (F.col("n") <= floor)).select(F.col("key").alias("printed"), F.col("n").alias("m"))
        found = tried.where("m is null").drop("m").join(rare, "printed").where(F.col("m") >= TIMES * F.col("n"))
        sure = tried.where("m is not null").unionByName(found)
    best = sure.groupBy("w").agg(F.max("n").alias("n"), F.min_by("printed", F.struct("stage", -F.col("m"), "printed")).alias("printed"))
    return best.where("n > 0 or printed is not null")


def neighbours(facts: DataFrame) -> DataFrame:
    """Adds ``next_head`` and ``last_tail``: the head of the paper's next page that has text, the tail of the one before.

    In two steps, within blocks of pages and over the edges of blocks, so that a paper of any size is spread over tasks."""
    text = facts.where("head is not null").select("doc_id", "page_number", "head", "tail", F.floor(F.col("page_number") / BLOCK).alias("block"))
    near = Window.partitionBy("doc_id", "block").orderBy("page_number")
    blocks = text.groupBy("doc_id", "block").agg(F.min_by("head", "page_number").alias("h"), F.max_by(F.struct("tail"), "page_number").alias("t"))
    far = Window.partitionBy("doc_id").orderBy("block")
    blocks = blocks.select("doc_id", "block", F.lead("h").over(far).alias("h"), F.lag("t").over(far).getField("tail").alias("t"))
    text = text.withColumn("first", F.row_number().over(near) == 1).withColumn("hn", F.lead("head").over(near)).withColumn("tl", F.lag("tail").over(near))
    text = text.join(blocks, ["doc_id", "block"])
    return facts.join(text.select("doc_id", "page_number", F.coalesce("hn", "h").alias("next_head"), F.when(F.col("first"), F.col("t")).otherwise(F.col("tl")).alias("last_tail")), ["doc_id", "page_number"], "left")


def _paragraph_ends(lines: list[str]) -> list[bool]:
    """For each line, whether a paragraph ends with it: a blank follows, a heading or table row stands alone, or it ends a sentence short of the usual width."""
    width = sorted(map(len, lines))[int(len(lines) * 0.8)] if lines else 0
    ends = []
    for x, y in zip(lines, [*lines[1:], None]):
        alone = bool(re.match(r"\d+(?:\.\d+)*\.? [A-ZÄÖÜÉ]", x)) and len(x) < 0.75 * width and not re.search(r"[.!?]$", x) or " | " in x
        after = y is not None and (bool(re.match(r"\d+(?:\.\d+)*\.? [A-Z]", y)) and len(y) < 0.75 * width and not re.search(r"[.,;!?]", y) or " | " in y)
        ends.append(alone or after or bool(re.search(r"[.!?:][)\"”’]?$", x)) and len(x) < 0.9 * width)
    return ends


def _repair(fixer: Repairer, row) -> tuple[list[tuple[int, str]], list[tuple[bool, str]]]:
    """(line_no, noise) of a page, and its repaired parts with whether each begins a paragraph."""
    fixer.more = {x["w"]: (x["n"], x["printed"]) for x in (row.more if row.more is not None else ())}
    lines = row.text.split("\n")
    drop = {**{n: "running" for n in (row.running if row.running is not None else [])}, **{n: "page_no" for n in (row.page_no if row.page_no is not None else [])}}
    noise = sorted(drop.items())
    body = [(n, x) for n, x in enumerate(lines, 1) if n not in drop and x.strip()]
    tokens = [x.split() for _, x in body]
    skip_first = False
    if body and row.last_tail and fixer.broken(row.last_tail, tokens[0][0]):
        skip_first = True
        a, b = row.last_tail[:-1].strip(_STRIP), tokens[0][0].strip(_STRIP)
        fixed = fixer.token(a + b)
        if fixed is not None and _where(a + b, fixed) >= len(a):
            noise.append((body[0][0], "ocr"))
    misread = {n for n, k in noise if k == "ocr"}
    out: list[list[str]] = []
    for i, (n, _) in enumerate(body):
        words_, start = list(tokens[i]), 0
        if skip_first:
            start = 1
        skip_first = False
        last = words_[-1]
        after = tokens[i + 1][0] if i + 1 < len(body) else row.next_head
        joined = None
        if len(last) > 1 and last[-1] in BREAKS and after and len(words_) > start and fixer.broken(last, after):
            noise.append((n, "hyphen"))
            a = last[:-1]
            joined = a + after
            fixed = fixer.token(joined)
            if fixed is not None:
                if _where(joined.strip(_STRIP), fixed) < len(a.strip(_STRIP)):
                    misread.add(n)
                elif i + 1 < len(body):
                    misread.add(body[i + 1][0])
                joined = _like(joined, fixed)
            skip_first = True
        line = []
        for t in words_[start : len(words_) - (joined is not None)]:
            fixed = fixer.token(t)
            if fixed is not None:
                misread.add(n)
                t = _like(t, fixed)
            line.append(t)
        if joined is not None:
            line.append(joined)
        out.append(line)
    noise = [x for x in noise if x[1] != "ocr"] + [(n, "ocr") for n in sorted(misread)]
    ends = _paragraph_ends([x.strip() for _, x in body])
    parts: list[tuple[bool, str]] = []
    fresh = bool(body) and not row.last_tail and bool(re.match(r"\d+(?:\.\d+)*\.? [A-Z]", body[0][1]))
    text: list[str] = []
    for line, end in zip(out, ends):
        text += line
        if end:
            if text:
                parts.append((fresh, " ".join(text)))
            text, fresh = [], True
    if text:
        parts.append((fresh, " ".join(text)))
    return noise, parts


def _where(a: str, b: str) -> int:
    """The first place at which two words differ."""
    a = a.lower()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _like(token: str, fixed: str) -> str:
    """``fixed`` with the capital and the punctuation of ``token``."""
    core = token.strip(_STRIP)
    at = token.find(core) if core else 0
    if core[:1].isupper() or core[:1].isdigit() and token[1:2].isupper():
        fixed = fixed[:1].upper() + fixed[1:]
    return token[:at] + fixed + token[at + len(core) :]


def repaired(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, noise array<struct<line_no int, noise string>>, parts array<struct<fresh boolean, text string>>).

    The vocabulary is counted over all different pages. What is sent to the tasks are its frequent words, at most WORDS whatever the corpus; of
    all others a page gets what it asks for by joins, so the result is that of the whole vocabulary. Empty pages have no noise and
    no parts; papers of one page have no running lines; very long pages are read whole. Duplicate scans count once."""
    once = settle(scanned(pages))
    tally = settle(tallied(once.select("text").distinct()))
    counts = tally.where("word")
    floor = (counts.agg(F.sum("n")).first()[0] or 0) / WORDS
    words = once.sparkSession.sparkContext.broadcast({r.key: r.n for r in counts.where(F.col("n") > floor).select("key", "n").collect()})
    lines = settle(edges_of(once, words))
    edges = lines.where("side < 2")
    near = neighbours(settle(page_facts(edges, tally.where("not word").select(F.col("key").alias("norm")))))
    if floor < 1:  # every word is a frequent one
        near = near.withColumn("more", F.lit(None).cast("array<struct<w:string,n:bigint,printed:string>>"))
    else:
        near = settle(near)

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fixer = Repairer(words.value)
            for batch in batches:
                yield pd.DataFrame([(d, p, w) for d, p, a, b in zip(*(batch[c] for c in batch.columns)) for w in fixer.asks_broken(a, b)], columns=["doc_id", "page_number", "w"])

        here = "doc_id string, page_number int, w string"
        ends = near.where("tail is not null and next_head is not null").select("doc_id", "page_number", "tail", "next_head").mapInPandas(over, here)
        starts = near.where("last_tail is not null and head is not null").select("doc_id", "page_number", "last_tail", "head").mapInPandas(over, here)
        asked = lines.where("side = 2").select("doc_id", "page_number", F.col("head").alias("w")).unionByName(ends).unionByName(starts).distinct()
        more = asked.join(lexicon(asked, counts, words, floor), "w").groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("w", "n", "printed")).alias("more"))
        near = near.join(more, ["doc_id", "page_number"], "left")
    rows = once.join(near, ["doc_id", "page_number"], "left").select("doc_id", "page_number", "text", "page_no", "running", "next_head", "last_tail", "more")
    made: list[Repairer] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Repairer(words.value))
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                noise, parts = _repair(made[0], row)
                out.append((row.doc_id, row.page_number, [{"line_no": n, "noise": k} for n, k in noise], [{"fresh": f, "text": t} for f, t in parts]))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "noise", "parts"])

    return rows.mapInPandas(run, "doc_id string, page_number int, noise array<struct<line_no:int,noise:string>>, parts array<struct<fresh:boolean,text:string>>")


def page_noise(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, noise)."""
    return repaired(pages).select("doc_id", "page_number", F.explode("noise").alias("x")).select("doc_id", "page_number", "x.line_no", "x.noise").distinct()


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, para_no, text): the paragraphs of each paper, numbered from 1 on the page where they begin; one that
    runs over a page's end stands whole. Paragraph starts are carried forward within blocks of pages and then over blocks."""
    parts = settle(repaired(pages).select("doc_id", "page_number", F.posexplode("parts").alias("i", "p")).select("doc_id", "page_number", "i", "p.fresh", "p.text", F.floor(F.col("page_number") / BLOCK).alias("block")))
    start = F.when(F.col("fresh"), F.struct("page_number", "i"))
    near = Window.partitionBy("doc_id", "block").orderBy("page_number", "i").rowsBetween(Window.unboundedPreceding, 0)
    blocks = parts.groupBy("doc_id", "block").agg(F.max(start).alias("s"), F.min(F.struct("page_number", "i")).alias("f"))
    far = Window.partitionBy("doc_id").orderBy("block")
    blocks = blocks.select("doc_id", "block", F.coalesce(F.last("s", True).over(far.rowsBetween(Window.unboundedPreceding, -1)), F.first("f").over(far.rowsBetween(Window.unboundedPreceding, 0))).alias("before"))
    parts = parts.withColumn("s", F.last(start, True).over(near)).join(blocks, ["doc_id", "block"]).withColumn("s", F.coalesce("s", "before"))
    whole = parts.groupBy("doc_id", F.col("s.page_number").alias("page_number"), F.col("s.i").alias("i")).agg(F.array_sort(F.collect_list(F.struct("page_number", "i", "text"))).alias("t"))
    return whole.select("doc_id", "page_number", (F.col("i") + 1).alias("para_no"), F.array_join(F.transform("t", lambda x: x.text), " ").alias("text"))
