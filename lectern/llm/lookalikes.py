"""Problem 3: one consistent form for text that reads the same but is coded differently."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that look like a Latin letter, as "latin: others". The first others are drawn
# alike in common type; those after a bar only resemble it.
LOOKALIKES = """
a: а | ɑ
b: | Ꮟ Ь
c: с ϲ ᴄ ⲥ
d: ԁ | Ꮷ
e: е | ҽ
g: ɡ | ց
h: һ | հ Ꮒ
i: і | ι ı ɩ Ꭵ
j: ј ϳ
k: | κ к
l: ӏ | ǀ
m: | м ᴍ
n: | ո
o: о ο օ ᴏ ⲟ | σ
p: р | ρ ⲣ
q: ԛ | գ զ
r: | г ᴦ
s: ѕ ꜱ
u: ᴜ | υ ս
v: ѵ ᴠ | ν
w: ԝ ᴡ | ѡ
x: х | χ
y: у | γ ү ყ Ꭹ
z: ᴢ
A: А Α Ꭺ ꓮ
B: В Β Ᏼ ꓐ | Ⲃ
C: С Ϲ Ꮯ ꓚ Ⲥ
D: Ꭰ ꓓ
E: Е Ε Ꭼ ꓰ
F: Ϝ ꓝ
G: Ꮐ ꓖ | Ԍ Ᏻ
H: Н Η Ꮋ ꓧ Ⲏ
I: І Ι Ӏ ꓲ Ⲓ
J: Ј Ϳ Ꭻ ꓙ
K: К Κ Ꮶ ꓗ Ⲕ
L: Ꮮ ꓡ
M: М Μ Ϻ Ꮇ ꓟ Ⲙ
N: Ν ꓠ Ⲛ
O: О Ο Օ ꓳ Ⲟ
P: Р Ρ Ꮲ ꓑ Ⲣ
Q: | Ԛ
R: Ꭱ Ꮢ ꓣ
S: Ѕ Տ Ꮪ ꓢ | Ꮥ
T: Т Τ Ꭲ ꓔ Ⲧ
U: ꓴ | Ս
V: Ꮩ ꓦ | Ѵ
W: Ꮃ ꓪ | Ԝ Ꮤ
X: Х Χ ꓫ Ⲭ
Y: Ү Υ Ꮍ ꓬ | У Ⲩ
Z: Ζ Ꮓ ꓜ
"""



def _char_class(chars: list[str]) -> re.Pattern[str]:
    """A pattern of one of the characters, as ranges."""
    codes, parts = sorted(map(ord, chars)), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]")


_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000)]))
IGNORABLE = _char_class(regex.findall(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]|[\p{Cc}--\s]", _ALL, regex.V1))
_MARKS = {**dict.fromkeys(regex.findall(r"\p{Pd}", _ALL) + list("−⁃˗"), "-"), **dict.fromkeys("‘’‛ʼ′´`", "'"), **dict.fromkeys("“”‟″", '"')}
_MARKED = _char_class([m for m in _MARKS if m not in "-`"])

#: Cost, in natural-log units, of taking a letter for one drawn alike, for one that only resembles it, and of a change of script inside a word.
ALIKE, RESEMBLES, MIXED = 1.0, 6.0, 12.0
#: Characters of phrases that are sent to the tasks in one pass.
PASS = 8_000_000


def _alternatives() -> dict[str, list[tuple[str, float]]]:
    """For every letter of the table, all letters it may stand for, with the cost."""
    out: dict[str, list[tuple[str, float]]] = {}
    for line in LOOKALIKES.strip().splitlines():
        latin, _, others = line.partition(":")
        same, _, similar = others.partition("|")
        for letters, cost in ((same.split(), ALIKE), (similar.split(), RESEMBLES)):
            for x in letters:
                out.setdefault(x, [(x, 0.0)]).append((latin, cost))
                # back from a Latin letter: only inside words of the other script
                out.setdefault(latin, [(latin, 0.0)]).append((x, cost))
    return out


ALTERNATIVES = _alternatives()


def script(ch: str) -> str:
    """The script of a letter: the first word of its Unicode name; "" for what isn't a letter."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""


def plain(text: str) -> str:
    """Compatibility form without ignorable characters, with one kind of dash and quote, and single spaces between words."""
    if IGNORABLE.search(text):
        text = IGNORABLE.sub("", text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
            if IGNORABLE.search(text):
                text = unicodedata.normalize("NFKC", IGNORABLE.sub("", text))
        if _MARKED.search(text):
            text = _MARKED.sub(lambda m: _MARKS[m.group()], text)
    return " ".join(text.split())


_DRAWN = {c: o[1][0] for c, o in ALTERNATIVES.items() if not c.isascii() and len(o) > 1 and o[1][1] == ALIKE}
_DRAWN_ALIKE = _char_class(list(_DRAWN))


def latin(text: str) -> str:
    """Every letter that is drawn like a Latin one as that one, without regard to its word: for keys, not for reading."""
    return text if text.isascii() or not _DRAWN_ALIKE.search(text) else _DRAWN_ALIKE.sub(lambda m: _DRAWN[m.group()], text)


class LatticeDecoder:
    """Viterbi over the lattice of look-alikes of a word, under character bigrams and script consistency.

    ``bigrams`` maps two letters (lower case; a space stands for a word's edge) to their count; letters outside
    the look-alike table are one class, so the model is bounded by the square of the table whatever the corpus."""

    def __init__(self, bigrams: dict[str, int]):
        self.total: dict[str, int] = {}
        for pair, n in bigrams.items():
            self.total[pair[0]] = self.total.get(pair[0], 0) + n
        self.bigrams, self.size = bigrams, max(2, len({p[1] for p in bigrams}))
        self.words: dict[str, str] = {}

    def cost(self, a: str, b: str) -> float:
        a, b = letter_class(a), letter_class(b)
        return -math.log((self.bigrams.get(a + b, 0) + 0.5) / (self.total.get(a, 0) + 0.5 * self.size))

    def word(self, word: str) -> str:
        """The cheapest reading of a word whose letters are of several scripts; a word of one script stays as it is."""
        if word in self.words:
            return self.words[word]
        if len({script(c) for c in word} - {""}) < 2:
            self.words[word] = word
            return word
        paths = {("", " "): (0.0, "")}  # (script so far, last letter) -> cost, reading
        for ch in word:
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for other, change in ALTERNATIVES.get(ch, [(ch, 0.0)]):
                kind = script(other)
                for (was, last), (cost, read) in paths.items():
                    c = cost + change + self.cost(last, other) + (MIXED if kind and was and kind != was else 0.0)
                    key = (kind or was, other)
                    if key not in step or c < step[key][0]:
                        step[key] = (c, read + other)
            paths = step
        best = min((c + self.cost(last, " "), read) for (_, last), (c, read) in paths.items())[1]
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[word] = best
        return best

    def text(self, text: str) -> str:
        """The consistent form of a text; case stays."""
        text = plain(text)
        if not text.isascii():
            strange = self.strange(text)
            parts = [w if w.isascii() else self.run(w, strange) for w in text.split(" ")]
            text = unicodedata.normalize("NFC", " ".join(parts))
        return text

    def strange(self, text: str) -> bool:
        """Whether a text has Latin words and no word of another script with a letter that is not drawn like a Latin one, so that words of
        nothing but such letters are Latin ones too."""
        latin_ = False
        for m in _LETTERS.finditer(text):
            w = m.group()
            if w.isascii():
                latin_ = latin_ or len(w) > 1
                continue
            kinds = {script(c) for c in w} - {""}
            if len(kinds) > 1:
                latin_ = latin_ or {script(c) for c in self.word(w)} - {""} == {"LATIN"}
            elif kinds == {"LATIN"}:
                latin_ = latin_ or len(w) > 1
            elif len(w) > 1 and not all(c in _DRAWN for c in w):
                return False
        return latin_

    def run(self, chunk: str, strange: bool = False) -> str:
        """The words of a stretch without blanks; where they are ``strange``, those drawn like Latin ones throughout as these."""

        def read(m: regex.Match) -> str:
            w = m.group()
            return w if w.isascii() else latin(w) if strange and all(c in _DRAWN for c in w) else self.word(w)

        return _LETTERS.sub(read, chunk)


_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_WORD = re.compile(r"[^\W\d_]+")
_CLASSES = {c.lower() for c in ALTERNATIVES} | set("abcdefghijklmnopqrstuvwxyz ")


_OTHERS = re.compile("[^" + "".join(sorted(c for c in _CLASSES if c != " ")) + "]")


def letter_class(ch: str) -> str:
    """The letter itself, in lower case, if the model tells it apart, else one sign for all others."""
    ch = ch.lower()
    return ch if ch in _CLASSES else "*"


def letter_bigrams(texts: DataFrame) -> DataFrame:
    """(pair, n): counts over all texts of letter pairs inside words and at their edges.

    A task counts words and takes the pairs of different words only; what it hands on, and the result, has at most the square
    of the look-alike table's rows a batch of words, whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            pairs: Counter[str] = Counter()
            for w, n in words.items():
                ring = f" {_OTHERS.sub('*', w)} "
                for i in range(len(ring) - 1):
                    pairs[ring[i : i + 2]] += n
            words.clear()
            return pd.DataFrame(list(pairs.items()), columns=["pair", "n"])

        for batch in batches:
            for t in batch["text"]:
                words.update(_WORD.findall(t.lower()))
            if len(words) > 200_000:
                yield flush()
        yield flush()

    return texts.where("text is not null").select("text").mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def bigram_model(texts: DataFrame) -> dict[str, int]:
    """The counts as a dictionary; bounded by the square of the alphabet of the look-alike table (about 12 000)."""
    bound = (len(_CLASSES) + 1) ** 2
    return {r.pair: r.n for r in letter_bigrams(texts).limit(bound + 1).collect()}


def canonical_udf(spark: SparkSession, bigrams: dict[str, int]):
    """A pandas UDF string -> string; NULL stays NULL."""
    shared = spark.sparkContext.broadcast(bigrams)
    made: list[LatticeDecoder] = []

    @F.pandas_udf("string")
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(LatticeDecoder(shared.value))
        for texts in batches:
            yield pd.Series([None if t is None else made[0].text(t) for t in texts], dtype=object)

    return canonical


def canonical_texts(df: DataFrame, column: str = "text", bigrams: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``column`` in the consistent form: compatibility normalisation, ignorable characters gone,
    every word read through its look-alike lattice, one kind of space, dash and quote.

    The letter statistics come from all rows of ``df`` unless given. Narrow apart from them. NULL stays NULL, empty
    stays empty, texts are taken whole, repeated rows stay repeated, other columns are untouched."""
    if bigrams is None:
        bigrams = bigram_model(df.select(F.col(column).alias("text")))
    return df.withColumn(column, canonical_udf(df.sparkSession, bigrams)(F.col(column)))


def phrase_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, phrase_no, doc_id, chunk_id, stored boolean): phrases that a reader sees in a chunk of the
    query's paper; ``stored`` tells whether the phrase as stored stands in the chunk as stored.

    The phrases, a stated set, are sent to the tasks in passes of at most PASS characters, as one automaton that reads each chunk once;
    no text is shuffled, and a paper with many chunks and phrases lies in many tasks. Only chunks of papers with a query are
    read. Queries and chunks delivered more than once count once. NULL texts, phrases and keys, and phrases without a visible
    character, give no row."""
    bigrams = bigram_model(chunks.select("text"))
    spark = chunks.sparkSession
    asked = queries.where("id is not null and doc_id is not null").select(F.col("id").alias("query_id"), "doc_id", F.posexplode("must_contain").alias("phrase_no", "phrase"))
    asked = asked.where("phrase is not null").distinct().withColumn("phrase_no", F.col("phrase_no") + 1)
    passes = int((asked.agg(F.sum(F.length("phrase"))).first()[0] or 0) // PASS) + 1
    there = chunks.where("doc_id is not null and chunk_id is not null and text is not null").select("doc_id", "chunk_id", "text")
    found = []
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("query_id", "phrase_no"), F.lit(passes)) == p) if passes > 1 else asked
        shared = spark.sparkContext.broadcast((bigrams, [tuple(r) for r in part.select("query_id", "doc_id", "phrase_no", "phrase").collect()]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            decoder, machine, papers = LatticeDecoder(shared.value[0]), ahocorasick.Automaton(), set()
            by: dict[str, dict[str, list[tuple[str, int, str]]]] = {}
            for query, paper, no, phrase in shared.value[1]:
                read = decoder.text(phrase).lower().strip()
                if read:
                    papers.add(paper)
                    by.setdefault(read, {}).setdefault(paper, []).append((query, no, phrase.lower()))
            for read, asks in by.items():
                machine.add_word(read, asks)
            machine.make_automaton()
            for batch in batches:
                rows = []
                for paper, chunk, text in zip(batch["doc_id"], batch["chunk_id"], batch["text"]) if by else ():
                    if paper in papers:
                        hits = {id(asks): asks for _, asks in machine.iter(decoder.text(text).lower()) if paper in asks}
                        low = text.lower() if hits else ""
                        rows += [(query, no, paper, chunk, phrase in low) for asks in hits.values() for query, no, phrase in asks[paper]]
                yield pd.DataFrame(rows, columns=["query_id", "phrase_no", "doc_id", "chunk_id", "stored"])

        found.append(there.mapInPandas(run, "query_id string, phrase_no int, doc_id string, chunk_id int, stored boolean"))
    return reduce(DataFrame.unionByName, found).groupBy("query_id", "phrase_no", "doc_id", "chunk_id").agg(F.max("stored").alias("stored"))
