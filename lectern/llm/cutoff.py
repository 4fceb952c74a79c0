"""Problem 9: texts that were cut before their end."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.lookalikes import latin, plain
from lectern.runtime import settle

#: One word in so many is common, and a sentence has at least four of these; of so many times its own count another word with the
#: same beginning makes a word a cut one; the share of a word's places at which a sentence ends from which on it may end a text.
COMMON, LONGER, ENDING = 20_000, 20, 0.5
#: A length is a limit of its source if at least ROWS different texts have it, PEAK times as many as a length nearby (NEAR on each
#: side) has on average, and SIGMA standard deviations more.
ROWS, PEAK, SIGMA, NEAR = 5, 3, 6, 25
#: Different words that a task counts before it hands the counts on.
HELD = 200_000

# Abbreviations that end no sentence; marks put where a text was cut.
ABBREVIATIONS = set("al. e.g. i.e. eq. eqs. fig. figs. sec. cf. vs. dr. prof. ref. refs. tab. vol. z.b. bzw. ca. p. pp. ej. approx.".split())
_MARK = re.compile(r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|�|&[a-z]{0,6}|\[(?:truncated|cut|more|continued)\]?|\(more\)|read more)\s*$", re.I)
_CLOSED = re.compile(r"[.!?。！？][)\]\"'”’»]*$")
_SENTENCE = re.compile(r"[^\W\d_]{2,}(?:[\s,;:()\-]+\S+){3,}")
_ROW = re.compile(r"^(?:[-*•]\s|\d+[.)]\s|\[\d+\]|(?:keywords?|contents?|received|submitted|accepted|index terms|tags|see also|subject|categories|schlagwörter|palabras clave|mots[- ]clés)\b)|\s\|\s|\t", re.I)
_TITLE = re.compile(r"\d+(?:\.\d+)*\.?\s+[^\W\d_][\w\-]*(?:\s+[\w\-]+){0,3}|[A-ZÀ-Þ][\w.\-]*(?:\s+[A-ZÀ-Þ][\w.\-]*){1,3}")
_LAST = re.compile(r"[^\W\d_]+$")
_WORD = re.compile(r"[^\W\d_]+(?:[.!?]+(?=\s+[^\W\da-z_]))?")


class WordTrie:
    """The trie of some words, laid out as a sorted array: a node is the range of words with its prefix."""

    def __init__(self, counts: dict[str, int]):
        self.words = sorted(counts)
        self.counts = [counts[w] for w in self.words]
        self.known = counts

    def node(self, prefix: str) -> tuple[int, int]:
        return bisect_left(self.words, prefix), bisect_left(self.words, prefix + "\U0010ffff")

    def cut_word(self, token: str) -> bool:
        """Whether the token is a proper prefix of known words and as good as unknown itself."""
        lo, hi = self.node(token)
        own = self.counts[lo] if lo < hi and self.words[lo] == token else 0
        longer = max(self.counts[lo + (own > 0) : hi], default=0)
        return longer > 0 and longer >= LONGER * own


def word_counts(documents: DataFrame) -> DataFrame:
    """(w, n, e): how often each word stands in the texts, and how often a sentence ends with it. The last word of a text, which is
    to be judged, teaches nothing. Counted within the tasks before the shuffle; every word is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            rows = [(k.rstrip(".!?"), n, n if k[-1] in ".!?" else 0) for k, n in counts.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=["w", "n", "e"])

        for batch in batches:
            for t in batch["text"]:
                head = t.rsplit(None, 1)
                if len(head) > 1:
                    counts.update(x.lower() for x in _WORD.findall(head[0]))
            if len(counts) > HELD:
                yield flush()
        yield flush()

    return documents.select("text").mapInPandas(run, "w string, n long, e long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def trie_nodes(counts: DataFrame) -> DataFrame:
    """(prefix, own, ends, longer): the corpus trie as a table, a row a node: the count of the word that ends there, how often it ends a
    sentence, and the largest count of a longer word. All words are in it; a task that reads a part of them combines it first."""
    size = F.length("w")
    at = counts.select("w", "n", "e", F.explode(F.sequence(F.lit(1), size)).alias("k")).select(F.substring("w", F.lit(1), F.col("k")).alias("prefix"), (F.col("k") == size).alias("whole"), "n", "e")
    return at.groupBy("prefix").agg(
        F.coalesce(F.sum(F.when(F.col("whole"), F.col("n"))), F.lit(0)).alias("own"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("e"))), F.lit(0)).alias("ends"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("n"))), F.lit(0)).alias("longer")
    )


def length_limits(sizes: DataFrame) -> DataFrame:
    """(source, measure, size) of rows (source, chars, bytes, digest): lengths in characters or UTF-8 bytes at which conspicuously many different
    texts of a source end, more than at the lengths nearby. What a limit must stand out from is measured there, so that one is found
    alike in small and large sources; only counts a length are ordered."""
    texts = sizes.groupBy("source", "digest").agg(F.max("chars").alias("chars"), F.max("bytes").alias("bytes"))
    both = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("size"))))
    by = texts.select("source", both.alias("s")).groupBy("source", "s").agg(F.count(F.lit(1)).alias("n")).select("source", "s.*", "n")
    near = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-NEAR, NEAR)
    by = by.withColumn("usual", (F.sum("n").over(near) - F.col("n")) / (2 * NEAR))
    return by.where((F.col("size") > 40) & (F.col("n") >= ROWS) & (F.col("n") >= PEAK * F.col("usual")) & (F.col("n") >= F.col("usual") + SIGMA * F.sqrt("usual"))).select("source", "measure", "size")


def ending(text: str, trie: WordTrie) -> tuple[str, str]:
    """(how a text ends, its last word in small letters, or "" where it ends with another sign).

    "mark": at a cut mark; "open": without a mark that ends a sentence; "row": after a table row, list item, reference, title or the like;
    "closed": at a sentence's end; "none": there is no sentence, that is none with four of the trie's words, at all."""
    flat = text.rstrip()
    cut = flat
    m = _MARK.search(flat)
    if m:
        cut = flat[: m.start()].rstrip()
    lines = [x for x in cut.split("\n") if x.strip()]
    if not lines:
        return "none", ""
    last = latin(plain(lines[-1]))
    found = _LAST.search(last)
    word = found.group().lower() if found else ""
    prose = (latin(plain(x)) for x in lines if not _ROW.search(x))  # read up to the first sentence
    if not any(_SENTENCE.search(x) and sum(w.lower() in trie.known for w in re.findall(r"[^\W\d_]+", x)) >= 4 for x in prose):
        return "none", word
    if m:
        return "mark", word
    if _CLOSED.search(last):
        end = last.split()[-1].lower().strip("()[]\"'")
        return ("open" if end in ABBREVIATIONS and len(last.split()) > 2 else "closed"), ""
    if _ROW.search(lines[-1]) or len(lines) > 1 and _TITLE.fullmatch(last.strip()):
        return "row", word
    return "open", word


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, broken, goes_on, at_limit, is_cut) of every document with a text.

    ``broken``: the trie knows the last word only as the beginning of other words; ``goes_on``: it knows the
    word, but seldom as the last of a sentence; ``at_limit``: the length is a limit of the source. A text is cut if it ends at a cut mark;
    if it ends without a sentence's mark and the last word is broken or goes on, or no word is there, or the length is a limit; and if it
    ends in a row or title and the last word is broken or the length is a limit. Texts without any sentence are not cut.

    The texts are read twice, for the words, counted over whole texts, and for their endings; the trie is a table that the last words are
    joined with, and only the words of which there are one in COMMON, at most so many, are sent to the tasks, to tell sentences.
    NULL and blank texts have no row; a NULL source is a source of its own; repeated ids give repeated rows."""
    docs = documents.where(F.col("doc_id").isNotNull() & (F.trim("text") != "")).select("doc_id", "source", "text")
    counts = settle(word_counts(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    shared = documents.sparkSession.sparkContext.broadcast({r.w: r.n for r in counts.where(F.col("n") > total / COMMON).select("w", "n").collect()})
    made: list[WordTrie] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(WordTrie(shared.value))
        for batch in batches:
            found = [ending(t, made[0]) for t in batch["text"]]
            out = batch[["doc_id", "source", "chars", "bytes", "digest"]].reset_index(drop=True)
            yield out.assign(ending=[a for a, _ in found], word=[w for _, w in found])

    kind = documents.schema["doc_id"].dataType.simpleString()
    sized = docs.withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text")).withColumn("digest", F.xxhash64("text"))
    rows = settle(sized.mapInPandas(run, f"doc_id {kind}, source string, chars int, bytes int, digest long, ending string, word string"))
    limits = length_limits(rows)
    for measure in ("chars", "bytes"):
        own = limits.where(F.col("measure") == measure).select(F.col("source").alias("s"), F.col("size").alias("z"), F.lit(True).alias(f"at_{measure}"))
        rows = rows.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col(measure) == F.col("z")), "left").drop("s", "z")
    rows = rows.join(trie_nodes(counts).withColumnRenamed("prefix", "word"), "word", "left")
    own, longer, ends = (F.coalesce(c, F.lit(0)) for c in ("own", "longer", "ends"))
    at_limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    broken = (F.col("word") != "") & (longer > 0) & (longer >= LONGER * own)
    goes_on = (F.col("word") != "") & (own > 0) & (ends < ENDING * own)
    rows = rows.select("doc_id", "source", "ending", "word", broken.alias("broken"), goes_on.alias("goes_on"), at_limit.alias("at_limit"))
    is_open = (F.col("ending") == "open") & (F.col("broken") | F.col("goes_on") | F.col("at_limit") | (F.col("word") == ""))
    is_cut = (F.col("ending") == "mark") | is_open | ((F.col("ending") == "row") & (F.col("broken") | F.col("at_limit")))
    return rows.select("doc_id", "source", "ending", "broken", "goes_on", "at_limit", is_cut.alias("is_cut"))


def cut_share(documents: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, cut_share) over the documents that have a text."""
    rows = endings(documents).dropDuplicates(["doc_id"])
    return rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("is_cut").cast("long")).alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("cut_share"))
