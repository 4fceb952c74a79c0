"""Problem 6: questions of evaluation splits that the training split also holds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.lookalikes import latin, plain
from lectern.operators.ranking import latest_by
from lectern.runtime import settle

#: How many times as frequent as a word the one is of which it is a misspelling; the share of a word's questions that are about a paper
#: with the word in its title, from which on it is a paper's name.
MISSPELT, NAMING = 20, 0.8
#: Of a rewording: papers in which it is seen, the share of the places of its rarest word at which it is seen, words exchanged, and
#: the hashes by which questions with a rewording between them are brought together.
SEEN, SHARE, EXCHANGED, HASHES = 3, 0.5, 3, 6

# Spellings of the splits; words that carry no condition.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test", "eval": "test"}
STOP = set("a an and are as at be been being by can could did do does for from had has have how i if in into is it its many me much of on once only or please q say tell that the their then there these this those to was we were what when where which who why will with would you your paper authors author question answer according just also".split())

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*(?:e[+-]?\d+)?|[^\W\d_]+(?:\d+)?(?:/[^\W\d_]+)?")


def tokens(text: str) -> list[str]:
    """Lower-case words and numbers after compatibility normalisation; hyphens part words."""
    return _TOKEN.findall(latin(plain(text)).lower().replace("'s ", " "))


def title_key(title: str) -> str:
    """A title without case, punctuation and white space."""
    return "".join(c for c in latin(plain(title)).lower() if c.isalnum())


def number(token: str) -> str:
    try:
        return repr(float(token.replace(",", "")))
    except ValueError:
        return token


def one_edit(a: str, b: str) -> bool:
    """At most one letter inserted, left out, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def parsed(records: DataFrame) -> DataFrame:
    """(id, part, title, doc_id, tokens, named): the question's tokens, numbers by value, and the words of the paper's title that may be its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["id", "part", "doc_id"]].reset_index(drop=True)
            titles = [p if p is not None else "" for p in batch["paper"]]
            yield out.assign(
                title=[title_key(t) for t in titles],
                tokens=[[number(t) if t[0].isdigit() else t for t in tokens(q)] for q in batch["question"]],
                named=[sorted({t for t in tokens(p) if len(t) > 3 and not t[0].isdigit()}) for p in titles],
            )

    return records.mapInPandas(run, "id string, part string, doc_id string, title string, tokens array<string>, named array<string>")


def one_edit_pairs(some: DataFrame, others: DataFrame) -> DataFrame:
    """(w, n, v, m): the words of (w, n) with those of ``others`` that are one edit away.

    Words meet by what is left of them when a letter is left out, an equi-join of distinct words, and are then compared."""

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(g, w, n) for w, n in zip(batch["w"], batch["n"]) if len(w) > 3 for g in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}]
            yield pd.DataFrame(rows, columns=["gap", "w", "n"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[one_edit(w, v) for w, v in zip(batch["w"], batch["v"])]]

    left, right = (x.select("w", "n").mapInPandas(gaps, "gap string, w string, n long") for x in (some, others))
    pairs = left.join(right.select("gap", F.col("w").alias("v"), F.col("n").alias("m")), "gap").where("w <> v").select("w", "n", "v", "m").distinct()
    return pairs.mapInPandas(near, "w string, n long, v string, m long")


def misspellings(counts: DataFrame) -> DataFrame:
    """(w, v) of (w, n): each word that is one edit from a word MISSPELT times as frequent, with the most frequent such word."""
    pairs = one_edit_pairs(counts, counts.where(F.col("n") >= MISSPELT)).where(F.col("m") >= MISSPELT * F.col("n"))
    return pairs.groupBy("w").agg(F.max_by("v", F.struct("m", "v")).alias("v"))


def bags(rows: DataFrame) -> DataFrame:
    """(id, part, title, doc_id, numbers, words) of ``parsed`` rows: the numbers of each question and its content words, spelled as the
    corpus spells them, without those that name its own paper and those that carry no condition, in alphabetical order.

    What is known of words, over all questions, is a table that the words of each question and title are joined with."""
    used = F.filter(F.array_distinct("tokens"), lambda t: ~t.rlike("^[0-9]"))
    uses = rows.select("named", F.explode(used).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_contains("named", F.col("w")).cast("long")).alias("own"))
    uses = settle(uses)
    names = uses.where(F.col("own") >= NAMING * F.col("n")).select("w", "n")
    alike = one_edit_pairs(uses.where("length(w) > 4"), names).where("n <= m").groupBy("w").agg(F.collect_set("v").alias("near"))
    # of most words there is nothing to say, and questions are joined with the others only
    known = misspellings(uses.select("w", "n")).join(names.select("w", F.lit(True).alias("name")), "w", "full").join(alike, "w", "full")
    asked = rows.select("id", F.explode(F.array_union(used, "named")).alias("w")).join(known, "w").groupBy("id").agg(F.collect_list(F.struct("w", "name", "v", "near")).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, words = [], []
            for toks, named, found in zip(batch["tokens"], batch["named"], batch["known"]):
                about = {x["w"]: x for x in (found if found is not None else ())}
                names = {w for w in named if w in about and about[w]["name"]}
                own = []
                for t in toks:
                    of = about.get(t)
                    if t[0].isdigit() or t in STOP or t in names or of is not None and of["near"] is not None and not names.isdisjoint(of["near"]):
                        continue
                    t = of["v"] if of is not None and of["v"] else t
                    if t not in STOP:
                        own.append(t)
                numbers.append(sorted(t for t in toks if t[0].isdigit()))
                words.append(sorted(own))
            yield batch[["id", "part", "title", "doc_id"]].reset_index(drop=True).assign(numbers=numbers, words=words)

    return rows.join(asked, "id", "left").mapInPandas(run, "id string, part string, title string, doc_id string, numbers array<string>, words array<string>")


def rewordings(rows: DataFrame) -> DataFrame:
    """(anchor, old, new, n): words, at most EXCHANGED, that stand for others, learned from questions of one paper with the same numbers.

    What two such questions don't share is a rewording if the same exchange is seen in SEEN papers or more, or is of one word for
    one that begins alike and is at most two edits away, as forms of a word are, and the rarest of its words
    hardly ever stands anywhere else: at least SHARE of its questions have such a twin. Conditions and quantities are exchanged too,
    between questions that differ, but they stand mostly in questions without a twin. The rarer side, ``old``, gives way to the
    other; ``anchor`` is its rarest word. Questions meet their neighbours only, in groups of equal hashes, so what is joined
    grows with the questions and not with their pairs."""
    paper = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("#"), F.lower(F.trim("doc_id"))))
    each = settle(rows.select(paper.alias("paper"), "numbers", F.array_distinct("words").alias("words")).where("paper is not null and size(words) > 1").distinct())
    often = each.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("m"))

    def least(k: int) -> Column:
        return F.array_min(F.transform("words", lambda w: F.xxhash64(F.lit(k), w)))

    hashes = F.array(*[least(k) for k in range(HASHES)])
    near = each.where("size(numbers) > 0").select(F.xxhash64("paper").alias("paper"), F.xxhash64("paper", "numbers").alias("about"), "words", F.posexplode(hashes).alias("k", "h"))
    near = near.select("paper", F.xxhash64("about", "k", "h").alias("group"), "words")
    near = near.withColumn("other", F.lag("words").over(Window.partitionBy("group").orderBy("words"))).where("other is not null")
    pairs = near.select("paper", "words", "other").distinct().select("paper", F.array_except("words", "other").alias("a"), F.array_except("other", "words").alias("b"), F.size(F.array_intersect("words", "other")).alias("same"))
    pairs = pairs.where(F.size("a").between(1, EXCHANGED) & F.size("b").between(1, EXCHANGED) & (F.col("same") >= 2)).select("paper", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    one, two = F.element_at("a", 1), F.element_at("b", 1)
    forms = (F.size("a") == 1) & (F.size("b") == 1) & (F.least(F.length(one), F.length(two)) > 3) & (F.left(one, F.lit(2)) == F.left(two, F.lit(2))) & (F.levenshtein(one, two) <= 2)
    seen = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("paper").alias("papers")).where((F.col("papers") >= SEEN) | forms)
    seen = seen.withColumn("id", F.xxhash64("a", "b"))
    words = seen.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("ws")), F.struct(F.lit(1).alias("side"), F.col("b").alias("ws")))).alias("x")).select("id", "x.side", F.explode("x.ws").alias("w"))
    rare = words.join(often, "w").groupBy("id").agg(F.min(F.struct("m", "w", "side")).alias("r"))
    found = seen.join(rare, "id").where(F.col("n") >= SHARE * F.col("r.m"))
    first = F.col("r.side") == 0
    return found.select(F.col("r.w").alias("anchor"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("old"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("new"), "n")


def canonical(rows: DataFrame) -> DataFrame:
    """(id, part, title, doc_id, bag): ``bags`` with what ``rewordings`` teaches put in its usual words, as one string, empty if nothing is left."""
    rules = rewordings(rows)
    mine = rows.select("id", "words", F.explode(F.array_distinct("words")).alias("anchor")).join(rules, "anchor").where(F.size(F.array_except("old", "words")) == 0)
    mine = mine.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "old", "new")), asc=False).alias("rules"))
    put = lambda words, r: F.when(F.size(F.array_except(r.old, words)) == 0, F.concat(F.filter(words, lambda w: ~F.array_contains(r.old, w)), r.new)).otherwise(words)
    rows = rows.join(mine, "id", "left").withColumn("words", F.array_sort(F.aggregate(F.coalesce("rules", F.array().cast("array<struct<n:bigint,old:array<string>,new:array<string>>>")), F.col("words"), put)))
    return rows.select("id", "part", "title", "doc_id", F.array_join(F.concat("numbers", "words"), " ").alias("bag"))


def split_of(split) -> Column:
    """The split's name in one spelling; NULL for none and unknown ones."""
    clean = F.lower(F.trim(split))
    return F.coalesce(*[F.when(clean == k, v) for k, v in SPLITS.items()])


def records_of(benchmark: DataFrame, corpus_queries: DataFrame) -> DataFrame:
    """(id, part, paper, doc_id, question), once an id: the training rows, and as evaluation the other splits and all corpus queries."""
    a = latest_by(benchmark.select("id", "split", "paper", "doc_id", "question", "created_at").where("id is not null"), ["id"], "created_at", ["question", "split", "paper", "doc_id"])
    a = a.select("id", split_of(F.col("split")).alias("part"), "paper", "doc_id", "question").where("part is not null")
    b = corpus_queries.where("id is not null").groupBy("id").agg(F.max(F.struct("question", "paper", "doc_id")).alias("r")).select("id", F.lit("queries").alias("part"), "r.paper", "r.doc_id", "r.question")
    return a.unionByName(b).where("question is not null")


def keyed(records: DataFrame) -> DataFrame:
    """(id, part, title, doc_id, keys): hashes of paper and canonical question, one for each way in which the record names its paper.

    The canonical question is that of ``tokens``, without case, punctuation and white space, then of ``bags`` and ``canonical``. Questions
    without content words after that, and records that name no paper, have no keys."""
    rows = canonical(settle(bags(settle(parsed(records)))))
    by_title = F.when(F.col("title") != "", F.xxhash64(F.lit("t"), "title", "bag"))
    by_id = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("d"), F.lower(F.trim("doc_id")), "bag"))
    return rows.select("id", "part", "title", "doc_id", F.when(F.col("bag") != "", F.filter(F.array(by_title, by_id), lambda k: k.isNotNull())).alias("keys"))


def overlaps(benchmark: DataFrame, corpus_queries: DataFrame) -> DataFrame:
    """(id_train, id_eval, part, title) of every training row and evaluation record with a common key: an equi-join of hashes."""
    rows = keyed(records_of(benchmark, corpus_queries)).select("id", "part", "title", F.explode("keys").alias("key"))
    train = rows.where("part = 'train'").select(F.col("id").alias("id_train"), "key")
    held = rows.where("part <> 'train'").select(F.col("id").alias("id_eval"), "part", "title", "key")
    return train.join(held, "key").select("id_train", "id_eval", "part", "title").distinct()


def overlap_counts(benchmark: DataFrame, corpus_queries: DataFrame) -> DataFrame:
    """(part, title, n_eval, n_pairs): per split and paper, the evaluation records that training holds too and their pairs.

    A pair is one of ``overlaps``: equal by title, by id or by both, which counts once. Counted by class of equal questions,
    so a class of many copies costs no more than its rows."""
    rows = keyed(records_of(benchmark, corpus_queries)).where("size(keys) > 0")
    rows = settle(rows.select("part", "title", F.when(F.col("title") != "", F.element_at("keys", 1)).alias("t"), F.when(F.col("doc_id").isNotNull(), F.element_at("keys", -1)).alias("d")))
    train, held = rows.where("part = 'train'"), rows.where("part <> 'train'").groupBy("part", "title", "t", "d").agg(F.count(F.lit(1)).alias("n"))
    for name, by in (("by_t", ["t"]), ("by_d", ["d"]), ("by_both", ["t", "d"])):
        held = held.join(train.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by, "left")
    each = F.coalesce("by_t", F.lit(0)) + F.coalesce("by_d", F.lit(0)) - F.coalesce("by_both", F.lit(0))
    return held.withColumn("each", each).where("each > 0").groupBy("part", "title").agg(F.sum("n").alias("n_eval"), F.sum(F.col("n") * F.col("each")).alias("n_pairs"))
