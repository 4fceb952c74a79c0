"""The lexical index and its Okapi BM25 search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.topk import TopK, blocks, by_key, flat
from lectern.runtime import settle

KEY = ("doc_id", "chunk_id")

#: Questions that are sent to the tasks in one pass, tokens of the first and of the largest block that is scored at once, cells of the
#: terms that are held for every chunk of a block because more than one in COMMON has them, and questions and sums that are taken at once.
PASS, FIRST, BLOCK, CELLS, COMMON, ASKED, SUMS = 30_000, 100_000, 4_000_000, 8_000_000, 32, 256, 4_000_000


def tokened(chunks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, t): the index tokens of every chunk, from the column ``tokens`` where an index holds them, else from its text."""
    return chunks.select(*key, F.col("tokens").alias("t") if "tokens" in chunks.columns else T.tokens("text").alias("t"))


def postings(chunks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, term, tf): how often each chunk has each token."""
    return tokened(chunks, key).select(*key, F.explode("t").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(chunks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, n_tokens) of every chunk, those without tokens included."""
    return tokened(chunks, key).select(*key, F.size("t").alias("n_tokens"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(posts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, df, idf): ln(1 + (N - df + 0.5) / (df + 0.5)), above 0 for every term."""
    total = chunks.agg(F.count(F.lit(1))).scalar()  # a scalar subquery, run once
    return document_frequency(posts).select("term", "df", F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame, question: str = "question") -> DataFrame:
    """(query_id, term, qtf): the tokens of each question with their multiplicity."""
    return queries.select("query_id", F.explode(T.tokens(question)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top(scored: DataFrame, k: int, key: Sequence[str] = KEY, by: str = "score") -> DataFrame:
    """The k best of each query with ``rank`` from 1; ties by key. The limit is pushed below the shuffle by rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(by).desc(), *key))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int, scope: DataFrame | None = None, key: Sequence[str] = KEY, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank): the k best chunks of each question by Okapi BM25.

    Exact. Chunks with a column ``tokens`` are an index and are not read for their text. The stated questions are sent in passes of bounded size, each with the document frequencies of its terms.
    A task inverts its chunks in blocks and keeps k rows a question, so no row a matching pair is ever shuffled; of a block it scores for a question in double precision only the chunks that may be
    among its k best so far by sums in single precision. Statistics are of the whole corpus even where ``scope`` (doc_id) restricts the chunks. Chunks without a
    common token are no result; a question without tokens has none. Scores are rounded to nine places, so that equal sums rank equal."""
    spark = chunks.sparkSession
    terms = query_terms(queries)
    rows = tokened(chunks, key)
    if "tokens" not in chunks.columns:
        rows = settle(rows)  # read for the statistics, the frequencies and in every pass
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean")).join(terms.agg(F.countDistinct("query_id").alias("asked")), F.lit(True)).first()
    stats_mean = stats.mean
    passes = stats.asked // PASS + 1
    asked = terms.join(document_frequency(rows.select(F.explode(F.array_distinct("t")).alias("term"))), "term")
    if passes > 1:
        asked = settle(asked)
    within = by_key(rows.join(scope.select("doc_id").distinct(), "doc_id", "left_semi") if scope is not None else rows, key)
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in key)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {kinds}, score double"
    found = []
    for p in range(passes):
        asks = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).select("query_id", "term", "qtf", "df").toArrow()
        if not len(asks):
            continue
        ids, words = (asks[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
        owner = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        df = asks["df"].to_numpy()
        weight = (asks["qtf"].to_numpy() * np.log(1 + (stats.n - df + 0.5) / (df + 0.5)))[order]
        shared = spark.sparkContext.broadcast((ids.dictionary, words.dictionary, owner[order], words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], weight))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, words, owner, slot, weight = shared.value
            kept = TopK(k, len(ids), 0.0)
            for block in blocks(batches, "t", FIRST, BLOCK):
                first = kept.block(block.select(list(key)))
                lens, tokens = flat(block["t"])
                _score(lens, pc.index_in(tokens, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False), len(words), k1 * (1 - b + b * lens / (stats_mean or 1.0)), k1, owner, slot, weight, kept, first)
            yield from kept.found(ids)

        found.append(within.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], f"{schema}, rank int")
    return top(reduce(DataFrame.unionByName, found), k, key)


def _score(lens: np.ndarray, terms: np.ndarray, n_terms: int, room: np.ndarray, k1: float, owner: np.ndarray, slot: np.ndarray, weight: np.ndarray, kept: TopK, first: int) -> None:
    """Gives ``kept`` the chunks of a block that may be among a question's best; they are numbered from ``first``.

    ``terms`` has the chunks' tokens as numbers, -1 where no question asks for one; ``owner``, ``slot`` and ``weight`` have the question, term and weight of what is asked, by question.
    Sums are first taken in single precision, of the common terms as a product of matrices; where these come within their error of a question's k-th best score, the sum is taken in double precision."""
    n, k = len(lens), kept.k
    held = np.sort((terms.astype(np.int64) * n + np.repeat(np.arange(n), lens))[terms >= 0])
    if not len(held):
        return
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    tf, held = np.diff(np.r_[starts, len(held)]), held[starts]
    term, chunk = np.divmod(held, n)
    impact = tf * (k1 + 1) / (tf + room[chunk])
    ends = np.searchsorted(term, np.arange(n_terms + 1))
    counts = np.diff(ends)
    used = counts[slot] > 0
    owner, slot, weight = owner[used], slot[used], weight[used]
    if not len(owner):
        return
    common = np.argsort(-counts, kind="stable")[: max(1, CELLS // n)]
    common = common[counts[common] * COMMON > n]
    row = np.full(n_terms, -1)
    row[common] = np.arange(len(common))
    hot = row[term] >= 0
    times = np.zeros((len(common), n), np.int32)
    times[row[term[hot]], chunk[hot]] = tf[hot]
    whole = np.zeros((len(common), n), np.float32)
    whole[row[term[hot]], chunk[hot]] = impact[hot]
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes, names = np.diff(np.r_[begins, len(owner)]), owner[begins]
    slack = (sizes + 8) * 2.0**-21 * np.add.reduceat(weight, begins) * (k1 + 1)  # more than single precision errs on these sums
    group = max(1, min(ASKED, SUMS // n))
    sums = np.empty((min(group, len(names)), n), np.float32)
    for i in range(0, len(names), group):
        j = min(i + group, len(names))
        lo, size = begins[i:j], sizes[i:j]
        some = slice(lo[0], lo[-1] + size[-1])
        mine, where = np.repeat(np.arange(j - i), size), row[slot[some]]
        often = where >= 0
        asked = np.zeros((j - i, len(common)), np.float32)
        asked[mine[often], where[often]] = weight[some][often]
        near = np.matmul(asked, whole, out=sums[: j - i])
        for m, t, w in zip(mine[~often].tolist(), slot[some][~often].tolist(), weight[some][~often].tolist()):
            x, y = ends[t], ends[t + 1]
            near[m, chunk[x:y]] += w * impact[x:y]
        floor = kept.floor[names[i:j]]
        at = np.flatnonzero(near > np.maximum(floor - slack[i:j], 0.0)[:, None].astype(np.float32))
        m, at = np.divmod(at, n)
        cuts = np.searchsorted(m, np.arange(j - i + 1))
        many = np.flatnonzero(np.diff(cuts) > 2 * k)
        if len(many):
            good = np.ones(len(at), bool)
            for q, x, y in zip(many.tolist(), cuts[many].tolist(), cuts[many + 1].tolist()):
                s = near[q, at[x:y]]
                good[x:y] = s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * slack[i + q]
            m, at = m[good], at[good]
        score = np.zeros(len(at))
        for o in range(size.max()):
            has = np.flatnonzero(size[m] > o)
            place, to = lo[m[has]] + o, at[has]
            t = slot[place]
            r = row[t]
            got = times[r, to] if len(common) else np.zeros(len(t), np.int32)
            rare = np.flatnonzero(r < 0)
            key = t[rare] * n + to[rare]
            found = np.minimum(np.searchsorted(held, key), len(held) - 1)
            got[rare] = np.where(held[found] == key, tf[found], 0)
            score[has] += weight[place] * (got * (k1 + 1) / (got + room[to]))
        score = np.round(score, 9)
        good = score > floor[m]
        kept.add(names[i + m[good]], at[good] + first, score[good])
    kept.cut()


def evidence(chunks: DataFrame, asked: DataFrame, most: int = 2, least_df: int = 2) -> DataFrame:
    """(id, term, place): of each (id, doc_id, chunk_id, question) the rarest terms of its chunk that the question lacks, in ``least_df`` chunks or more."""
    posts = postings(chunks)
    weights = idf(posts, chunks).where(F.col("df") >= least_df).where(F.col("term").rlike(r"^[a-z0-9][a-z0-9.\-]{2,19}$") & F.col("term").rlike("[a-z]"))
    rows = asked.select("id", *KEY, T.tokens("question").alias("q")).join(posts, list(KEY)).where(~F.array_contains("q", F.col("term"))).join(weights, "term")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("idf", 9).desc(), "term"))
    return rows.select("id", "term", place.alias("place")).where(F.col("place") <= most)
