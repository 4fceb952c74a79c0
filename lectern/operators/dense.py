"""Exact vector search, and a deterministic stand-in for a sentence embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions import text as T
from lectern.operators.lexical import KEY, top
from lectern.operators.topk import TopK, blocks, by_key, flat
from lectern.runtime import settle

#: Queries that are sent to the tasks in one pass, and chunks and queries that are scored at once.
PASS, BATCH, ASKED = 10_000, 2_048, 512


@F.arrow_udf(ArrayType(DoubleType()))
def _histogram(tokens: pa.Array, size: pa.Array) -> pa.Array:
    """Unit vectors of token counts by hash bucket: the first six hex digits of a token's MD5 modulo ``size``, found for the distinct tokens of a batch."""
    n = size[0].as_py() if len(size) else 1
    lens, each = flat(pa.chunked_array([tokens]))
    words = each.dictionary_encode()
    at = np.array([int(md5(w.encode()).hexdigest()[:6], 16) % n for w in words.dictionary.to_pylist()], np.int64)
    slots = np.repeat(np.arange(len(lens)) * n, lens) + (at[words.indices.to_numpy(zero_copy_only=False)] if len(each) else 0)
    rows = np.bincount(slots, minlength=len(lens) * n).reshape(len(lens), n).astype(np.float64)
    norm = np.sqrt((rows**2).sum(1, keepdims=True))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lens) + 1, dtype=np.int32) * np.int32(n)), pa.array((rows / np.where(norm > 0, norm, 1)).ravel()))


def embed(text: Column | str, size: int = 64) -> Column:
    """A unit vector of token counts by bucket; zeros for a text without tokens. Any function text -> array may take its place."""
    return embed_tokens(T.tokens(text), size)


def embed_tokens(tokens: Column | str, size: int = 64) -> Column:
    """``embed`` of a text of which an index holds the tokens."""
    return _histogram(T.col(tokens), F.lit(size))


def vectors_of(chunks: DataFrame, embedder=embed, key: Sequence[str] = KEY) -> DataFrame:
    """(key, embedding) of chunks; the stand-in embedder reads the column ``tokens`` where there is one."""
    return chunks.select(*key, (embed_tokens("tokens") if embedder is embed and "tokens" in chunks.columns else embedder("text")).alias("embedding"))


def model_embedder(load: Callable[[], Callable[[list[str]], Iterable[Sequence[float]]]], batch: int = 32):
    """A function text -> array<double> for ``embedder`` arguments around a model of the caller's: ``load`` gives, once a worker, a function
    of a list of texts; it is called with ``batch`` texts at a time, and vectors are brought to unit length. NULL text is embedded as ""."""
    made: list = []

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(load())
        for texts in batches:
            texts = [t or "" for t in texts]
            rows = [np.asarray(v, np.float64) for i in range(0, len(texts), batch) for v in made[0](texts[i : i + batch])]
            yield pd.Series([v / (np.sqrt((v**2).sum()) or 1.0) for v in rows], dtype=object)

    return lambda text: run(T.col(text))


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: Sequence[str] = KEY, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k vectors of greatest inner product with each query vector, ties by key.

    Exact. ``vectors`` has the key and ``embedding``, ``queries`` has query_id and ``embedding``. The stated queries are sent in passes of
    bounded size; each task keeps for each query its k best so far, so a task's result
    is queries times k rows whatever it has read. Products are first taken in single precision; where these come within their error of a query's k-th best
    score so far, the product is taken in double precision, which alone decides. Scores are rounded to nine places. A scope restricts the vectors before the search;
    NULL vectors take no part."""
    if scope is not None:
        vectors = vectors.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    spark = vectors.sparkSession
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in key)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    passes = asked.count() // PASS + 1
    vectors = vectors.where("embedding is not null").select(*key, "embedding")
    if passes > 1:
        asked, vectors = settle(asked), settle(vectors)
    vectors = by_key(vectors, key)
    found = []
    for p in range(passes):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else asked).toArrow()
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), _matrix(rows["embedding"])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            kept = TopK(k, len(q))
            for block in blocks(batches, "embedding", 256 * (q.shape[1] + 1), BATCH * (q.shape[1] + 1)):
                _score(q, _matrix(block["embedding"]), kept, kept.block(block.select(list(key))))
            yield from kept.found(ids)

        found.append(vectors.mapInArrow(run, f"query_id {kind}, {kinds}, score double"))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, {kinds}, score double, rank int")
    return top(reduce(DataFrame.unionByName, found), k, key)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    lens, values = flat(lists)
    if len(lens) and (lens != lens[0]).any():
        raise ValueError("vectors differ in length")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lens), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in single precision at unit length, and their lengths; a row of zeros stays."""
    norm = np.sqrt((x**2).sum(1))
    return (x / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32), norm


def _score(q: np.ndarray, v: np.ndarray, kept: TopK, first: int) -> None:
    """Gives ``kept`` the rows of ``v`` that may be among a query's best; they are numbered from ``first``."""
    n, k = len(v), kept.k
    near, far = _unit(q), _unit(v)
    longest = far[1].max()
    scaled = far[0] * (far[1] / (longest or 1))[:, None].astype(np.float32)
    sure = kept.full and np.isfinite(near[1]).all() and np.isfinite(far[1]).all()
    slack = (v.shape[1] + 8) * 2.0**-22  # more than single precision errs on unit vectors
    for i in range(0, len(q), ASKED):
        some = slice(i, min(i + ASKED, len(q)))
        if sure:
            reach = near[1][some] * longest  # no score of this block is above
            floor = kept.floor[some]
            room = np.where(reach > floor, floor / np.where(reach > 0, reach, 1), np.inf) - slack
            at = np.flatnonzero(near[0][some] @ scaled.T > room[:, None].astype(np.float32))
            a, c = at // n, at % n
            s = np.round(np.einsum("ij,ij->i", q[some][a], v[c]), 9)
            good = s > floor[a]
        else:
            scores = np.round(q[some] @ v.T, 9)
            a, c = np.nonzero(scores >= np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]) if n > k else np.nonzero(np.ones(scores.shape, bool))
            s = scores[a, c]
            good = np.ones(len(a), bool)
        kept.add(a[good] + i, c[good] + first, s[good])
    if not kept.full or kept.seen > 1.4 * kept.done:
        kept.cut()
