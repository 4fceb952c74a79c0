"""Rank-shaped operators: latest row of a key, ranks and quotas that survive hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import settle

#: The largest cap for which the survivors of a salted pass, ``salts`` times as many, still fit a task.
SMALL = 1_000


def latest_by(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key, the one with the greatest ``at`` (then the greatest ``ties``).

    A grouped ``max_by`` with map-side combine: copies of a hot key collapse before the shuffle.
    NULL in ``at`` loses to any value; if all are NULL the greatest ``ties`` win. NULL keys form a key."""
    rest = [c for c in df.columns if c not in set(keys)]
    order = F.struct(F.col(at).isNotNull(), F.col(at), *[F.struct(F.col(c).isNotNull(), F.col(c)) for c in ties])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: Column, spread: Column, name: str, salts: int = 32) -> DataFrame:
    """Adds ``name``: true for the first ``cap`` rows of each key in ``order``; a NULL cap keeps all.

    Two ranked passes, so that no task sorts a whole hot group: rows are first ranked within
    (key, salt); a row beyond ``cap`` there cannot be among the best and stays where it is, and only
    the survivors, at most ``salts * cap`` of a key, meet for the second pass. ``order`` must be
    total for a stable result; ``spread`` is what rows are salted by."""
    salt, near, far = f"_{name}_salt", f"_{name}_near", f"_{name}_room"
    df = df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    df = df.withColumn(near, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(*order)) <= cap)
    df = df.withColumn(far, F.when(F.coalesce(F.col(near), F.lit(False)), F.lit(-1)).otherwise(F.col(salt)))
    place = F.row_number().over(Window.partitionBy(*keys, far).orderBy(*order))
    return df.withColumn(name, F.when(cap.isNull(), True).otherwise(F.coalesce(F.col(near), F.lit(False)) & (place <= cap))).drop(salt, near, far)


def place_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the place, from 1, of each row in its key by ``order``, for groups of any size.

    Rows are spread over tasks by ranges of (key, order), so a hot key lies in as many tasks as its rows need; places are counted
    within a range and moved on by the rows of the key in the ranges before it, a count a key and range. The ranges are settled
    first, so that a lost executor cannot draw them anew. ``order`` must tell rows apart for a stable result; NULL keys form a key."""
    part, before, flags = f"_{name}_part", f"_{name}_before", [f"_{name}_key{i}" for i in range(len(keys))]
    cuts = [F.col(k).asc_nulls_first() for k in keys]
    spread = df.repartitionByRange(parts, *cuts, *order) if parts else df.repartitionByRange(*cuts, *order)
    rows = settle(spread.withColumn(part, F.spark_partition_id()))
    counts = rows.groupBy(*[F.col(k).alias(f) for k, f in zip(keys, flags)], part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*flags).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*flags, F.col(part).alias(f"{part}s"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias(before))
    same = F.col(part) == F.col(f"{part}s")
    for k, f in zip(keys, flags):
        same = same & F.col(k).eqNullSafe(F.col(f))
    here = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    return rows.withColumn(name, here).join(counts, same).withColumn(name, F.col(name) + F.col(before)).drop(*flags, part, f"{part}s", before)


def carried(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """Adds what is carried along each key in ``order``: ``sums``, running sums with the row itself (NULL counts 0); ``lasts``, the last value so far
    that is not NULL; ``before``, the value of the row before, NULL in the first row.

    In two steps, within blocks of a key and over blocks, so that no task sorts a whole key: ``block`` must not fall as ``order`` rises, and
    what is ordered over a key's blocks is one row a block."""
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    place = F.struct(*[F.col(c) for c in order])
    rows = settle(df.withColumn("_block", block))  # read for the blocks and for the rows
    near = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = near.rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.sum(F.coalesce(c, F.lit(0))).alias(f"_sum_{n}") for n, c in sums.items()]
    ends += [F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), place)).alias(f"_last_{n}") for n, c in lasts.items()]
    ends += [F.max_by(F.struct(c.alias("v")), place).alias(f"_before_{n}") for n, c in before.items()]
    far = Window.partitionBy(*keys).orderBy("_block")
    past = far.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_block").agg(*ends)
    blocks = blocks.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_block").alias("_blocks"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(past), F.lit(0)).alias(f"_sum_{n}") for n in sums],
        *[F.last(f"_last_{n}", True).over(past).alias(f"_last_{n}") for n in lasts],
        *[F.lag(f"_before_{n}").over(far).alias(f"_before_{n}") for n in before],
    )
    rows = rows.withColumns({
        **{n: F.sum(F.coalesce(c, F.lit(0))).over(upto) for n, c in sums.items()},
        **{n: F.last(F.when(c.isNotNull(), F.struct(c.alias("v"))), True).over(upto) for n, c in lasts.items()},
        **{n: F.lag(F.struct(c.alias("v"))).over(near) for n, c in before.items()},
    })
    same = F.col("_block").eqNullSafe(F.col("_blocks"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    rows = rows.join(blocks, same).withColumns({
        **{n: F.col(n) + F.col(f"_sum_{n}") for n in sums},
        **{n: F.coalesce(n, f"_last_{n}").getField("v") for n in lasts},
        **{n: F.coalesce(n, f"_before_{n}").getField("v") for n in before},
    })
    return rows.drop("_block", "_blocks", *[f"_key_{k}" for k in keys], *[f"_sum_{n}" for n in sums], *[f"_last_{n}" for n in lasts], *[f"_before_{n}" for n in before])
