"""Order-keeping building blocks: first occurrence, greedy top-k, lookups.

Every function takes an explicit order, so results never depend on partition
layout. The row-number passes carry their ``<= k`` filter directly above the
window: Spark then keeps at most ``k`` rows per group in every map task before
it shuffles, so a group that holds a third of all rows still reaches one task
as ``k`` rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.session import cut_lineage

_RANK = "__rank"
_SALT = "__salt"


def top_k(
    df: DataFrame, group: Sequence[str | Column], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows per group in ``order``; ``rank`` keeps the 1-based position."""
    name = rank or _RANK
    window = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add consecutive numbers from 1 per group; a hot group is sorted in many tasks.

    Rows are range-partitioned by group and order and written once, so that partitions keep their rows.
    A row's number is its place among its group's rows in its partition, after the sizes of the group's
    parts before it: one row per group and partition meets in one task. ``order`` must leave no ties.
    """
    keys = [F.col(c).asc_nulls_first() for c in group]
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    saved = cut_lineage(ranged, "ranged")
    parts = saved.groupBy(*group, "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        *(F.col(c).alias(f"__of_{c}") for c in group), F.col("__part").alias("__in"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group]
    place = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    numbered = saved.withColumn("__place", place).join(bases, [*same, F.col("__part") == F.col("__in")])
    return numbered.withColumn(name, F.col("__base") + F.col("__place")).select(*df.columns, name)


def unnest(
    df: DataFrame, keep: Sequence[str | Column], items: Column, value: str, pos: str | None = None
) -> DataFrame:
    """One row per array element: ``keep`` columns, ``value`` and its 0-based ``pos``.

    A plain explode makes the optimizer add a "size of the array > 0" filter
    below it, which evaluates a computed array again. The outer form does not,
    so the array is computed once; rows of empty arrays are dropped after it.
    """
    name = pos or "__pos"
    rows = df.select(*keep, F.posexplode_outer(items).alias(name, value)).filter(
        F.col(name).isNotNull()
    )
    return rows.withColumn(name, F.col(name).cast("long")) if pos else rows.drop(name)


def first_occurrence(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]
) -> DataFrame:
    """First row per key."""
    return top_k(df, keys, order, 1)


def greedy_top_k(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """Walk each group in ``order``, skip keys already used, stop after ``k``."""
    unique = first_occurrence(df, [*group, key], order)
    return top_k(unique, group, order, k, rank)


def ordered_union(frames: Sequence[DataFrame], keys: Sequence[str], position: str) -> DataFrame:
    """Distinct union that keeps first occurrences: earlier frames come first."""
    labelled = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    merged = labelled[0]
    for frame in labelled[1:]:
        merged = merged.unionByName(frame)
    return first_occurrence(merged, keys, [F.col("source_rank"), F.col(position)])


def prefix_limit(df: DataFrame, n: int, order: str = "idx", group: Sequence[str] = ("site",)) -> DataFrame:
    """First ``n`` pages per site by site order (0 or less: no limit)."""
    if n <= 0:
        return df
    return top_k(df, list(group), [F.col(order)], n)


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: str,
    how: str = "left",
    splits: int | None = None,
) -> DataFrame:
    """Join rows to a table that has at most one row per key.

    A plain equi-join: adaptive execution splits the partitions of ``left`` that
    a hot key swells, and broadcasts ``right`` where its measured size is small.
    Where a caller knows that it must not rely on that, ``splits`` cuts every key
    by a hash of ``spread`` (a column that varies within a key) and repeats
    ``right`` per cut.
    """
    if splits is None:
        return left.join(right, list(on), how)
    salted = left.withColumn(_SALT, F.pmod(F.xxhash64(F.col(spread)), F.lit(splits)).cast("int"))
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def first_distinct(items: Column, field: str, k: int) -> Column:
    """First ``k`` elements of an array of structs with distinct ``field`` values.

    One linear fold: the kept part never holds more than ``k`` elements.
    """
    none = F.filter(items, lambda r: F.lit(False))
    return F.aggregate(
        items,
        none,
        lambda kept, r: F.when(
            (F.size(kept) >= k) | F.exists(kept, lambda seen: seen[field] == r[field]), kept
        ).otherwise(F.concat(kept, F.array(r))),
    )
