"""Written intermediate tables and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegrain.session import work_folder


def quoted(columns: Sequence[str]) -> list[str]:
    """Names for ``select`` and ``col``, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns of these names, upper or lower case."""
    gone = {n.lower() for n in names}
    return df.select(*quoted([c for c in df.columns if c.lower() not in gone]))


def widened(df: DataFrame, more: str) -> StructType:
    """The columns of ``df`` and further ones (given as DDL)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; after a task's last batch the worker, which lives on, gives free Arrow memory back."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return passed


def extended(
    df: DataFrame, reads: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], more: str
) -> DataFrame:
    """``df`` with further columns (``more``, as DDL) that ``run`` makes of the columns ``reads``.

    ``run`` gives slices of its batches with their new columns. All other columns pass through in one struct, whatever
    their names are.
    """
    rest = [c for c in df.columns if c not in reads]
    packed = df.select(*quoted(reads), *([F.struct(*quoted(rest)).alias("__rest")] if rest else []))
    schema = widened(packed, more)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, new in run(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    old = [F.col(q if c in reads else f"__rest.{q}") for c, q in zip(df.columns, quoted(df.columns))]
    return packed.mapInArrow(released(passed), schema).select(*old, *quoted(StructType.fromDDL(more).names))


class Scratch:
    """Tables of one operator run, in the folder that ``spark.checkpoint.dir`` names.

    ``keep`` writes a table and reads it back, which cuts lineage for good: a lost
    executor costs a task. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count = spark, work_folder(spark, name), 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SPLITS = 16  # parts that a group of rows is cut into to meet its aggregates


def beside_groups(
    rows: DataFrame, keys: Sequence[str], by: str, aggregates: Sequence[Column], having: str | None = None, how: str = "inner"
) -> DataFrame:
    """``rows`` with aggregates of their group (``having`` leaves groups out; with ``how="left"`` their rows stay).

    An aggregation and a join on one key share a shuffle, so a hot group would meet its aggregates in one task. Here
    rows are dealt by key and by a hash of ``by`` in SPLITS parts, and a bit mask sends a group's one row to the parts
    that it has: rare keys are not copied. Larger parts can still be split by adaptive execution.
    """
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(SPLITS)).cast("int"))
    groups = rows.groupBy(*keys).agg(*aggregates, F.bit_or(F.expr("shiftleft(1, __part)")).alias("__mask"))
    if having:
        groups = groups.filter(having)
    parts = F.explode(F.expr(f"filter(sequence(0, {SPLITS - 1}), i -> getbit(__mask, i) = 1)"))
    groups = groups.withColumn("__part", parts).drop("__mask")
    return rows.join(groups, [*keys, "__part"], how).drop("__part")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; a component is named by its smallest id.

    Large-star and small-star rounds until every id points to one smaller id that points to none: that is told
    without another round. Minima are partial
    aggregates and neighbours meet them in parts, so a hub with a third of all
    edges is not one task. Every round is written to the shared folder and the
    one before it removed.
    Empty edges give an empty result; loops and repeated edges do no harm.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = scratch.keep(pairs, "edges")
    while not _settled(now):
        both = now.union(now.select("b", "a"))
        large = beside_groups(both, ["a"], "b", [F.min("b").alias("m")]).filter("b > a")
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = scratch.keep(large.filter("a <> b"), "edges")
        met = beside_groups(large, ["a"], "b", [F.min("b").alias("m")])
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            large.groupBy("a").agg(F.min("b").alias("b"))
        ).filter("a <> b")
        after = scratch.keep(small.distinct(), "edges")
        scratch.drop(now)
        scratch.drop(large)
        now = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether distinct ``edges(a, b)`` are stars: no ``a`` has two edges or is a ``b``."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    open_ends = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1 and out > 0")
    return open_ends.agg(F.count("*")).first()[0] == 0
