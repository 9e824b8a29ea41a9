"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, connected components.

Two vectors at the threshold share a table's key with probability ``p ** bits``, p = 1 - angle / pi; with the default
64 tables of 16 bits a pair at cosine 0.95 is missed by all of them with probability 3e-6.

Equal vectors fall together first and count by their number. The members of a bucket are split into blocks; every
pair of blocks is one group of at most ``2 * block`` rows, so no bucket is one task. From a group leave, per vector,
the number of its links and the smallest id that it hangs together with there - never pairs. A pair counts only in
the first table in which it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.tables import Scratch, beside_groups, connected_components


@dataclass(frozen=True)
class SignOptions:
    cosine: float = 0.95
    tables: int = 64
    bits: int = 16
    block: int = 512
    seed: int = 7


def usable(embedding: str) -> F.Column:
    """Not null, not empty, not zero, no null or non-finite component."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def planes(width: int, o: SignOptions) -> np.ndarray:
    return np.random.default_rng([o.seed, width]).standard_normal((width, o.tables * o.bits))


def keys(x: np.ndarray, o: SignOptions) -> np.ndarray:
    """Key of every row in every table."""
    signs = (x @ planes(x.shape[1], o) > 0).reshape(len(x), o.tables, o.bits)
    return (signs * (1 << np.arange(o.bits))).sum(axis=2)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one width as a matrix; the caller has split rows by width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def classes(vectors: DataFrame) -> DataFrame:
    """``first, embedding, n``: usable distinct vectors, their smallest id and number of rows. -0.0 is 0.0."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    rows = rows.filter(usable("embedding") & F.col("vec_id").isNotNull()).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))


def _bucket_rows(distinct: DataFrame, o: SignOptions) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            widths = column.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), 1024):
                    take = pa.array(own[at : at + 1024])
                    key = keys(_matrix(column.take(take)), o).astype(np.int64) * o.tables + np.arange(o.tables)
                    first = batch.column("first").take(take).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(first, o.tables)), pa.array(key.ravel()), pa.array(np.full(key.size, width, np.int32))], names=["first", "key", "width"]
                    )

    return distinct.select("first", "embedding").mapInArrow(run, "first bigint, key bigint, width int")


_GROUP = ("width", "key", "i", "j")


def _linked(rows: DataFrame, o: SignOptions) -> DataFrame:
    """Per group and vector: linked vectors (by their numbers) and the smallest id of its part of the group."""

    def links(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        """All groups of a run of rows: large ones one by one, so that no more pairs stand in memory than one group
        has; of small ones together, row r is compared with row r + d of its group, for each d in turn."""
        col = {c: batch.column(c).to_numpy() for c in (*_GROUP, "first", "n", "block")}
        x = _matrix(batch.column("embedding").combine_chunks())
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        group = np.cumsum(np.concatenate([[0], np.any([col[c][1:] != col[c][:-1] for c in _GROUP], axis=0)]))
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, len(group)))
        for b, m in zip(begin[size > 8], size[size > 8]):
            s = slice(b, b + m)
            near = unit[s] @ unit[s].T >= o.cosine - 1e-9
            a, c = np.nonzero(np.triu(near, 1))
            yield from settled(col, x, a + b, c + b)
        small = np.repeat(size <= 8, size)
        left, right = [], []
        for d in range(1, 8):
            a = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if not len(a):
                break
            hit = a[(unit[a] * unit[a + d]).sum(axis=1) >= o.cosine - 1e-9]
            left.append(hit)
            right.append(hit + d)
        yield from settled(col, x, *(np.concatenate([*p, np.zeros(0, int)]).astype(int) for p in (left, right)))

    def settled(col: dict, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What leaves a group of pairs: exact links, each in its first table, counted and hung together."""
        # Groups of two blocks hold pairs across them only.
        fits = (col["i"][a] == col["j"][a]) | (col["block"][a] != col["block"][b])
        a, b = a[fits], b[fits]
        for at in (slice(k, k + 16384) for k in range(0, len(a), 16384)):
            exact = (x[a[at]] * x[b[at]]).sum(axis=1) / np.sqrt((x[a[at]] ** 2).sum(axis=1) * (x[b[at]] ** 2).sum(axis=1))
            a[at] = np.where(exact >= o.cosine, a[at], -1)
        a, b = a[a >= 0], b[a >= 0]
        if not len(a):
            return
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        all_keys = np.concatenate([keys(x[used[k : k + 1024]], o) for k in range(0, len(used), 1024)]).astype(np.uint16 if o.bits <= 16 else np.int64)
        pa_, pb_ = place[: len(a)], place[len(a) :]
        own = np.ones(len(a), bool)
        table = col["key"][a] % o.tables
        for k in range(0, len(a), 16384):
            s = slice(k, k + 16384)
            own[s] = (all_keys[pa_[s]] == all_keys[pb_[s]]).argmax(axis=1) == table[s]
        ia, ib = pa_[own], pb_[own]
        if not len(ia):
            return
        number = np.zeros(len(used), np.int64)
        np.add.at(number, ia, col["n"][used[ib]])
        np.add.at(number, ib, col["n"][used[ia]])
        part = col["first"][used].copy()
        while True:
            low = np.minimum(part[ia], part[ib])
            before = part.copy()
            np.minimum.at(part, ia, low)
            np.minimum.at(part, ib, low)
            if (part == before).all():
                break
        hit = number > 0
        yield pa.RecordBatch.from_arrays([pa.array(col["first"][used][hit]), pa.array(number[hit]), pa.array(part[hit])], names=["first", "links", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            rows = pa.Table.from_batches(held)
            last = np.zeros(rows.num_rows, bool)
            last[-1] = True
            differs = np.any([rows.column(c).to_numpy() != rows.column(c)[-1].as_py() for c in _GROUP], axis=0)
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # the last group may go on
            if cut:
                for part in _by_width(rows.slice(0, cut)):
                    yield from links(part)
            held = rows.slice(cut).to_batches()
        if held:
            for part in _by_width(pa.Table.from_batches(held)):
                yield from links(part)

    return rows.mapInArrow(run, "first bigint, links bigint, part bigint")


def _by_width(rows: pa.Table) -> Iterator[pa.Table]:
    width = rows.column("width").to_numpy()
    for at in np.split(np.arange(len(width)), np.flatnonzero(np.diff(width)) + 1):
        if len(at):
            yield rows.slice(int(at[0]), len(at))


def near_vectors(vectors: DataFrame, o: SignOptions = SignOptions()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do vectors of
    different widths. Equal vectors are linked. Rows that repeat a vec_id count as vectors of their own with one id.
    A null vec_id links with nothing (component_id null, kept). Further columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    distinct = scratch.keep(classes(vectors), "classes")
    rows = _bucket_rows(distinct, o)
    rows = beside_groups(rows, ["width", "key"], "first", [F.count("*").alias("m")], "m > 1").withColumn("blocks", F.ceil(F.col("m") / o.block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("width", "key", "first", "block", other).select(
        "width", "key", "first", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    rows = rows.join(distinct, "first").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = scratch.keep(_linked(rows, o), "links")
    parts = connected_components(found.select(F.col("first").alias("a"), F.col("part").alias("b")), scratch)
    per = distinct.join(found.groupBy("first").agg(F.sum("links").alias("links")), "first", "left").join(
        parts.withColumnRenamed("id", "first"), "first", "left"
    )
    per = per.select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "first").alias("part")
    )
    ids = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    fit = usable("embedding") & F.col("vec_id").isNotNull()
    ids = ids.withColumn("embedding", F.when(fit, F.transform("embedding", lambda v: v + F.lit(0.0))))
    component = F.coalesce("part", "vec_id")
    return ids.join(per, "embedding", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
