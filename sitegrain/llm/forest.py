"""Approximate nearest neighbours by inner product with a hash-prefix forest.

Each tree gives every vector a long string of hyperplane signs; a tree is the sorted array of its strings. A query
descends each tree to its longest matching prefix and then ascends all trees together, one sign at a time: a
shorter prefix is a wider range of the sorted array. It stops where a vector as near as its k-th neighbour would
still be in none of the ranges with probability ``miss`` at most. The k-th neighbour of a bounded sample, which the
true one can only exceed, stands in for it, so the stop is on the safe side and needs no knowledge of the size.

The arrays are one table, range-partitioned by (tree, string) and written in the shared folder; queries are sent to
the parts that their ranges overlap, and only the best ``k`` of a part leave it. Equal vectors are one entry with the
ids that can come into any result. Inner products become angles by one more component, sqrt(longest^2 - norm^2) of
an indexed vector and 0 of a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.llm.tables import Scratch
from sitegrain.llm.vectors import usable
from sitegrain.operators.ordered import top_k


@dataclass(frozen=True)
class ForestOptions:
    k: int = 20
    trees: int = 16
    bits: int = 48  # signs of a string
    miss: float = 0.1  # most that the k-th neighbour is missed by; nearer ones are missed less
    sample: int = 2048  # vectors that the stopping level is fitted on
    part_rows: int = 32768  # of the sorted arrays
    part_queries: int = 4096  # that meet a part in one task
    seed: int = 11


def signs(x: np.ndarray, longest: float | None, o: ForestOptions) -> np.ndarray:
    """String of every row in every tree, as an integer below ``2 ** bits``; queries, without ``longest``, have no further component."""
    rest = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0.0))
    planes = np.random.default_rng([o.seed, x.shape[1]]).standard_normal((x.shape[1] + 1, o.trees * o.bits))
    above = (x @ planes[:-1] + rest[:, None] * planes[-1] > 0).reshape(len(x), o.trees, o.bits)
    return (above * (1 << np.arange(o.bits - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def level(nearness: np.ndarray, o: ForestOptions) -> np.ndarray:
    """Longest prefix at which a vector of this cosine is in one of the trees' ranges with probability 1 - miss."""
    same = 1 - np.arccos(np.clip(nearness, -1, 1)) / np.pi
    need = 1 - o.miss ** (1 / o.trees)
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.floor(np.log(need) / np.log(np.clip(same, 1e-9, 1 - 1e-9)))
    return np.clip(steps, 0, o.bits).astype(np.int64)


def _entries(vectors: DataFrame, o: ForestOptions) -> DataFrame:
    """``first, members, embedding`` of distinct usable vectors; of a class's ids only the k + 1 smallest matter."""
    rows = vectors.filter(usable("embedding") & F.col("vec_id").isNotNull())
    best = top_k(rows.distinct(), ["embedding"], [F.col("vec_id")], o.k + 1)
    return best.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("first", F.col("members")[0])


def _rows_of_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    column = batch.column("embedding")
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        for at in range(0, len(own), 1024):
            take = own[at : at + 1024]
            yield take, column.take(pa.array(take)).flatten().to_numpy(zero_copy_only=False).reshape(len(take), width).astype(np.float64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def nearest(vectors: DataFrame, is_query: Column, o: ForestOptions = ForestOptions()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` picks, its k nearest found among all other rows.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Vectors that are null, empty,
    zero or hold a null or non-finite component, and null ids, take no part. Vectors of different widths never meet.
    A row that repeats an id and vector counts once. With fewer than k candidates all are returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0)).alias("embedding"), is_query.alias("is_query"))
    entries = scratch.keep(_entries(rows.select("vec_id", "embedding"), o), "entries")
    queries = rows.filter(F.col("is_query") & usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), "embedding").distinct()

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    longest = {r["width"]: r["longest"] for r in entries.groupBy(F.size("embedding").alias("width")).agg(F.max(norm).alias("longest")).collect()}
    picked = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(o.sample).collect()
    sample: dict[int, list] = {}
    for r in picked:
        sample.setdefault(len(r["embedding"]), []).append(r["embedding"])
    shared = spark.sparkContext.broadcast((longest, {w: np.array(x) for w, x in sample.items()}))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, _ = shared.value
        for batch in batches:
            first = batch.column("first").to_numpy()
            for take, x in _rows_of_width(batch):
                width, t = x.shape[1], np.arange(o.trees)
                each = np.repeat(np.arange(len(x)), o.trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(width * o.trees + t, len(x))), pa.array(signs(x, longest[width], o).ravel()), pa.array(first[take][each]), _lists(x[each])],
                    names=["tree", "string", "first", "embedding"],
                )

    index = entries.select("first", "embedding").mapInArrow(strings, "tree bigint, string bigint, first bigint, embedding array<double>")
    parts = max(1, -(-entries.count() * o.trees // o.part_rows))
    index = index.repartitionByRange(parts, "tree", "string", "first").sortWithinPartitions("tree", "string", "first")
    index = scratch.keep(index.withColumn("part", F.spark_partition_id()), "index")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, sample = shared.value
        place = {w: {bytes(v): k for k, v in enumerate(s)} for w, s in sample.items()}
        for batch in batches:
            ids = batch.column("query_id").to_numpy()
            for take, x in _rows_of_width(batch):
                width, t = x.shape[1], np.arange(o.trees)
                near = x @ sample[width].T
                for r, own in enumerate(map(place[width].get, map(bytes, x))):
                    if own is not None:  # the query itself is no neighbour
                        near[r, own] = -np.inf
                size = np.sqrt((x * x).sum(axis=1)) * longest[width]
                kth = np.sort(near, axis=1)[:, -o.k] / size if near.shape[1] > o.k else np.full(len(x), -1.0)
                cut = (o.bits - level(np.where(np.isfinite(kth), kth, -1.0), o))[:, None]
                low = signs(x, None, o) >> cut << cut
                each = np.repeat(np.arange(len(x)), o.trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[take][each]), pa.array(np.tile(width * o.trees + t, len(x))), pa.array(low.ravel()), pa.array((low + (1 << cut) - 1).ravel()), _lists(x[each])],
                    names=["query_id", "tree", "low", "high", "embedding"],
                )

    # A part may hold the end of one tree and the beginning of the next.
    directory = scratch.keep(index.groupBy("part", "tree").agg(F.min("string").alias("least"), F.max("string").alias("most")), "directory")
    asked = queries.mapInArrow(ranges, "query_id bigint, tree bigint, low bigint, high bigint, embedding array<double>")
    asked = asked.join(directory, (asked["tree"] == directory["tree"]) & (F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least"))).select(
        "query_id", asked["tree"], "low", "high", "embedding", "part"
    )
    asked = scratch.keep(asked, "asked")
    loads = asked.groupBy("part").agg(F.ceil(F.count("*") / o.part_queries).alias("salts"))
    asked = asked.join(loads, "part").withColumn("salt", F.pmod(F.xxhash64("query_id", "tree"), F.col("salts"))).drop("salts")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))
    copies = index.join(loads, "part").select(*(F.col(c).alias(c) for c in ("part", "tree", "string", "first", "embedding")), every.alias("salt"))

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if ask.num_rows and have.num_rows:
            have = have.sort_by([("tree", "ascending"), ("string", "ascending"), ("first", "ascending")])
            ask = ask.sort_by([("tree", "ascending"), ("low", "ascending"), ("high", "ascending"), ("query_id", "ascending")])
            tree, string, first = (have.column(c).to_numpy() for c in ("tree", "string", "first"))
            own, low, high, ids = (ask.column(c).to_numpy() for c in ("tree", "low", "high", "query_id"))
            for t in np.unique(own):
                a, b = np.searchsorted(tree, [t, t + 1])
                mine = np.flatnonzero(own == t)
                if a == b:
                    continue
                v, q = (table.column("embedding").combine_chunks().take(pa.array(at)).flatten().to_numpy() for table, at in ((have, np.arange(a, b)), (ask, mine)))
                v, q = v.reshape(b - a, -1), q.reshape(len(mine), -1)
                lengths, norms = (np.sqrt((x * x).sum(axis=1)) for x in (q, v))
                begin = np.searchsorted(string[a:b], low[mine])
                end = np.searchsorted(string[a:b], high[mine], side="right")
                # Queries of one range stand together and share one product.
                edge = np.flatnonzero(np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])]))
                for e, f in zip(edge, [*edge[1:], len(mine)]):
                    for at in range(e, f, 128):
                        rows = slice(at, min(at + 128, f))
                        near = q[rows] @ v[begin[e] : end[e]].T
                        if not near.shape[1]:
                            continue
                        # Products are rounded otherwise than scores; all that may tie with the (k + 1)-th are scored.
                        border = np.full((len(near), 1), -np.inf)
                        if near.shape[1] > o.k + 1:
                            slack = 4 * v.shape[1] * np.finfo(float).eps * (lengths[rows] * norms[begin[e] : end[e]].max())
                            border = (np.partition(near, near.shape[1] - o.k - 1, axis=1)[:, -o.k - 1] - slack)[:, None]
                        each, best = np.nonzero(~(near < border))
                        each, best = each + rows.start, best + begin[e]
                        score = np.empty(len(each))
                        for c in range(0, len(each), 8192):
                            score[c : c + 8192] = (q[each[c : c + 8192]] * v[best[c : c + 8192]]).sum(axis=1)
                        name = first[a:b][best]
                        order = np.lexsort((name, -score, each))
                        place = np.arange(len(each)) - np.searchsorted(each, each)  # ``each`` ascends, and its order stays
                        kept = order[place <= o.k]
                        out.append(pa.table({"query_id": ids[mine][each[kept]], "first": name[kept], "score": score[kept]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = asked.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt")).applyInArrow(meet, "query_id bigint, first bigint, score double")
    found = found.groupBy("query_id", "first").agg(F.max("score").alias("score"))
    found = top_k(found, ["query_id"], [F.col("score").desc(), F.col("first")], o.k + 1)
    flat = found.join(entries.select("first", "members"), "first").select("query_id", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return flat.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= o.k).select("query_id", "rank", "vec_id", "score")
