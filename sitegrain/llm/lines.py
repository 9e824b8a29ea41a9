"""Incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without blanks at its ends, A-Z lower-cased; keys are told apart by a 128-bit digest. A key
that at least two documents hold loses its lines everywhere but in the smallest ``doc_id`` that holds it.

An index lives in a folder and grows by batches, which are only ever added:

* ``refs``: one row (doc_id, key) for every key of every document of the batch,
* ``counts``: for every key that the batch touched, its exact reference count and its smallest and largest holder as
  they are after the batch (of several rows of a key the newest holds),
* ``removed``: documents taken out by the batch,
* ``filters``: a cuckoo filter per shard of keys, with one copy of every key that has a holder and a second copy of
  every key that has two. A batch asks the filters first: keys that they do not know are new without a look at the
  exact tables; only keys that they may know are joined with ``counts``. Where a reference count falls to one or to
  none, the copy is deleted again, so an index after a removal equals one that never saw the document.

The row in ``state`` is written last; a batch that failed before it leaves nothing that is read. Shards are added
when the filters fill up. A hot key is one row of partial counts per task, and the documents that hold it meet its
count in up to ``SPLITS`` parts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm.cuckoo import CAPACITY, Cuckoo
from sitegrain.llm.tables import SPLITS, Scratch, extended, without
from sitegrain.llm.words import document_lines

KEY = ["k1", "k2"]
_REFS = "doc_id bigint, k1 bigint, k2 bigint"
_COUNTS = "k1 bigint, k2 bigint, n bigint, first bigint, last bigint, parts int"
_FILTERS = "shard int, filter binary"
_STATE = "batch int, id string, shards int, filters string, removes boolean"


@dataclass(frozen=True)
class LineOptions:
    shortest: int = 10  # code points of a key that counts
    capacity: int = CAPACITY  # copies of keys in a shard


def _keys(line: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(line, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_keys(docs: DataFrame, o: LineOptions = LineOptions()) -> DataFrame:
    """``doc_id, k1, k2``: the distinct keys of every row of ``docs`` that has a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, lines in document_lines(batch.column("text"), o.shortest):
                found = list({_keys(line) for _, line in lines if line is not None})
                if found and ids[row] is not None:
                    k1, k2 = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[row]] * len(k1), pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["doc_id", *KEY]
                    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held, n = [*held, batch], n + batch.num_rows
            if n >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(packed, _REFS)


def _counted(refs: DataFrame) -> DataFrame:
    """Exact counts of keys; ``parts`` has a bit for every part of documents that holds the key."""
    part = _part("doc_id")
    return refs.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bit_or(F.expr(f"shiftleft(1, {part})")).alias("parts")
    )


def _part(column: str) -> str:
    return f"cast(pmod(xxhash64({column}), {SPLITS}) as int)"


def _copies(n: str, first: str, last: str) -> str:
    return f"case when coalesce({n}, 0) = 0 then 0 when {first} < {last} then 2 else 1 end"


class LineIndex:
    """Lines of the documents inserted so far, in ``path`` (a folder that the whole cluster shares).

    Defined cases: a null or empty text is one empty line; rows that repeat a doc_id are one document; a document
    inserted again adds its lines to those it has; rows without a doc_id are neither counted nor changed; removing
    an unknown document changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, o: LineOptions = LineOptions()) -> None:
        self.spark, self.path, self.o = spark, path.rstrip("/"), o
        self.batches: list[dict] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, o: LineOptions = LineOptions()) -> LineIndex:
        """The index that an earlier session left in ``path``."""
        index = cls(spark, path, o)
        index.batches = sorted((r.asDict() for r in spark.read.schema(_STATE).json(f"{index.path}/state").collect()), key=lambda b: b["batch"])
        return index

    # -- stored tables

    def _read(self, name: str, schema: str, batches: list[dict]) -> DataFrame:
        """Table ``name`` of some batches, with the number of each row's batch."""
        out = self.spark.createDataFrame([], f"{schema}, batch int")
        for b in batches:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{b['id']}")
            out = out.union(rows.withColumn("batch", F.lit(b["batch"])))
        return out

    def _write(self, df: DataFrame, name: str, id: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}/{id}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/{id}")

    def _filters(self) -> DataFrame:
        last = self.batches[-1]["filters"] if self.batches else None
        return self.spark.read.schema(_FILTERS).parquet(f"{self.path}/filters/{last}") if last else self.spark.createDataFrame([], _FILTERS)

    def _counts(self) -> DataFrame:
        return self._read("counts", _COUNTS, self.batches)

    def live(self) -> DataFrame:
        """``doc_id, k1, k2``: the references of all documents that are in the index."""
        refs = self._read("refs", _REFS, [b for b in self.batches if not b["removes"]])
        gone = [b for b in self.batches if b["removes"]]
        if gone:
            removed = self._read("removed", "doc_id bigint", gone).groupBy("doc_id").agg(F.max("batch").alias("until"))
            refs = refs.join(removed, "doc_id", "left").filter("until is null or batch > until")
        return refs.select("doc_id", *KEY)

    @staticmethod
    def _newest(counts: DataFrame) -> DataFrame:
        rows = counts.groupBy(*KEY).agg(F.max_by(F.struct("n", "first", "last", "parts"), "batch").alias("c"))
        return rows.select(*KEY, "c.*")

    # -- filters

    def _shard(self, shards: int) -> str:
        return f"cast(pmod(k2, {shards}) as int)"

    def _streamed(self, keys: DataFrame, filters: DataFrame, shards: int, run, schema: str) -> DataFrame:
        """Each shard's filter and, after it, its keys with ``step`` pass through ``run`` in one task."""
        rows = filters.select("shard", F.lit(0).alias("kind"), "filter", F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"), F.lit(0).alias("step"))
        rows = rows.union(keys.select(F.expr(self._shard(shards)).alias("shard"), F.lit(1), F.lit(None).cast("binary"), *KEY, "step"))
        return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, schema)

    def _seen(self, keys: DataFrame, shards: int) -> DataFrame:
        """The keys that the filters may know."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, Cuckoo()
            for shard, filter, k1, k2, _ in _parts(batches):
                if shard != at:
                    at, held = shard, Cuckoo()
                if filter is not None:
                    held = Cuckoo(filter)
                known = held.copies(k1) > 0
                yield pa.RecordBatch.from_arrays([pa.array(k1[known]), pa.array(k2[known])], names=KEY)

        return self._streamed(keys.withColumn("step", F.lit(0)), self._filters(), shards, run, "k1 bigint, k2 bigint")

    def _updated(self, changes: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
        """Filters after ``changes``: keys with the number of copies to add, or to delete if negative."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, Cuckoo()
            stored = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held.to_bytes()], pa.binary())], names=["shard", "filter"])
            for shard, filter, k1, _, step in _parts(batches):
                if shard != at:
                    if at is not None:
                        yield stored()
                    at, held = shard, Cuckoo()
                if filter is not None:
                    held = Cuckoo(filter)
                held.add(np.repeat(k1, np.maximum(step, 0)))
                held.discard(np.repeat(k1, np.maximum(-step, 0)))
            if at is not None:
                yield stored()

        return self._streamed(changes, filters, shards, run, _FILTERS)

    def _room(self, more: int) -> tuple[int, DataFrame]:
        """Number of shards for ``more`` further keys, and the filters dealt to that many."""
        known = self._counts().filter("n > 0").select(*KEY).distinct().count() if self.batches else 0
        need = -(-2 * (known + more) // self.o.capacity) or 1
        have = self.batches[-1]["shards"] if self.batches else 0
        if have >= need:
            return have, self._filters()
        now = self._newest(self._counts()).selectExpr(*KEY, f"{_copies('n', 'first', 'last')} as step").filter("step > 0")
        empty = self.spark.createDataFrame([], _FILTERS)
        return max(need, 2 * have), self._updated(now, empty, max(need, 2 * have)) if self.batches else empty

    # -- batches

    def _commit(self, id: str, shards: int, filters: DataFrame, removes: bool) -> None:
        number = len(self.batches) + 1
        self._write(filters, "filters", id)
        state = self.spark.createDataFrame([(number, id, shards, id, removes)], _STATE)
        state.coalesce(1).write.mode("append").json(f"{self.path}/state")
        self.batches.append(state.first().asDict())

    def insert(self, docs: DataFrame) -> None:
        """Add the lines of ``docs(doc_id, text)`` as one batch."""
        id, scratch = uuid.uuid4().hex, Scratch(self.spark, "lines")
        refs = self._write(line_keys(docs, self.o), "refs", id)
        mine = scratch.keep(_counted(refs), "counts")
        shards, filters = self._room(mine.count())
        if self.batches:
            if shards != self.batches[-1]["shards"]:
                filters = self._write(filters, "filters", f"{id}-dealt")
                self.batches[-1] = self.batches[-1] | {"filters": f"{id}-dealt", "shards": shards}
            seen = scratch.keep(self._seen(mine.select(*KEY), shards), "seen")
            before = self._newest(self._counts().join(seen, KEY, "left_semi"))
        else:
            before = self.spark.createDataFrame([], _COUNTS)
        before = before.select(*KEY, *(F.col(c).alias(f"b_{c}") for c in ("n", "first", "last", "parts")))
        now = mine.join(before, KEY, "left").select(
            *KEY, F.expr("n + coalesce(b_n, 0)").alias("n"), F.least("first", "b_first").alias("first"), F.greatest("last", "b_last").alias("last"),
            F.expr("parts | coalesce(b_parts, 0)").alias("parts"), F.expr(_copies("b_n", "b_first", "b_last")).alias("had"),
        )
        now = scratch.keep(now, "now")
        self._write(now.drop("had"), "counts", id)
        changes = now.selectExpr(*KEY, f"{_copies('n', 'first', 'last')} - had as step").filter("step > 0")
        self._commit(id, shards, self._updated(changes, filters, shards), False)

    def remove(self, doc_ids: DataFrame) -> None:
        """Take the documents with these ``doc_id`` values out, as one batch."""
        if not self.batches:
            return
        id, scratch = uuid.uuid4().hex, Scratch(self.spark, "lines")
        ids = scratch.keep(doc_ids.select(F.col("doc_id").cast("bigint")).filter("doc_id is not null").distinct(), "ids")
        live = self.live()
        touched = scratch.keep(live.join(ids, "doc_id", "left_semi").select(*KEY).distinct(), "touched")
        left = _counted(live.join(ids, "doc_id", "left_anti").join(touched, KEY, "left_semi"))
        before = self._newest(self._counts().join(touched, KEY, "left_semi")).selectExpr(*KEY, f"{_copies('n', 'first', 'last')} as had")
        now = before.join(left, KEY, "left").select(*KEY, F.expr("coalesce(n, 0)").alias("n"), "first", "last", F.expr("coalesce(parts, 0)").alias("parts"), "had")
        now = scratch.keep(now, "now")
        self._write(ids, "removed", id)
        self._write(now.drop("had"), "counts", id)
        changes = now.selectExpr(*KEY, f"{_copies('n', 'first', 'last')} - had as step").filter("step < 0")
        shards = self.batches[-1]["shards"]
        self._commit(id, shards, self._updated(changes, self._filters(), shards), True)

    # -- results

    def repeated(self) -> DataFrame:
        """``doc_id, k1, k2``: the lines that documents lose."""
        # Without removals counts only grow, so a key with two holders now has a row that says so.
        counts = self._counts().filter(F.col("batch").isin([b["batch"] for b in self.batches if b["removes"]]) | F.expr("first < last"))
        twice = self._newest(counts).filter("first < last")
        bits = F.explode(F.expr(f"filter(sequence(0, {SPLITS - 1}), i -> getbit(parts, i) = 1)"))
        twice = twice.select(*KEY, "first", bits.alias("part"))
        rows = self.live().withColumn("part", F.expr(_part("doc_id")))
        return rows.join(twice, [*KEY, "part"]).filter("doc_id <> first").select("doc_id", *KEY)

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text without lines that an earlier document holds.

        The documents should be in the index. Columns of ``docs`` with these names are replaced.
        """
        shortest = self.o.shortest
        docs = without(docs, ("n_lines", "n_dropped", "kept"))
        gone = self.repeated().groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("__gone")).withColumnRenamed("doc_id", "__id")
        rows = docs.join(gone, F.col("doc_id").cast("bigint") == F.col("__id"), "left").drop("__id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            for batch in batches:
                text, gone = batch.column("text"), batch.column("__gone")
                n_lines, n_dropped, kept = [], [], []
                for row, lines in document_lines(text, shortest):
                    lost = {(g["k1"], g["k2"]) for g in gone[row].as_py() or ()}
                    lines = list(lines) if lost else lines
                    stay = [raw for raw, line in lines if line is None or _keys(line) not in lost] if lost else None
                    value = text[row].as_py()
                    value = value if isinstance(value, str) else "" if value is None else str(value)
                    total = len(lines) if lost else value.count("\n") + 1
                    n_lines.append(total)
                    n_dropped.append(total - len(stay) if lost else 0)
                    kept.append(b"\n".join(stay).decode() if lost else value)
                yield batch, [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]

        return extended(rows, ["text", "__gone"], run, "n_lines bigint, n_dropped bigint, kept string").drop("__gone")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, filter or None, k1, k2, step) for runs of rows of one shard; a filter is a run of its own."""
    for batch in batches:
        shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
        edges = np.flatnonzero((np.diff(shard) != 0) | (kind[1:] == 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(shard)]):
            if a == b:
                continue
            rows = batch.slice(a, b - a)
            filter = rows.column("filter")[0].as_py()
            rows = rows.slice(1) if kind[a] == 0 else rows
            k1, k2, step = (rows.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "step"))
            none = np.zeros(0, np.int64)
            yield (shard[a], filter, k1, k2, step) if len(rows) else (shard[a], filter, none, none, none)


def deduplicated_lines(docs: DataFrame, path: str, increments: int = 2, o: LineOptions = LineOptions()) -> tuple[LineIndex, DataFrame]:
    """The index of ``docs``, filled in increments by a hash of doc_id, and the cleaned documents."""
    index = LineIndex(docs.sparkSession, path, o)
    turn = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(increments)), F.lit(0))
    for i in range(increments):
        index.insert(docs.filter(turn == i))
    return index, index.cleaned(docs)
