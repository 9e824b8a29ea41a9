"""Incremental runs: pages, content changes, run progress, dead letters.

Each query is a plain Structured Streaming query over a folder of parquet files
with its own checkpoint. Sinks that a retried batch could write twice write one
folder per batch and overwrite it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from sitegrain.operators.ordered import first_occurrence
from sitegrain.operators.pages import content_quality, read_pages, scrape_fields
from sitegrain.operators.routing import route_pages
from sitegrain.operators.runs import DONE, FAILED, SKIPPED
from sitegrain.session import cut_lineage
from sitegrain.vocab import Vocabulary


def stream_folder(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000, names: str = "*"
) -> DataFrame:
    """Parquet files arriving in a folder; ``names`` is a glob on file names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", names).parquet(path)


def audited_pages(pages: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """Page features and route; the same projection for batch and stream."""
    features = content_quality(scrape_fields(read_pages(pages)))
    return route_pages(features, vocab).drop("html", "visible", "void_tags")


def run_page_stream(
    pages: DataFrame, out: str, checkpoint: str, vocab: Vocabulary = Vocabulary()
) -> StreamingQuery:
    """Append features of arriving pages; progress survives in the checkpoint."""
    return (
        audited_pages(pages, vocab)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


LATEST_BUCKETS = 64


def changed_pages_writer(store: str, key: str = "url", buckets: int = LATEST_BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch function that stores every row whose hash differs from the one before it, in ``seq`` order.

    Rows need ``key, content_hash, seq``; ``seq`` grows with time. ``store/history`` gets the changes, a folder per
    batch, however rows fall into batches. ``store/latest`` holds one row per key in hash buckets: a batch reads and
    rewrites only the buckets of its own keys, and no history. A row of ``latest`` remembers what it was before the
    batch that wrote it, so a retried batch starts from the same state, even if it broke off between two buckets.

    Rows not newer than the stored one of their key, and rows without key or seq, are passed over; of several rows
    with one key and seq the one with the smallest hash counts. A null hash is a value like any other.
    """
    latest_path, history = f"{store}/latest", f"{store}/history"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.schema.fields
        kind = {f.name: f.dataType for f in own}
        batch = batch.filter(F.col(key).isNotNull() & F.col("seq").isNotNull())
        rows = first_occurrence(batch, [key, "seq"], [F.col("content_hash").asc_nulls_first()])
        rows = cut_lineage(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
        state = StructType([StructField(n, kind[n]) for n in (key, "content_hash", "seq")])
        for f in (StructField("before_hash", kind["content_hash"]), StructField("before_seq", kind["seq"]), StructField("batch", LongType()), StructField("bucket", IntegerType())):
            state = state.add(f)
        stored = _stored(spark, latest_path, state).filter(F.col("bucket").isin(touched))
        again = F.col("batch") == batch_id
        known = stored.select(
            key, F.when(again, F.col("before_hash")).otherwise(F.col("content_hash")).alias("known_hash"),
            F.when(again, F.col("before_seq")).otherwise(F.col("seq")).alias("known_seq"), "bucket",
        ).filter("known_seq is not null")
        # The stored row of a key stands before its new ones; a window sees the rows of one key only.
        new = rows.join(known.drop("bucket"), key, "left").filter("known_seq is null or seq > known_seq")
        order = Window.partitionBy(key).orderBy("seq")
        first = F.row_number().over(order) == 1
        before = F.when(first, F.col("known_hash")).otherwise(F.lag("content_hash").over(order))
        seen = ~first | F.col("known_seq").isNotNull()
        judged = new.withColumns({"before": before, "seen": seen, "newest": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq"))) == 1})
        judged = cut_lineage(judged, "judged")
        changed = judged.filter(~F.col("seen") | ~F.col("before").eqNullSafe(F.col("content_hash")))
        changed.select(*(f.name for f in own)).write.mode("overwrite").parquet(_batch_folder(history, batch_id))
        fresh = judged.filter("newest").select(
            key, "content_hash", "seq", F.col("known_hash").alias("before_hash"), F.col("known_seq").alias("before_seq"),
            F.lit(batch_id).cast("long").alias("batch"), "bucket",
        )
        kept = stored.join(fresh.select(key), key, "left_anti")
        rewritten = cut_lineage(fresh.unionByName(kept), "latest")
        writer = rewritten.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(latest_path)

    return write


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def page_history(spark: SparkSession, store: str) -> DataFrame:
    """All changes that :func:`changed_pages_writer` stored."""
    return spark.read.parquet(f"{store}/history").drop("batch")


PROGRESS = "run_id string, total bigint, completed bigint, failed bigint, outcome string"
_COUNTED = "completed bigint, failed bigint, total bigint, seen_ms bigint, fired boolean"


def run_progress(status: DataFrame, totals: DataFrame, idle: str = "1 day") -> DataFrame:
    """One row per run when its last page is in: ``run_id, total, completed, failed, outcome``.

    ``status(run_id, url, status, ts)`` is a stream, ``totals(run_id, total)`` a stored table. Skipped pages count as
    completed. A run is ``finished`` once; further rows of it change nothing. A run without a row for ``idle`` of event
    time is dropped: one that was not finished comes out as ``abandoned``, one that was leaves nothing. The state is
    thus bounded by the runs of the last ``idle``. A row that comes after its run was dropped starts the run anew.

    Each task counts its own rows per run first, so a run with a third of all pages sends a few rows.
    """
    millis = idle_millis(idle)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows = rows.assign(completed=rows["status"].isin([DONE, SKIPPED]), failed=rows["status"] == FAILED)
            per = rows.groupby("run_id", as_index=False).agg({"completed": "sum", "failed": "sum", "total": "max", "ts": "max"})
            yield per.astype({"completed": "int64", "failed": "int64", "total": "int64"})

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        completed, failed, total, seen, fired = state.get if state.exists else (0, 0, 0, 0, False)
        row = lambda outcome: pd.DataFrame({"run_id": [key[0]], "total": [total], "completed": [completed], "failed": [failed], "outcome": [outcome]})
        if state.hasTimedOut:
            state.remove()
            if not fired:
                yield row("abandoned")
            return
        for part in frames:
            if not fired:
                completed, failed = completed + int(part["completed"].sum()), failed + int(part["failed"].sum())
            total = max(total, int(part["total"].max()))
            seen = max(seen, int(part["ts"].max().timestamp() * 1000))
        if not fired and completed + failed >= total:
            fired = True
            yield row("finished")
        state.update((completed, failed, total, seen, fired))
        state.setTimeoutTimestamp(max(seen + millis, state.getCurrentWatermarkMs() + 1))

    rows = status.join(totals, "run_id").select(F.col("run_id").cast("string"), "status", F.col("total").cast("long"), F.col("ts").cast("timestamp"))
    parts = rows.filter("run_id is not null and ts is not null").mapInPandas(counted, "run_id string, completed long, failed long, total long, ts timestamp")
    return parts.withWatermark("ts", "0 seconds").groupBy("run_id").applyInPandasWithState(
        advance, PROGRESS, _COUNTED, "append", GroupStateTimeout.EventTimeTimeout
    )


def idle_millis(idle: str) -> int:
    """Milliseconds of an interval such as ``1 day`` or ``30 minutes``."""
    number, unit = idle.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(float(number) * 1000 * seconds[unit.rstrip("s")])


def run_progress_stream(progress: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished and abandoned runs; the file sink writes each of them once."""
    return (
        progress.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def split_dead_letters(rows: DataFrame, stage: str, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """``(good, dead)``: rows with an error become ``stage, payload, error, failed_at``.

    Rows need ``failed_at`` (event time, so that retries give equal rows).
    """
    bad = F.col(error).isNotNull()
    payload = F.to_json(F.struct(*[c for c in rows.columns if c not in (error, "failed_at")]))
    dead = rows.filter(bad).select(
        F.lit(stage).alias("stage"), payload.alias("payload"), F.col(error).alias("error"), "failed_at"
    )
    return rows.filter(~bad).drop(error, "failed_at"), dead


def dead_letter_writer(good_path: str, dead_path: str, stage: str) -> Callable[[DataFrame, int], None]:
    """Batch function that writes good rows and dead letters side by side."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, dead = split_dead_letters(batch, stage)
        good.write.mode("overwrite").parquet(_batch_folder(good_path, batch_id))
        dead.write.mode("overwrite").parquet(_batch_folder(dead_path, batch_id))
        batch.unpersist()

    return write


def run_batches(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


