"""JSON artifacts with their envelope, and metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value
SCHEMA_VERSION = "1.0"
ENVELOPE = ("schemaVersion", "producer", "runId", "promptVersion", "model", "createdAt")
LOG_FIELDS = ("ts", "level", "event")


def with_envelope(
    payload: DataFrame,
    created_at: Column,
    producer: str = "unknown",
    run_id: str = "",
    prompt_version: str = "unknown",
    model: str = "",
) -> DataFrame:
    """Put envelope columns before the payload; payload columns of the same
    name win. ``created_at`` is explicit so that reruns give equal rows."""
    values = {
        "schemaVersion": F.lit(SCHEMA_VERSION),
        "producer": F.lit(producer or "unknown"),
        "runId": F.lit(run_id),
        "promptVersion": F.lit(prompt_version or "unknown"),
        "model": F.lit(model),
        "createdAt": created_at,
    }
    head = [values[c].alias(c) for c in ENVELOPE if c not in payload.columns]
    return payload.select(*head, "*")


def write_artifacts(enveloped: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, one folder per producer."""
    enveloped.write.mode(mode).partitionBy("producer").json(path)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Artifacts of a folder; lines that do not parse are dropped."""
    raw = (
        spark.read.schema(schema + ", _corrupt_record STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return raw.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def log_lines(events: DataFrame, ts: str, level: str, event: str) -> DataFrame:
    """``value`` column of JSON log lines; further columns follow the fixed three."""
    stamp = F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    extra = [c for c in events.columns if c not in (ts, level, event)]
    line = F.to_json(
        F.struct(
            stamp.alias("ts"), F.col(level).alias("level"), F.col(event).alias("event"), *extra
        )
    )
    return events.select(line.alias("value"))


def write_log(events: DataFrame, path: str, ts: str, level: str, event: str, mode: str = "append") -> None:
    log_lines(events, ts, level, event).write.mode(mode).text(path)


def split_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, bad)`` of JSON log lines: ``ts, level, event, extra``, and the lines that are no JSON object or have no event.

    Both read the lines once; free keys go to a map. Blank lines are neither.
    """
    fields = F.from_json("value", "map<string,string>")
    judged = lines.filter(F.trim("value") != "").select("value", fields.alias("f"))
    good = F.coalesce(F.col("f")["event"].isNotNull(), F.lit(False))
    records = judged.filter(good).select(
        F.to_timestamp(F.col("f")["ts"]).alias("ts"),
        F.col("f")["level"].alias("level"),
        F.col("f")["event"].alias("event"),
        F.map_filter("f", lambda k, v: ~k.isin(*LOG_FIELDS)).alias("extra"),
    )
    return records, judged.filter(~good).select("value")


def parse_log(lines: DataFrame) -> DataFrame:
    """``ts, level, event, extra`` from JSON lines; free keys go to a map."""
    fields = F.from_json("value", "map<string,string>")
    parsed = lines.select(fields.alias("f")).filter("f IS NOT NULL AND size(f) > 0")
    return parsed.select(
        F.to_timestamp(F.col("f")["ts"]).alias("ts"),
        F.col("f")["level"].alias("level"),
        F.col("f")["event"].alias("event"),
        F.map_filter("f", lambda k, v: ~k.isin(*LOG_FIELDS)).alias("extra"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))
