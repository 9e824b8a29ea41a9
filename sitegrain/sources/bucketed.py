"""Stored tables bucketed by page: joins of two of them on their key need no shuffle.

Snapshots, artifacts and crawls of a site are joined by page in every run. Stored by :func:`write_bucketed` with one key
and number of buckets, each bucket meets its partner in one task, sorted already: only new rows ever move.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BUCKETS = 64


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """Write ``df`` in ``path``, a sorted file per bucket, and read it as a bucketed table.

    The table is registered as ``name`` (else under a new one) in the session's catalog. Rows with a null key stay
    in one bucket. More than a bucket's worth of rows of one key cannot be split: choose keys that identify rows.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """A table that an earlier session wrote."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
