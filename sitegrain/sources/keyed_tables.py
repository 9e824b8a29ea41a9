"""Stored tables with one row per key, updated in place without rewriting what an update does not touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sitegrain.session import cut_lineage

_BUCKET = "__bucket"
MANY_FILES = 256  # a bucket of more files is written again as a whole


class KeyedTable:
    """A Parquet folder of hash buckets of keys; an upsert rewrites only the buckets that have some of its keys.

    The new buckets are written beside the table and take the place of the old ones when all are there (dynamic
    partition overwrite). An upsert that is run again gives the same table. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(_BUCKET, IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame) -> DataFrame:
        buckets = [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # no more than there are buckets
        return self._stored().filter(F.col(_BUCKET).isin(buckets))

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        """All rows, or those whose keys are among ``asked``; only the buckets of these are read."""
        if asked is None:
            return self._stored().drop(_BUCKET)
        return self._touched(asked).drop(_BUCKET).join(asked.select(*self.keys).distinct(), self.keys, "left_semi")

    def upsert(self, rows: DataFrame, stored: bool = False) -> None:
        """Insert ``rows`` (one per key; a key must not be null) or put them in the place of those with their keys.

        New files join a bucket that has none of the keys. Of a bucket that has, files whose keys all stay are taken
        over whole, files whose keys are all replaced are left behind, and only rows of the others meet the new keys.
        ``stored``: ``rows`` is a stored table, which is not written again first; its tasks write a file per bucket.
        """
        rows = rows.select(*self.schema.names)
        rows = rows if stored else cut_lineage(rows, "upsert")
        new = rows.withColumn(_BUCKET, self._bucket())
        files = self._files(rows)
        per: dict[int, list] = {}
        for f in files:
            per.setdefault(f[_BUCKET], []).append(f)
        again = [b for b, own in per.items() if len(own) > MANY_FILES or any(f["gone"] for f in own)]
        if again:
            paths = {k: [f["__file"] for b in again for f in per[b] if (f["gone"] == 0, f["gone"] == f["all"]) == k] for k in ((True, False), (False, False))}
            of = lambda k: self._stored().filter(F.col(_BUCKET).isin(again) & F.col("_metadata.file_path").isin(paths[k]))
            kept = of((True, False)).unionByName(of((False, False)).join(rows.select(*self.keys), self.keys, "left_anti"))
            rewritten = new.filter(F.col(_BUCKET).isin(again)).unionByName(cut_lineage(kept, "kept"))
            new = new.filter(~F.col(_BUCKET).isin(again))
        for part, mode in ((new, "append"), *([(rewritten, "overwrite")] if again else [])):
            dealt = part if stored else part.repartition(_BUCKET)
            writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            writer.partitionBy(_BUCKET).parquet(self.path)

    def _files(self, rows: DataFrame) -> list:
        """Files of the buckets of ``rows``, with their numbers of rows in all and of those whose keys are in ``rows``."""
        if not self._stored().inputFiles():
            return []
        held = self._touched(rows).select(*self.keys, _BUCKET, F.col("_metadata.file_path").alias("__file"))
        keys = rows.select(*self.keys).distinct().withColumn("__new", F.lit(1))
        per = held.join(keys, self.keys, "left").groupBy("__file", _BUCKET)
        return per.agg(F.count("*").alias("all"), F.count("__new").alias("gone")).collect()
