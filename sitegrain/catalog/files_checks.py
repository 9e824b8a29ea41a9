"""Registered queries over files: strict URL lists, sitemap files and logs, each written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog.audit_checks import order_sitemaps
from sitegrain.catalog.common import table
from sitegrain.session import work_folder
from sitegrain.sources import artifacts as A
from sitegrain.sources import url_lists as U
from sitegrain.sources.sitemaps import read_sitemap_files


def strict_urls(spark: SparkSession, sf: str) -> DataFrame:
    """A list file with a line per order: URLs, blanks, comments and lines that are no URL."""
    key, path = F.col("o_orderkey").cast("string"), work_folder(spark, "url-list")
    line = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("# "), key))
        .when(F.col("o_orderkey") % 7 == 1, F.lit("  "))
        .when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit("ftp://a.example/"), key))
        .otherwise(F.concat(F.lit(" HTTPS://a.example/"), key, F.lit("\t")))
    )
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    good, bad = U.strict_url_list(U.read_lines(spark, path))
    return good.select("url", F.lit(True).alias("usable")).unionByName(bad.select("url", F.lit(False).alias("usable")))


def sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap files of a thousand order keys each, by the XML reader."""
    path = work_folder(spark, "sitemaps")
    _, stored = order_sitemaps(spark, sf)
    entries = F.regexp_replace("xml", "</?urlset>", "")
    own = stored.filter("url like '%/b.xml'").groupBy(F.floor(F.regexp_extract("url", "o([0-9]+)[.]", 1).cast("bigint") / 1000).alias("file"))
    files = own.agg(F.array_join(F.collect_list(entries), "").alias("all"))
    files.select("file", F.concat(F.lit("<urlset>"), "all", F.lit("</urlset>")).alias("value")).write.partitionBy("file").text(path)
    return read_sitemap_files(spark, path).groupBy("loc").agg(F.count("*").alias("entries"))


def log_file(spark: SparkSession, sf: str) -> DataFrame:
    """Events logged to a file, errors as lines that break off; records and bad lines."""
    path = work_folder(spark, "log")
    events = table(spark, sf, "events").select("ts", F.lit("info").alias("level"), F.col("event_type").alias("event"), "event_id")
    A.write_log(events.filter("event <> 'error'"), path, "ts", "level", "event")
    lines = A.log_lines(events.filter("event = 'error'"), "ts", "level", "event")
    lines.select(F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.mode("append").text(path)
    records, bad = A.split_log(spark.read.text(path))
    good = records.select(F.col("extra")["event_id"].cast("bigint").alias("event_id"), F.unix_millis("ts").alias("ms"), "event", F.lit(True).alias("parsed"))
    lost = bad.select(F.regexp_extract("value", '"event_id":([0-9]+)', 1).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("ms"), F.lit("").alias("event"), F.lit(False).alias("parsed"))
    return good.unionByName(lost)


QUERIES = {f.__name__: f for f in (strict_urls, sitemap_files, log_file)}

ORACLES = {
    "strict_urls": """
      SELECT CASE o_orderkey % 7 WHEN 2 THEN 'ftp://a.example/' ELSE 'HTTPS://a.example/' END || o_orderkey AS url, o_orderkey % 7 <> 2 AS usable
      FROM orders WHERE o_orderkey % 7 > 1""",
    "sitemap_files": """
      SELECT 'https://o' || o_orderkey || '.example.com/' || p AS loc, count(*) AS entries FROM orders,
        (SELECT unnest(['s', 'login']) AS k), LATERAL (SELECT CASE k WHEN 's' THEN 's/' || o_orderkey ELSE 'login/' END AS p) GROUP BY 1""",
    "log_file": """
      SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS ms,
        CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS event, event_type <> 'error' AS parsed FROM events""",
}
