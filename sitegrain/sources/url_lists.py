"""URL list files and the precedence of discovered page lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.text import strip, text_or_empty
from sitegrain.operators.ordered import first_occurrence, lookup, prefix_limit

_HTTP = r"^(?i)https?://"


class UrlListError(ValueError):
    """A strict URL list holds no URL or lines that are not URLs."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a text file; numbers grow in file order."""
    raw = spark.read.text(path)
    return raw.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def parse_url_list(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Distinct http(s) URLs of ``(order, line)`` rows; the first copy stays."""
    cleaned = lines.select(order, strip(text_or_empty(F.col("line"))).alias("url"))
    return first_occurrence(cleaned.filter(F.col("url").rlike(_HTTP)), ["url"], [F.col(order)])


def strict_url_list(lines: DataFrame, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """``(urls, bad_lines)``: blanks and ``#`` lines dropped, the rest judged."""
    kept = lines.select(order, strip(text_or_empty(F.col("line"))).alias("url")).filter(
        (F.col("url") != "") & ~F.col("url").startswith("#")
    )
    is_url = F.col("url").rlike(_HTTP)
    return kept.filter(is_url), kept.filter(~is_url)


def load_strict(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a strict list file; raises on bad lines or an empty list."""
    good, bad = strict_url_list(read_lines(spark, path))
    examples = [r["url"] for r in bad.orderBy("line_no").limit(3).collect()]
    if examples:
        raise UrlListError("URL list contains non-http entries: " + ", ".join(examples))
    if good.isEmpty():
        raise UrlListError(f"URL list at {path} is empty.")
    return good


def discover(
    explicit: DataFrame,
    sitemap: DataFrame,
    crawled: DataFrame,
    max_pages: int = 0,
    staged: bool = False,
) -> DataFrame:
    """Pages per site from the first non-empty source, with the method's name.

    Each source has ``(site, pos, url)``. Utility paths are dropped; the staged
    form exempts the explicit list. Result: ``site, idx, url, method``, where
    ``idx`` keeps the order of the source.
    """
    # fixed values: method names, full and staged
    names = (
        ("explicit-list", "sitemap", "internal-crawl") if staged else ("url-list", "sitemap", "crawl")
    )
    every = None
    for priority, (frame, method) in enumerate(zip((explicit, sitemap, crawled), names)):
        rows = frame.select(
            "site",
            F.col("pos").cast("long").alias("idx"),
            strip(text_or_empty(F.col("url"))).alias("url"),
            F.lit(priority).alias("priority"),
            F.lit(method).alias("method"),
        ).filter("url <> ''")
        every = rows if every is None else every.unionByName(rows)
    chosen = every.groupBy("site").agg(F.min("priority").alias("chosen"))
    picked = lookup(every, chosen, ["site"], "url", "inner").filter("priority = chosen")
    allowed = ~urls.skip_for_audit(F.col("url"))
    if staged:
        allowed = allowed | (F.col("priority") == 0)
    unique = first_occurrence(picked.filter(allowed), ["site", "url"], [F.col("idx")])
    return prefix_limit(unique.select("site", "idx", "url", "method"), max_pages)


def by_precedence(
    sources: Sequence[tuple[str, DataFrame]], key: str, columns: Sequence[str]
) -> DataFrame:
    """One row per key from the first source that has it, with ``source`` named."""
    every = None
    for priority, (name, frame) in enumerate(sources):
        rows = frame.select(
            key, *columns, F.lit(name).alias("source"), F.lit(priority).alias("priority")
        )
        every = rows if every is None else every.unionByName(rows)
    return first_occurrence(every, [key], [F.col("priority")]).drop("priority")


# fixed values: file-name endings of scraped records, in the order they are tried
SCRAPED_ENDINGS = (".dataset.json", ".scraped.json", ".json")
STAGED_ENDINGS = (".scraped.json",)


def read_scraped_directory(
    spark: SparkSession, path: str, schema: str, endings: Sequence[str] = SCRAPED_ENDINGS
) -> DataFrame:
    """Scraped records of a directory, one per page slug, by ending precedence.

    Files that do not parse are skipped. ``schema`` is a DDL string.
    """
    raw = (
        spark.read.schema(schema + ", _corrupt_record STRING")
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("__file", F.col("_metadata.file_name"))
    )
    priority, slug = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, ending in reversed(list(enumerate(endings))):
        hit = F.col("__file").endswith(ending)
        priority = F.when(hit, i).otherwise(priority)
        slug = F.when(hit, F.substring("__file", F.lit(1), F.length("__file") - len(ending))).otherwise(slug)
    named = raw.filter("_corrupt_record IS NULL").withColumns({"slug": slug, "__priority": priority})
    usable = named.filter("slug IS NOT NULL")
    return first_occurrence(usable, ["slug"], [F.col("__priority")]).drop(
        "__priority", "__file", "_corrupt_record"
    )
