"""Sitemap files: parsing and the walk from the root sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.html import decode_references
from sitegrain.functions.text import bind, strip, text_or_empty
from sitegrain.operators.links import reachable_pages
from sitegrain.operators.ordered import first_occurrence, unnest
from sitegrain.session import cut_lineage


def _locs(xml: Column, entry: str) -> Column:
    """First ``<loc>`` of every ``<entry>`` element, trimmed, blanks dropped."""
    bare = F.regexp_replace(
        F.regexp_replace(text_or_empty(xml), r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"
    )
    entries = F.regexp_extract_all(bare, F.lit(rf"(?s)<{entry}(?:\s[^>]*)?>(.*?)</{entry}\s*>"), 1)
    found = F.transform(
        entries,
        lambda e: strip(decode_references(F.regexp_extract(e, r"(?s)<loc[^>]*>(.*?)</loc\s*>", 1))),
    )
    return F.filter(found, lambda u: u != "")


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Add ``page_locs`` and ``sitemap_locs`` to ``(url, xml)`` rows."""
    return sitemaps.withColumns(
        {"page_locs": _locs(F.col("xml"), "url"), "sitemap_locs": _locs(F.col("xml"), "sitemap")}
    )


def all_locs(xml: Column) -> Column:
    """Every ``<loc>``, whatever element holds it."""
    found = F.regexp_extract_all(text_or_empty(xml), F.lit(r"(?is)<loc>(.*?)</loc>"), 1)
    return F.filter(F.transform(found, strip), lambda u: u != "")


def read_sitemap_files(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """``(file, loc)`` of sitemap files through the built-in XML reader."""
    tag = "sitemap" if index else "url"
    rows = (
        spark.read.option("rowTag", tag).schema("loc STRING").xml(path)
        .select(F.col("_metadata.file_path").alias("file"), F.trim("loc").alias("loc"))
    )
    return rows.filter("loc <> ''")


def _good(locs: Column) -> Column:
    """Entries that are absolute URLs; the others are in ``bad_locs``."""
    return F.filter(locs, lambda u: urls.is_absolute(u))


def bad_locs(sitemaps: DataFrame) -> DataFrame:
    """``(url, pos, loc)`` of every entry of stored sitemaps that is no absolute URL."""
    rows = unnest(sitemaps, ["url"], all_locs(F.col("xml")), "loc", "pos")
    return rows.filter(~urls.is_absolute(F.col("loc"))).select("url", "pos", "loc")


def sitemap_pages(
    roots: DataFrame, sitemaps: DataFrame, audit: bool = False, max_sitemaps: int | None = None
) -> DataFrame:
    """Pages listed by the sitemaps reachable from ``/sitemap.xml`` of each root.

    ``roots(base_url)``, ``sitemaps(url, xml)`` (stored files). Result: ``site,
    pos, url`` with one row per page, ``pos`` ordered by sitemap visit and place
    in the file. The audit form takes every ``<loc>``: names that look like
    sitemaps are children, the rest pages, and utility paths are kept. Bad
    entries are passed over. ``max_sitemaps`` limits the files read per site.
    """
    site_and_root = bind(
        urls.base_url(F.col("base_url")),
        lambda o: F.struct(urls.hostname(o).alias("site"), F.concat(o, F.lit("/sitemap.xml")).alias("url")),
    )
    seeds = roots.select(site_and_root.alias("seed")).select("seed.site", "seed.url").distinct()
    if audit:
        looks_like_map = lambda u: u.rlike(r"(?i)\.xml(?:\?|$)") | u.rlike("(?i)sitemap")
        parsed = sitemaps.withColumn("__locs", _good(all_locs(F.col("xml")))).withColumns(
            {
                "page_locs": F.filter("__locs", lambda u: ~looks_like_map(u)),
                "sitemap_locs": F.filter("__locs", looks_like_map),
            }
        )
    else:
        parsed = parse_sitemaps(sitemaps).withColumns(
            {"sitemap_locs": _good(F.col("sitemap_locs")), "page_locs": _good(F.col("page_locs"))}
        )
    # Files are parsed once; the walk below reads the parsed table each round.
    stored = cut_lineage(
        parsed.select(
            urls.hostname(F.col("url")).alias("site"),
            urls.canonical(F.col("url")).alias("url"),
            F.transform("page_locs", lambda u: urls.canonical(u)).alias("pages"),
            F.transform("sitemap_locs", lambda u: urls.canonical(u)).alias("children"),
        )
    )
    edges = unnest(
        stored, ["site", F.col("url").alias("source")], F.col("children"), "target", "pos"
    ).filter(urls.hostname(F.col("target")) == F.col("site"))
    visited = reachable_pages(seeds, edges, stored, max_depth=None, max_pages=max_sitemaps, page_filter=False)
    listed = (
        visited.select("site", "url", "seq")
        .join(stored.select("site", "url", "pages"), ["site", "url"])
    )
    listed = unnest(listed, ["site", "seq"], F.col("pages"), "page", "pos")
    keep = urls.same_host(F.col("page"), F.col("site")) & urls.likely_html(F.col("page"))
    if not audit:
        keep = keep & ~urls.skip_for_audit(F.col("page"))
    unique = first_occurrence(listed.filter(keep), ["site", "page"], [F.col("seq"), F.col("pos")])
    return unique.select(
        "site", (F.col("seq") * F.lit(1 << 32) + F.col("pos")).alias("pos"), F.col("page").alias("url")
    )
