"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.operators.pages import content_quality, read_pages, scrape_fields
from sitegrain.operators.routing import route_pages, route_urls
from sitegrain.vocab import Vocabulary

# The given pages hold none of the default product words, so the registered
# queries read section names as vocabulary: both engines get the same words.
SITE_VOCAB = Vocabulary(
    product_terms=("en", "html"),
    attribute_terms=("the", "tion"),
    category_words=("de",),
    category_segments=("category", "categories", "de"),
    blog_segments=("fr",),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(table(spark, sf, "pages"))


def url_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``site, idx, url, page_type`` typed by URL; html is never read."""
    pages = site_pages(spark, sf).select("site", "idx", "url")
    return route_urls(pages, SITE_VOCAB)


def scraped(spark: SparkSession, sf: str) -> DataFrame:
    return scrape_fields(site_pages(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return route_pages(content_quality(scraped(spark, sf)), SITE_VOCAB)


def joined(array, sep: str = "|"):
    return F.array_join(array, sep)
