"""Page features: one projection over stored HTML, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import html as H
from sitegrain.functions import urls
from sitegrain.functions.text import first_n, word_count

PREFIX_WORDS = 1500
THIN_WORDS = 300


def read_pages(pages: DataFrame, idx: str = "page_id") -> DataFrame:
    """Stored pages as ``(site, idx, url, html)``; the site is the URL host."""
    return pages.select(
        urls.hostname(F.col("url")).alias("site"),
        F.col(idx).cast("long").alias("idx"),
        F.col("url"),
        F.col("html"),
    )


def scrape_fields(pages: DataFrame) -> DataFrame:
    """All fields of a scraped page; raw HTML is read once and kept last.

    Steps are separate projections so that each shared value (visible markup,
    headings, text, links) is computed once.
    """
    seen = F.col("visible")
    stripped = pages.withColumn("visible", H.strip_hidden(F.col("html"))).withColumn(
        "void_tags", H.void_tags(seen)
    )
    step1 = stripped.select(
        "site",
        "idx",
        "url",
        "html",
        "visible",
        "void_tags",
        H.title(seen).alias("title"),
        H.meta_description(F.col("void_tags")).alias("meta_description"),
        H.headings(seen).alias("headings"),
        H.body_text(seen).alias("body_text"),
        H.hrefs(seen).alias("hrefs"),
    )
    words = F.when(F.col("body_text") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.col("body_text"), " ")
    )
    step2 = step1.withColumn("body_words", words)
    return step2.select(
        "site",
        "idx",
        "url",
        "title",
        "meta_description",
        "headings",
        "body_text",
        F.array_join(first_n(F.col("body_words"), PREFIX_WORDS), " ").alias("first_1500_words"),
        F.size("body_words").cast("long").alias("word_count"),
        H.product_entity(H.first_h1(F.col("headings")), F.col("title"), F.col("url")).alias(
            "product_entity"
        ),
        H.internal_links(F.col("url"), F.col("hrefs")).alias("internal_links"),
        H.relative_link_count(F.col("hrefs")).alias("relative_link_count"),
        H.absolute_link_count(F.col("hrefs")).alias("absolute_link_count"),
        "html",
        "visible",
        "void_tags",
    )


def technical_columns() -> dict[str, Column]:
    """Technical fields by name, from the ``visible`` and ``void_tags`` columns."""
    seen, tags = F.col("visible"), F.col("void_tags")
    return {
        "technical_title": H.first_title(seen),
        "technical_meta_description": H.meta_description_or_og(tags),
        "canonical": H.canonical_link(tags),
        "robots": H.robots_meta(tags),
        "missing_alt_images": H.missing_alt_images(tags),
        "multiple_h1": H.h1_count(seen) > 1,
    }


def technical_seo(pages: DataFrame) -> DataFrame:
    stripped = pages.withColumn("visible", H.strip_hidden(F.col("html"))).withColumn(
        "void_tags", H.void_tags(F.col("visible"))
    )
    return stripped.select(
        "site", "idx", "url", *[c.alias(name) for name, c in technical_columns().items()]
    )


def content_quality(features: DataFrame, prefix_words: int | None = None) -> DataFrame:
    """Quality fields; scraped headings win over the h1–h6 fallback when present.

    All counts are over the whole page. ``prefix_words`` limits the word count
    to a stored prefix of that many words.
    """
    count = F.col("word_count") if prefix_words is None else F.least(F.col("word_count"), F.lit(prefix_words))
    fallback = H.headings(F.col("visible"), "1-6")
    return features.withColumns(
        {
            "quality_word_count": count,
            "thin_content": count < THIN_WORDS,
            "paragraph_count": H.paragraph_count(F.col("visible")),
            "heading_structure": F.when(F.size("headings") > 0, F.col("headings")).otherwise(fallback),
        }
    )


def serp_page(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Competitor page row: headings, text (cut at ``max_chars``, if given), word count, types, questions."""
    seen = F.col("visible")
    stripped = pages.withColumn("with_data", H.strip_hidden(F.col("html"), keep_json_ld=True))
    text = stripped.withColumn("visible", H.strip_hidden(F.col("with_data"))).withColumn(
        "serp_text", H.body_text(seen)
    )
    return text.select(
        "site",
        "idx",
        "url",
        H.headings(seen, "1-3", drop_empty=True).alias("headings"),
        (F.col("serp_text") if max_chars is None else F.substring("serp_text", 1, max_chars)).alias("paragraph_text"),
        word_count(F.col("serp_text")).alias("word_count"),
        H.json_ld_types(F.col("with_data")).alias("schema_types"),
        H.faq_questions(seen).alias("faq_questions"),
    )
