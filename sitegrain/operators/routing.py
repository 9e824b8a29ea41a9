"""Page-type routing, product signals, type filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import html as H
from sitegrain.functions import urls
from sitegrain.functions.text import any_of, bind, contains_any, holds_any, text_or_empty
from sitegrain.vocab import Vocabulary


def page_type(
    url: Column,
    title: Column | None = None,
    heading_texts: Column | None = None,
    text: Column | None = None,
    vocab: Vocabulary = Vocabulary(),
) -> Column:
    """Page type by the first rule that matches: path rules first, words second."""
    raw = text_or_empty(url)
    p = F.lower(F.when(urls.is_absolute(raw), urls.path(raw)).otherwise(raw))
    blank = F.lit("")
    combined = F.lower(
        F.concat_ws(
            " ",
            text_or_empty(title) if title is not None else blank,
            F.array_join(heading_texts, " ") if heading_texts is not None else blank,
            text_or_empty(text) if text is not None else blank,
        )
    )
    product = (
        p.rlike(f"/{any_of(vocab.product_segments)}/")
        | p.rlike(f"/{any_of(vocab.product_terms)}(?:/|$)")
        | p.rlike(f"/{any_of(vocab.product_prefixes)}")
    )
    blog = p.rlike(f"/{any_of(vocab.blog_segments)}/")
    category = p.rlike(f"/{any_of(vocab.category_segments)}/") | p.rlike(
        f"/{any_of(vocab.category_words)}(?:/|$)"
    )

    def by_rule(words: Column) -> Column:
        return (
            F.when(p.isin("", "/"), "homepage")
            .when(product | holds_any(words, vocab.commerce_phrases), "pdp")
            .when(blog | holds_any(words, vocab.blog_words), "blog")
            .when(category, "category")
            .otherwise("generic")
        )

    return bind(combined, by_rule)


def route_pages(features: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """Add ``page_type`` from URL, title, headings and the whole visible text."""
    texts = F.transform("headings", lambda h: h["text"])
    return features.withColumn(
        "page_type",
        page_type(F.col("url"), F.col("title"), texts, F.col("body_text"), vocab),
    )


def route_urls(pages: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """Add ``page_type`` from the URL alone (before a page is read)."""
    return pages.withColumn("page_type", page_type(F.col("url"), vocab=vocab))


def product_signals(pages: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """Five product signals and the verdict drawn from them."""
    page = text_or_empty(F.col("html"))
    p = F.lower(F.when(urls.is_absolute(F.col("url")), urls.path(F.col("url"))).otherwise(""))
    url_pattern = p.rlike(f"/{any_of(vocab.signal_segments)}(?:/|$)") | p.rlike(
        any_of(vocab.signal_path_prefixes)
    )
    cta = page.rlike(
        r"(?i)(?:add\s*to\s*cart|upload\s*artwork|customize|select\s*size|choose\s*options?)"
    )
    pricing = page.rlike(r"\$\s?\d") | page.rlike(
        r"(?i)(?<![A-Za-z0-9_])price(?![A-Za-z0-9_])"
    )
    schema = page.rlike(r'(?i)(?:schema\.org/Product|"@type"\s*:\s*(?:\[\s*)?"Product")')
    h1 = F.lower(
        H.inner_text(F.regexp_extract(page, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>", 1))
    )
    out = pages.withColumns(
        {
            "signal_url": url_pattern,
            "signal_cta": cta,
            "signal_pricing": pricing,
            "signal_schema": schema,
            "signal_heading": contains_any(h1, vocab.signal_headings),
        }
    )
    names = ["signal_url", "signal_cta", "signal_pricing", "signal_schema", "signal_heading"]
    score = sum((F.col(n).cast("int") for n in names), F.lit(0))
    with_url = F.col("signal_url") & (
        F.col("signal_cta") | F.col("signal_pricing") | F.col("signal_heading")
    )
    return out.withColumn("is_product", F.col("signal_schema") | with_url | (score >= 2))


def apply_type_filter(
    routed: DataFrame, page_type_filter: str | None = None, force_pdp: bool = False
) -> DataFrame:
    """Mark pages of other types as skipped and say whether a page is a product page."""
    skip = F.lit(None).cast("string")
    if page_type_filter:
        skip = F.when(
            F.col("page_type") != page_type_filter, F.concat(F.lit("filtered_"), F.col("page_type"))
        )
    return routed.withColumns(
        {
            "skip_reason": skip,
            "product_page": F.lit(True) if force_pdp else (F.col("page_type") == "pdp"),
        }
    )


# fixed values: messages worth another attempt
RETRYABLE_MESSAGES = (
    "status code 503", "status code 429", "status code 502", "status code 504",
    "overloaded", "timeout",
)
NETWORK_MESSAGES = ("econnreset", "socket hang up")


def is_retryable(
    message: Column,
    network: bool = True,
    messages: Sequence[str] = RETRYABLE_MESSAGES,
    network_messages: Sequence[str] = NETWORK_MESSAGES,
) -> Column:
    terms = tuple(messages) + (tuple(network_messages) if network else ())
    return contains_any(F.lower(text_or_empty(message)), terms)
