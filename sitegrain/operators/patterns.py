"""Page-structure signals and the store of learned page patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import (
    WORD_END,
    contains_any,
    first_n,
    strip,
    tags_to_space,
    text_or_empty,
)
from sitegrain.operators.ordered import first_occurrence, lookup, number_within, top_k, unnest
from sitegrain.vocab import CTA_LINK_TERMS, SECTION_KEYWORDS

STORE_SIZE = 200
DOMINANT = 4
# fixed values: signal defaults when nothing was seen
SIGNAL_DEFAULTS = {
    "layout_preference": "balanced", "section_density": "medium", "cta_frequency": "medium",
}


def structure_signals(
    pages: DataFrame,
    section_keywords: Sequence[tuple[str, Sequence[str]]] = SECTION_KEYWORDS,
    cta_terms: Sequence[str] = CTA_LINK_TERMS,
) -> DataFrame:
    """Add dominant sections, layout, density and call-to-action bands to pages."""
    page = text_or_empty(F.col("html"))

    def tag_count(tag: str) -> Column:
        return F.regexp_count(page, F.lit(rf"(?i)<{tag}{WORD_END}")).cast("long")

    headings = F.filter(
        F.transform(
            F.regexp_extract_all(page, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), 2),
            lambda h: strip(tags_to_space(h)),
        ),
        lambda h: h != "",
    )
    link_texts = F.regexp_extract_all(page, F.lit(rf"(?is)<a{WORD_END}[^>]*>(.*?)</a>"), 1)
    calls = F.filter(link_texts, lambda t: contains_any(F.lower(tags_to_space(t)), cta_terms))
    counted = pages.withColumns(
        {
            "section_count": F.greatest(tag_count("section"), F.lit(1)),
            "heading_texts": headings,
            "paragraphs": tag_count("p"),
            "images": tag_count("img"),
            "cta_count": tag_count("button") + F.size(calls),
        }
    )

    def ranked(component: str, terms: Sequence[str], place: int) -> Column:
        hits = F.size(F.filter("heading_texts", lambda h: contains_any(F.lower(h), terms)))
        return F.struct(
            (-hits).alias("negative"), F.lit(place).alias("place"), F.lit(component).alias("name")
        )

    scores = F.array(*[ranked(c, t, i) for i, (c, t) in enumerate(section_keywords)])
    dominant = F.transform(
        first_n(F.array_sort(F.filter(scores, lambda s: s["negative"] < 0)), DOMINANT),
        lambda s: s["name"],
    )
    low = F.lower(page)
    visual = (
        (F.col("images") >= F.col("section_count")) | low.contains("grid") | low.contains("columns")
    )
    density = (F.col("paragraphs") + F.size("heading_texts") * 2) / F.col("section_count")
    return counted.withColumns(
        {
            "dominant_sections": dominant,
            "layout_preference": F.when(visual, "visual").otherwise("editorial"),
            "section_density": F.when(density > 8, "high")
            .when(density > 4, "medium")
            .otherwise("low"),
            "cta_frequency": F.when(F.col("cta_count") >= 4, "high")
            .when(F.col("cta_count") >= 2, "medium")
            .otherwise("low"),
        }
    )


def merge_signals(signals: DataFrame, group: Sequence[str] = ("site",), order: str = "idx") -> DataFrame:
    """Most common signal values per group, ties to the value seen first."""
    single = list(SIGNAL_DEFAULTS)
    field = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("field"), F.array(F.col(c)).alias("items")) for c in single],
            F.struct(F.lit("dominant_sections").alias("field"), F.col("dominant_sections").alias("items")),
        )
    )
    values = (
        signals.select(*group, order, field.alias("f"))
    )
    values = unnest(
        values, [*group, order, F.col("f.field").alias("field")], F.col("f.items"), "value", "pos"
    ).filter("value IS NOT NULL AND value <> ''")
    counts = values.groupBy(*group, "field", "value").agg(
        F.count("*").alias("uses"), F.min(F.struct(order, "pos")).alias("first_seen")
    )
    ranked = top_k(
        counts, [*group, "field"], [F.desc("uses"), F.col("first_seen")], DOMINANT, "rank"
    )
    merged = ranked.groupBy(*group).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("field") == "dominant_sections", F.struct("rank", "value"))
                )
            ),
            lambda r: r["value"],
        ).alias("dominant_sections"),
        *[
            F.coalesce(
                F.max(F.when((F.col("field") == c) & (F.col("rank") == 1), F.col("value"))),
                F.lit(default),
            ).alias(c)
            for c, default in SIGNAL_DEFAULTS.items()
        ],
    )
    return merged


def blueprint_signature(page_type: Column, theme: Column, sections: Column) -> Column:
    """Signature of a blueprint: types, section order, section variants."""
    order = F.array_join(F.transform(sections, lambda s: s["component"]), "|")
    variants = F.array_join(
        F.transform(sections, lambda s: F.concat_ws(":", s["component"], s["variant"])), "|"
    )
    return F.concat_ws("::", page_type, theme, order, variants)


def record_patterns(store: DataFrame, uses: DataFrame, size: int | None = None) -> DataFrame:
    """Add pattern uses to the store; ``size`` keeps the most used, then the latest (``STORE_SIZE`` is usual).

    ``store(signature, page_type, theme, usage_count, last_used)``,
    ``uses(page_type, theme, sections, used_at)``. Uses are counted per
    signature before the shuffle; the kept part is a top-k.
    """
    fresh = uses.select(
        blueprint_signature(F.col("page_type"), F.col("theme"), F.col("sections")).alias("signature"),
        "page_type",
        "theme",
        F.lit(1).cast("long").alias("usage_count"),
        F.col("used_at").alias("last_used"),
    )
    merged = (
        store.select(*fresh.columns)
        .unionByName(fresh)
        .groupBy("signature", "page_type", "theme")
        .agg(F.sum("usage_count").alias("usage_count"), F.max("last_used").alias("last_used"))
    )
    if size is None:
        return merged
    return merged.orderBy(F.desc("usage_count"), F.desc("last_used"), "signature").limit(size)


def confidence(usage_count: Column) -> Column:
    n = F.coalesce(usage_count, F.lit(0))
    return F.when(n > 5, "high").when(n > 2, "medium").otherwise("low")


def rank_patterns(store: DataFrame, group: Sequence[str] = ("page_type", "theme")) -> DataFrame:
    """All patterns with confidence and their rank per group."""
    order = [F.desc("usage_count"), F.col("signature")]
    banded = store.withColumn("confidence", confidence(F.col("usage_count")))
    return number_within(banded, group, order, "rank")


def preferred_patterns(requests: DataFrame, store: DataFrame, spread: str) -> DataFrame:
    """Attach the most used pattern of (page_type, theme) when it is trusted enough."""
    best = first_occurrence(
        store, ["page_type", "theme"], [F.desc("usage_count"), F.col("signature")]
    ).withColumn("confidence", confidence(F.col("usage_count")))
    trusted = best.filter(F.col("confidence").isin("medium", "high")).select(
        "page_type", "theme", "signature", "usage_count", "confidence"
    )
    return lookup(requests, trusted, ["page_type", "theme"], spread)
