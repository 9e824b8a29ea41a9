"""Markdown reports and the output index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import list_or_empty, text_or_empty
from sitegrain.operators.gaps import REPORTED
from sitegrain.operators.ordered import first_occurrence, top_k

INDEX_SIZE = 50


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def _bullets(items: Column) -> Column:
    """Lines of a list, or null (no line at all) when it is empty."""
    return F.nullif(F.array_join(F.transform(items, lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit(""))


def page_audit_markdown(audits: DataFrame) -> DataFrame:
    """Add ``markdown``, the full audit report of a page.

    Needs ``url, page_type, product_page, word_count, thin_content,
    internal_link_count, orphan_page_risk, prompt_version, content_score,
    keyword_themes, clusters, contextual_links, seo_recommendations``.
    """
    blank = F.lit("")
    clusters = F.transform(
        "clusters", lambda c: F.concat(c["topic"], F.lit(": "), F.array_join(c["keywords"], ", "))
    )
    links = F.transform("contextual_links", lambda r: F.concat_ws(": ", r["anchor"], r["url"]))
    none = F.array().cast("array<string>")
    text = F.concat_ws(
        "\n",
        F.lit("# Page Audit"),
        blank,
        _line("URL", F.col("url")),
        _line("Page Type", F.col("page_type")),
        _line("Product Page", F.col("product_page")),
        _line("Word Count", _or(F.col("word_count"), "0")),
        _line("Thin Content", _yes_no(F.col("thin_content"))),
        _line("Internal Links", _or(F.col("internal_link_count"), "0")),
        _line("Orphan Risk", _yes_no(F.col("orphan_page_risk"))),
        _line("Prompt Version", _or(F.nullif(F.col("prompt_version"), blank), "unknown")),
        _line("Content Score", _or(F.col("content_score"), "n/a")),
        blank,
        F.lit("## SERP Themes"),
        _bullets(list_or_empty(F.col("keyword_themes"))),
        blank,
        F.lit("## Keyword Clusters"),
        _bullets(F.coalesce(clusters, none)),
        blank,
        F.lit("## Suggested Internal Links"),
        _bullets(F.coalesce(links, none)),
        blank,
        F.lit("## Recommendations"),
        F.coalesce(
            F.nullif(text_or_empty(F.col("seo_recommendations")), blank),
            F.lit("No specialized recommendations generated."),
        ),
    )
    return audits.withColumn("markdown", text)


def staged_audit_markdown(audits: DataFrame, trailing_blank: bool = True) -> DataFrame:
    """Short audit report of the staged runs; queued runs end without a blank line."""
    parts = [
        F.lit("# Page Audit"),
        F.lit(""),
        _line("URL", F.col("url")),
        _line("Page Type", F.col("page_type")),
        _line("Product Page", F.col("product_page")),
        _line("Score", _or(F.col("eval_score"), "n/a")),
        F.lit(""),
        F.lit("## Recommendations"),
        text_or_empty(F.col("seo_recommendations")),
    ]
    if trailing_blank:
        parts.append(F.lit(""))
    return audits.withColumn("markdown", F.concat_ws("\n", *parts))


def site_overview_markdown(
    report: DataFrame,
    page_types: DataFrame,
    gaps: DataFrame,
    topics: DataFrame,
    group: Sequence[str] = ("site",),
) -> DataFrame:
    """One overview text per site from its report and strategy tables.

    ``report`` has one row per group with the run counts, strategy counts and
    ``estimated_cost_usd``; ``page_types(group, page_type, pages, first_idx)``
    is listed in order of first appearance; of ``gaps(group, idx, url, topic,
    missing_keywords)`` and ``topics(group, idx, pos, topic)`` ten rows each
    are printed.
    """
    types = page_types.groupBy(*group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_idx", "page_type", "pages"))),
                lambda r: F.concat(F.lit('"'), r["page_type"], F.lit('":'), r["pages"].cast("string")),
            ),
            ",",
        ).alias("type_json")
    )
    gap_rows = top_k(gaps, list(group), [F.col("idx"), F.col("topic_pos")], 10, "n").groupBy(*group).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "n",
                    F.concat(
                        F.col("url"), F.lit(" ["), F.col("topic"), F.lit("]: "),
                        F.array_join("missing_keywords", ", "),
                    ).alias("line"),
                )
            )
        ).alias("gap_lines")
    )
    topic_rows = top_k(topics, list(group), [F.col("idx"), F.col("pos")], 10, "n").groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("n", F.col("topic").alias("line")))).alias("topic_lines")
    )
    joined = (
        report.join(types, list(group), "left")
        .join(gap_rows, list(group), "left")
        .join(topic_rows, list(group), "left")
    )
    lines = lambda c: _bullets(
        list_or_empty(F.transform(F.col(c), lambda r: r["line"]))
    )
    blank = F.lit("")
    text = F.concat_ws(
        "\n",
        F.lit("# SEO Optimization Overview"),
        blank,
        _line("Base URL", F.col("base_url")),
        _line("Generated At", F.col("generated_at")),
        _line("Total URLs Discovered", F.col("total_urls_discovered")),
        _line("Pages Audited", F.col("pages_audited")),
        _line("Pages Skipped", F.col("pages_skipped")),
        _line("Product Pages Detected", F.col("product_pages_detected")),
        _line("Product Pages Optimized", F.col("product_pages_optimized")),
        _line("Errors", F.col("errors")),
        blank,
        F.lit("## Site Strategy Summary"),
        F.concat(F.lit("- Page Types: {"), _or(F.col("type_json"), ""), F.lit("}")),
        _line("Thin Pages", F.col("thin_pages")),
        _line("Weak Internal Link Pages", F.col("weak_internal_link_pages")),
        _line("Missing Meta Pages", F.col("missing_meta_pages")),
        _line("SERP Analyzed Pages", F.col("serp_analyzed_pages")),
        _line("Keyword Clustered Pages", F.col("keyword_clustered_pages")),
        _line("Internal Link Recommendations", F.col("internal_link_recommendations")),
        _line("Estimated Claude Cost (USD)", _or(F.col("estimated_cost_usd"), "0")),
        blank,
        F.lit("## Keyword Gaps"),
        lines("gap_lines"),
        blank,
        F.lit("## Recommended Blog Topics"),
        lines("topic_lines"),
        blank,
    )
    return joined.select(*group, text.alias("markdown"))


def queue_overview_markdown(report: DataFrame, highlights: Sequence[str]) -> DataFrame:
    """Short overview of a queued run with its strategy highlights."""
    text = F.concat_ws(
        "\n",
        F.lit("# SEO Optimization Overview"),
        F.lit(""),
        _line("Base URL", F.col("base_url")),
        _line("Pages Audited", F.col("pages_audited")),
        _line("Pages Skipped", F.col("pages_skipped")),
        _line("Errors", F.col("errors")),
        _line("Product Pages Optimized", F.col("product_pages_optimized")),
        F.lit(""),
        F.lit("## Strategy Highlights"),
        *[F.lit(f"- {h}") for h in highlights],
        F.lit(""),
    )
    return report.withColumn("markdown", text)


def gap_report_markdown(opportunities: DataFrame, pages_analyzed: DataFrame) -> DataFrame:
    """One-row gap report; ``opportunities`` is already capped, in ``place`` order.

    ``pages_analyzed`` is a one-row table with ``pages``.
    """
    line = F.concat(
        F.lit("- "), F.col("title"), F.lit(" ("), F.col("search_intent"), F.lit(", "),
        F.col("estimated_difficulty"), F.lit(")"),
    )
    listed = opportunities.agg(
        F.count("*").alias("recommended"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= REPORTED, F.struct("place", line.alias("line"))))).alias("top"),
    )
    text = F.concat_ws(
        "\n",
        F.lit("# Content Gap Report"),
        F.lit(""),
        _line("Pages analyzed", F.col("pages")),
        _line("Recommended pages", F.col("recommended")),
        F.lit(""),
        F.lit("## Top Opportunities"),
        F.nullif(F.array_join(F.transform("top", lambda r: r["line"]), "\n"), F.lit("")),
        F.lit(""),
    )
    return listed.crossJoin(F.broadcast(pages_analyzed)).select(text.alias("markdown"))  # one row each


def output_index(existing: DataFrame, entries: DataFrame, size: int = INDEX_SIZE) -> DataFrame:
    """Newest entry per slug, newest first, at most ``size``; flags the latest.

    Both have ``slug, generated_at`` and the same further columns; entries of
    the same time are ordered by slug.
    """
    order = [F.desc("generated_at"), F.col("slug")]
    merged = first_occurrence(existing.unionByName(entries), ["slug"], order)
    kept = merged.orderBy(*order).limit(size)
    newest = kept.agg(F.max(F.struct("generated_at", "slug")).alias("newest"))  # one row
    return kept.crossJoin(F.broadcast(newest)).withColumn(
        "is_latest", F.col("generated_at") == F.col("newest.generated_at")
    ).drop("newest")
