"""Site strategy: summary counts, short lists, keyword gaps, blog topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import list_or_empty, listed_in, text_or_empty
from sitegrain.operators.ordered import first_occurrence, lookup, top_k, unnest
from sitegrain.vocab import BLOG_TOPIC_TEMPLATES, MISSING_CATEGORY_PAGES, PILLAR_PAGES

SHORT_LIST = 10
LINK_LINES = 30
GAP_KEYWORDS = 5
GAP_ROWS = 20  # of a strategy report
BLOG_TOPICS = 12


def pages_by_type(audits: DataFrame, group: Sequence[str] = ("site",)) -> DataFrame:
    kind = F.coalesce(F.nullif(text_or_empty(F.col("page_type")), F.lit("")), F.lit("generic"))
    return audits.groupBy(*group, kind.alias("page_type")).agg(F.count("*").alias("pages"))


def summary(audits: DataFrame, link_plan: DataFrame, group: Sequence[str] = ("site",)) -> DataFrame:
    """Counts of a site in one pass over its audits, plus planned links.

    ``audits``: group, ``thin_content, orphan_page_risk, meta_description,
    serp_analyzed, keyword_clustered``.
    """
    counts = audits.groupBy(*group).agg(
        F.count("*").alias("total_pages"),
        F.count_if(F.col("thin_content")).alias("thin_pages"),
        F.count_if(F.col("orphan_page_risk")).alias("weak_internal_link_pages"),
        F.count_if(text_or_empty(F.col("meta_description")) == "").alias("missing_meta_pages"),
        F.count_if(F.col("serp_analyzed")).alias("serp_analyzed_pages"),
        F.count_if(F.col("keyword_clustered")).alias("keyword_clustered_pages"),
    )
    links = link_plan.groupBy(*group).agg(F.count("*").alias("planned"))
    joined = counts.join(links, list(group), "left") if group else counts.crossJoin(links)
    return joined.withColumn(
        "internal_link_recommendations", F.coalesce("planned", F.lit(0))
    ).drop("planned")


def short_list(audits: DataFrame, condition: str, n: int = SHORT_LIST, group: Sequence[str] = ("site",)) -> DataFrame:
    """First ``n`` pages per site, in site order, that meet a boolean column."""
    rows = audits.filter(F.col(condition)).select(*group, "idx", "url")
    return top_k(rows, list(group), [F.col("idx")], n, "rank")


def link_lines(plan: DataFrame, n: int = LINK_LINES, group: Sequence[str] = ("site",)) -> DataFrame:
    """First planned links per site as text lines."""
    line = F.concat(
        F.col("source_page"), F.lit(" -> ("), F.col("anchor"), F.lit(") -> "), F.col("target_page")
    )
    rows = top_k(plan, list(group), [F.col("source_idx"), F.col("rank")], n, "line_no")
    return rows.select(*group, "line_no", line.alias("line"))


def keyword_gaps(
    clusters: DataFrame, audits: DataFrame, limit: int | None = None, group: Sequence[str] = ("site",)
) -> DataFrame:
    """Cluster rows whose keywords the page's text lacks; ``limit`` keeps the first per site, in page order.

    ``clusters(site, idx, url, topic_pos, topic, keywords)``,
    ``audits(site, idx, url, seo_recommendations)``.
    """
    first = first_occurrence(audits, [*group, "url"], [F.col("idx")]).select(*group, "url", "seo_recommendations")
    joined = lookup(clusters, first, [*group, "url"], "idx")
    missing = listed_in(
        list_or_empty(F.col("keywords")), text_or_empty(F.col("seo_recommendations")), present=False, first=GAP_KEYWORDS
    )
    gaps = joined.withColumn("missing", missing).filter(F.size("missing") > 0)
    if limit is not None:
        gaps = top_k(gaps, list(group), [F.col("idx"), F.col("topic_pos")], limit)
    return gaps.select(*group, "idx", "url", "topic", F.col("missing").alias("missing_keywords"))


def blog_topics(patterns: DataFrame, limit: int | None = None, group: Sequence[str] = ("site",)) -> DataFrame:
    """Distinct blog topics of each site; ``limit`` keeps the first, in page and pattern order.

    ``patterns(site, idx, pos, core_keyword, pattern)``. Patterns compare by equality.
    """
    entity = F.coalesce(F.nullif(text_or_empty(F.col("core_keyword")), F.lit("")), F.lit("product"))
    topic = F.lit(None).cast("string")
    for pattern, before, after in BLOG_TOPIC_TEMPLATES:
        topic = F.when(
            F.col("pattern") == pattern, F.concat(F.lit(before), entity, F.lit(after))
        ).otherwise(topic)
    rows = patterns.withColumn("topic", topic).filter("topic IS NOT NULL")
    order = [F.col("idx"), F.col("pos")]
    unique = first_occurrence(rows, [*group, "topic"], order)
    if limit is not None:
        unique = top_k(unique, list(group), order, limit)
    return unique.select(*group, "idx", "pos", "topic")


def cluster_rows(audits: DataFrame, group: Sequence[str] = ("site",)) -> DataFrame:
    """One row per page and keyword cluster: ``idx, url, topic_pos, topic, keywords``."""
    rows = unnest(audits, [*group, "idx", "url"], F.col("clusters"), "cluster", "topic_pos")
    return rows.select(*group, "idx", "url", "topic_pos", F.col("cluster.topic").alias("topic"), F.col("cluster.keywords").alias("keywords"))


def _listed(rows: DataFrame, order: Sequence[str], value: str, name: str, group: Sequence[str]) -> DataFrame:
    """One array per group: ``value`` in ``order``. Its rows are a top-k per group."""
    places = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy(*group).agg(F.transform(places, lambda r: r[value]).alias(name))


def site_strategy(
    audits: DataFrame, link_plan: DataFrame, patterns: DataFrame | None = None, rows: int = GAP_ROWS,
    topics: int = BLOG_TOPICS, group: Sequence[str] = ("site",),
) -> DataFrame:
    """The strategy of every site in one row: counts, short lists, gaps, topics, link lines and fixed advice.

    ``audits``: site, idx, url, thin_content, orphan_page_risk, meta_description, serp_analyzed,
    keyword_clustered, clusters, seo_recommendations. ``link_plan``: site, source_idx, rank, source_page,
    anchor, target_page. ``patterns`` as for ``blog_topics``. The lists of a report are its first rows; the
    operators they come from return everything.
    """
    keys = list(group)
    gaps = keyword_gaps(cluster_rows(audits, group), audits, rows, group)
    gap = F.concat(F.col("url"), F.lit(": "), F.col("topic"), F.lit(" - "), F.array_join("missing_keywords", ", "))
    parts = [
        _listed(short_list(audits, "thin_content", group=group), ["rank"], "url", "thin_page_list", keys),
        _listed(short_list(audits, "orphan_page_risk", group=group), ["rank"], "url", "weak_page_list", keys),
        _listed(gaps.withColumn("gap", gap), ["idx", "topic"], "gap", "keyword_gap_list", keys),
        _listed(link_lines(link_plan, group=group), ["line_no"], "line", "link_line_list", keys),
    ]
    if patterns is not None:
        parts.append(_listed(blog_topics(patterns, topics, group), ["idx", "pos"], "topic", "blog_topic_list", keys))
    report = summary(audits, link_plan, group)
    for part in parts:
        report = report.join(part, keys, "left")
    lists = [c for c in report.columns if c.endswith("_list")]
    return report.withColumns({c: list_or_empty(F.col(c)) for c in lists}).withColumns(
        {"pillar_pages": F.array(*map(F.lit, PILLAR_PAGES)), "missing_category_pages": F.array(*map(F.lit, MISSING_CATEGORY_PAGES))}
    )
