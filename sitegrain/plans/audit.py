"""Full site audit as one set of DataFrames.

Raw HTML is scanned once: all page features are extracted in one projection and
written to the shared checkpoint folder; everything after that reads the narrow
feature table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import hyphen_tokens
from sitegrain.operators import strategy
from sitegrain.operators.linkplan import plan_links
from sitegrain.operators.links import known_link_hits, merge_suggestions
from sitegrain.operators.ordered import lookup, prefix_limit
from sitegrain.operators.pages import content_quality, scrape_fields, technical_columns
from sitegrain.operators.routing import apply_type_filter, route_pages, route_urls
from sitegrain.operators.runs import serp_budget
from sitegrain.operators.serp import (
    attach_by_entity,
    insights,
    intel_requests,
    keyword_clusters,
    serp_intel,
)
from sitegrain.operators.suggestions import suggest_links
from sitegrain.session import cut_lineage
from sitegrain.vocab import Vocabulary

AUDIT_THEMES = 24


@dataclass(frozen=True)
class AuditOptions:
    vocab: Vocabulary = Vocabulary()
    max_pages: int = 0
    page_type_filter: str | None = None
    force_pdp: bool = False
    max_serp_calls: int = 0  # pages per site whose search results are used; 0: all


class SiteAudit:
    """Result tables of an audit; each is computed when it is first asked for, from one feature table."""

    def __init__(self, features: DataFrame, options: AuditOptions, serp_pages: DataFrame | None) -> None:
        self.features, self.options, self.serp_pages = features, options, serp_pages

    @property
    def _urls(self) -> DataFrame:
        return self.features.select("site", "idx", "url")

    @cached_property
    def _kept(self) -> DataFrame:
        o = self.options
        return apply_type_filter(self.features, o.page_type_filter, o.force_pdp).filter("skip_reason IS NULL")

    @cached_property
    def suggestions(self) -> DataFrame:
        """Planned links first, then contextual ones."""
        contextual = suggest_links(self._kept, self._urls, self.options.vocab)
        return cut_lineage(merge_suggestions(plan_links(route_urls(self._urls, self.options.vocab)), contextual), "suggestions")

    @cached_property
    def link_plan(self) -> DataFrame:
        return cut_lineage(plan_links(self.features.select("site", "idx", "url", "page_type")), "link-plan")

    @cached_property
    def page_audits(self) -> DataFrame:
        """One row per kept page with its links, suggestions, search themes and clusters."""
        links = known_link_hits(self._kept, self._urls)
        listed = self.suggestions.groupBy("site", F.col("source_idx").alias("idx")).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "anchor", F.col("target_page").alias("url")))),
                lambda r: F.struct(r["anchor"].alias("anchor"), r["url"].alias("url")),
            ).alias("contextual_links")
        )
        base = self._kept.drop("page_tokens", "skip_reason")
        searched = self.serp_pages is not None
        if searched:
            base = _with_themes(base, self.serp_pages, self.options)
        else:
            base = base.withColumn("keyword_themes", F.array().cast("array<string>"))
        audits = (
            keyword_clusters(base, "keyword_themes")
            .join(links.drop("url"), ["site", "idx"], "left")
            .join(listed, ["site", "idx"], "left")
            .withColumns(
                {
                    "serp_analyzed": F.col("keyword_themes").isNotNull() & F.lit(searched),
                    "keyword_clustered": F.size("clusters") > 0,
                }
            )
        )
        return cut_lineage(audits, "audits")

    @cached_property
    def page_types(self) -> DataFrame:
        return strategy.pages_by_type(self.page_audits)

    @cached_property
    def summary(self) -> DataFrame:
        described = self.page_audits.withColumn("meta_description", F.col("technical_meta_description"))
        return strategy.summary(described, self.link_plan)


def _with_themes(base: DataFrame, serp_pages: DataFrame, options: AuditOptions) -> DataFrame:
    """Pages with the themes of their entity's search results; null where the budget of their site is spent.

    Only queries of pages within the budget are looked up.
    """
    requests = cut_lineage(intel_requests(base), "requests")
    keyed = serp_budget(attach_by_entity(base, requests.select("site", "entity_key", "query")), options.max_serp_calls)
    asked = keyed.filter("within_budget").select("query").distinct()
    queries = requests.select("query", F.lit("ok").alias("status"), "headings", "text").dropDuplicates(["query"])
    seen = insights(serp_intel(queries.join(asked, "query", "left_semi"), serp_pages, options.vocab), AUDIT_THEMES)
    themed = lookup(keyed, seen, ["query"], "idx")
    return themed.withColumn("keyword_themes", F.when(F.col("within_budget"), F.col("keyword_themes"))).drop("within_budget")


def page_features(
    pages: DataFrame, vocab: Vocabulary = Vocabulary(), keep_tokens: bool = True
) -> DataFrame:
    """All row-local features of ``pages(site, idx, url, html)``; html is dropped."""
    routed = route_pages(content_quality(scrape_fields(pages)), vocab)
    columns = technical_columns()
    if keep_tokens:
        columns["page_tokens"] = F.array_distinct(hyphen_tokens(F.col("html")))
    return routed.withColumns(columns).drop("html", "visible", "void_tags")


def audit_sites(
    pages: DataFrame, options: AuditOptions = AuditOptions(), serp_pages: DataFrame | None = None
) -> SiteAudit:
    """Audit all sites of ``pages(site, idx, url, html)``.

    ``serp_pages`` holds stored result pages per query (see ``aggregate_intel``);
    without it every roll-up is empty, as when no search results are available.
    """
    limited = prefix_limit(pages, options.max_pages)
    return SiteAudit(cut_lineage(page_features(limited, options.vocab), "features"), options, serp_pages)
