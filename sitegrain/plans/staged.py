"""Staged runs: optimise pages from generated texts, find content gaps, report.

Generated texts come from outside as a table; everything around them (links,
schema, scores, retry decision, audit section, run status) is computed here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.prompts import append_audit_section
from sitegrain.functions.text import text_or_empty
from sitegrain.operators import gaps, runs, schema_org, scoring
from sitegrain.operators.links import inject_links
from sitegrain.operators.serp import attach_by_entity, intel_requests, serp_intel
from sitegrain.session import cut_lineage
from sitegrain.vocab import ScoringRules, Vocabulary

# fixed values: texts of pages without generated content
AUDIT_ONLY = "<p>Audit mode: optimization skipped.</p>"
NO_SPECIALIST = "<p>No specialized optimization agent for page type: {kind}.</p>"


@dataclass(frozen=True)
class GapAnalysis:
    pages: DataFrame
    opportunities: DataFrame


def optimize_pages(
    audits: DataFrame, generated: DataFrame, intel: DataFrame | None = None, rules: ScoringRules = ScoringRules(),
    max_model_calls: int = 0,
) -> DataFrame:
    """Final content, schema, scores and retry decision of every audited page.

    ``audits``: rows of ``audit_sites``. ``generated``: ``site, idx,
    generated_content, attempt``, one row per page; product pages without one
    have failed. ``intel`` (``entity_key`` and roll-up lists) feeds the content
    score. Only product pages are scored. With ``max_model_calls`` the product
    pages of a site that come after its budget is spent fail.
    """
    joined = audits.join(generated, ["site", "idx"], "left")
    if max_model_calls > 0:
        asked = joined.filter("product_page").select("site", "idx", F.coalesce("attempt", F.lit(1)).alias("attempt"))
        over = runs.model_budget(asked, max_model_calls).filter("NOT within_budget").select("site", "idx", F.lit(True).alias("__over"))
        joined = joined.join(over, ["site", "idx"], "left")
        joined = joined.withColumn("generated_content", F.when(F.col("__over").isNull(), F.col("generated_content"))).drop("__over")
    before, after = NO_SPECIALIST.split("{kind}")
    fallback = F.concat(F.lit(before), F.col("page_type"), F.lit(after))
    own = F.when(F.col("product_page"), text_or_empty(F.col("generated_content"))).otherwise(
        F.coalesce(F.col("generated_content"), fallback)
    )
    linked = joined.withColumns(
        {
            "status": F.when(
                F.col("product_page") & (text_or_empty(F.col("generated_content")) == ""), runs.FAILED
            ).otherwise(runs.DONE),
            "optimized_content": inject_links(own, F.col("contextual_links"), staged=True),
        }
    )
    typed = linked.withColumn("page_type", F.when(F.col("product_page"), "pdp").otherwise(F.col("page_type")))
    with_schema = schema_org.page_schema(typed).withColumn("schema_present", F.lit(True))
    lists = ("heading_patterns", "entity_coverage", "faq_patterns")
    if intel is None:
        none = F.array().cast("array<string>")
        ready = with_schema.withColumns(
            {"average_word_count": F.lit(0).cast("long"), **{c: none for c in lists}}
        )
    else:
        ready = attach_by_entity(
            with_schema.drop("average_word_count", *lists), intel.select("site", "entity_key", "average_word_count", *lists)
        )
    scored = scoring.content_score(scoring.evaluate(ready, rules=rules), rules=rules)
    decided = scoring.retry_decision(scored.withColumn("attempt", F.coalesce("attempt", F.lit(1))), rules)
    product = F.col("product_page")
    only_products = {
        c: F.when(product, F.col(c))
        for c in ("eval_score", "failed_checks", "content_score", "needs_retry", "retry_reason")
    }
    return decided.withColumns(only_products).withColumn(
        "optimized_content", append_audit_section(F.col("optimized_content"), product)
    )


def page_intel(features: DataFrame, serp_pages: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:
    """One roll-up per entity key of the pages, from stored result pages."""
    requests = cut_lineage(intel_requests(features))
    queries = requests.select("query", F.lit("ok").alias("status"), "headings", "text").dropDuplicates(["query"])
    intel = serp_intel(queries, serp_pages, vocab)
    return requests.select("site", "entity_key", "query").join(intel, "query")


def find_gaps(features: DataFrame, intel: DataFrame) -> GapAnalysis:
    """Keywords of the pages' roll-ups that their site never uses.

    Pages without an entity or title are left out, as they have no query.
    """
    vocabulary = gaps.site_vocabulary(features)
    named = features.filter(
        F.coalesce(
            F.nullif(text_or_empty(F.col("product_entity")), F.lit("")), text_or_empty(F.col("title"))
        )
        != ""
    )
    themes = attach_by_entity(named, intel.select("site", "entity_key", "semantic_phrases")).select(
        "site",
        "idx",
        F.coalesce("semantic_phrases", F.array().cast("array<string>")).alias("keywords"),
    )
    pages = cut_lineage(gaps.page_gaps(gaps.missing_keywords(cut_lineage(themes), vocabulary)))
    return GapAnalysis(pages, gaps.gap_opportunities(pages))


def run_status(optimized: DataFrame, run_id: str) -> DataFrame:
    """Status rows of a run, the input of the run report."""
    return optimized.select(
        F.lit(run_id).alias("run_id"), "url", "status", "product_page",
        F.when(F.col("status") == runs.FAILED, F.lit("Generated content is empty")).alias("error"),
    )
