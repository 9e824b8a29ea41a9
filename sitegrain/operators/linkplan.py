"""Internal-link plan: up to five targets per page, without page pairs.

Within one (site, section, type) every target has the same score for a given
source, so only the first few distinct anchors can ever be picked. The plan
therefore keeps two small tables, candidates per section and cross-section
candidates per site, each row holding a bounded array, and ranks them next to
each source row. Nothing grows with the square of a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.text import bind
from sitegrain.operators.ordered import first_distinct, lookup, top_k, unnest

PICKS = 5


def plan_links(pages: DataFrame, picks: int = PICKS) -> DataFrame:
    """Plan from ``(site, idx, url, page_type)``, one row per planned link.

    Result: ``site, source_idx, source_page, rank, anchor, target_page, score``.
    """
    # A class may lose picks-1 anchors to better classes and one row to the
    # source itself, so picks + (picks - 1) + 1 distinct anchors are enough.
    depth = 2 * picks
    nodes = pages.select(
        "site",
        "idx",
        "url",
        F.coalesce("page_type", F.lit("generic")).alias("page_type"),
        urls.section_root(F.col("url")).alias("section"),
        urls.planner_anchor(F.col("url")).alias("anchor"),
    )
    order = [F.col("idx")]

    # Two rows per anchor: the first may be the source, which is no target.
    target = F.struct("idx", "url", "anchor", "page_type", "section")
    by_anchor = ["site", "section", "page_type", "anchor"]
    holders = (
        top_k(nodes, by_anchor, order, 2)
        .groupBy(*by_anchor)
        .agg(F.array_sort(F.collect_list(target)).alias("holders"))
        .withColumn("first_idx", F.col("holders")[0]["idx"])
    )
    kept = top_k(holders, ["site", "section", "page_type"], [F.col("first_idx")], depth + 1)
    section_lists = kept.groupBy("site", "section").agg(
        F.flatten(F.collect_list("holders")).alias("section_targets")
    )

    # Cross-section targets are categories (for pdp sources) and pdps (for
    # category sources). A later copy of an anchor is never needed: its first
    # holder is either a candidate too or scores higher in the own section.
    linkable = nodes.filter(F.col("page_type").isin("pdp", "category"))
    firsts = top_k(linkable, ["site", "page_type", "anchor"], order, 1)
    spread = top_k(firsts, ["site", "page_type", "section"], order, depth)
    across = top_k(spread, ["site", "page_type"], order, 2 * depth)
    site_lists = across.groupBy("site").agg(F.collect_list(target).alias("site_targets"))

    with_section = lookup(nodes, section_lists, ["site", "section"], "idx")
    with_both = lookup(with_section, site_lists, ["site"], "idx")
    ranked = with_both.withColumn("targets", _ranked_targets(picks))
    keep = ["site", F.col("idx").alias("source_idx"), F.col("url").alias("source_page")]
    return unnest(ranked, keep, F.col("targets"), "target", "rank").select(
        "site",
        "source_idx",
        "source_page",
        (F.col("rank") + 1).alias("rank"),
        F.col("target.anchor").alias("anchor"),
        F.col("target.url").alias("target_page"),
        (-F.col("target.negative_score")).cast("long").alias("score"),
    )


def _score(source_type: Column, target: Column, same_section: Column) -> Column:
    kind = target["page_type"]
    cross = (
        F.when((source_type == "pdp") & (kind == "category"), 3)
        .when((source_type == "pdp") & (kind == "pdp") & same_section, 2)
        .when((source_type == "category") & (kind == "pdp"), 2)
        .otherwise(0)
    )
    return cross + F.when(same_section, 1).otherwise(0)


def _ranked_targets(picks: int) -> Column:
    none = F.array().cast(
        "array<struct<idx:bigint,url:string,anchor:string,page_type:string,section:string>>"
    )
    own = F.coalesce(F.col("section_targets"), none)
    other = F.filter(
        F.coalesce(F.col("site_targets"), none), lambda t: t["section"] != F.col("section")
    )
    scored = F.transform(
        F.filter(F.concat(own, other), lambda t: t["idx"] != F.col("idx")),
        lambda t: F.struct(
            (-_score(F.col("page_type"), t, t["section"] == F.col("section"))).alias(
                "negative_score"
            ),
            t["idx"].alias("idx"),
            t["anchor"].alias("anchor"),
            t["url"].alias("url"),
        ),
    )
    positive = F.array_sort(F.filter(scored, lambda t: t["negative_score"] < 0))
    return bind(positive, lambda rows: first_distinct(rows, "anchor", picks))
