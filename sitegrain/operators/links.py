"""Link analysis, merging, related pages, reachability, link injection."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.text import bind, first_n, strip, text_or_empty
from sitegrain.operators.ordered import first_occurrence, greedy_top_k, lookup, number_within, top_k, unnest
from sitegrain.session import cut_lineage
from sitegrain.vocab import RELATED_DEFAULT, RELATED_TYPES

MERGED_LINKS = 5


def merge_suggestions(
    planned: DataFrame, contextual: DataFrame, limit: int = MERGED_LINKS
) -> DataFrame:
    """Planner links first, then contextual ones; one per anchor ignoring case."""
    columns = ["site", "source_idx", "source_page", "rank", "anchor", "target_page"]
    rows = (
        planned.select(*columns)
        .withColumn("origin", F.lit(0))
        .unionByName(contextual.select(*columns).withColumn("origin", F.lit(1)))
        .filter(text_or_empty(F.col("anchor")) != "")
        .withColumn("anchor_key", F.lower("anchor"))
        .withColumnRenamed("rank", "origin_rank")
    )
    order = [F.col("origin"), F.col("origin_rank")]
    merged = greedy_top_k(rows, ["site", "source_idx"], "anchor_key", order, limit)
    return merged.select(
        "site", "source_idx", "source_page", F.col("rank").cast("long").alias("rank"),
        "anchor", "target_page",
    )


def known_link_hits(features: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Per page: link count, links to known URLs, orphan risk in both readings.

    ``known_urls`` has one column ``url``.
    """
    known = (
        known_urls.select(urls.canonical(F.col("url")).alias("link"))
        .filter("link IS NOT NULL")
        .distinct()
        .withColumn("is_known", F.lit(True))
    )
    links = features.select("site", "idx", "url", F.explode_outer("internal_links").alias("link"))
    hits = lookup(links, known, ["link"], "idx")
    counted = hits.groupBy("site", "idx", "url").agg(
        F.count("link").alias("internal_link_count"),
        F.count("is_known").alias("known_link_hits"),
    )
    few = F.col("internal_link_count") < 2
    return counted.withColumns(
        {"orphan_page_risk": few | (F.col("known_link_hits") == 0), "few_links": few}
    )


def broken_links(
    features: DataFrame, url_status: DataFrame, checked: int | None = None
) -> DataFrame:
    """Links of each page whose status is missing or an error.

    ``url_status`` has ``(url, status)``; of several rows of a URL the worst
    status counts. ``checked`` limits the links looked at per page.
    """
    first = F.col("internal_links") if checked is None else first_n(F.col("internal_links"), checked)
    links = unnest(features, ["site", "idx", "url"], first, "link", "pos")
    status = url_status.groupBy(F.col("url").alias("link")).agg(F.max("status").alias("status"))
    joined = lookup(links, status, ["link"], "idx")
    bad = joined.filter(F.col("status").isNull() | (F.col("status") >= 400))
    return bad.select("site", "idx", "url", "pos", "link", "status")


def related_pages(pages: DataFrame, limit: int = 4) -> DataFrame:
    """First pages, in site order, of the types that suit each page's type.

    ``pages`` has ``(site, idx, page_type, topic)``.
    """
    wanted = [(source, kind) for source, kinds in RELATED_TYPES.items() for kind in kinds]
    listed = list(RELATED_TYPES)
    order = [F.col("idx")]
    source_class = F.when(F.col("page_type").isin(listed), F.col("page_type")).otherwise("other")
    wanted += [("other", kind) for kind in RELATED_DEFAULT]
    serves = F.lit(None).cast("array<string>")
    for kind in sorted({k for _, k in wanted}):
        sources = [s for s, k in wanted if k == kind]
        serves = F.when(F.col("page_type") == kind, F.array(*map(F.lit, sources))).otherwise(serves)
    offers = pages.withColumn("source_class", F.explode(serves)).select(
        "site", "source_class", "idx", "topic", F.col("page_type").alias("kind")
    )
    # One spare entry: the page itself may be among the first.
    best = top_k(offers, ["site", "source_class"], order, limit + 1)
    lists = best.groupBy("site", "source_class").agg(
        F.array_sort(F.collect_list(F.struct("idx", "kind", "topic"))).alias("offers")
    )
    joined = lookup(
        pages.withColumn("source_class", source_class), lists, ["site", "source_class"], "idx"
    )
    mine = F.filter(
        "offers", lambda o: (o["kind"] != F.col("page_type")) | (o["topic"] != F.col("topic"))
    )
    keep = ["site", F.col("idx").alias("source_idx")]
    return unnest(joined, keep, first_n(mine, limit), "offer", "rank").select(
        "site",
        "source_idx",
        (F.col("rank") + 1).alias("rank"),
        F.col("offer.idx").alias("target_idx"),
        F.col("offer.kind").alias("target_type"),
        F.col("offer.topic").alias("target_topic"),
    )


def reachable_pages(
    seeds: DataFrame,
    links: DataFrame,
    stored: DataFrame,
    max_depth: int | None = None,
    max_pages: int | None = None,
    page_filter: bool = True,
) -> DataFrame:
    """Breadth-first reach over the stored link table.

    ``seeds(site, url)``, ``links(site, source, pos, target)`` and
    ``stored(site, url)``. Visits are ordered by depth, then by the order in
    which links appear; visited pages that are not stored count but lead nowhere.
    ``max_depth`` and ``max_pages`` (per site) are limits of a crawl; without them
    the walk ends when nothing new is reached. The table of links is written once
    and each round is one equi-join on the frontier.
    """
    edges = links.select("site", "source", "pos", "target")
    if page_filter:
        edges = edges.filter(
            (urls.hostname(F.col("target")) == F.col("site"))
            & urls.likely_html(F.col("target"))
            & ~urls.skip_for_audit(F.col("target"))
        )
    edges = cut_lineage(edges, "edges")
    have = cut_lineage(stored.select("site", "url").distinct().withColumn("is_stored", F.lit(True)), "stored")
    # Every round reads the seeds, so they are written once, like what later rounds find.
    visited = cut_lineage(
        first_occurrence(
            seeds.select("site", "url").withColumns({"depth": F.lit(0), "seq": F.lit(1).cast("long")}),
            ["site", "url"],
            [F.col("seq")],
        ),
        "frontier",
    )
    frontier = visited
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        # Parents that hold no page have no links to follow.
        parents = frontier.join(have, ["site", "url"], "left_semi")
        step = parents.select(
            "site", F.col("url").alias("source"), F.col("seq").alias("parent_seq")
        ).join(edges, ["site", "source"])
        reached = first_occurrence(
            step.select("site", F.col("target").alias("url"), "parent_seq", "pos"),
            ["site", "url"],
            [F.col("parent_seq"), F.col("pos")],
        ).join(visited.select("site", "url"), ["site", "url"], "left_anti")
        reached = cut_lineage(reached, "reached")
        if reached.isEmpty():
            break
        taken = visited.groupBy("site").agg(F.max("seq").alias("taken"))
        order = [F.col("parent_seq"), F.col("pos")]
        if max_pages is None:
            # One site may hold most links; its new pages are numbered in many tasks.
            numbered = number_within(reached, ["site"], order, "place")
        else:
            numbered = top_k(reached, ["site"], order, max_pages, "place")
        frontier = numbered.join(taken, "site").select(
            "site",
            "url",
            F.lit(depth).alias("depth"),
            (F.col("taken") + F.col("place")).alias("seq"),
        )
        if max_pages is not None:
            frontier = frontier.filter(F.col("seq") <= max_pages)
        # Each round writes what is new; what was visited before is not written again.
        frontier = cut_lineage(frontier, "frontier")
        visited = visited.unionByName(frontier)
    return visited.join(have, ["site", "url"], "left").select(
        "site",
        "url",
        F.col("depth").cast("long").alias("depth"),
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("is_stored", F.lit(False)).alias("is_page"),
    )


def page_link_table(features: DataFrame) -> DataFrame:
    """``(site, source, pos, target)`` rows of the links found in pages."""
    keep = ["site", urls.canonical(F.col("url")).alias("source")]
    return unnest(features, keep, F.col("internal_links"), "target", "pos")


def inject_links(content: Column, links: Column, staged: bool = False) -> Column:
    """Append the first link to the first paragraph; without one, append a list.

    ``links`` is ``array<struct<anchor,url>>``; only four are considered. The
    staged form drops incomplete links and uses its own list header.
    """
    text = text_or_empty(content)
    four = first_n(F.coalesce(links, F.array().cast("array<struct<anchor:string,url:string>>")), 4)
    if staged:
        usable = F.filter(
            four, lambda r: (text_or_empty(r["anchor"]) != "") & (text_or_empty(r["url"]) != "")
        )
        rendered = F.transform(
            usable, lambda r: F.concat(F.lit("["), r["anchor"], F.lit("]("), r["url"], F.lit(")"))
        )
        header = "Related links:"
    else:
        name = lambda a: F.when(text_or_empty(a) == "", F.lit("related page")).otherwise(a)
        rendered = F.transform(
            four,
            lambda r: F.concat(
                F.lit("["), strip(name(r["anchor"])), F.lit("]("),
                strip(text_or_empty(r["url"])), F.lit(")"),
            ),
        )
        header = "CONTEXTUAL INTERNAL LINKS"

    def written(markdown: Column) -> Column:
        first_paragraph = r"(?is)^(.*?)<p[^>]*>(.*?)</p>(.*)$"
        with_link = F.concat(
            F.regexp_extract(text, first_paragraph, 1),
            F.lit("<p>"),
            F.regexp_extract(text, first_paragraph, 2),
            F.lit(" See also "),
            F.try_element_at(markdown, F.lit(1)),
            F.lit(".</p>"),
            F.regexp_extract(text, first_paragraph, 3),
        )
        listed = F.concat(text, F.lit(f"\n\n{header}\n- "), F.array_join(markdown, "\n- "))
        return (
            F.when(F.size(markdown) == 0, text)
            .when(~text.rlike(r"(?i)<p[^>]*>"), listed)
            .when(text.rlike(first_paragraph), with_link)
            .otherwise(text)
        )

    return bind(rendered, written)


