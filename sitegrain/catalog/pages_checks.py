"""Registered queries over stored pages: fields, URLs, filters, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog import sql
from sitegrain.catalog.common import SITE_VOCAB, features, joined, scraped, site_pages, table, url_pages
from sitegrain.functions import html as H
from sitegrain.functions import urls
from sitegrain.functions.text import any_of, text_slug
from sitegrain.operators import pages as P
from sitegrain.operators import robots, routing
from sitegrain.operators.ordered import first_occurrence, prefix_limit
from sitegrain.sources import url_lists

V = SITE_VOCAB
ALLOWED_HOSTS = tuple(
    f"{sub}spam-farm.example.{tld}" for sub in ("", "m.", "blog.") for tld in ("org", "com", "net")
)


def url_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "pages").select(
        F.col("page_id").alias("line_no"), F.concat(F.lit("  "), "url", F.lit(" ")).alias("line")
    )
    # A second copy of every line: the first occurrence must win.
    copies = lines.unionByName(lines.withColumn("line_no", F.col("line_no") + 1_000_000_000_000))
    return url_lists.parse_url_list(copies)


def visible_markup(spark: SparkSession, sf: str) -> DataFrame:
    return site_pages(spark, sf).select("idx", H.strip_hidden(F.col("html")).alias("visible"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return scraped(spark, sf).select(
        "idx", "site", "title", "first_1500_words", "word_count", "product_entity"
    )


def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    exploded = scraped(spark, sf).select("idx", F.posexplode("headings").alias("pos", "h"))
    return exploded.select(
        "idx", F.col("pos").cast("long").alias("pos"), F.col("h.tag").alias("tag"), F.col("h.text").alias("text")
    )


def technical_fields(spark: SparkSession, sf: str) -> DataFrame:
    return P.technical_seo(site_pages(spark, sf)).drop("site")


def content_quality(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select(
        "idx",
        "quality_word_count",
        "thin_content",
        "paragraph_count",
        joined(F.transform("heading_structure", lambda h: h["text"])).alias("heading_structure"),
    )


def main_content(spark: SparkSession, sf: str) -> DataFrame:
    stripped = site_pages(spark, sf).withColumn(
        "visible", H.strip_hidden(F.col("html"), H.BATCH_HIDDEN_TAGS)
    )
    return stripped.select(
        "idx", H.main_content(F.col("visible"), ("main", "article")).alias("main_content")
    )


def internal_links(spark: SparkSession, sf: str) -> DataFrame:
    return scraped(spark, sf).select(
        "idx",
        joined(F.col("internal_links"), " ").alias("internal_links"),
        F.size("internal_links").cast("long").alias("internal_link_count"),
        "relative_link_count",
        "absolute_link_count",
    )


def competitor_page(spark: SparkSession, sf: str) -> DataFrame:
    return P.serp_page(site_pages(spark, sf), max_chars=12000).select(
        "idx",
        joined(F.transform("headings", lambda h: h["text"])).alias("headings"),
        "paragraph_text",
        "word_count",
        F.size("schema_types").cast("long").alias("schema_types"),
        F.size("faq_questions").cast("long").alias("faq_questions"),
    )


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.base_url(u).alias("base_url"),
        urls.canonical(u).alias("normal_url"),
        urls.url_key(u).alias("url_key"),
        urls.planner_anchor(u).alias("planner_anchor"),
        urls.suggestion_anchor(u).alias("suggestion_anchor"),
        urls.section_root(u).alias("section_root"),
    )


def url_slugs(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.page_file_slug(u).alias("file_slug"),
        urls.audit_page_slug(u).alias("audit_slug"),
        urls.batch_file_name(u).alias("batch_file"),
        text_slug(u).alias("text_slug"),
        urls.domain_slug(urls.hostname(u)).alias("domain_slug"),
    )


def route_pages(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("idx", "site", "page_type")


def pages_per_type(spark: SparkSession, sf: str) -> DataFrame:
    from sitegrain.operators.strategy import pages_by_type

    return pages_by_type(features(spark, sf))


def product_signals(spark: SparkSession, sf: str) -> DataFrame:
    from sitegrain.vocab import Vocabulary

    vocab = Vocabulary(
        signal_segments=("en", "de"), signal_path_prefixes=("/fr",), signal_headings=("the", "ing")
    )
    return routing.product_signals(site_pages(spark, sf), vocab).drop("html", "url", "site")


def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.same_host(u, F.lit("spam-farm.example.org")).alias("same_host"),
        urls.likely_html(u).alias("likely_html"),
        urls.skip_for_audit(u).alias("skipped"),
    )


def unsafe_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", urls.block_reason(F.col("url"), ALLOWED_HOSTS).alias("reason")
    )


def type_filter(spark: SparkSession, sf: str) -> DataFrame:
    routed = routing.apply_type_filter(url_pages(spark, sf), "pdp")
    return routed.select("idx", "page_type", "skip_reason", "product_page")


def page_budget(spark: SparkSession, sf: str) -> DataFrame:
    from sitegrain.operators.runs import serp_budget

    limited = prefix_limit(url_pages(spark, sf), 5)
    return serp_budget(limited, 3).select("site", "idx", "within_budget")


def model_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sites: their orders spend one or two calls each."""
    from sitegrain.operators.runs import model_budget as budget

    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("idx"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("attempt"),
    )
    return budget(orders, 5).select("site", "idx", "within_budget")


def first_page_of_section(spark: SparkSession, sf: str) -> DataFrame:
    sections = url_pages(spark, sf).withColumn("section", urls.section_root(F.col("url")))
    return first_occurrence(sections, ["site", "section"], [F.col("idx")]).select("site", "section", "idx")


def safe_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    rows = site_pages(spark, sf).select(
        "idx", F.posexplode(H.hrefs(H.strip_hidden(F.col("html")))).alias("pos", "href")
    )
    # Short links become a bad scheme, the others get characters to escape.
    odd = F.when(F.length("href") < 5, F.concat(F.lit("java&'"), "href")).otherwise(
        F.concat("href", F.lit('?a="1"&b=<2>'))
    )
    return rows.select(
        "idx", F.col("pos").cast("long").alias("pos"), urls.safe_href(odd).alias("safe_href")
    )


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    pages = site_pages(spark, sf).select("idx", "url")
    # One robots file per origin, written from the data: the site's smallest
    # language section and a query rule are closed to all, others to one bot.
    bodies = pages.groupBy(urls.origin(F.col("url")).alias("origin")).agg(
        F.concat(
            F.lit("# robots\nUser-agent: somebot\nDisallow: /\n\nUser-agent: *\nDisallow:\nDisallow: /"),
            F.min(urls.section_root(F.col("url"))),
            F.lit("/\nAllow: /x\nUser-agent: other\nDisallow: /fr\n"),
        ).alias("body")
    )
    checked = robots.apply_robots(pages, robots.robots_rules(bodies))
    return checked.select("idx", "robots_allowed")


def sources_by_precedence(spark: SparkSession, sf: str) -> DataFrame:
    pages = site_pages(spark, sf).select("idx", urls.url_key(F.col("url")).alias("key"))
    cached = pages.filter("key LIKE '%.com/%'").withColumn("payload", F.concat(F.lit("cache "), "key"))
    stored = pages.filter("key LIKE '%/en/%'").withColumn("payload", F.concat(F.lit("stored "), "key"))
    fresh = pages.withColumn("payload", F.concat(F.lit("fresh "), "key"))
    return url_lists.by_precedence(
        [("memory-cache", cached), ("pre-scraped", stored), ("scraper", fresh)], "key", ["payload"]
    )


def discovered_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = site_pages(spark, sf).select("site", F.col("idx").alias("pos"), "url")
    explicit = pages.filter(F.col("site").endswith(".org"))
    sitemap = pages.filter(F.col("site").rlike(r"\.(?:org|com)$"))
    found = url_lists.discover(explicit, sitemap, pages, max_pages=4)
    return found.select("site", "idx", "url", "method")


QUERIES = {
    f.__name__: f
    for f in (
        url_list, visible_markup, page_text, page_headings, technical_fields, content_quality,
        main_content, internal_links, competitor_page, url_parts, url_slugs, route_pages,
        pages_per_type, product_signals, url_filters, unsafe_urls, type_filter, page_budget, model_budget,
        first_page_of_section, safe_hrefs, robots_allowed, sources_by_precedence, discovered_pages,
    )
}

_TYPE_BY_URL = sql.page_type("path", None, V)
_ROUTED = f"""
routed AS (
  SELECT *, {sql.page_type('path', "lower(concat_ws(' ', title, array_to_string(heading_texts, ' '), body_text))", V)} AS page_type
  FROM feats
)"""
_SLUG_NOISE = r"(?i)\b(custom|cheap|best|buy|shop|online|printing|print)\b"
_P = sql.path("url")
_NO_END = f"regexp_replace({_P}, '/+$', '')"
_HTML_EXT = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|xml|json|css|js|ico|txt)$"
_SKIP = (
    "/(login|recover-password|share|feedback|contact|customer-care|help-center-and-support|"
    "track-my-order|returns|issues-and-resolutions|resources|videos)(/|$)"
)
_ESCAPE = (
    "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
)

ORACLES = {
    "url_list": f"""
      SELECT page_id AS line_no, url FROM pages WHERE regexp_matches(url, '(?i)^https?://')""",
    "visible_markup": f"SELECT page_id AS idx, {sql.visible('html')} AS visible FROM pages",
    "page_text": f"""
      WITH {sql.PAGES}, src AS (
        SELECT *, trim(coalesce(heading_texts[1], '') || ' ' || title || ' ' ||
               regexp_replace({sql.last_segment('url', '')}, '[-_]+', ' ', 'g')) AS s FROM feats)
      SELECT idx, site, title, first_1500_words, len(body_words) AS word_count,
             array_to_string(list_filter(string_split(
               {sql.squash(f"regexp_replace(s, '{_SLUG_NOISE}', '', 'g')")}, ' '),
               lambda t: t <> '')[1:3], ' ') AS product_entity
      FROM src""",
    "page_headings": f"""
      WITH {sql.PAGES}, h AS (
        SELECT idx, unnest(regexp_extract_all(vis, '(?is)<h([1-4])(?:\\s[^>]*)?>.*?</h[1-4]\\s*>', 1)) AS lvl,
               unnest(heading_texts) AS text, generate_subscripts(heading_texts, 1) - 1 AS pos
        FROM page_fields)
      SELECT idx, pos, 'h' || lvl AS tag, text FROM h""",
    "technical_fields": f"""
      WITH {sql.PAGES}
      SELECT idx, url,
             {sql.strip(sql.decode("regexp_extract(vis, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS technical_title,
             '' AS technical_meta_description, '' AS canonical, '' AS robots,
             len(regexp_extract_all(vis, '(?i)<img')) AS missing_alt_images,
             len(regexp_extract_all(vis, '(?i)<h1[\\s>]')) > 1 AS multiple_h1
      FROM raw_pages""",
    "content_quality": f"""
      WITH {sql.PAGES}
      SELECT idx, {sql.word_count('body_text')} AS quality_word_count,
             {sql.word_count('body_text')} < 300 AS thin_content,
             len(regexp_extract_all(vis, '(?i)<p[\\s>]')) AS paragraph_count,
             array_to_string(heading_texts, '|') AS heading_structure
      FROM feats""",
    "main_content": f"""
      WITH {sql.PAGES}
      SELECT idx, coalesce(nullif(regexp_extract(vis, '(?is)<main[^>]*>(.*?)</main\\s*>', 1), ''),
                           nullif(regexp_extract(vis, '(?is)<article[^>]*>(.*?)</article\\s*>', 1), ''),
                           regexp_extract(vis, '(?is)<body[^>]*>(.*)', 1)) AS main_content
      FROM raw_pages""",
    "internal_links": f"""
      WITH {sql.PAGES}, {sql.LINKS}, hits AS (
        SELECT idx, string_agg(link, ' ' ORDER BY pos) AS links, count(*) AS n FROM page_links GROUP BY idx),
      rel AS (SELECT idx, count(*) FILTER (href LIKE '/%') AS r,
                     count(*) FILTER (regexp_matches(href, '(?i)^https?://')) AS a FROM href_rows GROUP BY idx)
      SELECT p.idx, coalesce(links, '') AS internal_links, coalesce(n, 0) AS internal_link_count,
             coalesce(r, 0) AS relative_link_count, coalesce(a, 0) AS absolute_link_count
      FROM raw_pages p LEFT JOIN hits USING (idx) LEFT JOIN rel USING (idx)""",
    "competitor_page": f"""
      WITH {sql.PAGES}
      SELECT idx, array_to_string(list_filter(heading_texts, lambda h: h <> ''), '|') AS headings,
             substring(body_text, 1, 12000) AS paragraph_text, len(body_words) AS word_count,
             0 AS schema_types, 0 AS faq_questions
      FROM feats""",
    "url_parts": f"""
      SELECT page_id, {sql.origin('url')} AS base_url, {sql.no_fragment('url')} AS normal_url,
             lower({sql.no_fragment('url')}) AS url_key,
             lower(regexp_replace({sql.last_segment('url', 'home')}, '[-_]+', ' ', 'g')) AS planner_anchor,
             trim(regexp_replace({sql.last_segment('url', 'home')}, '[-_]+', ' ', 'g')) AS suggestion_anchor,
             {sql.first_segment('url', 'root')} AS section_root
      FROM pages""",
    "url_slugs": f"""
      SELECT page_id,
             regexp_replace(CASE WHEN {_NO_END} = '' THEN 'home' ELSE
               replace(ltrim({_NO_END}, '/'), '/', '--') END, '[^a-zA-Z0-9_-]+', '-', 'g') AS file_slug,
             CASE WHEN {_NO_END} = '' THEN 'home' ELSE
               replace(regexp_replace(ltrim({_NO_END}, '/'), '[^a-zA-Z0-9/_-]+', '-', 'g'), '/', '--') END AS audit_slug,
             replace(regexp_replace(regexp_replace({_P}, '^/', ''), '/$', ''), '/', '--') || '.md' AS batch_file,
             substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS text_slug,
             regexp_replace({sql.host('url')}, '[^a-zA-Z0-9.-]+', '-', 'g') AS domain_slug
      FROM pages""",
    "route_pages": f"WITH {sql.PAGES}, {_ROUTED} SELECT idx, site, page_type FROM routed",
    "pages_per_type": f"""
      WITH {sql.PAGES}, {_ROUTED}
      SELECT site, page_type, count(*) AS pages FROM routed GROUP BY ALL""",
    "product_signals": f"""
      WITH {sql.PAGES}, s AS (
        SELECT idx,
          regexp_matches(lower(path), '/(en|de)(/|$)') OR contains(lower(path), '/fr') AS signal_url,
          regexp_matches(html, '(?i)(add\\s*to\\s*cart|upload\\s*artwork|customize|select\\s*size|choose\\s*options?)') AS signal_cta,
          regexp_matches(html, '\\$\\s?\\d') OR regexp_matches(html, '(?i)\\bprice\\b') AS signal_pricing,
          regexp_matches(html, '(?i)schema\\.org/Product|"@type"\\s*:\\s*(\\[\\s*)?"Product"') AS signal_schema,
          regexp_matches(lower(coalesce(heading_texts[1], '')), '(the|ing)') AS signal_heading
        FROM feats)
      SELECT *, signal_schema OR (signal_url AND (signal_cta OR signal_pricing OR signal_heading))
             OR (signal_url::INT + signal_cta::INT + signal_pricing::INT + signal_schema::INT + signal_heading::INT) >= 2
             AS is_product
      FROM s""",
    "url_filters": f"""
      SELECT page_id, {sql.host('url')} = 'spam-farm.example.org' AS same_host,
             NOT regexp_matches({_P}, '{_HTML_EXT}') AS likely_html,
             ({_P}) <> '/' AND regexp_matches(lower({_P}), '{_SKIP}') AS skipped
      FROM pages""",
    "unsafe_urls": f"""
      SELECT page_id, CASE WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'Blocked URL protocol'
             WHEN {sql.host('url')} NOT IN ({', '.join(sql.q(h) for h in ALLOWED_HOSTS)})
             THEN 'Blocked host outside allowlist: ' || {sql.host('url')} END AS reason
      FROM pages""",
    "type_filter": f"""
      WITH {sql.PAGES}, t AS (SELECT idx, {_TYPE_BY_URL} AS page_type FROM raw_pages)
      SELECT idx, page_type, CASE WHEN page_type <> 'pdp' THEN 'filtered_' || page_type END AS skip_reason,
             page_type = 'pdp' AS product_page FROM t""",
    "page_budget": f"""
      WITH r AS (SELECT {sql.host('url')} AS site, page_id AS idx,
                        row_number() OVER (PARTITION BY {sql.host('url')} ORDER BY page_id) AS n FROM pages)
      SELECT site, idx, n <= 3 AS within_budget FROM r WHERE n <= 5""",
    "model_budget": """
      SELECT o_custkey AS site, o_orderkey AS idx,
             coalesce(sum(CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS within_budget FROM orders""",
    "first_page_of_section": f"""
      SELECT {sql.host('url')} AS site, {sql.first_segment('url', 'root')} AS section, min(page_id) AS idx
      FROM pages GROUP BY ALL""",
    "safe_hrefs": f"""
      WITH {sql.PAGES}, {sql.LINKS},
      o AS (SELECT idx, pos, CASE WHEN length({sql.decode('href')}) < 5 THEN 'java&''' || {sql.decode('href')}
                             ELSE {sql.decode('href')} || '?a="1"&b=<2>' END AS x FROM href_rows)
      SELECT idx, pos, CASE WHEN regexp_matches(x, '^(#|/|\\./|\\.\\./)') THEN {_ESCAPE} ELSE '#' END AS safe_href
      FROM o""",
    "robots_allowed": f"""
      WITH p AS (SELECT page_id AS idx, {sql.origin('url')} AS origin, {_P} AS path,
                        {sql.first_segment('url', 'root')} AS section FROM pages),
      closed AS (SELECT origin, min(section) AS section FROM p GROUP BY origin)
      SELECT idx, NOT starts_with(path, '/' || closed.section || '/') AS robots_allowed
      FROM p JOIN closed USING (origin)""",
    "sources_by_precedence": f"""
      WITH k AS (SELECT page_id AS idx, lower({sql.no_fragment('url')}) AS key FROM pages),
      w AS (SELECT key, min(CASE WHEN key LIKE '%.com/%' THEN 0 WHEN key LIKE '%/en/%' THEN 1 ELSE 2 END) AS p FROM k GROUP BY key)
      SELECT key, ['cache ', 'stored ', 'fresh '][p + 1] || key AS payload,
             ['memory-cache', 'pre-scraped', 'scraper'][p + 1] AS source FROM w""",
    "discovered_pages": f"""
      WITH p AS (SELECT {sql.host('url')} AS site, page_id AS idx, url, {_P} AS path FROM pages),
      kept AS (SELECT site, min(idx) AS idx, url FROM p
               WHERE NOT (path <> '/' AND regexp_matches(lower(path), '{_SKIP}')) GROUP BY site, url),
      n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY idx) AS rn FROM kept)
      SELECT site, idx, url, CASE WHEN site LIKE '%.org' THEN 'url-list' WHEN site LIKE '%.com' THEN 'sitemap' ELSE 'crawl' END AS method
      FROM n WHERE rn <= 4""",
}
