"""Registered queries over links: plans, suggestions, graph reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog import sql
from sitegrain.catalog.common import SITE_VOCAB, features, joined, scraped, site_pages, table, url_pages
from sitegrain.functions import urls
from sitegrain.operators import links as L
from sitegrain.operators.linkplan import plan_links
from sitegrain.operators.ordered import ordered_union
from sitegrain.operators.suggestions import suggest_links
from sitegrain.session import cut_lineage

V = SITE_VOCAB


def link_plan(spark: SparkSession, sf: str) -> DataFrame:
    return plan_links(url_pages(spark, sf)).drop("source_page")


def _suggestion_input(spark: SparkSession, sf: str) -> DataFrame:
    typed = url_pages(spark, sf)
    text = scraped(spark, sf).select(
        "idx",
        "product_entity",
        # Numbers of the page's own links and text stand in for shared words.
        F.concat_ws(" ", "html", "url").alias("content"),
    )
    return typed.join(text, "idx")


def link_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    pages = cut_lineage(_suggestion_input(spark, sf))
    return suggest_links(pages, pages.select("site", "idx", "url"), V).drop("source_page")


def _part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Product pages of one shop per part type: hot words in every anchor."""
    part = table(spark, sf, "part")
    slug = F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.lower("p_brand"))
    url = F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.com/"),
                   F.when(F.col("p_size") < 10, "category/").otherwise("x/"),
                   F.regexp_replace(slug, "#", "-"))
    return part.select(
        F.concat(F.lower("p_type"), F.lit(".example.com")).alias("site"),
        F.col("p_partkey").alias("idx"),
        F.concat(url, F.lit("?k="), "p_partkey").alias("url"),
        F.when(F.col("p_size") > 25, "pdp").otherwise("generic").alias("page_type"),
        F.element_at(F.split("p_name", " "), 1).alias("product_entity"),
        F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), "p_brand").alias("content"),
    )


def shop_link_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions on shops with hundreds of pages and words shared by most anchors."""
    pages = _part_pages(spark, sf)
    return suggest_links(pages, pages.select("site", "idx", "url"), V).drop("source_page")


def merged_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    pages = cut_lineage(_suggestion_input(spark, sf))
    contextual = suggest_links(pages, pages.select("site", "idx", "url"), V)
    return L.merge_suggestions(plan_links(pages), contextual).drop("source_page")


def _linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    return scraped(spark, sf).select("site", "idx", "url", "internal_links")


def known_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links are known when another page of any host links to the same path."""
    pages = _linked_pages(spark, sf)
    known = pages.select(F.explode("internal_links").alias("url")).filter(
        F.length(urls.path(F.col("url"))) <= 5
    )
    return L.known_link_hits(pages, known).drop("url")


def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = _linked_pages(spark, sf)
    seen = pages.select(F.explode("internal_links").alias("url")).distinct()
    status = seen.filter(F.length("url") > 26).withColumn(
        "status", F.when(F.col("url").contains("th"), 404).otherwise(200).cast("long")
    )
    return L.broken_links(pages, status).drop("url")


def related_pages(spark: SparkSession, sf: str) -> DataFrame:
    names = {"homepage": "home", "pdp": "service", "category": "location"}
    kind = F.col("page_type")
    for old, new in names.items():
        kind = F.when(F.col("page_type") == old, new).otherwise(kind)
    pages = url_pages(spark, sf).select(
        "site", "idx", kind.alias("page_type"), urls.planner_anchor(F.col("url")).alias("topic")
    )
    return L.related_pages(pages)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    item = table(spark, sf, "lineitem")
    node = lambda c: F.concat(F.lit("/p/"), F.col(c).cast("string"))
    edges = item.select(
        F.col("l_returnflag").alias("site"),
        node("l_partkey").alias("source"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("/p/"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber"))).cast("string")).alias("target"),
    )
    seeds = item.groupBy(F.col("l_returnflag").alias("site")).agg(
        F.concat(F.lit("/p/"), F.min("l_partkey").cast("string")).alias("url")
    )
    stored = item.select(F.col("l_returnflag").alias("site"), node("l_partkey").alias("url")).distinct()
    return seeds, edges, stored


def reachable_pages(spark: SparkSession, sf: str) -> DataFrame:
    seeds, edges, stored = _graph(spark, sf)
    return L.reachable_pages(seeds, edges, stored, max_depth=2, page_filter=False)


def linked_words(spark: SparkSession, sf: str) -> DataFrame:
    """Reach over the link table of the stored pages, from each site's first page."""
    pages = _linked_pages(spark, sf)
    edges = L.page_link_table(pages)
    stored = pages.select("site", urls.canonical(F.col("url")).alias("url"))
    seeds = pages.groupBy("site").agg(
        F.min_by(urls.canonical(F.col("url")), "idx").alias("url")
    )
    return L.reachable_pages(seeds, edges, stored, max_depth=2)


def injected_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = site_pages(spark, sf)
    links = F.array(
        F.struct(urls.planner_anchor(F.col("url")).alias("anchor"), F.col("url").alias("url"))
    )
    inner = F.regexp_extract("html", r"(?is)<article>(.*)</article>", 1)
    plain = F.regexp_extract("html", r"(?is)<h1>(.*?)</h1>", 1)
    return pages.select(
        "idx",
        L.inject_links(inner, links).alias("with_link"),
        L.inject_links(plain, links, staged=True).alias("with_list"),
    )


def union_of_links(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered distinct union: a page's links, then its site's first links."""
    pages = features(spark, sf).select("site", "idx", "internal_links")
    own = pages.select("site", "idx", F.posexplode("internal_links").alias("pos", "link"))
    backwards = own.withColumn("pos", -F.col("pos"))
    merged = ordered_union([own, backwards], ["site", "idx", "link"], "pos")
    return merged.groupBy("site", "idx").agg(
        joined(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "pos", "link"))), lambda r: r["link"]), " ").alias("links")
    )


QUERIES = {
    f.__name__: f
    for f in (
        link_plan, link_suggestions, shop_link_suggestions, merged_suggestions, known_links,
        broken_links, related_pages, reachable_pages, linked_words, injected_links, union_of_links,
    )
}

_TYPED = f"""
typed AS (
  SELECT idx, site, url, {sql.page_type('path', None, V)} AS page_type,
         {sql.first_segment('url', 'root')} AS section,
         lower(regexp_replace({sql.last_segment('url', 'home')}, '[-_]+', ' ', 'g')) AS anchor
  FROM raw_pages
)"""
# All ordered pairs of pages: the defining form of the plan.
_PLAN = """
pairs AS (
  SELECT s.site, s.idx AS source_idx, t.idx AS tidx, t.anchor, t.url AS target_page,
         (CASE WHEN s.page_type = 'pdp' AND t.page_type = 'category' THEN 3 ELSE 0 END)
         + (CASE WHEN s.page_type = 'pdp' AND t.page_type = 'pdp' AND s.section = t.section THEN 2 ELSE 0 END)
         + (CASE WHEN s.page_type = 'category' AND t.page_type = 'pdp' THEN 2 ELSE 0 END)
         + (CASE WHEN s.section = t.section THEN 1 ELSE 0 END) AS score
  FROM typed s JOIN typed t ON s.site = t.site AND s.idx <> t.idx
),
unique_anchor AS (
  SELECT *, row_number() OVER (PARTITION BY site, source_idx, anchor ORDER BY score DESC, tidx) AS a
  FROM pairs WHERE score > 0
),
plan AS (
  SELECT site, source_idx, anchor, target_page, score,
         row_number() OVER (PARTITION BY site, source_idx ORDER BY score DESC, tidx) AS rank
  FROM unique_anchor WHERE a = 1 QUALIFY rank <= 5
)"""


def _suggest(pages: str, vocab) -> str:
    """All ordered pairs again, with token sets; ``pages`` names a CTE with
    ``site, idx, url, page_type, content, product_entity``."""
    terms = "|".join(vocab.product_terms)
    cats = "|".join(vocab.category_segments)
    return f"""
cand AS (
  SELECT site, idx, url, trim(regexp_replace({sql.last_segment('url', 'home')}, '[-_]+', ' ', 'g')) AS anchor,
         regexp_matches(url, '/({cats})/') AS cat
  FROM {pages}
),
cand_tokens AS (SELECT *, {sql.hyphen_tokens('anchor')} AS toks FROM cand),
src AS (SELECT site, idx, page_type, list_distinct({sql.hyphen_tokens("content || ' ' || product_entity")}) AS words FROM {pages}),
scored AS (
  SELECT s.site, s.idx AS source_idx, c.idx AS tidx, c.anchor, c.url AS target_page,
         2 * len(list_filter(c.toks, lambda t: list_contains(s.words, t)))
         + len(list_filter(c.toks, lambda t: regexp_matches(t, '({terms})')))
         + (CASE WHEN s.page_type = 'pdp' AND c.cat THEN 1 ELSE 0 END) AS score
  FROM src s JOIN cand_tokens c ON s.site = c.site AND s.idx <> c.idx
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY site, source_idx, anchor ORDER BY score DESC, tidx) AS a
  FROM scored WHERE score > 0
),
picked AS (
  SELECT site, source_idx, anchor, target_page,
         row_number() OVER (PARTITION BY site, source_idx ORDER BY score DESC, tidx) AS rank
  FROM best WHERE a = 1 QUALIFY rank <= 6
),
fill AS (
  SELECT s.site, s.source_idx, s.anchor, s.target_page, s.tidx,
         row_number() OVER (PARTITION BY s.site, s.source_idx, s.anchor ORDER BY s.tidx) AS a
  FROM scored s ANTI JOIN picked p ON s.site = p.site AND s.source_idx = p.source_idx AND s.anchor = p.anchor
),
filled AS (
  SELECT site, source_idx, anchor, target_page, rank AS ord, 0 AS part FROM picked
  UNION ALL SELECT site, source_idx, anchor, target_page, tidx AS ord, 1 AS part FROM fill WHERE a = 1
),
counted AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.site, f.source_idx ORDER BY part, ord) AS rank FROM filled f
),
suggestions AS (
  SELECT site, source_idx, rank, anchor, target_page FROM counted WHERE part = 0 OR rank <= 3
)"""


_SUGGEST_PAGES = f"""
sp AS (
  SELECT t.idx, t.site, t.url, t.page_type, r.html || ' ' || t.url AS content, e.product_entity
  FROM typed t JOIN raw_pages r USING (idx) JOIN (
    SELECT idx, array_to_string(list_filter(string_split({sql.squash("regexp_replace(trim(coalesce(heading_texts[1], '') || ' ' || title || ' ' || regexp_replace(" + sql.last_segment('url', '') + ", '[-_]+', ' ', 'g')), '(?i)" + chr(92) + "b(custom|cheap|best|buy|shop|online|printing|print)" + chr(92) + "b', '', 'g')")}, ' '),
      lambda t: t <> '')[1:3], ' ') AS product_entity FROM page_fields) e USING (idx)
)"""
_PARTS = """
pp AS (
  SELECT lower(p_type) || '.example.com' AS site, p_partkey AS idx,
         'https://' || lower(p_type) || '.example.com/' || CASE WHEN p_size < 10 THEN 'category/' ELSE 'x/' END
         || replace(replace(p_name, ' ', '-') || '-' || lower(p_brand), '#', '-') || '?k=' || p_partkey AS url,
         CASE WHEN p_size > 25 THEN 'pdp' ELSE 'generic' END AS page_type,
         string_split(p_name, ' ')[2] || ' ' || p_brand AS content,
         string_split(p_name, ' ')[1] AS product_entity
  FROM part
)"""
_REACH = """
stored AS (SELECT DISTINCT site, source AS url FROM edges),
d0 AS (SELECT site, url, 0 AS depth, 1 AS seq FROM seeds),
c1 AS (SELECT e.site, e.target AS url, min(e.pos) AS pos FROM d0 JOIN edges e ON e.site = d0.site AND e.source = d0.url GROUP BY ALL),
d1 AS (SELECT site, url, 1 AS depth, 1 + row_number() OVER (PARTITION BY site ORDER BY pos) AS seq
       FROM c1 ANTI JOIN d0 USING (site, url) QUALIFY seq <= {cap}),
c2 AS (SELECT e.site, e.target AS url, min((d1.seq, e.pos)) AS place
       FROM d1 JOIN edges e ON e.site = d1.site AND e.source = d1.url GROUP BY ALL),
d2 AS (SELECT c2.site, c2.url, 2 AS depth,
              t.taken + row_number() OVER (PARTITION BY c2.site ORDER BY place) AS seq
       FROM c2 JOIN (SELECT site, max(seq) AS taken FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) GROUP BY site) t
         ON t.site = c2.site
       ANTI JOIN (SELECT site, url FROM d0 UNION ALL SELECT site, url FROM d1) v
         ON v.site = c2.site AND v.url = c2.url
       QUALIFY seq <= {cap}),
visited AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)
SELECT site, url, depth, seq, (site, url) IN (SELECT (site, url) FROM have) AS is_page FROM visited"""

ORACLES = {
    "link_plan": f"""
      WITH {sql.PAGES}, {_TYPED}, {_PLAN}
      SELECT site, source_idx, rank, anchor, target_page, score FROM plan""",
    "link_suggestions": f"""
      WITH {sql.PAGES}, {_TYPED}, {_SUGGEST_PAGES}, {_suggest('sp', V)}
      SELECT * FROM suggestions""",
    "shop_link_suggestions": f"WITH {_PARTS}, {_suggest('pp', V)} SELECT * FROM suggestions",
    "merged_suggestions": f"""
      WITH {sql.PAGES}, {_TYPED}, {_PLAN}, {_SUGGEST_PAGES}, {_suggest('sp', V)},
      every AS (SELECT site, source_idx, rank AS r, anchor, target_page, 0 AS o FROM plan
                UNION ALL SELECT site, source_idx, rank, anchor, target_page, 1 FROM suggestions),
      u AS (SELECT *, row_number() OVER (PARTITION BY site, source_idx, lower(anchor) ORDER BY o, r) AS a FROM every)
      SELECT site, source_idx, row_number() OVER (PARTITION BY site, source_idx ORDER BY o, r) AS rank, anchor, target_page
      FROM u WHERE a = 1 QUALIFY rank <= 5""",
    "known_links": f"""
      WITH {sql.PAGES}, {sql.LINKS},
      known AS (SELECT DISTINCT link FROM page_links WHERE length({sql.path('link')}) <= 5)
      SELECT p.site, p.idx, count(l.link) AS internal_link_count, count(k.link) AS known_link_hits,
             count(l.link) < 2 OR count(k.link) = 0 AS orphan_page_risk, count(l.link) < 2 AS few_links
      FROM raw_pages p LEFT JOIN page_links l USING (idx) LEFT JOIN known k ON k.link = l.link
      GROUP BY p.site, p.idx""",
    "broken_links": f"""
      WITH {sql.PAGES}, {sql.LINKS},
      n AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pos) - 1 AS p FROM page_links),
      s AS (SELECT *, CASE WHEN length(link) > 26 THEN CASE WHEN contains(link, 'th') THEN 404 ELSE 200 END END AS status FROM n)
      SELECT site, idx, p AS pos, link, status FROM s WHERE status IS NULL OR status >= 400""",
    "related_pages": f"""
      WITH {sql.PAGES}, {_TYPED},
      t AS (SELECT site, idx, anchor AS topic, CASE page_type WHEN 'homepage' THEN 'home' WHEN 'pdp' THEN 'service'
                   WHEN 'category' THEN 'location' ELSE page_type END AS kind FROM typed),
      r AS (SELECT s.site, s.idx AS source_idx, o.idx AS target_idx, o.kind AS target_type, o.topic AS target_topic,
                   row_number() OVER (PARTITION BY s.site, s.idx ORDER BY o.idx) AS rank
            FROM t s JOIN t o ON s.site = o.site AND (s.kind <> o.kind OR s.topic <> o.topic)
             AND CASE s.kind WHEN 'home' THEN o.kind IN ('service', 'location')
                             WHEN 'service' THEN o.kind IN ('location', 'blog')
                             WHEN 'location' THEN o.kind IN ('service', 'blog')
                             ELSE o.kind IN ('service', 'home') END
            QUALIFY rank <= 4)
      SELECT site, source_idx, rank, target_idx, target_type, target_topic FROM r""",
    "reachable_pages": """
      WITH edges AS (SELECT l_returnflag AS site, '/p/' || l_partkey AS source, l_orderkey * 10 + l_linenumber AS pos,
                            '/p/' || (l_suppkey * 7 + l_linenumber) AS target FROM lineitem),
      seeds AS (SELECT l_returnflag AS site, '/p/' || min(l_partkey) AS url FROM lineitem GROUP BY 1),
      have AS (SELECT DISTINCT site, source AS url FROM edges),""" + _REACH.format(cap=10**9),
    "linked_words": f"""
      WITH {sql.PAGES}, {sql.LINKS},
      edges AS (SELECT site, {sql.no_fragment('url')} AS source, pos, link AS target FROM page_links
                WHERE NOT regexp_matches({sql.path('link')}, '(?i)\\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|xml|json|css|js|ico|txt)$')
                AND NOT regexp_matches(lower({sql.path('link')}), '/(login|recover-password|share|feedback|contact|customer-care|help-center-and-support|track-my-order|returns|issues-and-resolutions|resources|videos)(/|$)')),
      seeds AS (SELECT site, {sql.no_fragment('min_by(url, idx)')} AS url FROM raw_pages GROUP BY site),
      have AS (SELECT DISTINCT site, {sql.no_fragment('url')} AS url FROM raw_pages),""" + _REACH.format(cap=10**9),
    "injected_links": f"""
      WITH {sql.PAGES}, {_TYPED}, a AS (
        SELECT idx, regexp_extract(html, '(?is)<article>(.*)</article>', 1) AS x,
               regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS h, '[' || anchor || '](' || url || ')' AS md
        FROM typed JOIN (SELECT idx, html FROM raw_pages) USING (idx))
      SELECT idx,
        CASE WHEN NOT regexp_matches(x, '(?i)<p[^>]*>') THEN x || chr(10) || chr(10) || 'CONTEXTUAL INTERNAL LINKS' || chr(10) || '- ' || md
             WHEN regexp_matches(x, '(?is)<p[^>]*>.*?</p>') THEN
               regexp_extract(x, '(?is)^(.*?)<p[^>]*>(.*?)</p>', 1) || '<p>' || regexp_extract(x, '(?is)<p[^>]*>(.*?)</p>', 1)
               || ' See also ' || md || '.</p>' || regexp_extract(x, '(?is)^.*?<p[^>]*>.*?</p>(.*)$', 1)
             ELSE x END AS with_link,
        h || chr(10) || chr(10) || 'Related links:' || chr(10) || '- ' || md AS with_list
      FROM a""",
    "union_of_links": f"""
      WITH {sql.PAGES}, {sql.LINKS}
      SELECT site, idx, string_agg(link, ' ' ORDER BY pos) AS links FROM page_links GROUP BY ALL""",
}
