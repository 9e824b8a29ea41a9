"""Markup, addresses and sitemap forms that the given pages lack, built from columns of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog import sql
from sitegrain.catalog.audit_checks import order_sitemaps
from sitegrain.catalog.common import joined, scraped, table
from sitegrain.functions import html as H
from sitegrain.functions import urls
from sitegrain.operators import pages as P
from sitegrain.operators.runs import content_hash
from sitegrain.sources.sitemaps import bad_locs, sitemap_pages


def built_markup(spark: SparkSession, sf: str) -> DataFrame:
    """A page per part: descriptions, canonical link, robots, images, main role, JSON-LD and questions."""
    # A small file of many rows may be one task; the work on a row is long, so rows are dealt to all cores.
    part = table(spark, sf, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    key = F.col("p_partkey")
    own = lambda n, k, text: F.when(key % n == k, text).otherwise("")
    put = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    html = put(
        "<html><head><title>", F.col("p_name"), "</title>",
        own(3, 0, put('<meta name="description" content=" ', F.col("p_brand"), ' ">')),
        own(2, 0, put("<META property='og:description' content='", F.col("p_type"), "'>")),
        own(5, 1, put('<link rel="canonical" href="https://x.example/p/', key.cast("string"), '"/>')),
        own(7, 2, F.lit('<meta content="noindex, follow" name="robots">')),
        own(4, 1, put('<script type="application/ld+json">{"@type": "', F.col("p_brand"), '"}</script>')),
        own(4, 2, put('<script type="application/ld+json">[{"@type": ["', F.col("p_brand"), '", "Thing"]}, {"@type": "Thing"}]</script>')),
        own(4, 3, F.lit('<script type="application/ld+json">{broken</script>')),
        "</head><body><img src='a'><img src='b' alt=' '>", own(3, 1, F.lit("<img src='c' alt='c'>")), own(3, 2, F.lit("<img src='d' alt=''>")),
        own(2, 1, put("<div role='main'><b>", F.col("p_type"), "</b><div>", F.col("p_brand"), "<DIV>x</DIV></div> tail</div><div>y</div>")),
        "<p>What makes ", F.col("p_name"), " good?</p><ul><li>Q: sizes of ", F.col("p_brand"), "</li><li>Short?</li></ul></body></html>",
    )
    pages = part.select(F.lit("x.example").alias("site"), key.alias("idx"), put("https://x.example/", key.cast("string")).alias("url"), html.alias("html"))
    technical = P.technical_seo(pages).drop("site", "url", "multiple_h1")
    main = pages.select("idx", H.main_content(H.strip_hidden(F.col("html"))).alias("main_content"))
    serp = P.serp_page(pages).select("idx", joined(F.col("schema_types")).alias("schema_types"), joined(F.col("faq_questions")).alias("faq_questions"))
    return technical.join(main.withColumn("main_content", F.when(F.col("idx") % 2 == 1, F.col("main_content"))), "idx").join(serp, "idx")


def unsafe_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """An address per order: other schemes, local names, private and public IPv4."""
    key = F.col("o_orderkey")
    last = (key % 250).cast("string")
    forms = ["ftp://a.example/", "http://localhost/", "https://n.localhost/", "http://10.1.2.", "http://192.168.7.", "http://8.8.4.", "https://a.example/"]
    url = F.element_at(F.array(*(F.concat(F.lit(f), last) for f in forms)), (key % len(forms) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", urls.block_reason(url).alias("reason"))


def audited_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """The audit form of the walk: any ``<loc>``, names decide what is a sitemap."""
    roots, stored = order_sitemaps(spark, sf)
    return sitemap_pages(roots, stored, audit=True).select("site", "url")


def bad_sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of sitemaps made of document lines that are no absolute URL."""
    lines = F.concat(F.lit("<urlset><url><loc>https://a.example/"), F.col("doc_id"), F.lit("</loc></url><url><loc>"), F.col("source"), F.lit("</loc></url></urlset>"))
    return bad_locs(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), lines.alias("xml")))


def page_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of pages with equal content by the default fields."""
    pages = scraped(spark, sf).select("idx", content_hash().alias("h"))
    return pages.groupBy("h").agg(F.min("idx").alias("first_page"), F.count("*").alias("copies")).drop("h")


QUERIES = {f.__name__: f for f in (built_markup, unsafe_hosts, audited_sitemaps, bad_sitemap_entries, page_hashes)}

ORACLES = {
    "built_markup": """
      SELECT p_partkey AS idx, p_name AS technical_title,
        CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS technical_meta_description,
        CASE WHEN p_partkey % 5 = 1 THEN 'https://x.example/p/' || p_partkey ELSE '' END AS canonical,
        CASE WHEN p_partkey % 7 = 2 THEN 'noindex, follow' ELSE '' END AS robots,
        CASE WHEN p_partkey % 3 = 2 THEN 3 ELSE 2 END AS missing_alt_images,
        CASE WHEN p_partkey % 2 = 1 THEN '<b>' || p_type || '</b><div>' || p_brand || '<DIV>x</DIV></div> tail' END AS main_content,
        CASE p_partkey % 4 WHEN 1 THEN p_brand WHEN 2 THEN p_brand || '|Thing' ELSE '' END AS schema_types,
        'What makes ' || p_name || ' good?|sizes of ' || p_brand AS faq_questions
      FROM part""",
    "unsafe_hosts": """
      SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Blocked URL protocol: ftp:' WHEN 1 THEN 'Blocked local hostname: localhost'
        WHEN 2 THEN 'Blocked local hostname: n.localhost' WHEN 3 THEN 'Blocked private IP target: 10.1.2.' || (o_orderkey % 250)
        WHEN 4 THEN 'Blocked private IP target: 192.168.7.' || (o_orderkey % 250) END AS reason FROM orders""",
    "audited_sitemaps": """
      WITH l AS (SELECT 'o' || o_orderkey || '.example.com' AS site, * FROM orders)
      SELECT site, 'https://' || site || '/p/' || o_custkey AS url FROM l WHERE o_orderpriority NOT LIKE '1%' AND o_orderstatus <> 'F'
      UNION SELECT site, 'https://' || site || '/s/' || o_orderkey FROM l
      UNION SELECT site, 'https://' || site || '/login/' FROM l""",
    "bad_sitemap_entries": """
      SELECT doc_id::VARCHAR AS url, 1::BIGINT AS pos, source AS loc FROM documents""",
    "page_hashes": f"""
      WITH {sql.PAGES} SELECT min(idx) AS first_page, count(*) AS copies FROM feats
      GROUP BY title, body_text, regexp_extract_all(vis, '(?is)<(h[1-4])(?:\\s[^>]*)?>.*?</h[1-4]\\s*>', 1), heading_texts""",
}
