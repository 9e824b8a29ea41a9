"""Registered queries over whole flows: site audit, sitemaps, streams, artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegrain.catalog import sql
from sitegrain.catalog.common import SITE_VOCAB, joined, site_pages, table
from sitegrain.catalog.links_checks import _PLAN, _suggest
from sitegrain.catalog.text_checks import _phrase_ctes
from sitegrain.operators.serp import intel_requests
from sitegrain.plans.audit import AuditOptions, SiteAudit, audit_sites
from sitegrain.session import work_folder
from sitegrain.sources import artifacts as A
from sitegrain.sources.sitemaps import sitemap_pages
from sitegrain.streaming import page_stream as S

V = SITE_VOCAB
HALF = "2024-01-16 00:00:00"


def _audit(spark: SparkSession, sf: str) -> SiteAudit:
    return audit_sites(site_pages(spark, sf), AuditOptions(vocab=V))


def page_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every page with its type, quality, links and suggestions."""
    links = F.transform("contextual_links", lambda r: F.concat_ws(">", r["anchor"], r["url"]))
    return _audit(spark, sf).page_audits.select(
        "site", "idx", "url", "page_type", "product_page", "title", "product_entity", "word_count",
        "thin_content", "paragraph_count", "multiple_h1", "internal_link_count", "known_link_hits",
        "orphan_page_risk", F.coalesce(joined(links), F.lit("")).alias("contextual_links"), "core_keyword",
        joined(F.transform("clusters", lambda c: c["keywords"][0])).alias("first_keywords"),
    )


def audit_with_intel(spark: SparkSession, sf: str) -> DataFrame:
    """The audit with search results: the document that has a request's page number is its result page."""
    pages = site_pages(spark, sf)
    plain = audit_sites(pages, AuditOptions(vocab=V))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("request_idx"), F.col("text").alias("paragraph_text"))
    none = F.array().cast("array<string>")
    found = intel_requests(plain.features).select("query", "request_idx").join(docs, "request_idx").select(
        "query", F.col("request_idx").alias("row_pos"), F.concat(F.lit("https://r.example/"), "request_idx").alias("url"),
        F.array().cast("array<struct<tag:string,text:string>>").alias("headings"), "paragraph_text", F.lit(1).cast("bigint").alias("word_count"),
        none.alias("faq_questions"), none.alias("schema_types"),
    )
    audit = SiteAudit(plain.features, plain.options, found)
    return audit.page_audits.select("site", "idx", "query", "serp_analyzed", F.coalesce(joined(F.col("keyword_themes")), F.lit("")).alias("keyword_themes"))


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).summary


def order_sitemaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Roots and stored sitemaps: every order is a small site, an index file with two page files."""
    item = table(spark, sf, "orders")
    site = F.concat(F.lit("https://o"), "o_orderkey", F.lit(".example.com"))
    entry = lambda tag, *url: F.concat(F.lit(f"<{tag}><loc> "), *url, F.lit(f" </loc></{tag}>"))
    end = F.when(F.col("o_orderstatus") == "F", ".jpg").when(F.col("o_orderpriority").startswith("2"), "#x").otherwise("")
    home = F.when(F.col("o_orderpriority").startswith("1"), F.lit("https://other.example.com")).otherwise(site)
    based = item.select(
        site.alias("base_url"),
        F.array(
            F.struct(
                F.concat(site, F.lit("/sitemap.xml")).alias("url"),
                F.concat(
                    F.lit("<sitemapindex>"), entry("sitemap", site, F.lit("/a.xml")), entry("sitemap", site, F.lit("/sitemap.xml")),
                    entry("sitemap", F.lit("https://other.example.com/c.xml")), entry("sitemap", site, F.lit("/b.xml")),
                    F.lit("</sitemapindex>"),
                ).alias("xml"),
            ),
            F.struct(
                F.concat(site, F.lit("/a.xml")).alias("url"),
                F.concat(F.lit("<urlset>"), entry("url", home, F.lit("/p/"), "o_custkey", end), F.lit("</urlset>")).alias("xml"),
            ),
            F.struct(
                F.concat(site, F.lit("/b.xml")).alias("url"),
                F.concat(
                    F.lit("<urlset>"), entry("url", site, F.lit("/s/"), "o_orderkey"), entry("url", site, F.lit("/login/")),
                    F.lit("</urlset>"),
                ).alias("xml"),
            ),
        ).alias("files"),
    )
    stored = based.select(F.explode("files").alias("f")).select("f.url", "f.xml")
    return based.select("base_url").distinct(), stored


def sitemap_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of every order's sitemaps."""
    return sitemap_pages(*order_sitemaps(spark, sf)).select("site", "url")


def stored_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts written as JSON per producer and read back."""
    path = work_folder(spark, "artifacts")
    docs = table(spark, sf, "documents").select("doc_id", F.struct("lang", "text").alias("data"))
    A.write_artifacts(A.with_envelope(docs, F.lit("2024-01-01"), producer="scrape"), path)
    schema = "schemaVersion STRING, createdAt STRING, doc_id BIGINT, data STRUCT<lang: STRING, text: STRING>, producer STRING"
    back = A.read_artifacts(spark, path, schema)
    return back.select("schemaVersion", "producer", "doc_id", F.col("data.text").alias("text"))


def _stored_schema(spark: SparkSession, sf: str, name: str) -> StructType:
    return table(spark, sf, name).schema


def streamed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages audited as a stream equal the batch result."""
    out, checkpoint = work_folder(spark, "pages"), work_folder(spark, "pages-ckpt")
    # The braces make a pattern of the path: the table may be a file or a folder of files, and a stream takes no plain file.
    pages = S.stream_folder(spark, f"{sf}/{{pages.parquet}}", _stored_schema(spark, sf, "pages"))
    S.run_page_stream(pages, out, checkpoint, V).awaitTermination()
    return spark.read.parquet(out).select("site", "idx", "page_type", "word_count", "thin_content")


def _arrivals(spark: SparkSession, sf: str, run, marks: Sequence[str] = (HALF,)) -> None:
    """Feed events in arrivals that end at the marks: by default the first half of the month, then the rest."""
    folder = work_folder(spark, "events")
    events = table(spark, sf, "events")
    ends = [None, *marks, None]
    for low, high in zip(ends, ends[1:]):
        part = (F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high)
        events.filter(part).write.mode("append").parquet(folder)
        run(S.stream_folder(spark, folder, events.schema, 1_000_000)).awaitTermination()


def streamed_changes(spark: SparkSession, sf: str) -> DataFrame:
    store, checkpoint = work_folder(spark, "store"), work_folder(spark, "store-ckpt")
    write = S.changed_pages_writer(store)

    def run(events: DataFrame):
        rows = events.select(
            F.concat(F.lit("u"), "user_id").alias("url"), F.sha2("event_type", 256).alias("content_hash"),
            F.col("event_id").alias("seq"),
        )
        return S.run_batches(rows, write, checkpoint)

    _arrivals(spark, sf, run)
    return S.page_history(spark, store).select("url", "seq")


def streamed_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Days of events as runs; each comes out once, when its last event is in."""
    final, checkpoint = work_folder(spark, "final"), work_folder(spark, "final-ckpt")
    day = F.to_date("ts").cast("string").alias("run_id")
    totals = table(spark, sf, "events").groupBy(day).agg(F.count("*").alias("total"))

    def run(events: DataFrame):
        status = F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status")
        return S.run_progress_stream(S.run_progress(events.select(day, status, "ts"), totals), final, checkpoint)

    _arrivals(spark, sf, run)
    return spark.read.parquet(final).select("run_id", "total", "completed", "failed", "outcome")


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    good, dead = work_folder(spark, "good"), work_folder(spark, "dead")
    write = S.dead_letter_writer(good, dead, "scrape_page")

    def run(events: DataFrame):
        rows = events.select(
            "event_id", "event_type", F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
            F.col("ts").alias("failed_at"),
        )
        return S.run_batches(rows, write, checkpoint)

    checkpoint = work_folder(spark, "dead-ckpt")
    _arrivals(spark, sf, run)
    kept = spark.read.parquet(good).select("event_id", F.lit("good").alias("kind"), F.lit("").alias("error"))
    lost = spark.read.parquet(dead).select(
        F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), F.col("stage").alias("kind"), "error"
    )
    return kept.unionByName(lost)


QUERIES = {
    f.__name__: f
    for f in (
        page_audits, audit_with_intel, audit_summary, sitemap_walk, stored_artifacts, streamed_pages, streamed_changes,
        streamed_progress, dead_letters,
    )
}

_ENTITY = (
    "array_to_string(list_filter(string_split("
    + sql.squash(
        "regexp_replace(trim(coalesce(heading_texts[1], '') || ' ' || title || ' ' || regexp_replace("
        + sql.last_segment("url", "")
        + ", '[-_]+', ' ', 'g')), '(?i)\\b(custom|cheap|best|buy|shop|online|printing|print)\\b', '', 'g')"
    )
    + ", ' '), lambda t: t <> '')[1:3], ' ')"
)
_CONTENT_TYPE = sql.page_type(
    "path", "lower(concat_ws(' ', title, array_to_string(heading_texts, ' '), body_text))", V
)
# Types by URL plan the links; types by content drive the suggestions.
_AUDIT = f"""
typed AS (
  SELECT idx, site, url, {sql.page_type('path', None, V)} AS page_type, {sql.first_segment('url', 'root')} AS section,
         lower(regexp_replace({sql.last_segment('url', 'home')}, '[-_]+', ' ', 'g')) AS anchor FROM raw_pages),
{_PLAN},
full_pages AS (SELECT *, {_CONTENT_TYPE} AS page_type, {_ENTITY} AS product_entity, html AS content FROM feats),
{_suggest('full_pages', V)},
every AS (SELECT site, source_idx, rank AS r, anchor, target_page, 0 AS o FROM plan
          UNION ALL SELECT site, source_idx, rank, anchor, target_page, 1 FROM suggestions),
u AS (SELECT *, row_number() OVER (PARTITION BY site, source_idx, lower(anchor) ORDER BY o, r) AS a FROM every),
m AS (SELECT *, row_number() OVER (PARTITION BY site, source_idx ORDER BY o, r) AS k FROM u WHERE a = 1 QUALIFY k <= 5),
merged AS (SELECT source_idx AS idx, string_agg(anchor || '>' || target_page, '|' ORDER BY k) AS contextual_links FROM m GROUP BY 1),
hits AS (
  SELECT p.idx, count(l.link) AS n, count(k.url) AS known
  FROM raw_pages p LEFT JOIN page_links l USING (idx)
  LEFT JOIN (SELECT DISTINCT {sql.no_fragment('url')} AS url FROM pages) k ON k.url = l.link GROUP BY 1)"""
_CORE = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"

ORACLES = {
    "audit_with_intel": f"""
      WITH {sql.PAGES}, e AS (
        SELECT idx, array_to_string(list_filter(string_split(
               {sql.squash("regexp_replace(trim(coalesce(heading_texts[1], '') || ' ' || title || ' ' || regexp_replace(regexp_extract(path, '([^/]*)/?$', 1), '[-_]+', ' ', 'g')), '(?i)" + chr(92) + "b(custom|cheap|best|buy|shop|online|printing|print)" + chr(92) + "b', '', 'g')")}, ' '),
               lambda t: t <> '')[1:3], ' ') AS entity, title, url, site,
               {sql.page_type('path', "lower(concat_ws(' ', title, array_to_string(heading_texts, ' '), body_text))", V)} AS page_type
        FROM feats),
      k AS (SELECT *, regexp_replace(regexp_replace(lower(coalesce(nullif(entity, ''), page_type)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS entity_key FROM e),
      f AS (SELECT site, entity_key, min(idx) AS request_idx FROM k GROUP BY ALL),
      r AS (SELECT f.site, f.entity_key, f.request_idx, lower(trim(coalesce(nullif(entity, ''), nullif(title, ''), url))) AS query FROM f JOIN k ON k.idx = f.request_idx),
      {_phrase_ctes('documents')},
      firsts AS (SELECT query, term, min((doc_id, pos)) AS place FROM ep JOIN (SELECT DISTINCT query, request_idx FROM r) q ON q.request_idx = doc_id WHERE kind = 'phrase' GROUP BY ALL),
      nums AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) AS n FROM firsts),
      themes AS (SELECT query, string_agg(term, '|' ORDER BY n) AS t FROM nums WHERE n <= 24 GROUP BY query)
      SELECT k.site, k.idx, r.query, true AS serp_analyzed, coalesce(t, '') AS keyword_themes
      FROM k JOIN r USING (site, entity_key) LEFT JOIN themes USING (query)""",
    "page_audits": f"""
      WITH {sql.PAGES}, {sql.LINKS}, {_AUDIT},
      c AS (SELECT *, {_CORE.format(x="coalesce(nullif(product_entity, ''), heading_texts[1], 'product')")} AS core FROM full_pages),
      vr AS (SELECT *, CASE WHEN core = '' THEN 'custom product' ELSE core END AS base FROM c),
      s AS (SELECT *, [base || ' printing', base || ' custom sizes', base || ' design upload', base || ' online order', base || ' near me'] AS src FROM vr)
      SELECT site, idx, url, page_type, page_type = 'pdp' AS product_page, title, product_entity, len(body_words) AS word_count,
        len(body_words) < 300 AS thin_content, len(regexp_extract_all(vis, '(?i)<p[\\s>]')) AS paragraph_count,
        len(regexp_extract_all(vis, '(?i)<h1[\\s>]')) > 1 AS multiple_h1, n AS internal_link_count, known AS known_link_hits,
        n < 2 OR known = 0 AS orphan_page_risk, coalesce(contextual_links, '') AS contextual_links, core AS core_keyword,
        concat_ws('|',
          {', '.join(f"coalesce(list_filter(src, lambda x: regexp_matches(x, '({pat})'))[1], trim(core || ' {topic}') || ' printing')" for topic, pat in (
              ("installation", "install|mount|fence|setup|hardware|hang"),
              ("durability", "durable|weather|wind|outdoor|uv|waterproof|perforated"),
              ("pricing", "price|cost|cheap|quote|bulk"),
              ("customization", "custom|design|artwork|upload|template|print"),
              ("shipping", "shipping|delivery|turnaround|production|rush")))}) AS first_keywords
      FROM s JOIN hits USING (idx) LEFT JOIN merged USING (idx)""",
    "audit_summary": f"""
      WITH {sql.PAGES}, {sql.LINKS}, {_AUDIT},
      ct AS (SELECT * REPLACE (p.page_type AS page_type) FROM typed JOIN (SELECT idx, page_type FROM full_pages) p USING (idx)),
      pr AS (SELECT s.site, s.idx AS si, t.anchor,
                max(CASE WHEN s.page_type = 'pdp' AND t.page_type = 'category' THEN 3 WHEN s.page_type = 'pdp' AND t.page_type = 'pdp' AND s.section = t.section THEN 2
                  WHEN s.page_type = 'category' AND t.page_type = 'pdp' THEN 2 ELSE 0 END + CASE WHEN s.section = t.section THEN 1 ELSE 0 END) AS sc
             FROM ct s JOIN ct t ON s.site = t.site AND s.idx <> t.idx GROUP BY ALL),
      lk AS (SELECT site, sum(k) AS k FROM (SELECT site, si, least(5, count(*) FILTER (sc > 0)) AS k FROM pr GROUP BY ALL) GROUP BY 1)
      SELECT f.site, count(*) AS total_pages, count(*) FILTER (len(body_words) < 300) AS thin_pages,
        count(*) FILTER (n < 2 OR known = 0) AS weak_internal_link_pages, count(*) AS missing_meta_pages, 0::BIGINT AS serp_analyzed_pages,
        count(*) AS keyword_clustered_pages, coalesce(any_value(lk.k), 0)::BIGINT AS internal_link_recommendations
      FROM full_pages f JOIN hits USING (idx) LEFT JOIN lk ON lk.site = f.site GROUP BY 1""",
    "sitemap_walk": """
      WITH l AS (SELECT 'o' || o_orderkey || '.example.com' AS site, * FROM orders)
      SELECT site, 'https://' || site || '/p/' || o_custkey AS url FROM l WHERE o_orderpriority NOT LIKE '1%' AND o_orderstatus <> 'F'
      UNION SELECT site, 'https://' || site || '/s/' || o_orderkey FROM l""",
    "stored_artifacts": """
      SELECT '1.0' AS "schemaVersion", 'scrape' AS producer, doc_id, text FROM documents""",
    "streamed_pages": f"""
      WITH {sql.PAGES}
      SELECT site, idx, {_CONTENT_TYPE} AS page_type, len(body_words) AS word_count, len(body_words) < 300 AS thin_content FROM feats""",
    "streamed_changes": """
      SELECT 'u' || user_id AS url, event_id AS seq FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
      WHERE before IS NULL OR before <> event_type""",
    "streamed_progress": """
      SELECT ts::DATE::VARCHAR AS run_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS completed,
             count(*) FILTER (event_type = 'error') AS failed, 'finished' AS outcome FROM events GROUP BY 1""",
    "dead_letters": """
      SELECT event_id, CASE event_type WHEN 'error' THEN 'scrape_page' ELSE 'good' END AS kind,
             CASE event_type WHEN 'error' THEN props ELSE '' END AS error FROM events""",
}
