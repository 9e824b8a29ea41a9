"""Registered queries over runs: snapshots, resume, costs, reports, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog import sql
from sitegrain.catalog.common import joined, table
from sitegrain.operators import quality, reports, runs, strategy
from sitegrain.operators.quality import Field
from sitegrain.session import work_folder
from sitegrain.sources import artifacts as A
from sitegrain.sources.bucketed import write_bucketed
from sitegrain.sources.keyed_tables import KeyedTable
from sitegrain.vocab import MISSING_CATEGORY_PAGES, PILLAR_PAGES


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def latest_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    snaps = _events(spark, sf).select(F.col("user_id").alias("page_id"), F.col("event_id").alias("id"), "event_type")
    return runs.latest_by(snaps, ["page_id"], "id")


def overlaid_states(spark: SparkSession, sf: str) -> DataFrame:
    """Latest present value of each state column per user."""
    kind = F.col("event_type")
    states = _events(spark, sf).select(
        "user_id", "event_id",
        F.when(kind == "error", F.col("props")).alias("error"),
        F.when(kind != "error", kind).alias("status"),
    )
    return runs.overlay_states(states, ["user_id"], "event_id", ["error", "status"])


def unchanged_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Latest value per user equals the current one (the user's smallest value)."""
    e = _events(spark, sf)
    snaps = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("page_id"),
        F.sha2(F.floor("value").cast("string"), 256).alias("content_hash"),
    )
    current = e.groupBy(F.col("user_id").alias("page_id")).agg(
        F.sha2(F.floor(F.min("value") + 3).cast("string"), 256).alias("content_hash")
    )
    kept = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("page_id"))
    return runs.unchanged_pages(current, snaps, kept).select("page_id")


def _crawls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two crawls of the documents: texts by language and source."""
    docs = table(spark, sf, "documents")
    previous = docs.filter("lang <> 'es'").select(
        F.col("doc_id").alias("url"), F.sha2("text", 256).alias("content_hash")
    )
    current = docs.filter("lang <> 'de'").select(
        F.col("doc_id").alias("url"),
        F.sha2(F.when(F.col("source") == "src1", F.upper("text")).otherwise(F.col("text")), 256).alias("content_hash"),
        F.when(F.col("source") == "src2", "failed").otherwise("completed").alias("status"),
    )
    return previous, current


def crawl_diff(spark: SparkSession, sf: str) -> DataFrame:
    return runs.snapshot_diff(*_crawls(spark, sf))


def resumed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Users without both kinds of artifact."""
    e = _events(spark, sf)
    kinds = F.when(F.col("event_type") == "purchase", "optimized").when(F.col("event_type") == "error", "schema")
    artifacts = e.filter("value > 55").select(F.col("user_id").alias("url"), kinds.alias("type"))
    pages = e.select(F.col("user_id").alias("url")).distinct()
    return runs.pages_to_process(pages, artifacts)


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    model = F.when(F.col("event_type") == "click", "claude-3-5-haiku-latest").when(
        F.col("event_type") == "view", "claude-sonnet-4-20250514"
    ).otherwise(F.col("event_type"))
    tokens_in = F.get_json_object("props", "$.k").cast("long") * 1000
    rows = e.select(
        "event_id", "event_type", model.alias("model"), tokens_in.alias("tokens_in"),
        F.floor(F.col("value") * 100).cast("long").alias("tokens_out"),
    )
    return rows.withColumn("cost_usd", runs.model_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))


def model_costs(spark: SparkSession, sf: str) -> DataFrame:
    return _usage(spark, sf).select("event_id", "cost_usd")


def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    return runs.cost_report(_usage(spark, sf), ["event_type"])


def _status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf).select(
        F.to_date("ts").cast("string").alias("run_id"),
        F.col("event_id").cast("string").alias("url"),
        F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("completed").alias("status"),
        (kind == "purchase").alias("product_page"),
        F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("error"),
    )


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_report(_status(spark, sf))


def run_errors(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_errors(_status(spark, sf))


def site_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _events(spark, sf).select(
        F.col("user_id").alias("site"), kind.isin("purchase", "click").alias("product"),
        F.when(kind == "error", F.col("props")).alias("classify_error"),
        F.when(F.col("value") > 5, "ok").otherwise("error").alias("status"),
    )
    return runs.site_audit_summary(rows)


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = _events(spark, sf).select(
        "user_id", F.when(kind == "error", "error").when(kind == "view", "skipped").otherwise("ok").alias("status")
    )
    return runs.batch_summary(rows, ["user_id"])


def run_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, orders and line items as runs, snapshots and artifacts."""
    all_runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    snaps = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("status"),
    )
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), F.col("l_returnflag").alias("type"),
        F.col("l_linenumber").cast("long").alias("path"),
    )
    found = runs.run_artifacts(all_runs, snaps, items)
    return found.groupBy("run_id", "type").agg(F.count("*").alias("artifacts"), F.sum("path").alias("paths"))


def dimension_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Known customers keep their ids; customers of new orders get the next ones."""
    known = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    wanted = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("seq")
    )
    return runs.get_or_create(known, wanted, ["name", "segment"], [F.col("seq")])


def _run_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as runs at their start, and what their line items say at the end."""
    orders = table(spark, sf, "orders")
    blank = F.lit(None).cast("string")
    started = runs.create_runs(
        orders.select(
            F.col("o_orderkey").alias("id"), blank.alias("finished_at"), F.lit("").alias("status"),
            F.lower("o_orderpriority").alias("mode"), blank.alias("prompt_version"),
            blank.alias("template_version"), F.col("o_orderstatus").alias("model"),
        )
    )
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("errors"),
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("finished_at"),
    )
    updates = per_order.select(
        "id", "finished_at", runs.final_run_status(F.col("errors")).alias("status"),
        F.when(F.col("errors") > 1, "full").alias("mode"), F.lit("v2").alias("prompt_version"),
        F.lit("").alias("template_version"), blank.alias("model"),
    )
    return started, updates


def finished_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.finish_runs(*_run_rows(spark, sf))


def stored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs kept in a stored table: all are started, then finished in two batches."""
    started, updates = _run_rows(spark, sf)
    stored = KeyedTable(spark, work_folder(spark, "runs"), started.schema, ["id"], buckets=8)
    stored.upsert(started)
    for status in ("completed", "completed_with_errors"):
        runs.update_stored_runs(stored, updates.filter(F.col("status") == status))
    return stored.read()


def bucketed_crawl_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The two crawls of ``crawl_diff`` stored by page and joined without a shuffle."""
    previous, current = _crawls(spark, sf)
    stored = lambda df, name: write_bucketed(df, work_folder(spark, name), ["url"], 8)
    return runs.snapshot_diff(stored(previous, "crawl"), stored(current, "crawl"))


def skip_ladder(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    has = F.col("event_type") != "error"
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id",
        runs.skip_reason(has, True, k, F.floor("value"), F.lit(12)).alias("changed_only"),
        runs.skip_reason(has, False, k, F.floor("value"), F.lit(12)).alias("full"),
        runs.final_snapshot_status(k).alias("snapshot_status"),
    )


def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("site", F.pmod("user_id", F.lit(13)))
    kind = F.col("event_type")
    audits = e.select(
        "site", (F.col("value") < 10).alias("thin_content"), (kind == "click").alias("orphan_page_risk"),
        F.when(kind == "view", "").otherwise(kind).alias("meta_description"),
        (F.col("value") > 2).alias("serp_analyzed"), kind.isNotNull().alias("keyword_clustered"),
    )
    return strategy.summary(audits, e.filter(kind == "purchase").select("site"))


def snapshot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of every other event's snapshot, some of them zero or blank."""
    e = _events(spark, sf)
    snaps = e.select(
        F.col("event_id").alias("id"), F.lit(1).cast("long").alias("tokens_in"), F.lit(2).cast("long").alias("tokens_out"),
        F.lit(0.5).alias("cost_usd"), F.lit("pending").alias("status"), F.lit("old").alias("error"),
    )
    metrics = e.filter("event_id % 2 = 0").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("tokens_in"), F.col("user_id").cast("long").alias("tokens_out"), F.col("value").alias("cost_usd"),
        F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_type") == "error", "bad").otherwise("").alias("error"),
    )
    return runs.updated_snapshots(snaps, metrics)


def site_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Strategy of every source: a page per document, a planned link per order line, a blog pattern per event."""
    docs = table(spark, sf, "documents")
    words = F.split("text", " ")
    audits = docs.select(
        F.col("source").alias("site"), F.col("doc_id").alias("idx"), F.concat(F.lit("/d/"), "doc_id").alias("url"),
        (F.col("n_chars") < 600).alias("thin_content"), (F.col("doc_id") % 7 == 3).alias("orphan_page_risk"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("meta_description"), (F.col("doc_id") % 2 == 0).alias("serp_analyzed"),
        F.lit(True).alias("keyword_clustered"), F.array(F.struct(F.col("lang").alias("topic"), words.alias("keywords"))).alias("clusters"),
        F.element_at(F.split("text", "\n"), 1).alias("seo_recommendations"),
    )
    plan = table(spark, sf, "lineitem").select(
        F.concat(F.lit("src"), F.col("l_suppkey") % 25).alias("site"), F.col("l_orderkey").alias("source_idx"), (F.col("l_linenumber") * F.lit(1 << 32) + F.col("l_partkey")).alias("rank"),
        F.concat(F.lit("/o/"), "l_orderkey").alias("source_page"), F.col("l_linestatus").alias("anchor"), F.concat(F.lit("/p/"), "l_partkey").alias("target_page"),
    )
    patterns = _events(spark, sf).select(
        F.concat(F.lit("src"), F.col("user_id") % 25).alias("site"), F.col("user_id").alias("idx"), F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "view", "how-to").when(F.col("event_type") == "click", "pricing").alias("pattern"), F.concat(F.lit("item "), "user_id").alias("core_keyword"),
    )
    report = strategy.site_strategy(audits, plan, patterns)
    return report.select(*(joined(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in report.dtypes))


def thin_pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("site"), F.col("doc_id").alias("idx"), F.concat(F.lit("/d/"), "doc_id").alias("url"),
        (F.col("n_chars") < 1000).alias("thin"),
    )
    return strategy.short_list(docs, "thin").withColumn("rank", F.col("rank").cast("long"))


def link_lines(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("site"), F.col("l_orderkey").alias("source_idx"),
        (F.col("l_linenumber") * F.lit(1 << 32) + F.col("l_partkey")).alias("rank"), F.concat(F.lit("/o/"), "l_orderkey").alias("source_page"),
        F.col("l_linestatus").alias("anchor"), F.concat(F.lit("/p/"), "l_partkey").alias("target_page"),
    )
    return strategy.link_lines(plan).withColumn("line_no", F.col("line_no").cast("long"))


def keyword_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster keywords of each document against the text of the audit with its URL."""
    docs = table(spark, sf, "documents")
    url = F.concat_ws("/", "source", "lang")
    clusters = docs.select(
        F.col("source").alias("site"), F.col("doc_id").alias("idx"), url.alias("url"), F.lit(0).alias("topic_pos"), F.col("lang").alias("topic"),
        F.split("text", " ").alias("keywords"),
    )
    audits = docs.select(F.col("source").alias("site"), F.col("doc_id").alias("idx"), url.alias("url"), F.col("text").alias("seo_recommendations"))
    gaps = strategy.keyword_gaps(clusters, audits)
    return gaps.withColumn("missing_keywords", joined(F.col("missing_keywords")))


def blog_topics(spark: SparkSession, sf: str) -> DataFrame:
    names = {"view": "how-to", "click": "shipping", "purchase": "pricing", "signup": "sizing"}
    pattern = F.col("event_type")
    for old, new in names.items():
        pattern = F.when(F.col("event_type") == old, new).otherwise(pattern)
    patterns = _events(spark, sf).select(
        (F.col("user_id") % 5).alias("site"), F.col("user_id").alias("idx"), F.col("event_id").alias("pos"), pattern.alias("pattern"),
        F.when(F.col("value") > 3, F.concat(F.lit("item "), "user_id")).alias("core_keyword"),
    )
    return strategy.blog_topics(patterns)


def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderpriority")).alias("topic"),
        F.lower("o_orderstatus").alias("pageType"),
        F.when(F.col("o_totalprice") > 200000, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("sections"),
        F.when(F.col("o_custkey") < 500, F.lit("x")).alias("extra"),
    )
    fields = (
        Field("topic", min_length=1),
        Field("pageType", "enum", values=("o", "f")),
        Field("sections", "array", min_items=1),
    )
    checked = quality.check_contract(orders, "Input", fields, keys=("o_orderkey",))
    return checked.select("o_orderkey", joined(F.col("violations")).alias("violations"))


def blueprint_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item is a blueprint of two sections."""
    section = lambda c, v: F.struct(F.col(c).alias("component"), F.col(v).alias("variant"))
    blueprints = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item"),
        F.array(section("l_returnflag", "l_linestatus"), section("l_linestatus", "l_returnflag")).alias("sections"),
    )
    registry = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        F.explode(F.array(F.lit("N"), F.lit("A"))).alias("component"), F.col("o_orderstatus").alias("variant")
    )
    return quality.check_blueprints(blueprints, registry, ["item"])


def page_audit_reports(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    audits = docs.select(
        "doc_id", F.concat(F.lit("https://x/"), "doc_id").alias("url"), F.col("lang").alias("page_type"),
        (F.col("lang") == "en").alias("product_page"), F.col("n_chars").alias("word_count"),
        (F.col("n_chars") < 1000).alias("thin_content"), F.lit(3).alias("internal_link_count"),
        (F.col("lang") == "de").alias("orphan_page_risk"), F.lit("").alias("prompt_version"),
        F.when(F.col("lang") == "en", 90).alias("content_score"), F.when(F.col("lang") == "en", 70).alias("eval_score"),
        F.when(F.col("lang") == "fr", F.array("source", "lang")).alias("keyword_themes"),
        F.array(F.struct(F.lit("pricing").alias("topic"), F.array("lang", "source").alias("keywords"))).alias("clusters"),
        F.array(F.struct(F.col("source").alias("anchor"), F.lit("/u").alias("url"))).alias("contextual_links"),
        F.when(F.col("lang") != "es", F.col("text")).alias("seo_recommendations"),
    )
    full = reports.page_audit_markdown(audits).withColumnRenamed("markdown", "full_report")
    return reports.staged_audit_markdown(full).select("doc_id", "full_report", F.col("markdown").alias("short_report"))


def site_overviews(spark: SparkSession, sf: str) -> DataFrame:
    """Overview text per source, from its documents."""
    docs = table(spark, sf, "documents").withColumn("site", F.col("source"))
    n = lambda c: F.count_if(c)
    report = docs.groupBy("site").agg(
        F.count("*").alias("total_urls_discovered"), n(F.col("lang") != "es").alias("pages_audited"),
        n(F.col("lang") == "es").alias("pages_skipped"), n(F.col("lang") == "en").alias("product_pages_detected"),
        n(F.col("lang") == "fr").alias("product_pages_optimized"), n(F.col("n_chars") > 9000).alias("errors"),
        n(F.col("n_chars") < 900).alias("thin_pages"), n(F.col("n_chars") < 500).alias("weak_internal_link_pages"),
        F.count("*").alias("missing_meta_pages"), F.count("*").alias("serp_analyzed_pages"),
        F.count("*").alias("keyword_clustered_pages"), n(F.col("lang") == "de").alias("internal_link_recommendations"),
    ).withColumns({
        "base_url": F.concat(F.lit("https://"), "site"), "generated_at": F.lit("2024-01-01"),
        "estimated_cost_usd": F.lit(None).cast("double"),
    })
    types = docs.groupBy("site", F.col("lang").alias("page_type")).agg(
        F.count("*").alias("pages"), F.min("doc_id").alias("first_idx")
    )
    gaps = docs.filter("lang = 'fr'").select(
        "site", F.col("doc_id").alias("idx"), F.lit(0).alias("topic_pos"), F.concat(F.lit("/"), "doc_id").alias("url"),
        F.lit("pricing").alias("topic"), F.array("lang", "source").alias("missing_keywords"),
    )
    topics = docs.filter("lang = 'es'").select(
        "site", F.col("doc_id").alias("idx"), F.lit(0).alias("pos"), F.concat(F.lit("topic "), "doc_id").alias("topic")
    )
    return reports.site_overview_markdown(report, types, gaps, topics)


def output_index(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(
        F.concat(F.lit("page-"), "user_id").alias("slug"), F.col("ts").alias("generated_at"), "event_id", "event_type"
    )
    old, new = e.filter("event_type = 'view'"), e.filter("event_type <> 'view'")
    return reports.output_index(old, new).select("slug", "event_id", "is_latest")


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Metric lines written as JSON text and parsed back."""
    logged = _events(spark, sf).select(
        "ts", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.col("event_type").alias("event"), F.lit("agent").alias("agent"), F.col("user_id"), "event_id",
    )
    parsed = A.parse_log(A.log_lines(logged, "ts", "level", "event"))
    return parsed.select(
        F.col("extra")["event_id"].cast("long").alias("event_id"), F.unix_millis("ts").alias("ms"), "level", "event",
        F.size("extra").cast("long").alias("extra_keys"), F.col("extra")["user_id"].cast("long").alias("user_id"),
    )


def enveloped_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    payload = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"), F.struct("source", "n_chars").alias("data"))
    full = A.with_envelope(payload, F.lit("2024-01-01T00:00:00.000Z"), producer="scrape", run_id="r1", model="none")
    return full.select("schemaVersion", "producer", "runId", "promptVersion", "model", "createdAt", "doc_id", F.col("data.source").alias("source"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents with equal content."""
    docs = table(spark, sf, "documents").select("doc_id", runs.content_hash("lang", "text").alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).drop("h")


QUERIES = {
    f.__name__: f
    for f in (
        latest_snapshots, overlaid_states, unchanged_pages, crawl_diff, bucketed_crawl_diff, stored_runs, resumed_pages, model_costs, cost_report,
        run_report, run_errors, site_audit_summary, batch_summary, run_artifacts, dimension_rows, finished_runs,
        skip_ladder, strategy_summary, site_strategy, snapshot_metrics, thin_pages, link_lines, keyword_gaps, blog_topics, contract_violations,
        blueprint_violations, page_audit_reports, site_overviews, output_index, log_records, enveloped_artifacts,
        content_hashes,
    )
}

_NL = "chr(10)"
_USAGE = """
u AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'h' WHEN 'view' THEN 's' ELSE 'd' END AS m,
             (props->>'$.k')::BIGINT * 1000 AS tin, floor(value * 100)::BIGINT AS tout FROM events),
c AS (SELECT *, round(tin / 1e6::DOUBLE * CASE m WHEN 'h' THEN 0.8::DOUBLE WHEN 's' THEN 3 ELSE 1 END
                    + tout / 1e6::DOUBLE * CASE m WHEN 'h' THEN 4 WHEN 's' THEN 15 ELSE 5 END, 6) AS cost FROM u)"""
_STATUS = """
st AS (SELECT ts::DATE::VARCHAR AS run_id, event_id::VARCHAR AS url,
              CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'completed' END AS status,
              event_type = 'purchase' AS pp, CASE WHEN value > 20 THEN props ELSE '' END AS error FROM events)"""

ORACLES = {
    "latest_snapshots": """
      SELECT user_id AS page_id, max(event_id) AS id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1""",
    "overlaid_states": """
      SELECT user_id, max_by(props, event_id) FILTER (event_type = 'error') AS error,
             max_by(event_type, event_id) FILTER (event_type <> 'error') AS status, max(event_id) AS event_id
      FROM events GROUP BY 1""",
    "unchanged_pages": """
      WITH l AS (SELECT user_id, max_by(floor(value), event_id) AS v, floor(min(value) + 3) AS c,
                        bool_or(event_type = 'purchase') AS art FROM events GROUP BY 1)
      SELECT user_id AS page_id FROM l WHERE v = c AND art""",
    "crawl_diff": """
      SELECT doc_id AS url, CASE WHEN lang = 'de' THEN 'removed' WHEN source = 'src2' THEN 'failed' WHEN lang = 'es' THEN 'new'
             WHEN source = 'src1' AND upper(text) <> text THEN 'changed' ELSE 'unchanged' END AS change FROM documents""",
    "resumed_pages": """
      SELECT user_id AS url FROM events GROUP BY 1
      HAVING NOT (bool_or(value > 55 AND event_type = 'purchase') AND bool_or(value > 55 AND event_type = 'error'))""",
    "model_costs": f"WITH {_USAGE} SELECT event_id, cost AS cost_usd FROM c",
    "cost_report": f"""
      WITH {_USAGE} SELECT event_type, count(*) AS calls, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out,
                           round(sum(cost), 6) AS estimated_cost_usd FROM c GROUP BY 1""",
    "run_report": f"""
      WITH {_STATUS} SELECT run_id, count(*) AS total_urls_discovered, count(*) FILTER (status = 'completed') AS pages_audited,
        count(*) FILTER (status = 'skipped') AS pages_skipped, count(*) FILTER (pp) AS product_pages_detected,
        count(*) FILTER (pp AND status = 'completed') AS product_pages_optimized, count(*) FILTER (status = 'failed') AS errors
      FROM st GROUP BY 1""",
    "run_errors": f"""
      WITH {_STATUS} SELECT run_id, url, coalesce(nullif(error, ''), 'failed') AS error FROM st WHERE status = 'failed'""",
    "site_audit_summary": """
      SELECT user_id AS site, count(*) AS total_urls_discovered, count(*) FILTER (event_type IN ('purchase', 'click')) AS product_pages_detected,
        count(*) FILTER (event_type IN ('purchase', 'click') AND value > 5) AS pages_audited,
        count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS pages_skipped,
        count(*) FILTER (event_type = 'error' OR (event_type IN ('purchase', 'click') AND value <= 5)) AS errors
      FROM events GROUP BY 1""",
    "batch_summary": """
      SELECT user_id, count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'view')) AS ok,
        count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""",
    "run_artifacts": """
      SELECT c_custkey AS run_id, l_returnflag AS type, count(*) AS artifacts, sum(l_linenumber)::BIGINT AS paths
      FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "dimension_rows": """
      SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'
      UNION ALL
      SELECT (SELECT max(c_custkey) FROM customer WHERE c_mktsegment <> 'BUILDING') + row_number() OVER (ORDER BY c_custkey), c_name, c_mktsegment
      FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "finished_runs": """
      WITH l AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS e, strftime(max(l_shipdate), '%Y-%m-%d') AS f FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS id, f AS finished_at,
        CASE WHEN l.id IS NULL THEN 'running' WHEN e > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status,
        CASE WHEN e > 1 THEN 'full' ELSE lower(o_orderpriority) END AS mode,
        CASE WHEN l.id IS NULL THEN 'unknown' ELSE 'v2' END AS prompt_version, 'unknown' AS template_version, o_orderstatus AS model
      FROM orders LEFT JOIN l ON l.id = o_orderkey""",
    "skip_ladder": """
      WITH k AS (SELECT event_id, event_type <> 'error' AS has, (props->>'$.k')::BIGINT AS k, floor(value) AS v FROM events)
      SELECT event_id, CASE WHEN has AND k = 12 THEN 'unchanged_db_hash' WHEN has AND v = 12 THEN 'unchanged_content_hash' END AS changed_only,
             CASE WHEN has THEN 'optimized_exists' END AS "full", CASE WHEN k < 85 THEN 'low_score' ELSE 'completed' END AS snapshot_status FROM k""",
    "strategy_summary": """
      SELECT user_id % 13 AS site, count(*) AS total_pages, count(*) FILTER (value < 10) AS thin_pages,
        count(*) FILTER (event_type = 'click') AS weak_internal_link_pages, count(*) FILTER (event_type = 'view') AS missing_meta_pages,
        count(*) FILTER (value > 2) AS serp_analyzed_pages, count(event_type) AS keyword_clustered_pages,
        count(*) FILTER (event_type = 'purchase') AS internal_link_recommendations FROM events GROUP BY 1""",
    "thin_pages": """
      SELECT source AS site, doc_id AS idx, '/d/' || doc_id AS url, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank
      FROM documents WHERE n_chars < 1000 QUALIFY rank <= 10""",
    "link_lines": """
      SELECT l_returnflag AS site, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS line_no,
             '/o/' || l_orderkey || ' -> (' || l_linestatus || ') -> /p/' || l_partkey AS line FROM lineitem QUALIFY line_no <= 30""",
    "snapshot_metrics": """
      SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN nullif(event_id % 3, 0) ELSE 1 END AS tokens_in,
        CASE WHEN event_id % 2 = 0 THEN nullif(user_id, 0) ELSE 2 END AS tokens_out, CASE WHEN event_id % 2 = 0 THEN nullif(value, 0) ELSE 0.5 END AS cost_usd,
        CASE WHEN event_id % 2 = 1 THEN 'pending' WHEN event_type = 'click' THEN 'completed' ELSE event_type END AS status,
        CASE WHEN event_id % 2 = 1 THEN 'old' WHEN event_type = 'error' THEN 'bad' END AS error FROM events""",
    "site_strategy": f"""
      WITH d AS (SELECT source AS site, doc_id AS idx, '/d/' || doc_id AS url, n_chars < 600 AS thin, doc_id % 7 = 3 AS weak, lang,
                        string_split(text, ' ') AS kw, lower(string_split(text, chr(10))[1]) AS t FROM documents),
      l AS (SELECT 'src' || (l_suppkey % 25) AS site, l_orderkey, l_linenumber, l_partkey, '/o/' || l_orderkey || ' -> (' || l_linestatus || ') -> /p/' || l_partkey AS line FROM lineitem),
      g AS (SELECT site, idx, url || ': ' || lang || ' - ' || array_to_string(list_filter(kw, lambda k: NOT contains(t, lower(k)))[1:5], ', ') AS gap,
                   len(list_filter(kw, lambda k: NOT contains(t, lower(k)))) AS m FROM d),
      e AS (SELECT 'src' || (user_id % 25) AS site, user_id AS idx, event_id AS pos, CASE event_type WHEN 'view' THEN 'How to choose the right item ' || user_id || ' for your use case'
                   WHEN 'click' THEN 'item ' || user_id || ' pricing guide: size, material, and finishing factors' END AS topic FROM events),
      u AS (SELECT * FROM e WHERE topic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, topic ORDER BY idx, pos) = 1),
      lists AS (
        SELECT site, 'thin' AS k, string_agg(url, '|' ORDER BY idx) AS s FROM (SELECT * FROM d WHERE thin QUALIFY row_number() OVER (PARTITION BY site ORDER BY idx) <= 10) GROUP BY site
        UNION ALL SELECT site, 'weak', string_agg(url, '|' ORDER BY idx) FROM (SELECT * FROM d WHERE weak QUALIFY row_number() OVER (PARTITION BY site ORDER BY idx) <= 10) GROUP BY site
        UNION ALL SELECT site, 'gap', string_agg(gap, '|' ORDER BY idx) FROM (SELECT * FROM g WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY idx) <= 20) GROUP BY site
        UNION ALL SELECT site, 'line', string_agg(line, '|' ORDER BY l_orderkey, l_linenumber, l_partkey) FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY site ORDER BY l_orderkey, l_linenumber, l_partkey) <= 30) GROUP BY site
        UNION ALL SELECT site, 'blog', string_agg(topic, '|' ORDER BY idx, pos) FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site ORDER BY idx, pos) <= 12) GROUP BY site),
      c AS (SELECT source AS site, count(*) AS total_pages, count(*) FILTER (n_chars < 600) AS thin_pages, count(*) FILTER (doc_id % 7 = 3) AS weak_internal_link_pages,
                   count(*) FILTER (lang = 'en') AS missing_meta_pages, count(*) FILTER (doc_id % 2 = 0) AS serp_analyzed_pages, count(*) AS keyword_clustered_pages FROM documents GROUP BY 1)
      SELECT c.*, coalesce((SELECT count(*) FROM l WHERE l.site = c.site), 0) AS internal_link_recommendations,
        {", ".join(f"coalesce((SELECT s FROM lists WHERE lists.site = c.site AND k = '{k}'), '') AS {n}" for k, n in (("thin", "thin_page_list"), ("weak", "weak_page_list"), ("gap", "keyword_gap_list"), ("line", "link_line_list"), ("blog", "blog_topic_list")))},
        {sql.q("|".join(PILLAR_PAGES))} AS pillar_pages, {sql.q("|".join(MISSING_CATEGORY_PAGES))} AS missing_category_pages
      FROM c""",
    "keyword_gaps": """
      WITH d AS (SELECT doc_id, source AS site, source || '/' || lang AS url, lang, text, string_split(text, ' ') AS kw FROM documents),
      f AS (SELECT url, min_by(text, doc_id) AS t FROM d GROUP BY 1),
      g AS (SELECT doc_id, site, d.url, lang, list_filter(kw, lambda k: NOT contains(lower(t), lower(k))) AS m FROM d JOIN f ON f.url = d.url)
      SELECT site, doc_id AS idx, url, lang AS topic, array_to_string(m[1:5], '|') AS missing_keywords FROM g WHERE len(m) > 0""",
    "blog_topics": """
      WITH t AS (SELECT user_id % 5 AS site, user_id AS idx, event_id AS pos, CASE WHEN value > 3 THEN 'item ' || user_id ELSE 'product' END AS e, event_type FROM events),
      x AS (SELECT site, idx, pos, CASE event_type WHEN 'view' THEN 'How to choose the right ' || e || ' for your use case'
              WHEN 'click' THEN e || ' shipping and turnaround timelines explained'
              WHEN 'purchase' THEN e || ' pricing guide: size, material, and finishing factors'
              WHEN 'signup' THEN e || ' sizing guide for first-time buyers' END AS topic FROM t)
      SELECT site, idx, pos, topic FROM x WHERE topic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, topic ORDER BY idx, pos) = 1""",
    "contract_violations": """
      SELECT o_orderkey, array_to_string(list_filter([
        CASE WHEN o_orderstatus = 'P' THEN 'Input.topic is required.' END,
        CASE WHEN o_orderstatus = 'F' THEN 'Input.topic must be at least 1 characters.' END,
        CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'Input.pageType must be one of: o, f.' END,
        CASE WHEN o_totalprice <= 200000 THEN 'Input.sections must contain at least 1 item(s).' END,
        CASE WHEN o_custkey < 500 THEN 'Input.extra is not allowed.' END], lambda x: x IS NOT NULL), '|') AS violations
      FROM orders""",
    "blueprint_violations": """
      WITH n AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item, 0 AS pos,
                        l_returnflag AS component, l_linestatus AS variant FROM lineitem
                 UNION ALL SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), 1, l_linestatus, l_returnflag FROM lineitem)
      SELECT *, CASE WHEN component NOT IN ('N', 'A') THEN 'Blueprint references unknown component "' || component || '".'
                     ELSE 'Component "' || component || '" does not define variant "' || variant || '".' END AS message
      FROM n WHERE component NOT IN ('N', 'A') OR variant <> 'O'""",
    "page_audit_reports": f"""
      SELECT doc_id,
        '# Page Audit' || {_NL} || {_NL} || '- URL: https://x/' || doc_id || {_NL} || '- Page Type: ' || lang || {_NL} || '- Product Page: ' || (lang = 'en')
        || {_NL} || '- Word Count: ' || n_chars || {_NL} || '- Thin Content: ' || CASE WHEN n_chars < 1000 THEN 'yes' ELSE 'no' END || {_NL} || '- Internal Links: 3'
        || {_NL} || '- Orphan Risk: ' || CASE WHEN lang = 'de' THEN 'yes' ELSE 'no' END || {_NL} || '- Prompt Version: unknown'
        || {_NL} || '- Content Score: ' || CASE WHEN lang = 'en' THEN '90' ELSE 'n/a' END || {_NL} || {_NL} || '## SERP Themes' || {_NL}
        || CASE WHEN lang = 'fr' THEN '- ' || source || {_NL} || '- fr' || {_NL} ELSE '' END || {_NL} || '## Keyword Clusters' || {_NL} || '- pricing: ' || lang || ', ' || source
        || {_NL} || {_NL} || '## Suggested Internal Links' || {_NL} || '- ' || source || ': /u' || {_NL} || {_NL} || '## Recommendations' || {_NL}
        || CASE WHEN lang = 'es' OR text = '' THEN 'No specialized recommendations generated.' ELSE text END AS full_report,
        '# Page Audit' || {_NL} || {_NL} || '- URL: https://x/' || doc_id || {_NL} || '- Page Type: ' || lang || {_NL} || '- Product Page: ' || (lang = 'en')
        || {_NL} || '- Score: ' || CASE WHEN lang = 'en' THEN '70' ELSE 'n/a' END || {_NL} || {_NL} || '## Recommendations' || {_NL}
        || CASE WHEN lang = 'es' THEN '' ELSE text END || {_NL} AS short_report
      FROM documents""",
    "site_overviews": f"""
      WITH t AS (SELECT source, string_agg('"' || lang || '":' || n, ',' ORDER BY f) AS j FROM
                   (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2) GROUP BY 1),
      g AS (SELECT source, string_agg('- /' || doc_id || ' [pricing]: fr, ' || source, {_NL} ORDER BY doc_id) AS l FROM
              (SELECT * FROM documents WHERE lang = 'fr' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) GROUP BY 1),
      b AS (SELECT source, string_agg('- topic ' || doc_id, {_NL} ORDER BY doc_id) AS l FROM
              (SELECT * FROM documents WHERE lang = 'es' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10) GROUP BY 1)
      SELECT d.source AS site, '# SEO Optimization Overview' || {_NL} || {_NL} || '- Base URL: https://' || d.source || {_NL} || '- Generated At: 2024-01-01'
        || {_NL} || '- Total URLs Discovered: ' || count(*) || {_NL} || '- Pages Audited: ' || count(*) FILTER (lang <> 'es')
        || {_NL} || '- Pages Skipped: ' || count(*) FILTER (lang = 'es') || {_NL} || '- Product Pages Detected: ' || count(*) FILTER (lang = 'en')
        || {_NL} || '- Product Pages Optimized: ' || count(*) FILTER (lang = 'fr') || {_NL} || '- Errors: ' || count(*) FILTER (n_chars > 9000)
        || {_NL} || {_NL} || '## Site Strategy Summary' || {_NL} || '- Page Types: {{' || any_value(t.j) || '}}' || {_NL} || '- Thin Pages: ' || count(*) FILTER (n_chars < 900)
        || {_NL} || '- Weak Internal Link Pages: ' || count(*) FILTER (n_chars < 500) || {_NL} || '- Missing Meta Pages: ' || count(*)
        || {_NL} || '- SERP Analyzed Pages: ' || count(*) || {_NL} || '- Keyword Clustered Pages: ' || count(*)
        || {_NL} || '- Internal Link Recommendations: ' || count(*) FILTER (lang = 'de') || {_NL} || '- Estimated Claude Cost (USD): 0'
        || {_NL} || {_NL} || '## Keyword Gaps' || {_NL} || coalesce(any_value(g.l) || {_NL}, '') || {_NL} || '## Recommended Blog Topics' || {_NL}
        || coalesce(any_value(b.l) || {_NL}, '') AS markdown
      FROM documents d JOIN t ON t.source = d.source LEFT JOIN g ON g.source = d.source LEFT JOIN b ON b.source = d.source GROUP BY 1""",
    "output_index": """
      WITH l AS (SELECT 'page-' || user_id AS slug, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1)
      SELECT slug, event_id, ts = (SELECT max(ts) FROM events) AS is_latest FROM l ORDER BY ts DESC, slug LIMIT 50""",
    "log_records": """
      SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, event_type AS event,
             3 AS extra_keys, user_id FROM events""",
    "enveloped_artifacts": """
      SELECT '1.0' AS "schemaVersion", 'scrape' AS producer, 'r1' AS "runId", 'unknown' AS "promptVersion", lang AS model,
             '2024-01-01T00:00:00.000Z' AS "createdAt", doc_id, source FROM documents""",
    "content_hashes": """
      SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY lang, text""",
}

ORACLES |= {"bucketed_crawl_diff": ORACLES["crawl_diff"], "stored_runs": ORACLES["finished_runs"]}
