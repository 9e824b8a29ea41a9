from pyspark.sql import functions as F

from sitegrain.catalog.markup_checks import built_markup
from sitegrain.operators import phrases, runs
from sitegrain.operators import serp as search
from sitegrain.operators.linkplan import plan_links
from sitegrain.operators.quality import check_blueprints
from sitegrain.operators.ordered import first_occurrence, top_k
from sitegrain.operators.pages import read_pages
from sitegrain.plans.audit import AuditOptions, audit_sites
from sitegrain.sources.keyed_tables import KeyedTable
from sitegrain.plans.staged import find_gaps, optimize_pages, page_intel, run_status

ROWS = [
    (0, "https://s.com/", "<title>Home</title><body><h1>Welcome</h1><a href=/banner/mesh-banner>m</a><a href=/blog/tips>t</a></body>"),
    (1, "https://s.com/banner/mesh-banner", "<title>Mesh</title><body><h1>Mesh Banner</h1><p>wind vinyl banner words</p></body>"),
    (2, "https://s.com/banner/vinyl-banner", "<title>Vinyl</title><body><h1>Vinyl Banner</h1><p>add to cart</p></body>"),
    (3, "https://s.com/blog/tips", "<title>Tips</title><body><h1>Tips</h1><p>article</p></body>"),
]


def pages(spark):
    return read_pages(spark.createDataFrame(ROWS, "page_id BIGINT, url STRING, html STRING"))


def serp(spark):
    row = ("mesh banner mesh", 0, "https://r.com", [("h2", "Wind Rated")], "hurricane grade mesh banner", 4, [], [])
    return spark.createDataFrame(
        [row], "query STRING, row_pos BIGINT, url STRING, headings ARRAY<STRUCT<tag:STRING,text:STRING>>,"
        "paragraph_text STRING, word_count BIGINT, faq_questions ARRAY<STRING>, schema_types ARRAY<STRING>",
    )


def test_staged_run(spark):
    audit = audit_sites(pages(spark), serp_pages=serp(spark))
    rows = {r["idx"]: r for r in audit.page_audits.collect()}
    assert [rows[i]["page_type"] for i in range(4)] == ["homepage", "pdp", "pdp", "blog"]
    assert rows[0]["known_link_hits"] == 2 and not rows[0]["orphan_page_risk"]
    assert rows[1]["contextual_links"][0]["anchor"] == "vinyl banner"
    intel = page_intel(audit.features, serp(spark))
    assert intel.count() == 4
    texts = spark.createDataFrame([("s.com", 1, "<p>Mesh Banner Mesh.</p> Wind Rated", 1)], "site STRING, idx BIGINT, generated_content STRING, attempt INT")
    done = {r["idx"]: r for r in optimize_pages(audit.page_audits, texts, intel).collect()}
    assert done[1]["status"] == "completed" and done[2]["status"] == "failed"
    assert "See also [vinyl banner](https://s.com/banner/vinyl-banner)" in done[1]["optimized_content"]
    assert "SEO ANALYSIS" in done[1]["optimized_content"] and "SEO ANALYSIS" not in done[3]["optimized_content"]
    assert done[1]["needs_retry"] and done[1]["retry_reason"] == "missing_sections"
    assert done[1]["missing_entities"] == [] and done[3]["content_score"] is None
    report = runs.run_report(run_status(optimize_pages(audit.page_audits, texts, intel), "r1")).first()
    assert (report["total_urls_discovered"], report["errors"], report["product_pages_optimized"]) == (4, 1, 1)
    found = find_gaps(audit.features, intel)
    assert {r["idx"]: r["missing_keywords"] for r in found.pages.collect()}[1] == [
        "hurricane grade", "grade mesh", "hurricane grade mesh", "grade mesh banner",
    ]
    assert found.opportunities.orderBy("idx", "pos").first()["title"] == "Hurricane Grade Guide"


def test_budgets(spark):
    audit = audit_sites(pages(spark), AuditOptions(max_serp_calls=2), serp_pages=serp(spark))
    rows = {r["idx"]: r for r in audit.page_audits.collect()}
    assert [rows[i]["serp_analyzed"] for i in range(4)] == [True, True, False, False]
    texts = spark.createDataFrame(
        [("s.com", i, "<p>Mesh Banner Mesh.</p>", 1) for i in range(4)], "site STRING, idx BIGINT, generated_content STRING, attempt INT"
    )
    free = {r["idx"]: r["status"] for r in optimize_pages(audit.page_audits, texts).collect()}
    assert free[1] == free[2] == "completed"
    tight = {r["idx"]: r["status"] for r in optimize_pages(audit.page_audits, texts, max_model_calls=1).collect()}
    assert tight[1] == "completed" and tight[2] == "failed" and tight[3] == "completed"


def test_limits_and_filter(spark):
    audit = audit_sites(pages(spark), AuditOptions(max_pages=3, page_type_filter="pdp"))
    assert audit.features.count() == 3 and audit.page_audits.count() == 2


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    for query in (top_k(df, ["g"], [F.col("id")], 5), first_occurrence(df, ["g"], [F.col("id")])):
        text = plan_text(query)
        assert text.count("WindowGroupLimit") == 2, text  # partial below the exchange, final above
    nodes = spark.createDataFrame([("s", 1, "https://s/a", "pdp")], "site STRING, idx BIGINT, url STRING, page_type STRING")
    text = plan_text(plan_links(nodes))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("WindowGroupLimit") >= 10


def test_phrases_shuffle_texts_once(spark):
    docs = spark.createDataFrame([(1, "a")], "id BIGINT, t STRING")
    text = plan_text(phrases.entities_and_phrases(docs, "id", "t"))
    assert text.count("Exchange hashpartitioning") == 1, text


def test_a_small_registry_leaves_sections_in_place(spark, tmp_path):
    sections = "array(struct('A' AS component, 'x' AS variant), struct('Z' AS component, 'y' AS variant)) AS sections"
    spark.range(100).selectExpr("id AS item", sections).write.parquet(str(tmp_path / "b"))
    registry = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", None)], "component STRING, variant STRING")
    found = check_blueprints(spark.read.parquet(str(tmp_path / "b")), registry, ["item"])
    assert "Exchange hashpartitioning" not in plan_text(found)
    assert {(r["component"], r["pos"]) for r in found.collect()} == {("Z", 1)} and found.count() == 100


def test_markup_of_parts_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(9).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert "RoundRobinPartitioning" in plan_text(built_markup(spark, str(tmp_path)))


def test_texts_stay_until_it_is_known_which_are_looked_up(spark, tmp_path, monkeypatch):
    written = []
    keep = search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df, name="table": written.append((name, df.columns)) or keep(df, name))
    heads = "headings array<struct<tag:string,text:string>>"
    queries = spark.createDataFrame([("q1", "ok", [], "red vinyl banner"), ("q1", "ok", [], "red vinyl banner"), ("q2", "failed", [], "blue sign")], f"query string, status string, {heads}, text string")
    pages = spark.createDataFrame([("q1", 1, "u", [], "red vinyl banner", 3, [], []), ("q3", 1, "u", [], "x", 1, [], [])], f"query string, row_pos long, url string, {heads}, paragraph_text string, word_count long, faq_questions array<string>, schema_types array<string>")
    cache = KeyedTable(spark, str(tmp_path / "cache"), search.INTEL_CACHE, ["cache_key"], buckets=2)
    rounds = [search.cached_intel(queries, cache, pages, F.lit("2024-01-01").cast("timestamp")).collect() for _ in range(2)]
    assert sorted((r["query"], r["origin"]) for r in rounds[0]) == [("q1", "results"), ("q1", "results"), ("q2", "fallback")]
    assert {r["origin"] for r in rounds[1]} == {"cache"}
    assert {tuple(r["semantic_phrases"]) for r in rounds[0]} == {tuple(r["semantic_phrases"]) for r in rounds[1]}
    assert all(not {"text", "headings"} & set(columns) for name, columns in written if name == "asked")
