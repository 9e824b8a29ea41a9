from pyspark.sql import functions as F

from sitegrain.catalog import scoring_checks
from sitegrain.operators import schema_org, scoring
from sitegrain.vocab import REQUIRED_SECTIONS

c = F.col
SCHEMA = '{"@context":"https://schema.org","@type":"Product"}'


def evaluate(spark, text, schema=SCHEMA, entity=""):
    df = spark.createDataFrame([(text, schema, entity)], "optimized_content STRING, schema_json STRING, product_entity STRING")
    return scoring.evaluate(df).first()


def test_sections(one):
    text = "PRODUCT HEADER\nSome content\nFAQ"
    assert not one(scoring.sections_ok(c("t")), t=text)
    assert len(one(scoring.missing_sections(c("t")), t=text)) == 9


def test_complete_page_still_loses_eight(spark):
    text = "\n".join(
        s + "\n" + ("words " * 220 if s == "PRODUCT OVERVIEW TAB" else "x " * 800) for s in REQUIRED_SECTIONS
    )
    row = evaluate(spark, text + " [a](/b) Mesh Banner", entity=" Mesh Banner ")
    assert [f["check"] for f in row["failed_checks"]] == ["generic_headings"]
    assert row["eval_score"] == 92 and not row["eval_retry"]


def test_penalties(spark):
    row = evaluate(spark, "<h1>a</h1><h3>http://x</h3>", schema=None, entity="mesh")
    assert [f["check"] for f in row["failed_checks"]] == [
        "required_sections", "heading_hierarchy", "product_entity", "overview_length", "schema_validation",
        "links_in_headings", "internal_links",
    ]
    # 11 missing sections are capped at 40.
    assert row["eval_score"] == 100 - 40 - 10 - 12 - 6 - 10 - 8 - 5 and row["eval_retry"]


def test_sections_and_link(spark):
    row = evaluate(spark, "\n".join(REQUIRED_SECTIONS) + "\n[mesh banner](/mesh)", entity="mesh banner")
    assert row["eval_score"] == 100 - 8 - 6
    ordered = evaluate(spark, "ARTWORK TAB has a border " + " ".join(REQUIRED_SECTIONS))
    assert "cta_section_rules" in [f["check"] for f in ordered["failed_checks"]]


def test_hierarchy(one):
    for text, ok in (("<h1><h3>", False), ("<h1><h2><h3><h1>", True), ("", True), ("<H2 x><h4>", False)):
        assert one(scoring.heading_hierarchy_ok(c("t")), t=text) is ok, text


def score(spark, text, avg=0, headings=(), entities=(), faq=(), schema=False):
    df = spark.createDataFrame(
        [(text, avg, list(headings), list(entities), list(faq), schema)],
        "optimized_content STRING, average_word_count BIGINT, heading_patterns ARRAY<STRING>,"
        "entity_coverage ARRAY<STRING>, faq_patterns ARRAY<STRING>, schema_present BOOLEAN",
    )
    return scoring.content_score(df).first()


def test_score_without_expectations(spark):
    row = score(spark, "x")
    assert row["content_score"] == 10 + 15 + 25 + 15
    assert row["improvement_suggestions"] == [
        "Include schema-aligned structured data output.", "Add contextual internal links in paragraph copy.",
    ]


def test_word_band_is_inclusive(spark):
    for n, ok in ((60, True), (59, False), (140, True), (141, False)):
        row = score(spark, "w " * n, avg=100, schema=True)
        assert row["content_score"] == (75 if ok else 65), n


def test_heading_hits_count_over_all(spark):
    many = [f"zz{i}" for i in range(10)] + ["hit"]
    row = score(spark, "a HIT here", headings=many, schema=True)
    assert len(row["missing_headings"]) == 10
    assert row["content_score"] == round(10 + 1.5 + 25 + 15 + 10 + 0.0001)


def test_retry(spark):
    rows = [(1, True, 90, False, [], []), (1, False, 90, False, ["e"], []), (1, True, 80, False, ["e"], ["h"]),
            (1, True, 80, False, [], ["h"]), (1, True, 90, True, [], []), (2, False, 0, True, ["e"], [])]
    df = spark.createDataFrame(
        rows, "attempt INT, sections_ok BOOLEAN, content_score BIGINT, eval_retry BOOLEAN,"
        "missing_entities ARRAY<STRING>, missing_headings ARRAY<STRING>",
    )
    got = [(r["needs_retry"], r["retry_reason"]) for r in scoring.retry_decision(df).collect()]
    assert got == [
        (False, None), (True, "missing_sections"), (True, "missing_entities"), (True, "missing_headings"),
        (True, "low_score"), (False, None),
    ]


def test_texts_without_words_are_decided(spark, tmp_path):
    rows = [(1, "", "en"), (2, " \n\t", "de"), (3, None, "fr"), (4, "The la de", "en")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r) for r in scoring_checks.retry_decisions(spark, str(tmp_path)).collect()}
    assert got == {(k, True, "missing_sections") for k in (1, 2, 3, 4)}
    failed = {r["doc_id"]: r["failed_checks"] for r in scoring_checks.evaluation(spark, str(tmp_path)).collect()}
    # A text without a first word names no entity, so none is missing.
    assert failed[1] == "required_sections|generic_headings|overview_length" and "product_entity" not in failed[2]


def test_faq_pairs(one):
    pairs = lambda t: [tuple(p) for p in one(schema_org.faq_pairs(c("t")), t=t)]
    assert pairs("Q: a\nA: b") == [("a", "b")]
    assert pairs("q: a\r\ntext\n\nANSWER: b") == [("a", "b")]
    assert pairs("Q: a\nQ: b\nA: c") == [("b", "c")]
    assert pairs("Q: a\nA: b\nA: c") == [("a", "b")]
    assert pairs("Q:\nA: b") == []
    assert pairs("Q: a\nA:\nA: c") == []
    assert pairs("## Why?\nA: so") == [("Why?", "so")]
    assert pairs("") == []


def test_schema(spark):
    df = spark.createDataFrame(
        [("u", "pdp", "T", "", "", "words", "Q: a\nA: b"), ("u", "blog", "T", "E", "d", "w", ""),
         ("u", "pdp", "T", "E", "d", "w", '{"@type":"Own"}')],
        "url STRING, page_type STRING, title STRING, product_entity STRING, meta_description STRING,"
        "first_1500_words STRING, optimized_content STRING",
    )
    a, b, own = [r["schema_json"] for r in schema_org.page_schema(df).collect()]
    assert '"@type":"Product","name":"T","description":"words","url":"u"' in a and '"faqPage"' in a
    assert b == '{"@context":"https://schema.org","@type":"WebPage","url":"u","name":"T"}'
    assert own == '{"@type":"Own"}'
