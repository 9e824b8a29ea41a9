"""Registered queries over generated texts: section checks, scores, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog import sql
from sitegrain.catalog.common import joined, site_pages, table
from sitegrain.operators import routing, scoring
from sitegrain.vocab import ScoringRules

# Words of the given texts stand in for section names and sales terms.
RULES = ScoringRules(
    required_sections=("The", "Un", "Ein", "ing", "eau", "Ench", "ción", "Der", "Que", "is.", "FAQ"),
    structure_sections=("The", "Un", "Ein", "ing", "eau", "Ench", "ción", "Der", "Que"),
    cta_sections=("The", "Ein", "eau", "de", "ing"),
    cta_terms=("thand", "schen", "elle", "ando"),
    generic_headings=("The", "Die", "En", "Un the"),
    overview_section="de",
    overview_words=(100, 220),
    faq_marker="la",
)


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as generated texts, with links, headings and schemas drawn in
    from their own columns, each with an expectation list from its own words."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != "")
    link = F.when(F.col("quality") == 1, F.concat(F.lit(" [more](/"), "lang", F.lit(")")))
    heads = F.when(F.col("lang") == "de", "<h2>A</h2><h4>B</h4>").when(
        F.col("lang") == "fr", "<h2>http://x</h2><h3>B</h3>"
    )
    content = F.concat("text", F.coalesce(link, F.lit("")), F.coalesce(heads, F.lit("")))
    schema = F.when(F.col("toxic") == 0, '{"@context":"https://schema.org","@type":"Product"}').when(
        F.col("toxic") == 1, '{"@type":"Product"}'
    )
    return docs.withColumn("w", words).select(
        "doc_id",
        content.alias("optimized_content"),
        schema.alias("schema_json"),
        F.col("toxic").isNotNull().alias("schema_present"),
        F.lower(F.try_element_at("w", F.lit(1))).alias("product_entity"),
        F.lit(300).alias("average_word_count"),
        F.array_union(F.slice("w", 1, 6), F.array(F.lit("Zebra"), F.lit("ING"))).alias("heading_patterns"),
        F.when(F.col("lang") == "es", F.array().cast("array<string>"))
        .otherwise(F.array_union(F.slice("w", 1, 3), F.array(F.lit("Quagga"), F.lit("xyzzy"))))
        .alias("entity_coverage"),
        F.array(F.lit("la"), F.lit("Un "), F.lit("zzz")).alias("faq_patterns"),
        F.lit(1).alias("attempt"),
    )


def missing_sections(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", joined(scoring.missing_sections(text, RULES)).alias("missing"),
        scoring.sections_ok(text, RULES).alias("ok"),
    )


def rule_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = scoring.rule_flags(_generated(spark, sf), "optimized_content", RULES)
    return flags.select(
        "doc_id", "generic_headings", joined(F.col("cta_violations")).alias("cta_violations"),
        "links_in_headings", "hierarchy_ok", "overview_ok", "has_internal_link",
        scoring.schema_ok(F.col("schema_json")).alias("schema_ok"),
    )


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.evaluate(_generated(spark, sf), rules=RULES)
    return scored.select(
        "doc_id", "eval_score", "eval_retry",
        joined(F.transform("failed_checks", lambda c: c["check"])).alias("failed_checks"),
    )


def content_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.content_score(_generated(spark, sf), rules=RULES)
    return scored.select(
        "doc_id", "content_score", joined(F.col("missing_entities")).alias("missing_entities"),
        joined(F.col("missing_headings")).alias("missing_headings"),
        F.size("improvement_suggestions").cast("long").alias("suggestions"),
    )


def retry_decisions(spark: SparkSession, sf: str) -> DataFrame:
    both = scoring.content_score(scoring.evaluate(_generated(spark, sf), rules=RULES), rules=RULES)
    return scoring.retry_decision(both, RULES).select("doc_id", "needs_retry", "retry_reason")


def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Hierarchy of real markup with a deeper heading behind the first."""
    page = F.concat("html", F.when(F.col("url").contains("/en/"), "<h3>x</h3>").otherwise("<H2>x</H2><h1>y</h1>"))
    return site_pages(spark, sf).select("idx", scoring.heading_hierarchy_ok(page).alias("hierarchy_ok"))


def retryable_events(spark: SparkSession, sf: str) -> DataFrame:
    message = F.concat(
        F.lit("Request FAILED with Status Code "), F.when(F.col("event_type") == "error", "503")
        .when(F.col("event_type") == "view", "x: socket hang up").otherwise(F.col("value").cast("int").cast("string")),
    )
    return table(spark, sf, "events").select(
        "event_id", routing.is_retryable(message).alias("core"),
        routing.is_retryable(message, network=False).alias("full"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        missing_sections, rule_flags, evaluation, content_scores, retry_decisions, heading_levels, retryable_events,
    )
}


def _list(words) -> str:
    return "[" + ", ".join(sql.q(w) for w in words) + "]"


_GEN = """
base AS (
  SELECT doc_id, text, lang, quality, toxic,
         list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM documents LEFT JOIN labels USING (doc_id)),
gen AS (
  SELECT doc_id, text || CASE WHEN quality = 1 THEN ' [more](/' || lang || ')' ELSE '' END ||
         CASE lang WHEN 'de' THEN '<h2>A</h2><h4>B</h4>' WHEN 'fr' THEN '<h2>http://x</h2><h3>B</h3>' ELSE '' END AS c,
         coalesce(toxic = 0, false) AS schema_ok, toxic IS NOT NULL AS schema_present, lower(w[1]) AS entity,
         lang = 'de' AS bad_levels, lang = 'fr' AS link_heading, coalesce(quality = 1, false) AS has_link, lang,
         (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(list_concat(w[1:6], ['Zebra', 'ING'])) AS x,
             generate_subscripts(list_concat(w[1:6], ['Zebra', 'ING']), 1) AS i) GROUP BY x)) AS hp,
         CASE WHEN lang = 'es' THEN [] ELSE (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(list_concat(w[1:3], ['Quagga', 'xyzzy'])) AS x,
             generate_subscripts(list_concat(w[1:3], ['Quagga', 'xyzzy']), 1) AS i) GROUP BY x)) END AS ec
  FROM base)""".replace("\\\\", "\\")
_CTA = "(" + "|".join(RULES.cta_terms) + ")"
_FLAGS = f"""
fl AS (
  SELECT *,
    list_filter({_list(RULES.required_sections)}, lambda s: NOT contains(c, s)) AS miss,
    contains(lower(c), 'la') AS faq,
    regexp_matches(c, '(?i)\\b({"|".join(RULES.generic_headings)})\\b') AS generic,
    list_filter({_list(RULES.cta_sections)}, lambda s: contains(c, s) AND regexp_matches(lower(substring(c, instr(c, s), 700)), '{_CTA}')) AS cta,
    contains(c, 'de') AND {sql.word_count("regexp_replace(substring(c, instr(c, 'de'), 1300), '<[^>]+>', ' ', 'g')")} BETWEEN 100 AND 220 AS overview
  FROM gen)"""
_EVAL = f"""
ev AS (
  SELECT *, list_filter([
      CASE WHEN len(miss) > 0 THEN 'required_sections' END, CASE WHEN bad_levels THEN 'heading_hierarchy' END,
      CASE WHEN entity <> '' AND NOT contains(lower(c), entity) THEN 'product_entity' END,
      CASE WHEN len(cta) > 0 THEN 'cta_section_rules' END, CASE WHEN generic THEN 'generic_headings' END,
      CASE WHEN NOT overview THEN 'overview_length' END, CASE WHEN NOT schema_ok THEN 'schema_validation' END,
      CASE WHEN link_heading THEN 'links_in_headings' END, CASE WHEN NOT has_link THEN 'internal_links' END], lambda x: x IS NOT NULL) AS failed
  FROM fl),
sc AS (
  SELECT *, greatest(0, 100 - CASE WHEN len(miss) > 0 THEN least(40, 4 * len(miss)) ELSE 0 END
    - CASE WHEN list_contains(failed, 'heading_hierarchy') THEN 10 ELSE 0 END - CASE WHEN list_contains(failed, 'product_entity') THEN 12 ELSE 0 END
    - CASE WHEN len(cta) > 0 THEN 10 ELSE 0 END - CASE WHEN generic THEN 8 ELSE 0 END - CASE WHEN NOT overview THEN 6 ELSE 0 END
    - CASE WHEN NOT schema_ok THEN 10 ELSE 0 END - CASE WHEN link_heading THEN 8 ELSE 0 END - CASE WHEN NOT has_link THEN 5 ELSE 0 END) AS eval_score
  FROM ev)"""
_SCORE = f"""
cs0 AS (
  SELECT *, {sql.word_count("regexp_replace(c, '<[^>]+>', ' ', 'g')")} AS words,
    list_filter(hp, lambda x: contains(lower(c), lower(x))) AS hh, list_filter(ec, lambda x: contains(lower(c), lower(x))) AS eh,
    list_filter(hp[1:10], lambda x: NOT contains(lower(c), lower(x))) AS mh, list_filter(ec[1:20], lambda x: NOT contains(lower(c), lower(x))) AS me,
    len(list_filter(['la', 'Un ', 'zzz'], lambda x: contains(lower(c), lower(x)))) AS fh,
    len(list_filter({_list(RULES.structure_sections)}, lambda s: contains(c, s))) AS st
  FROM sc),
cs AS (
  SELECT *, least(100, greatest(0, round(
      (CASE WHEN words >= 300 * 0.6::DOUBLE AND words <= 300 * 1.4::DOUBLE THEN 10 ELSE 0 END)
      + 15 * least(1.0::DOUBLE, len(hh)::DOUBLE / least(10, len(hp)))
      + 25 * CASE WHEN len(ec) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, len(eh)::DOUBLE / least(15, len(ec))) END
      + 15 * least(1.0::DOUBLE, fh::DOUBLE / 3) + CASE WHEN schema_present THEN 10 ELSE 0 END
      + CASE WHEN has_link THEN 10 ELSE 0 END + 15 * (st::DOUBLE / 9))))::BIGINT AS content_score,
      (CASE WHEN words >= 180 AND words <= 420 THEN 0 ELSE 1 END) + (CASE WHEN schema_present THEN 0 ELSE 1 END)
      + (CASE WHEN has_link THEN 0 ELSE 1 END) + (CASE WHEN len(me) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(mh) > 0 THEN 1 ELSE 0 END) AS sg
  FROM cs0)"""

ORACLES = {
    "missing_sections": f"""
      SELECT doc_id, array_to_string(list_filter({_list(RULES.required_sections)}, lambda s: NOT contains(text, s)), '|') AS missing,
             len(list_filter({_list(RULES.required_sections)}, lambda s: NOT contains(text, s))) = 0 AND contains(lower(text), 'la') AS ok
      FROM documents""",
    "rule_flags": f"""
      WITH {_GEN}, {_FLAGS}
      SELECT doc_id, generic AS generic_headings, array_to_string(cta, '|') AS cta_violations, link_heading AS links_in_headings,
             NOT bad_levels AS hierarchy_ok, overview AS overview_ok, has_link AS has_internal_link, schema_ok FROM fl""",
    "evaluation": f"""
      WITH {_GEN}, {_FLAGS}, {_EVAL}
      SELECT doc_id, eval_score, eval_score < 85 AS eval_retry, array_to_string(failed, '|') AS failed_checks FROM sc""",
    "content_scores": f"""
      WITH {_GEN}, {_FLAGS}, {_EVAL}, {_SCORE}
      SELECT doc_id, content_score, array_to_string(me, '|') AS missing_entities, array_to_string(mh, '|') AS missing_headings,
             sg AS suggestions FROM cs""",
    "retry_decisions": f"""
      WITH {_GEN}, {_FLAGS}, {_EVAL}, {_SCORE}, d AS (
        SELECT *, len(miss) = 0 AND faq AS ok FROM cs)
      SELECT doc_id, NOT ok OR content_score < 85 OR eval_score < 85 AS needs_retry,
             CASE WHEN ok AND content_score >= 85 AND eval_score >= 85 THEN NULL WHEN NOT ok THEN 'missing_sections'
                  WHEN len(me) > 0 THEN 'missing_entities' WHEN len(mh) > 0 THEN 'missing_headings' ELSE 'low_score' END AS retry_reason
      FROM d""",
    "heading_levels": """
      WITH l AS (SELECT page_id AS idx, regexp_extract_all(html || CASE WHEN contains(url, '/en/') THEN '<h3>x</h3>' ELSE '<H2>x</H2><h1>y</h1>' END,
                        '(?i)<h([1-6])\\b', 1) AS lv FROM pages),
      j AS (SELECT idx, unnest(lv)::INT AS a, generate_subscripts(lv, 1) AS i FROM l),
      d AS (SELECT idx, a - lag(a) OVER (PARTITION BY idx ORDER BY i) AS step FROM j)
      SELECT p.page_id AS idx, coalesce(max(step), 0) <= 1 AS hierarchy_ok FROM pages p LEFT JOIN d ON d.idx = p.page_id GROUP BY 1""".replace("\\\\", "\\"),
    "retryable_events": """
      SELECT event_id, event_type IN ('error', 'view') AS core, event_type = 'error' AS "full" FROM events""",
}
