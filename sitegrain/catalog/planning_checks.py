"""Registered queries over topics, site plans and learned patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.catalog import sql
from sitegrain.catalog.common import joined, site_pages, table
from sitegrain.functions import topics as Tp
from sitegrain.operators import patterns as Pt
from sitegrain.operators import planning
from sitegrain.vocab import SERP_RULES, SERVICE_EXPANSIONS, TONES

# Part types and brands become trades and places, names stay.
TRADES = {
    "STANDARD": "Gym", "ECONOMY": "Dry Needling", "MEDIUM": "HVAC repair guide", "PROMO": "Software offer",
    "LARGE": "Rehab", "SMALL": "",
}


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    trade = Tp.literal_map(TRADES, F.col("p_type"), "")
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    where = F.when(number < 6, " Alexandria MN").when(number < 10, " near New Ulm MN").otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.trim(F.concat_ws(" ", trade, F.initcap("p_name"))), where).alias("topic"),
        F.when(number == 12, "Fargo ND").alias("location"),
        F.when(number > 20, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_size") == 1, " Homepage").when(F.col("p_size") == 2, "location").alias("page_type"),
    )


def topic_types(spark: SparkSession, sf: str) -> DataFrame:
    kind = Tp.topic_type(F.col("topic"), F.col("page_type"))
    return _topics(spark, sf).select("p_partkey", kind.alias("topic_type"), joined(Tp.tone(kind)).alias("tone"))


def content_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return planning.profiles(_topics(spark, sf)).withColumn("tone", joined(F.col("tone")))


def topic_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return planning.expand_topics(_topics(spark, sf)).select(
        "p_partkey", "base_topic", "base_location", joined(F.col("service_topics")).alias("service_topics")
    )


def planned_sites(spark: SparkSession, sf: str) -> DataFrame:
    pages = planning.site_pages(_topics(spark, sf), ["p_partkey"])
    return planning.navigation(pages).drop("location")


def serp_expansion(spark: SparkSession, sf: str) -> DataFrame:
    rows = planning.serp_expansion(_topics(spark, sf))
    return rows.select("p_partkey", *[joined(F.col(c)).alias(c) for c in ("entities", "questions", "headings")])


def structure_signals(spark: SparkSession, sf: str) -> DataFrame:
    signals = _signals(spark, sf)
    return signals.select(
        "idx", joined(F.col("dominant_sections")).alias("dominant_sections"), "layout_preference",
        "section_density", "cta_frequency",
    )


# Syllables of the given headings and link words stand in for section words.
KEYWORDS = (
    ("hero", ("the", "der")), ("content", ("ing", "ung")), ("benefits", ("eau",)), ("process", ("tion", "ción")),
    ("testimonials", ("oui", "sch")), ("faq", ("an",)), ("cta", ("es ", "th")),
)
CTA = ("the", "der", "de", "on")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return Pt.structure_signals(site_pages(spark, sf), KEYWORDS, CTA)


def merged_signals(spark: SparkSession, sf: str) -> DataFrame:
    merged = Pt.merge_signals(_signals(spark, sf))
    return merged.withColumn("dominant_sections", joined(F.col("dominant_sections")))


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    section = lambda c, v: F.struct(c.alias("component"), v.alias("variant"))
    k = (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")
    uses = e.select(
        F.col("event_type").alias("page_type"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("theme"),
        F.array(section(F.lit("hero"), k), section(F.col("event_type"), F.lit("v"))).alias("sections"),
        F.col("ts").alias("used_at"), "event_type",
    )
    signature = Pt.blueprint_signature(F.col("page_type"), F.col("theme"), F.col("sections"))
    store = uses.filter("event_type = 'error'").groupBy(signature.alias("signature"), "page_type", "theme").agg(
        F.count("*").alias("usage_count"), F.max("used_at").alias("last_used")
    )
    return store, uses.filter("event_type <> 'error'").drop("event_type")


def recorded_patterns(spark: SparkSession, sf: str) -> DataFrame:
    store, uses = _store(spark, sf)
    return Pt.record_patterns(store, uses).drop("last_used")


def ranked_patterns(spark: SparkSession, sf: str) -> DataFrame:
    store, uses = _store(spark, sf)
    ranked = Pt.rank_patterns(Pt.record_patterns(store, uses))
    return ranked.select("signature", "usage_count", "confidence", F.col("rank").cast("long").alias("rank"))


def preferred_patterns(spark: SparkSession, sf: str) -> DataFrame:
    store, uses = _store(spark, sf)
    few = store.withColumn("usage_count", F.col("usage_count") % 5)
    requests = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("page_type"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("theme")
    )
    return Pt.preferred_patterns(requests, few, "event_id").select("event_id", "signature", "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        topic_types, content_profiles, topic_expansion, planned_sites, serp_expansion, structure_signals,
        merged_signals, recorded_patterns, ranked_patterns, preferred_patterns,
    )
}

_TRADE = "CASE p_type " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in TRADES.items()) + " END"
_TOPICS = f"""
tp0 AS (SELECT *, regexp_extract(p_brand, '(\\d+)', 1)::INT AS n FROM part),
tp AS (
  SELECT p_partkey, trim({_TRADE} || ' ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' '))
         || CASE WHEN n < 6 THEN ' Alexandria MN' WHEN n < 10 THEN ' near New Ulm MN' ELSE '' END AS topic,
         CASE WHEN n = 12 THEN 'Fargo ND' END AS location, CASE WHEN n > 20 THEN p_brand END AS brand,
         CASE p_size WHEN 1 THEN ' Homepage' WHEN 2 THEN 'location' END AS page_type
  FROM tp0)"""


def _any(text: str, terms: tuple[str, ...]) -> str:
    return sql.contains_any(text, terms)


def _topic_type(text: str) -> str:
    from sitegrain.vocab import TOPIC_RULES

    return "CASE " + " ".join(f"WHEN {_any(text, t)} THEN {sql.q(k)}" for k, t in TOPIC_RULES) + " ELSE 'local-service' END"


_TONE = "CASE tt " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q('|'.join(v))}" for k, v in TONES.items()) + " END"
_SPLIT = f"""
sp AS (
  SELECT *, location IS NULL AND len(string_split(topic, ' ')) >= 3 AND regexp_matches(topic, ' [A-Z][a-z]+ [A-Z][A-Z]$') AS loc FROM tp),
ex AS (
  SELECT p_partkey, topic, brand, CASE WHEN loc THEN regexp_replace(topic, ' [A-Z][a-z]+ [A-Z][A-Z]$', '') ELSE topic END AS base_topic,
         CASE WHEN loc THEN regexp_extract(topic, '[A-Z][a-z]+ [A-Z][A-Z]$') ELSE coalesce(location, '') END AS base_location
  FROM sp),
sv AS (
  SELECT *, CASE {' '.join(f"WHEN {_any('lower(base_topic)', t)} THEN [{', '.join(sql.q(x) for x in v)}]" for t, v in SERVICE_EXPANSIONS)}
    ELSE [base_topic || ' Services', base_topic || ' Specialists', base_topic || ' Solutions'] END AS services FROM ex)"""
_SCOPE = "lower(topic || ' ' || coalesce(location, ''))"


def _rules(part: str, default: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {_any(_SCOPE, r.terms)} THEN [{', '.join(sql.q(x) for x in getattr(r, part))}]" for r in SERP_RULES
    ) + f" ELSE {default} END"


def _every(part: str) -> str:
    lists = ", ".join(
        f"CASE WHEN {_any(_SCOPE, r.terms)} THEN [{', '.join(sql.q(x) for x in getattr(r, part))}] ELSE [] END" for r in SERP_RULES
    )
    return f"flatten([{lists}])"


_T2 = (
    "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN "
    "('the','and','for','with','your','you','our','home','page','near','best','top','in'))"
)


def _ordered_distinct(lst: str, cap: int) -> str:
    return (
        f"(SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest({lst}) AS x, "
        f"generate_subscripts({lst}, 1) AS i) GROUP BY x ORDER BY i LIMIT {cap}))"
    )


_SIG_HEADS = "list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', ' ', 'g'))), lambda h: h <> '')"
_SIGNALS = f"""
g0 AS (
  SELECT idx, site, html, greatest(1, len(regexp_extract_all(html, '(?i)<section\\b'))) AS sec, {_SIG_HEADS} AS heads,
         len(regexp_extract_all(html, '(?i)<p\\b')) AS ps, len(regexp_extract_all(html, '(?i)<img\\b')) AS im,
         len(regexp_extract_all(html, '(?i)<button\\b')) + len(list_filter(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1),
             lambda t: regexp_matches(lower(t), '({'|'.join(CTA)})'))) AS cta
  FROM raw_pages),
comp AS (
  SELECT idx, site, c, k, len(list_filter(heads, lambda h: regexp_matches(lower(h), pat))) AS n
  FROM g0, (VALUES {', '.join(f"({i}, {sql.q(k)}, {sql.q('(' + '|'.join(t) + ')')})" for i, (k, t) in enumerate(KEYWORDS))}) v(c, k, pat)),
dom AS (
  SELECT idx, site, k, row_number() OVER (PARTITION BY idx ORDER BY n DESC, c) AS pos FROM comp WHERE n > 0 QUALIFY pos <= 4),
sg AS (
  SELECT g0.idx, g0.site, coalesce((SELECT string_agg(k, '|' ORDER BY pos) FROM dom WHERE dom.idx = g0.idx), '') AS dominant_sections,
    CASE WHEN im >= sec OR contains(lower(html), 'grid') OR contains(lower(html), 'columns') THEN 'visual' ELSE 'editorial' END AS layout_preference,
    CASE WHEN (ps + 2 * len(heads))::DOUBLE / sec > 8 THEN 'high' WHEN (ps + 2 * len(heads))::DOUBLE / sec > 4 THEN 'medium' ELSE 'low' END AS section_density,
    CASE WHEN cta >= 4 THEN 'high' WHEN cta >= 2 THEN 'medium' ELSE 'low' END AS cta_frequency
  FROM g0)""".replace("\\\\", "\\")


def _mode(column: str) -> str:
    return (
        f"(SELECT x FROM (SELECT {column} AS x, count(*) AS n, min(idx) AS i FROM sg s2 WHERE s2.site = sg.site GROUP BY 1 "
        "ORDER BY n DESC, i LIMIT 1))"
    )


_SIGNATURE = (
    "event_type || '::t' || (user_id % 7) || '::hero|' || event_type || '::hero:' || ((props->>'$.k')::INT % 5) || '|' || event_type || ':v'"
)
_PATTERNS = f"""
pat AS (SELECT {_SIGNATURE} AS signature, event_type AS page_type, 't' || (user_id % 7) AS theme, count(*) AS usage_count, max(ts) AS lu
        FROM events GROUP BY 1, 2, 3)"""

ORACLES = {
    "topic_types": f"""
      WITH {_TOPICS}, t AS (SELECT p_partkey, {_topic_type("lower(topic || ' ' || coalesce(page_type, ''))")} AS tt FROM tp)
      SELECT p_partkey, tt AS topic_type, {_TONE} AS tone FROM t""",
    "content_profiles": f"""
      WITH {_TOPICS}, l AS (
        SELECT *, coalesce(location, CASE WHEN regexp_matches(topic, '\\b([A-Z][a-z]+)\\s([A-Z][A-Z])\\b')
                 THEN CASE WHEN regexp_matches(topic, '^([A-Z][a-z]+ )+[A-Z][A-Z]$') THEN topic ELSE regexp_extract(topic, '\\b[A-Z][a-z]+\\s[A-Z][A-Z]\\b') END END) AS place FROM tp),
      k AS (SELECT *, CASE WHEN page_type = ' Homepage' THEN 'home' WHEN page_type IS NOT NULL THEN page_type
              WHEN {_any('lower(topic)', ('guide', 'tips', 'blog', 'what is', 'how to'))} THEN 'blog'
              WHEN {_any('lower(topic)', ('home', 'company'))} THEN 'home'
              WHEN {_any('lower(topic)', ('landing', 'campaign', 'offer'))} THEN 'landing'
              WHEN {_any('lower(topic)', ('therapy', 'treatment', 'service', 'repair', 'dry needling', 'cleaning'))} THEN 'service'
              WHEN place IS NOT NULL THEN 'location' ELSE 'service' END AS kind FROM l),
      t AS (SELECT *, {_topic_type("lower(topic || ' ' || kind)")} AS tt FROM k)
      SELECT p_partkey, topic, kind AS page_type, place AS location, brand, tt AS topic_type, {_TONE} AS tone,
             CASE kind WHEN 'home' THEN 'navigational' WHEN 'blog' THEN 'informational' ELSE 'conversion' END AS intent,
             CASE kind WHEN 'home' THEN 'light' WHEN 'landing' THEN 'light' WHEN 'blog' THEN 'deep' ELSE 'medium' END AS content_depth
      FROM t""",
    "topic_expansion": f"""
      WITH {_TOPICS}, {_SPLIT}
      SELECT p_partkey, base_topic, base_location, array_to_string(services, '|') AS service_topics FROM sv""",
    "planned_sites": f"""
      WITH {_TOPICS}, {_SPLIT},
      pg AS (
        SELECT p_partkey, unnest(list_concat(list_concat(
            [{{'page_type': 'home', 'topic': coalesce(brand, base_topic)}}],
            list_transform(services, lambda s: {{'page_type': 'service', 'topic': trim(s || ' ' || base_location)}})),
            list_concat(CASE WHEN base_location <> '' THEN list_transform(services, lambda s: {{'page_type': 'location', 'topic': s}}) ELSE [] END,
            list_transform(services[1:2], lambda s: {{'page_type': 'blog', 'topic': 'What to Know About ' || s || CASE WHEN base_location <> '' THEN ' in ' || base_location ELSE '' END}})))) AS p,
          unnest(range(CASE WHEN base_location <> '' THEN 9 ELSE 6 END)) AS pos
        FROM sv)
      SELECT p_partkey, pos, p.page_type, p.topic, CASE WHEN p.page_type = 'home' THEN 'Home' ELSE p.topic END AS label,
             CASE WHEN p.page_type = 'home' THEN '/' ELSE '/' || p.page_type || '/' || regexp_replace(regexp_replace(lower(p.topic), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS href
      FROM pg""",
    "serp_expansion": f"""
      WITH {_TOPICS}, h AS (
        SELECT *, {_rules('headings', "['Why Choose ' || topic, 'What to Expect From ' || topic, topic || ' Pricing', 'Common Questions About ' || topic]")} AS hs FROM tp),
      e AS (
        SELECT *, list_concat(list_concat(list_concat({_T2.format(x='topic')}, {_every('entities')}),
            flatten(list_transform(hs, lambda h: list_concat({_T2.format(x='h')}, CASE WHEN regexp_matches(h, '(?i)pricing|cost|rates') THEN ['pricing'] ELSE [] END)))),
            CASE WHEN location IS NULL THEN [] ELSE [location, 'local availability'] END) AS es,
          list_concat(list_concat({_every('questions')},
            flatten(list_transform(hs, lambda h: list_concat(CASE WHEN regexp_matches(h, '(?i)pricing|cost|rates') THEN ['How does pricing work for ' || topic || '?'] ELSE [] END,
              CASE WHEN regexp_matches(h, '(?i)what|how|when|why') THEN [h || '?'] ELSE [] END)))),
            CASE WHEN location IS NULL THEN [] ELSE ['Do you serve customers in ' || location || '?'] END) AS qs
        FROM h)
      SELECT p_partkey, {_ordered_distinct('es', 12)} AS entities, {_ordered_distinct('qs', 6)} AS questions, array_to_string(hs, '|') AS headings FROM e""",
    "structure_signals": f"""
      WITH {sql.PAGES}, {_SIGNALS} SELECT idx, dominant_sections, layout_preference, section_density, cta_frequency FROM sg""",
    "merged_signals": f"""
      WITH {sql.PAGES}, {_SIGNALS},
      dc AS (SELECT site, k, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, min((idx, pos))) AS r FROM dom GROUP BY site, k QUALIFY r <= 4)
      SELECT DISTINCT site, coalesce((SELECT string_agg(k, '|' ORDER BY r) FROM dc WHERE dc.site = sg.site), '') AS dominant_sections,
             {_mode('layout_preference')} AS layout_preference, {_mode('section_density')} AS section_density, {_mode('cta_frequency')} AS cta_frequency
      FROM sg""",
    "recorded_patterns": f"""
      WITH {_PATTERNS} SELECT signature, page_type, theme, usage_count FROM pat""",
    "ranked_patterns": f"""
      WITH {_PATTERNS}, k AS (SELECT * FROM pat)
      SELECT signature, usage_count, CASE WHEN usage_count > 5 THEN 'high' WHEN usage_count > 2 THEN 'medium' ELSE 'low' END AS confidence,
             row_number() OVER (PARTITION BY page_type, theme ORDER BY usage_count DESC, signature) AS rank FROM k""",
    "preferred_patterns": f"""
      WITH {_PATTERNS}, b AS (
        SELECT page_type, theme, signature, usage_count % 5 AS u FROM pat WHERE page_type = 'error'
        QUALIFY row_number() OVER (PARTITION BY page_type, theme ORDER BY usage_count % 5 DESC, signature) = 1)
      SELECT event_id, signature, CASE WHEN u > 2 THEN 'medium' END AS confidence
      FROM events LEFT JOIN b ON b.page_type = event_type AND b.theme = 't' || (user_id % 7) AND u > 2""",
}
