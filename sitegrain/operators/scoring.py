"""Content score, evaluation score, section checks, retry ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import (
    WORD_END,
    WORD_START,
    any_of,
    bind,
    contains_any,
    first_n,
    holds_any,
    list_or_empty,
    listed_in,
    literal_array,
    tags_to_space,
    text_or_empty,
    word_count,
)
from sitegrain.vocab import (
    SUGGEST_ENTITIES,
    SUGGEST_HEADINGS,
    SUGGEST_LENGTH,
    SUGGEST_LINKS,
    SUGGEST_SCHEMA,
    ScoringRules,
)

# fixed values: score weights and penalties
WEIGHTS = {
    "words": 10, "headings": 15, "entities": 25, "faq": 15, "schema": 10, "links": 10,
    "structure": 15,
}
PENALTIES = {
    "section": 4, "sections_max": 40, "hierarchy": 10, "entity": 12, "cta": 10, "generic": 8,
    "overview": 6, "schema": 10, "heading_links": 8, "links": 5,
}
CTA_WINDOW = 700
OVERVIEW_WINDOW = 1300
_LINK = r"\[[^\]]+\]\((?:https?://|/)"
_ANCHOR = r"(?i)<a\s+href="


def missing_sections(text: Column, rules: ScoringRules = ScoringRules()) -> Column:
    return F.filter(literal_array(rules.required_sections), lambda s: ~text.contains(s))


def sections_ok(text: Column, rules: ScoringRules = ScoringRules()) -> Column:
    return (F.size(missing_sections(text, rules)) == 0) & F.lower(text).contains(
        rules.faq_marker.lower()
    )


def has_generic_headings(text: Column, rules: ScoringRules = ScoringRules()) -> Column:
    # Most texts hold none of the words; the word-edge test runs on the others.
    words = [w.lower() for w in rules.generic_headings]
    likely = bind(F.lower(text), lambda low: holds_any(low, words))
    return likely & text.rlike(f"(?i){any_of(rules.generic_headings)}{WORD_END}") & text.rlike(
        f"(?i){WORD_START}{any_of(rules.generic_headings)}{WORD_END}"
    )


def _window_after(text: Column, marker: Column, size: int) -> Column:
    """``size`` characters from the first ``marker``; empty when it is absent."""
    start = F.instr(text, marker)
    return F.when(start > 0, F.substring(text, start, F.lit(size))).otherwise(F.lit(""))


def cta_violations(text: Column, rules: ScoringRules = ScoringRules()) -> Column:
    return F.filter(
        literal_array(rules.cta_sections),
        lambda s: contains_any(F.lower(_window_after(text, s, CTA_WINDOW)), rules.cta_terms),
    )


def links_in_headings(text: Column) -> Column:
    return text.rlike(r"(?i)<h[1-6][^>]*>[^<]*(?:https?://|<a\s)")


def heading_hierarchy_ok(text: Column) -> Column:
    """No heading is more than one level below the heading before it."""
    levels = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?i)<h([1-6])(?![A-Za-z0-9_])"), 1), lambda v: v.cast("int")
    )
    jumps = F.zip_with(
        levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: b - a
    )
    return ~F.exists(jumps, lambda d: F.coalesce(d, F.lit(0)) > 1)


def section_word_count_ok(text: Column, section: str, low: int, high: int) -> Column:
    window = _window_after(text, F.lit(section), OVERVIEW_WINDOW)
    n = word_count(tags_to_space(window))
    return text.contains(section) & n.between(low, high)


def schema_ok(schema_json: Column) -> Column:
    has = lambda key: text_or_empty(F.get_json_object(schema_json, f"$['{key}']")) != ""
    return F.coalesce(has("@context") & has("@type"), F.lit(False))


def has_internal_link(text: Column) -> Column:
    return text.rlike(_LINK) | text.rlike(_ANCHOR)


def rule_flags(df: DataFrame, content: str, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """All rule flags of a generated text as columns."""
    text = text_or_empty(F.col(content))
    low, high = rules.overview_words
    return df.withColumns(
        {
            "missing_sections": missing_sections(text, rules),
            "sections_ok": sections_ok(text, rules),
            "generic_headings": has_generic_headings(text, rules),
            "cta_violations": cta_violations(text, rules),
            "links_in_headings": links_in_headings(text),
            "hierarchy_ok": heading_hierarchy_ok(text),
            "overview_ok": section_word_count_ok(text, rules.overview_section, low, high),
            "has_internal_link": has_internal_link(text),
        }
    )


def evaluate(
    df: DataFrame,
    content: str = "optimized_content",
    schema_json: str = "schema_json",
    entity: str = "product_entity",
    rules: ScoringRules = ScoringRules(),
) -> DataFrame:
    """Add ``eval_score``, ``failed_checks`` and ``eval_retry``."""
    text = text_or_empty(F.col(content))
    flags = rule_flags(df, content, rules)
    name = F.lower(F.trim(text_or_empty(F.col(entity))))
    p = PENALTIES
    missing = F.size("missing_sections")
    checks = (
        ("required_sections", missing > 0, F.least(F.lit(p["sections_max"]), missing * p["section"]),
         F.col("missing_sections")),
        ("heading_hierarchy", ~F.col("hierarchy_ok"), F.lit(p["hierarchy"]),
         F.array(F.lit("Invalid heading level jumps"))),
        ("product_entity", (name != "") & ~F.lower(text).contains(name), F.lit(p["entity"]),
         F.array(F.concat(F.lit("Entity not found: "), name))),
        ("cta_section_rules", F.size("cta_violations") > 0, F.lit(p["cta"]), F.col("cta_violations")),
        ("generic_headings", F.col("generic_headings"), F.lit(p["generic"]),
         F.array(F.lit("Contains generic headings"))),
        ("overview_length", ~F.col("overview_ok"), F.lit(p["overview"]),
         F.array(F.lit("Overview section out of range"))),
        ("schema_validation", ~schema_ok(F.col(schema_json)), F.lit(p["schema"]),
         F.array(F.lit("Schema is missing required fields"))),
        ("links_in_headings", F.col("links_in_headings"), F.lit(p["heading_links"]),
         F.array(F.lit("Detected links in heading tags"))),
        ("internal_links", ~F.col("has_internal_link"), F.lit(p["links"]),
         F.array(F.lit("No internal links detected in output"))),
    )
    total = F.lit(100)
    failed = []
    for check, bad, cost, details in checks:
        total = total - F.when(bad, cost).otherwise(0)
        failed.append(F.when(bad, F.struct(F.lit(check).alias("check"), details.alias("details"))))
    scored = flags.withColumns(
        {
            "eval_score": F.greatest(total, F.lit(0)).cast("long"),
            "failed_checks": F.array_compact(F.array(*failed)),
        }
    )
    return scored.withColumn("eval_retry", F.col("eval_score") < rules.threshold)


def content_score(
    df: DataFrame,
    content: str = "optimized_content",
    schema_present: str = "schema_present",
    rules: ScoringRules = ScoringRules(),
) -> DataFrame:
    """Add ``content_score``, ``missing_entities``, ``missing_headings``,
    ``improvement_suggestions``.

    The row carries its roll-up: ``average_word_count, heading_patterns,
    entity_coverage, faq_patterns``.
    """
    text = text_or_empty(F.col(content))
    prepared = df.withColumns(
        {
            "__words": word_count(tags_to_space(text)),
            "__avg": F.coalesce(F.col("average_word_count"), F.lit(0)),
            "__heading_hits": F.size(listed_in(list_or_empty(F.col("heading_patterns")), text)),
            "__entity_hits": F.size(listed_in(list_or_empty(F.col("entity_coverage")), text)),
            "__faq_hits": F.size(listed_in(list_or_empty(F.col("faq_patterns")), text)),
            "__missing_headings": listed_in(
                first_n(list_or_empty(F.col("heading_patterns")), 10), text, present=False
            ),
            "__missing_entities": listed_in(
                first_n(list_or_empty(F.col("entity_coverage")), 20), text, present=False
            ),
            "__schema": text.rlike(r"""(?i)"@context"\s*:\s*"https://schema.org"|schema\.org""")
            | F.coalesce(F.col(schema_present), F.lit(False)),
            "__links": has_internal_link(text),
            "__sections": F.size(
                F.filter(literal_array(rules.structure_sections), lambda s: text.contains(s))
            ),
        }
    )
    length_ok = (F.col("__avg") <= 0) | (
        (F.col("__words") >= F.col("__avg") * F.lit(0.6))
        & (F.col("__words") <= F.col("__avg") * F.lit(1.4))
    )

    def coverage(hits: str, listed: str, most: int) -> Column:
        n = F.size(list_or_empty(F.col(listed)))
        ratio = F.when(n == 0, 1.0).otherwise(
            F.col(hits) / F.greatest(F.least(F.lit(most), n), F.lit(1))
        )
        return F.least(F.lit(1.0), ratio)

    w = WEIGHTS
    total = (
        F.when(length_ok, w["words"]).otherwise(0)
        + w["headings"] * coverage("__heading_hits", "heading_patterns", 10)
        + w["entities"] * coverage("__entity_hits", "entity_coverage", 15)
        + w["faq"] * coverage("__faq_hits", "faq_patterns", 8)
        + F.when(F.col("__schema"), w["schema"]).otherwise(0)
        + F.when(F.col("__links"), w["links"]).otherwise(0)
        + w["structure"] * (F.col("__sections") / len(rules.structure_sections))
    )
    suggestions = F.array_compact(
        F.array(
            F.when(~length_ok, SUGGEST_LENGTH),
            F.when(~F.col("__schema"), SUGGEST_SCHEMA),
            F.when(~F.col("__links"), SUGGEST_LINKS),
            F.when(F.size("__missing_entities") > 0, SUGGEST_ENTITIES),
            F.when(F.size("__missing_headings") > 0, SUGGEST_HEADINGS),
        )
    )
    scored = prepared.withColumns(
        {
            "content_score": F.least(F.greatest(F.round(total), F.lit(0)), F.lit(100)).cast("long"),
            "missing_entities": first_n(F.col("__missing_entities"), 15),
            "missing_headings": first_n(F.col("__missing_headings"), 10),
            "improvement_suggestions": first_n(suggestions, 8),
        }
    )
    return scored.drop(*[c for c in scored.columns if c.startswith("__")])


def retry_decision(df: DataFrame, rules: ScoringRules = ScoringRules()) -> DataFrame:
    """Add ``needs_retry`` and ``retry_reason`` for an optimisation attempt.

    Needs ``attempt, sections_ok, content_score, eval_retry, missing_entities,
    missing_headings``.
    """
    weak = (
        ~F.col("sections_ok")
        | (F.col("content_score") < rules.threshold)
        | F.col("eval_retry")
    )
    needs = (F.col("attempt") < rules.max_attempts) & weak
    reason = (
        F.when(~needs, None)
        .when(~F.col("sections_ok"), "missing_sections")
        .when(F.size("missing_entities") > 0, "missing_entities")
        .when(F.size("missing_headings") > 0, "missing_headings")
        .otherwise("low_score")
    )
    return df.withColumns({"needs_retry": needs, "retry_reason": reason})
