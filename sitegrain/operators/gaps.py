"""Content gaps: keywords whose words the site never uses, and what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import contains_any, first_n, hyphen_tokens, text_or_empty, title_case
from sitegrain.operators.ordered import first_occurrence, lookup, top_k, unnest

MISSING_PER_PAGE = 15
THEMES_PER_PAGE = 20
TOPICS_PER_PAGE = 5
REPORTED = 15


def site_vocabulary(pages: DataFrame, group: tuple[str, ...] = ("site",)) -> DataFrame:
    """Distinct tokens of a site's pages: whole text, else stored or visible text, else title."""
    known = [c for c in ("body_text", "first_1500_words", "visible_text", "title") if c in pages.columns]
    text = F.coalesce(*[F.nullif(text_or_empty(F.col(c)), F.lit("")) for c in known])
    tokens = F.array_distinct(hyphen_tokens(text))
    return unnest(pages, list(group), tokens, "token").distinct()


def missing_keywords(
    pages: DataFrame, vocabulary: DataFrame, group: tuple[str, ...] = ("site",)
) -> DataFrame:
    """Add ``missing``: keywords with a token outside the vocabulary, in order.

    ``pages``: group columns, ``idx`` and the ordered ``keywords`` array. Only
    tokens and keyword places travel: asked tokens are made distinct before the
    anti-join, so both of its sides hold a token once however often it is used,
    and the unknown ones meet the places that use them over split keys.
    """
    placed = unnest(pages, [*group, "idx"], F.col("keywords"), "keyword", "place")
    tokens = F.array_distinct(hyphen_tokens(F.col("keyword")))
    used = unnest(placed, [*group, "idx", "place"], tokens, "token")
    unknown = (
        used.select(*group, "token")
        .distinct()
        .join(vocabulary, [*group, "token"], "left_anti")
        .withColumn("unknown", F.lit(True))
    )
    hits = (
        lookup(used, unknown, [*group, "token"], "idx", "inner")
        .groupBy(*group, "idx")
        .agg(F.array_sort(F.collect_set("place")).alias("places"))
    )
    joined = pages.join(hits, [*group, "idx"], "left")
    missing = F.transform("places", lambda p: F.get("keywords", p.cast("int")))
    return joined.withColumn(
        "missing", F.coalesce(missing, F.array().cast("array<string>"))
    ).drop("places")


def page_gaps(flagged: DataFrame, group: tuple[str, ...] = ("site",)) -> DataFrame:
    """Per page: first missing keywords and first themes, in theme order."""
    return flagged.select(
        *group,
        "idx",
        first_n(F.col("missing"), MISSING_PER_PAGE).alias("missing_keywords"),
        F.col("missing").alias("all_missing"),
        first_n(F.col("keywords"), THEMES_PER_PAGE).alias("keyword_themes"),
    )


# fixed values: wording of recommended pages and difficulty words
HARD_WORDS = ("price", "cost", "compare", "best")
EASY_WORDS = ("guide", "how", "tips", "ideas")
INFORMATIONAL_WORDS = ("how", "guide", "tips")
H2_TEMPLATES = (
    ("What to Know About ", ""),
    ("Best Use Cases for ", ""),
    ("", " Pricing and Options"),
    ("How to Choose the Right ", ""),
)
HARD_RANKS = 3


def difficulty(topic: Column, rank: Column) -> Column:
    low = F.lower(text_or_empty(topic))
    return (
        F.when(contains_any(low, HARD_WORDS) | (rank <= HARD_RANKS), "high")
        .when(contains_any(low, EASY_WORDS), "medium")
        .otherwise("low")
    )


def recommend_pages(topics: DataFrame) -> DataFrame:
    """Recommendation columns for rows with ``topic, keywords, topic_rank``."""
    core = F.when(text_or_empty(F.col("topic")) == "", F.lit("opportunity")).otherwise(F.col("topic"))
    named = topics.withColumns({"core": core, "topic_title": title_case(core)})
    name = F.col("topic_title")
    return named.select(
        *[c for c in topics.columns if c not in ("keywords",)],
        F.concat(name, F.lit(" Guide")).alias("title"),
        F.when(contains_any(F.col("core"), INFORMATIONAL_WORDS), "informational")
        .otherwise("commercial")
        .alias("search_intent"),
        first_n(F.col("keywords"), 8).alias("target_keywords"),
        F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in H2_TEMPLATES]).alias(
            "suggested_h2_headings"
        ),
        difficulty(F.col("core"), F.col("topic_rank")).alias("estimated_difficulty"),
    )


def gap_opportunities(
    gaps: DataFrame, limit: int | None = None, group: tuple[str, ...] = ("site",)
) -> DataFrame:
    """Recommendations of each site, one per title, first in page order.

    ``gaps`` is the output of ``page_gaps``. ``limit`` keeps the first ones per site.
    """
    first = first_n(F.col("all_missing"), TOPICS_PER_PAGE)
    topics = unnest(
        gaps, [*group, "idx", F.col("all_missing").alias("keywords")], first, "topic", "pos"
    ).withColumn("topic_rank", F.col("pos") + 1)
    rows = recommend_pages(topics)
    order = [F.col("idx"), F.col("pos")]
    unique = first_occurrence(rows, [*group, "title"], order)
    return unique if limit is None else top_k(unique, list(group), order, limit)
