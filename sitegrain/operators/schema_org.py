"""Structured data of pages: FAQ pairs and JSON-LD text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import bind, strip, text_or_empty

_QUESTION = r"^(?i)(?:q:|question:)"
_ANSWER = r"^(?i)(?:a:|answer:)"
_HEADING_QUESTION = r"^#+\s+.*\?$"
CONTEXT = "https://schema.org"
DESCRIPTION_CHARS = 320


def faq_pairs(text: Column) -> Column:
    """``array<struct<question,answer>>`` read from marked lines.

    Only question and answer lines matter. An answer belongs to the marked line
    directly before it, when that is a question with text; so comparing each
    marked line with its predecessor finds all pairs, row by row.
    """
    lines = F.transform(F.split(text_or_empty(text), r"\r?\n"), strip)

    def is_question(line: Column) -> Column:
        return line.rlike(_QUESTION) | line.rlike(_HEADING_QUESTION)

    marked = F.transform(
        F.filter(lines, lambda line: is_question(line) | line.rlike(_ANSWER)),
        lambda line: F.struct(
            is_question(line).alias("asks"),
            F.when(
                is_question(line),
                strip(F.regexp_replace(F.regexp_replace(line, _QUESTION, ""), r"^#+\s+", "")),
            )
            .otherwise(strip(F.regexp_replace(line, _ANSWER, "")))
            .alias("content"),
        ),
    )

    def paired(rows: Column) -> Column:
        before = F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))
        after = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        both = F.zip_with(
            before,
            after,
            lambda q, a: F.struct(
                (q["asks"] & (q["content"] != "") & ~a["asks"] & (a["content"] != "")).alias("ok"),
                q["content"].alias("question"),
                a["content"].alias("answer"),
            ),
        )
        return F.transform(
            F.filter(both, lambda p: p["ok"]),
            lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer")),
        )

    return bind(marked, paired)


def page_schema(df: DataFrame, content: str = "optimized_content", rating: str | None = None) -> DataFrame:
    """Add ``schema_json`` built from page fields and generated content.

    Needs ``url, page_type, title, product_entity, meta_description,
    first_1500_words`` and the content column.
    """
    blank = lambda c: F.nullif(text_or_empty(F.col(c)), F.lit(""))
    text = text_or_empty(F.col(content))
    paired = df.withColumn("__faq", faq_pairs(text))
    web_page = F.to_json(
        F.struct(
            F.lit(CONTEXT).alias("@context"),
            F.lit("WebPage").alias("@type"),
            F.col("url"),
            F.coalesce(blank("title"), blank("url"), F.lit("")).alias("name"),
        )
    )
    questions = F.transform(
        "__faq",
        lambda p: F.struct(
            F.lit("Question").alias("@type"),
            p["question"].alias("name"),
            F.struct(F.lit("Answer").alias("@type"), p["answer"].alias("text")).alias(
                "acceptedAnswer"
            ),
        ),
    )
    fields = [
        F.lit(CONTEXT).alias("@context"),
        F.lit("Product").alias("@type"),
        F.coalesce(blank("product_entity"), blank("title"), F.lit("Product")).alias("name"),
        F.coalesce(
            blank("meta_description"),
            F.substring(text_or_empty(F.col("first_1500_words")), 1, DESCRIPTION_CHARS),
        ).alias("description"),
        F.col("url"),
        F.struct(
            F.lit("Offer").alias("@type"),
            F.lit("USD").alias("priceCurrency"),
            F.lit(f"{CONTEXT}/InStock").alias("availability"),
        ).alias("offers"),
    ]
    if rating:
        fields.append(F.col(rating).alias("aggregateRating"))
    fields.append(
        F.when(
            F.size("__faq") > 0,
            F.struct(
                F.lit(CONTEXT).alias("@context"),
                F.lit("FAQPage").alias("@type"),
                questions.alias("mainEntity"),
            ),
        ).alias("faqPage")
    )
    own = text_or_empty(F.get_json_object(text, "$['@type']"))
    schema = (
        F.when(F.coalesce(F.col("page_type"), F.lit("")) != "pdp", web_page)
        .when(own != "", text)
        .otherwise(F.to_json(F.struct(*fields)))
    )
    return paired.withColumn("schema_json", schema).drop("__faq")
