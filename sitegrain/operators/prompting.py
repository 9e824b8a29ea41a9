"""Batch prompt preparation over scraped records and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.prompts import FIELD_CAPS, safe_prompt, sanitize
from sitegrain.functions.text import strip, text_or_empty, word_count


def normalize_scraped(scraped: DataFrame) -> DataFrame:
    """Sanitised copy of a scraped record with defaults.

    Needs ``title, meta_description, html, first_1500_words, visible_text,
    word_count, product_entity``. The prefix text stands in for visible text.
    """
    text = F.coalesce(F.col("first_1500_words"), F.col("visible_text"), F.lit(""))
    count = F.coalesce(F.nullif(F.col("word_count"), F.lit(0)), word_count(text)).cast("long")
    cleaned = {
        name: sanitize(F.col(name), FIELD_CAPS[name]) for name in ("title", "meta_description", "html")
    }
    body = sanitize(text, FIELD_CAPS["first_1500_words"])
    return scraped.withColumns(
        {
            **cleaned,
            "first_1500_words": body,
            "visible_text": body,
            "word_count": count,
            "product_entity": sanitize(
                strip(text_or_empty(F.col("product_entity"))), FIELD_CAPS["product_entity"]
            ),
        }
    )


def prompt_table(
    records: DataFrame, key: str, text: str, task: str, section: str, max_chars: int = 12000
) -> DataFrame:
    """``(key, prompt)`` with one fenced section of untrusted text per record."""
    prompt = safe_prompt(F.lit(task), [(section, F.col(text))], max_chars=max_chars)
    return records.select(key, prompt.alias("prompt"))
