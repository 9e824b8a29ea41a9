"""Site plans from topics: expansion, page list, navigation, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import topics as Tp
from sitegrain.functions.text import text_or_empty
from sitegrain.operators.ordered import unnest
from sitegrain.vocab import SERP_RULES, SERVICE_EXPANSIONS, SerpRule


def expand_topics(inputs: DataFrame, expansions=SERVICE_EXPANSIONS) -> DataFrame:
    """Add ``base_topic, base_location, service_topics``; inputs have ``topic, location``."""
    parts = Tp.split_topic(F.col("topic"), F.col("location"))
    split = inputs.withColumn("__parts", parts)
    return split.withColumns(
        {
            "base_topic": F.col("__parts.base_topic"),
            "base_location": F.col("__parts.location"),
            "service_topics": Tp.service_topics(F.col("__parts.base_topic"), expansions),
        }
    ).drop("__parts")


def site_pages(inputs: DataFrame, key: Sequence[str], expansions=SERVICE_EXPANSIONS) -> DataFrame:
    """Ordered page list of a planned site: home, services, locations, two blogs."""
    planned = expand_topics(inputs, expansions)
    where = F.col("base_location")
    located = where != ""
    none = F.array().cast("array<struct<page_type:string,topic:string>>")

    def page(kind: str, topic: Column) -> Column:
        return F.struct(F.lit(kind).alias("page_type"), topic.alias("topic"))

    blank = lambda c: F.nullif(text_or_empty(F.col(c)), F.lit(""))
    home = F.array(page("home", F.coalesce(blank("brand"), blank("base_topic"), F.col("topic"))))
    services = F.transform(
        "service_topics",
        lambda t: page("service", F.trim(F.when(located, F.concat_ws(" ", t, where)).otherwise(t))),
    )
    locations = F.when(
        located, F.transform("service_topics", lambda t: page("location", t))
    ).otherwise(none)
    suffix = F.when(located, F.concat(F.lit(" in "), where)).otherwise(F.lit(""))
    blogs = F.transform(
        F.slice("service_topics", 1, 2),
        lambda t: page("blog", F.concat(F.lit("What to Know About "), t, suffix)),
    )
    every = F.concat(home, services, locations, blogs)
    listed = unnest(planned, [*key, "base_location"], every, "page", "pos")
    return listed.select(
        *key,
        "pos",
        F.col("page.page_type").alias("page_type"),
        F.col("page.topic").alias("topic"),
        F.col("base_location").alias("location"),
    )


def navigation(pages: DataFrame) -> DataFrame:
    """Add ``label`` and ``href`` to planned pages."""
    label = F.when(F.col("page_type") == "home", F.lit("Home")).otherwise(F.col("topic"))
    return pages.withColumns(
        {"label": label, "href": Tp.page_path(F.col("page_type"), F.col("topic"))}
    )


def profiles(inputs: DataFrame) -> DataFrame:
    """Content profile columns for ``topic, location, brand, page_type`` rows."""
    profile = Tp.content_profile(
        F.col("topic"), F.col("location"), F.col("brand"), F.col("page_type")
    )
    keep = [c for c in inputs.columns if c not in ("topic", "location", "brand", "page_type")]
    return inputs.withColumn("__profile", profile).select(*keep, "__profile.*")


def serp_expansion(
    inputs: DataFrame, headings: str | None = None, rules: Sequence[SerpRule] = SERP_RULES
) -> DataFrame:
    """Add ``entities, questions, headings`` expected for each topic."""
    given = F.col(headings) if headings else None
    profile = Tp.serp_profile(F.col("topic"), F.col("location"), given, rules)
    keep = [c for c in inputs.columns if c != headings]
    return inputs.withColumn("__serp", profile).select(*keep, "__serp.*")
