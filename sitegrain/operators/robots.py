"""robots.txt rules and the pages they block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.functions.text import strip, text_or_empty
from sitegrain.operators.ordered import lookup


def disallow_rules(robots_text: Column) -> Column:
    """Disallow prefixes of ``User-agent: *`` groups, in file order.

    Splitting at User-agent lines gives one chunk per agent line, which governs
    exactly the lines up to the next one.
    """
    chunks = F.split(text_or_empty(robots_text), r"(?im)^[ \t]*User-agent:[ \t]*(?=\S)", -1)
    groups = F.filter(
        F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0))),
        lambda chunk: strip(F.regexp_extract(chunk, r"^([^\r\n]*)", 1)) == "*",
    )
    rules = F.flatten(
        F.transform(
            groups,
            lambda chunk: F.regexp_extract_all(
                chunk, F.lit(r"(?im)^[ \t]*Disallow:[ \t]*([^\r\n]*)"), 1
            ),
        )
    )
    return F.filter(F.transform(rules, strip), lambda r: r != "")


def robots_rules(robots: DataFrame) -> DataFrame:
    """``(origin, rules)`` from ``(origin, body)``; missing files need no row."""
    return robots.select("origin", disallow_rules(F.col("body")).alias("rules"))


def apply_robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``robots_allowed``; origins without rules allow everything."""
    target = F.concat(urls.path(F.col("url")), urls.search(F.col("url")))
    asked = pages.withColumns({"origin": urls.origin(F.col("url")), "__target": target})
    joined = lookup(asked, rules, ["origin"], "url")
    blocked = F.exists("rules", lambda r: F.startswith(F.col("__target"), r))
    return joined.withColumn("robots_allowed", ~F.coalesce(blocked, F.lit(False))).drop(
        "__target", "rules"
    )
