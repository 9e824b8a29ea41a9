"""Columns that classify topics and plan content around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.text import (
    WORD_END,
    WORD_START,
    bind,
    contains_any,
    first_n,
    list_or_empty,
    literal_array,
    path_slug,
    text_or_empty,
    topic_tokens,
    words,
)
from sitegrain.vocab import (
    DEPTHS,
    INTENTS,
    SERP_RULES,
    SERVICE_EXPANSIONS,
    TONES,
    TOPIC_PAGE_TYPES,
    TOPIC_RULES,
    SerpRule,
)

DEFAULT_TOPIC = "General Service"
_CITY = r"^[A-Z][a-z]+$"
_STATE = r"^[A-Z]{2}$"


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column | str) -> Column:
    """Name of the first rule with a term contained in ``text``."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(list(rules)):
        out = F.when(contains_any(text, terms), name).otherwise(out)
    return F.coalesce(out, default if isinstance(default, Column) else F.lit(default))


def topic_type(topic: Column, page_type: Column) -> Column:
    text = F.lower(F.concat_ws(" ", text_or_empty(topic), text_or_empty(page_type)))
    return first_rule(text, TOPIC_RULES, "local-service")


def literal_map(table: dict[str, str], key: Column, default: str) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def tone(kind: Column) -> Column:
    out = literal_array(TONES["local-service"])
    for name, pair in TONES.items():
        out = F.when(kind == name, literal_array(pair)).otherwise(out)
    return out


def find_location(text: Column) -> Column:
    """``City ST`` when the whole text has that form, else its first occurrence."""

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        cities = F.slice(tokens, 1, F.greatest(n - 1, F.lit(0)))
        whole = (
            (n >= 2)
            & F.coalesce(F.try_element_at(tokens, F.lit(-1)).rlike(_STATE), F.lit(False))
            & F.forall(cities, lambda t: t.rlike(_CITY))
        )
        pattern = rf"{WORD_START}([A-Z][a-z]+)\s([A-Z]{{2}}){WORD_END}"
        city = F.regexp_extract(text, pattern, 1)
        inside = F.when(city != "", F.concat_ws(" ", city, F.regexp_extract(text, pattern, 2)))
        return F.when(whole, F.array_join(tokens, " ")).otherwise(F.coalesce(inside, F.lit("")))

    return bind(words(text_or_empty(text)), of)


def content_profile(topic: Column, location: Column, brand: Column, page_type: Column) -> Column:
    """Struct with topic, page type, location, topic type, tone, intent, depth."""
    t, where = text_or_empty(topic), text_or_empty(location)
    blank = lambda c: F.nullif(c, F.lit(""))
    composite = F.trim(F.concat_ws(" ", blank(t), blank(where)))
    place = F.coalesce(blank(find_location(where)), blank(find_location(composite)))
    given = F.lower(F.trim(text_or_empty(page_type)))
    given = F.when(given == "homepage", F.lit("home")).otherwise(given)
    located = F.when(
        place.isNotNull() | (find_location(t) != ""), F.lit("location")
    ).otherwise(F.lit("service"))
    kind = F.coalesce(blank(given), first_rule(F.lower(t), TOPIC_PAGE_TYPES, located))
    name = F.coalesce(blank(t), blank(composite), F.lit(DEFAULT_TOPIC))

    def of(k: Column) -> Column:
        return bind(
            topic_type(name, k),
            lambda topic_kind: F.struct(
                name.alias("topic"),
                k.alias("page_type"),
                place.alias("location"),
                blank(text_or_empty(brand)).alias("brand"),
                topic_kind.alias("topic_type"),
                tone(topic_kind).alias("tone"),
                literal_map(INTENTS, k, "conversion").alias("intent"),
                literal_map(DEPTHS, k, "medium").alias("content_depth"),
            ),
        )

    return bind(kind, of)


# --- rule expansion -----------------------------------------------------------------

_PRICE = r"(?i)(?:pricing|cost|rates)"
_ASKS = r"(?i)(?:what|how|when|why)"
ENTITY_CAP, QUESTION_CAP = 12, 6


def _scope(topic: Column, location: Column) -> Column:
    return F.lower(F.concat_ws(" ", text_or_empty(topic), text_or_empty(location)))


def _matching(scope: Column, rules: Sequence[SerpRule], part: str) -> list[Column]:
    return [
        F.when(contains_any(scope, r.terms), literal_array(getattr(r, part))).otherwise(
            F.array().cast("array<string>")
        )
        for r in rules
    ]


def serp_headings(topic: Column, location: Column, rules: Sequence[SerpRule] = SERP_RULES) -> Column:
    """Headings of the first matching rule, else four templates."""
    scope = _scope(topic, location)
    t = text_or_empty(topic)
    # fixed values: fallback headings
    out = F.array(
        F.concat(F.lit("Why Choose "), t),
        F.concat(F.lit("What to Expect From "), t),
        F.concat(t, F.lit(" Pricing")),
        F.concat(F.lit("Common Questions About "), t),
    )
    for rule in reversed(list(rules)):
        out = F.when(contains_any(scope, rule.terms), literal_array(rule.headings)).otherwise(out)
    return out


def serp_entities(
    topic: Column, location: Column, headings: Column, rules: Sequence[SerpRule] = SERP_RULES
) -> Column:
    where = text_or_empty(location)
    none = F.array().cast("array<string>")
    of_heading = F.flatten(
        F.transform(
            headings,
            lambda h: F.concat(
                topic_tokens(h), F.when(h.rlike(_PRICE), F.array(F.lit("pricing"))).otherwise(none)
            ),
        )
    )
    place = F.when(where != "", F.array(where, F.lit("local availability"))).otherwise(none)
    every = F.concat(
        topic_tokens(topic), *_matching(_scope(topic, location), rules, "entities"), of_heading, place
    )
    return first_n(F.array_distinct(every), ENTITY_CAP)


def serp_questions(
    topic: Column, location: Column, headings: Column, rules: Sequence[SerpRule] = SERP_RULES
) -> Column:
    t, where = text_or_empty(topic), text_or_empty(location)
    none = F.array().cast("array<string>")
    # fixed values: question wording
    of_heading = F.flatten(
        F.transform(
            headings,
            lambda h: F.concat(
                F.when(
                    h.rlike(_PRICE), F.array(F.concat(F.lit("How does pricing work for "), t, F.lit("?")))
                ).otherwise(none),
                F.when(
                    h.rlike(_ASKS), F.array(F.concat(F.regexp_replace(h, r"\?+$", ""), F.lit("?")))
                ).otherwise(none),
            ),
        )
    )
    place = F.when(
        where != "", F.array(F.concat(F.lit("Do you serve customers in "), where, F.lit("?")))
    ).otherwise(none)
    every = F.array_distinct(
        F.concat(*_matching(_scope(topic, location), rules, "questions"), of_heading, place)
    )
    spare = F.array(
        F.concat(F.lit("What should someone know about "), t, F.lit("?")),
        F.concat(F.lit("How does "), t, F.lit(" work?")),
        F.concat(F.lit("What is the best next step for "), t, F.lit("?")),
    )
    return first_n(F.when(F.size(every) == 0, spare).otherwise(every), QUESTION_CAP)


def serp_profile(
    topic: Column,
    location: Column,
    competitor_headings: Column | None = None,
    rules: Sequence[SerpRule] = SERP_RULES,
) -> Column:
    """Struct of entities, questions and headings expected for a topic."""
    inferred = serp_headings(topic, location, rules)
    chosen = inferred if competitor_headings is None else F.coalesce(competitor_headings, inferred)
    return bind(
        list_or_empty(chosen),
        lambda h: F.struct(
            serp_entities(topic, location, h, rules).alias("entities"),
            serp_questions(topic, location, h, rules).alias("questions"),
            h.alias("headings"),
        ),
    )


# --- site plans ----------------------------------------------------------------------


def split_topic(topic: Column, location: Column) -> Column:
    """Struct ``base_topic, location``: trailing ``City ST`` split off a topic."""
    t, explicit = F.trim(text_or_empty(topic)), F.trim(text_or_empty(location))

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        city, state = F.try_element_at(tokens, F.lit(-2)), F.try_element_at(tokens, F.lit(-1))
        located = (explicit == "") & (n >= 3) & state.rlike(_STATE) & city.rlike(_CITY)
        head = F.array_join(F.slice(tokens, 1, F.greatest(n - 2, F.lit(0))), " ")
        yes = F.coalesce(located, F.lit(False))
        return F.struct(
            F.when(yes, head).otherwise(t).alias("base_topic"),
            F.when(yes, F.concat_ws(" ", city, state)).otherwise(explicit).alias("location"),
        )

    return bind(words(t), of)


def service_topics(
    base_topic: Column, expansions: Sequence[tuple[Sequence[str], Sequence[str]]] = SERVICE_EXPANSIONS
) -> Column:
    """Three service topics by the first matching rule, else three fallbacks."""
    base = F.when(text_or_empty(base_topic) == "", F.lit("Core Service")).otherwise(base_topic)
    # fixed values: fallback wording
    out = F.array(*[F.concat(base, F.lit(s)) for s in (" Services", " Specialists", " Solutions")])
    low = F.lower(text_or_empty(base_topic))
    for terms, topics in reversed(list(expansions)):
        out = F.when(contains_any(low, terms), literal_array(topics)).otherwise(out)
    return out


def page_path(page_type: Column, topic: Column) -> Column:
    slug = path_slug(F.coalesce(F.nullif(text_or_empty(topic), F.lit("")), page_type))
    return F.when(page_type == "home", F.lit("/")).otherwise(
        F.concat(F.lit("/"), page_type, F.lit("/"), slug)
    )
