"""Search-result intelligence: roll-ups per query, insight views, clusters."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import (
    bind,
    first_n,
    holds_any,
    list_or_empty,
    literal_array,
    normalize_keyword,
    text_or_empty,
    text_slug,
    word_count,
)
from sitegrain.operators.ordered import first_occurrence, lookup, top_k, unnest
from sitegrain.operators.phrases import _merged, entities_and_phrases, listed_terms, most_frequent
from sitegrain.session import cut_lineage
from sitegrain.sources.keyed_tables import KeyedTable
from sitegrain.vocab import (
    CLUSTER_GROUPS,
    CLUSTER_SUFFIXES,
    MESH_BANNER_KEYWORDS,
    STOPWORDS,
    Vocabulary,
)

# fixed values: list caps of a roll-up
CAPS = {
    "heading_patterns": 50,
    "entity_coverage": 50,
    "semantic_phrases": 60,
    "faq_patterns": 30,
    "schema_types": 20,
    "top_urls": 10,
}
FALLBACK_HEADINGS = 20
INTEL_LISTS = tuple(CAPS)


def aggregate_intel(
    serp_pages: DataFrame, vocab: Vocabulary = Vocabulary(), stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """One row per query from its result pages.

    ``serp_pages``: ``query, row_pos, url, headings, paragraph_text, word_count,
    faq_questions, schema_types`` with ``row_pos`` unique per query. Every list
    is a distinct union in (row, position) order: every task reduces its values to
    the first ones under the list's cap, which alone are shuffled, and those are
    ranked by their first place per query.
    """
    keyed = serp_pages.withColumn("row_id", F.struct("query", F.col("row_pos").cast("long").alias("row_pos")))
    terms = entities_and_phrases(keyed, "row_id", "paragraph_text", vocab, stopwords)
    mined = terms.select(
        "row_id.query",
        "row_id.row_pos",
        F.when(F.col("kind") == "entity", "entity_coverage")
        .otherwise("semantic_phrases")
        .alias("list"),
        "pos",
        F.col("term").alias("value"),
    )
    listed = serp_pages.select(
        "query",
        F.col("row_pos").cast("long").alias("row_pos"),
        F.explode(
            F.array(
                _named("heading_patterns", F.transform("headings", lambda h: h["text"])),
                _named("faq_patterns", F.col("faq_questions")),
                _named("schema_types", F.col("schema_types")),
                _named("top_urls", F.array("url")),
            )
        ).alias("part"),
    )
    listed = unnest(
        listed, ["query", "row_pos", F.col("part.list").alias("list")], F.col("part.items"), "value", "pos"
    )
    values = mined.unionByName(listed.filter("value IS NOT NULL"))
    values = values.select("query", "row_pos", "list", "pos", "value")
    firsts = values.mapInArrow(_first_values, values.schema).groupBy("query", "list", "value").agg(
        F.min(F.struct("row_pos", "pos")).alias("place")
    )
    ranked = top_k(firsts, ["query", "list"], [F.col("place")], max(CAPS.values()), "n")
    cap = F.lit(0)
    for name, limit in CAPS.items():
        cap = F.when(F.col("list") == name, limit).otherwise(cap)
    kept = ranked.filter(F.col("n") <= cap)
    lists = kept.groupBy("query").agg(
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("list") == name, F.struct("n", "value")))
                ),
                lambda r: r["value"],
            ).alias(name)
            for name in CAPS
        ]
    )
    averages = serp_pages.groupBy("query").agg(
        F.coalesce(F.round(F.avg(F.when(F.col("word_count") > 0, F.col("word_count")))), F.lit(0))
        .cast("long")
        .alias("average_word_count")
    )
    return averages.join(lists, "query", "left").select(
        "query", "average_word_count", *[list_or_empty(F.col(n)).alias(n) for n in CAPS]
    )


HELD_VALUES = 100_000  # values that a task holds; beyond them it passes on what it has


def _first_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first distinct values of each query and list, up to the list's cap, among a task's ``values``.

    A value that has a cap's number of others before it here has them before it in the whole list, too.
    """
    held: dict[tuple, dict] = defaultdict(dict)  # places of the values of a query and list, at most twice the cap
    last: dict[tuple, tuple] = {}  # place that the cap ends at, once it is reached
    size, schema = 0, None

    def cut(key: tuple) -> int:
        own = held[key]
        kept = sorted(own.items(), key=lambda x: x[1])[: CAPS[key[1]]]
        held[key], last[key] = dict(kept), kept[-1][1]
        return len(own) - len(kept)

    def passed() -> pa.RecordBatch:
        for key, own in held.items():
            if len(own) > CAPS[key[1]]:
                cut(key)
        rows = [(q, row, name, pos, value) for (q, name), own in held.items() for value, (_, row, pos) in own.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for query, row, name, pos, value in zip(*(c.to_pylist() for c in batch.columns)):
            key, place = (query, name), (row is not None, row, pos)  # nulls first
            if key in last and place > last[key]:
                continue
            own = held[key]
            if value in own:
                own[value] = min(own[value], place)
                continue
            own[value] = place
            size += 1
            if len(own) >= 2 * CAPS[name]:
                size -= cut(key)
        if size > HELD_VALUES:
            yield passed()
            held.clear()
            last.clear()
            size = 0
    if schema is not None:
        yield passed()


def _named(name: str, items: Column) -> Column:
    return F.struct(F.lit(name).alias("list"), list_or_empty(items).alias("items"))


def fallback_intel(
    failed: DataFrame,
    vocab: Vocabulary = Vocabulary(),
    stopwords: Sequence[str] = STOPWORDS,
    keep: Sequence[str] = (),
    alone: bool = False,
) -> DataFrame:
    """Roll-up of queries whose lookup failed, from the page's own text.

    ``failed``: ``query, headings, text``; one row per query. A query in one row is rolled up where it lies; with
    ``alone`` the caller knows that all are. The columns ``keep`` stay.
    """
    none = F.array().cast("array<string>")
    headings = F.filter(F.transform("headings", lambda h: h["text"]), lambda t: text_or_empty(t) != "")

    def rolled(df: DataFrame, entities: Column, phrases: Column) -> DataFrame:
        return df.select(
            *keep,
            "query",
            word_count(text_or_empty(F.col("text"))).alias("average_word_count"),
            list_or_empty(first_n(headings, FALLBACK_HEADINGS)).alias("heading_patterns"),
            list_or_empty(entities).alias("entity_coverage"),
            list_or_empty(phrases).alias("semantic_phrases"),
            none.alias("faq_patterns"),
            none.alias("schema_types"),
            none.alias("top_urls"),
        )

    def in_place(df: DataFrame) -> DataFrame:
        terms = [F.when(F.col("query").isNotNull(), listed) for listed in listed_terms(F.col("best"), vocab)]
        return rolled(df.withColumn("best", most_frequent(F.col("text"), stopwords)), *terms)

    if alone:
        return in_place(failed)
    shared = cut_lineage(failed.groupBy(F.col("query").alias("__query")).count().filter("count > 1").select("__query"), "shared-keys")
    same = F.col("query").eqNullSafe(F.col("__query"))
    once, again = failed.join(shared, same, "left_anti"), failed.join(shared, same, "left_semi")
    terms = _merged(again, "query", "text", vocab, stopwords)
    lists = terms.groupBy("query").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "term")))),
                lambda r: r["term"],
            ).alias(name)
            for kind, name in (("entity", "entity_coverage"), ("phrase", "semantic_phrases"))
        ]
    )
    merged = again.join(lists, "query", "left")
    return in_place(once).unionByName(rolled(merged, F.col("entity_coverage"), F.col("semantic_phrases")))


def serp_intel(
    queries: DataFrame,
    serp_pages: DataFrame,
    vocab: Vocabulary = Vocabulary(),
    stopwords: Sequence[str] = STOPWORDS,
) -> DataFrame:
    """Roll-up per query by its lookup status.

    ``queries``: ``query, status, headings, text``. Status ``failed`` uses the
    page's own text; any other status uses the result pages, and a query
    without result pages yields empty lists.
    """
    failed = queries.filter("status = 'failed'").select("query", "headings", "text")
    served = queries.filter("status <> 'failed' OR status IS NULL").select("query")
    return _served_intel(served, serp_pages, vocab, stopwords).unionByName(fallback_intel(failed, vocab, stopwords))


def _served_intel(served: DataFrame, serp_pages: DataFrame, vocab: Vocabulary, stopwords: Sequence[str]) -> DataFrame:
    """Roll-up of each row of ``served`` (``query`` and more columns, which stay) from the result pages of its query.

    Only asked result pages are tokenised. The page of a query that has one meets it once and is rolled up there;
    only the values of queries with several pages meet again.
    """
    keep = served.columns
    asked = served.select("query").distinct()
    counts = serp_pages.select("query").join(asked, "query", "left_semi").groupBy("query").agg(F.count("*").alias("__pages"))
    counts = cut_lineage(counts, "page-counts")
    counted = served.join(counts, "query", "left")
    none = F.array().cast("array<string>")
    full = counted.filter("__pages IS NULL").select(*keep, F.lit(0).cast("long").alias("average_word_count"), *[none.alias(n) for n in CAPS])
    several = {r["several"] for r in counts.select((F.col("__pages") > 1).alias("several")).distinct().collect()}
    if False in several:
        alone = counted.filter("__pages = 1").drop("__pages").join(serp_pages, "query")
        full = full.unionByName(_page_intel(alone, vocab, stopwords, keep))
    if True in several:
        asked = serp_pages.join(counts.filter("__pages > 1").select("query"), "query", "left_semi")
        full = full.unionByName(served.join(aggregate_intel(asked, vocab, stopwords), "query"))
    return full


def _page_intel(pages: DataFrame, vocab: Vocabulary, stopwords: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """:func:`aggregate_intel` of queries with one page each, row by row."""
    counted = pages.withColumn("best", most_frequent(F.col("paragraph_text"), stopwords))
    entities, phrases = listed_terms(F.col("best"), vocab)
    lists = {
        "heading_patterns": F.transform("headings", lambda h: h["text"]),
        "entity_coverage": entities,
        "semantic_phrases": phrases,
        "faq_patterns": F.col("faq_questions"),
        "schema_types": F.col("schema_types"),
        "top_urls": F.array("url"),
    }
    words = F.round(F.when(F.col("word_count") > 0, F.col("word_count")).cast("double"))
    return counted.select(
        *keep,
        F.coalesce(words, F.lit(0)).cast("long").alias("average_word_count"),
        *[first_n(F.array_distinct(F.array_compact(list_or_empty(lists[n]))), limit).alias(n) for n, limit in CAPS.items()],
    )


def insights(intel: DataFrame, themes: int = 20) -> DataFrame:
    """Insight view of a roll-up; the full audit keeps 24 themes, others 20."""
    return intel.select(
        "query",
        first_n(F.col("semantic_phrases"), themes).alias("keyword_themes"),
        F.col("heading_patterns").alias("common_headings"),
        F.col("average_word_count").alias("avg_word_count"),
        "faq_patterns",
        F.col("entity_coverage").alias("related_entities"),
        F.when(F.size("schema_types") > 0, "yes").otherwise("unknown").alias(
            "structured_data_presence"
        ),
        "schema_types",
        "top_urls",
    )


def entity_key(entity: Column, page_type: Column) -> Column:
    """Uncut slug under which pages share one roll-up."""
    source = F.coalesce(
        F.nullif(text_or_empty(entity), F.lit("")),
        F.nullif(text_or_empty(page_type), F.lit("")),
        F.lit("generic"),
    )
    return text_slug(source, limit=None)


def intel_requests(pages: DataFrame) -> DataFrame:
    """One request per site and entity key; the first page in site order supplies it.

    ``pages``: ``site, idx, url, title, page_type, product_entity, headings`` and ``body_text`` (or ``first_1500_words``,
    which stands in where there is no ``body_text``).
    """
    text = "body_text" if "body_text" in pages.columns else "first_1500_words"
    keyed = pages.withColumn("entity_key", entity_key(F.col("product_entity"), F.col("page_type")))
    first = first_occurrence(keyed, ["site", "entity_key"], [F.col("idx"), F.col("url")])
    query = F.coalesce(
        F.nullif(text_or_empty(F.col("product_entity")), F.lit("")),
        F.nullif(text_or_empty(F.col("title")), F.lit("")),
        F.col("url"),
    )
    return first.select(
        "site",
        "entity_key",
        F.col("idx").alias("request_idx"),
        F.col("url").alias("request_url"),
        F.lower(F.trim(query)).alias("query"),
        "page_type",
        "headings",
        F.col(text).alias("text"),
    )


def attach_by_entity(pages: DataFrame, per_key: DataFrame) -> DataFrame:
    """Join a table with one row per site and entity key back to all pages."""
    keyed = pages.withColumn("entity_key", entity_key(F.col("product_entity"), F.col("page_type")))
    return lookup(keyed, per_key, ["site", "entity_key"], "idx")


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text_or_empty(query))), 256), 1, 16)


def fresh_cache_entries(cache: DataFrame, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    """Latest entry per key that is at most ``ttl_hours`` old at ``as_of``.

    ``cache``: ``cache_key, fetched_at, …``. An entry exactly at the limit is
    still fresh.
    """
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    fresh = cache.filter(age <= ttl_hours * 3600 * 1_000_000)
    return first_occurrence(fresh, ["cache_key"], [F.desc("fetched_at")])


INTEL_CACHE = "cache_key string, fetched_at timestamp, average_word_count bigint, " + ", ".join(f"{name} array<string>" for name in CAPS)


def cached_intel(
    queries: DataFrame,
    cache: KeyedTable,
    serp_pages: DataFrame,
    as_of: Column,
    ttl_hours: int = 24,
    vocab: Vocabulary = Vocabulary(),
    stopwords: Sequence[str] = STOPWORDS,
) -> DataFrame:
    """Roll-up per query, kept up to date in ``cache``: ``query, origin`` and the columns of :func:`serp_intel`.

    ``queries``: ``query, status, headings, text``, one row per query. A query whose key has a fresh entry takes that
    (``cache``). Only the others are looked up: their result pages are tokenised (``results``), or their own text
    where the lookup failed (``fallback``). Both replace the entry of their key; of queries with one key the first
    in order is looked up for all. Only buckets with asked keys are read, only those with replaced entries rewritten.
    """
    # Texts and headings stay where they are until it is known which are needed.
    keyed = queries.withColumn("cache_key", query_hash(F.col("query")))
    asked = cut_lineage(keyed.select("query", "cache_key", "status"), "asked")
    fresh = fresh_cache_entries(cache.read(asked.select("cache_key")), as_of, ttl_hours)
    lists = ["average_word_count", *CAPS]
    # What is in the cache now is read before the new entries go in.
    known = asked.select("query", "cache_key").join(fresh, "cache_key").select("query", F.lit("cache").alias("origin"), *lists)
    known = cut_lineage(known, "known")
    lacking = asked.join(fresh.select("cache_key"), "cache_key", "left_anti")
    times = lacking.groupBy("cache_key").agg(F.count("*").alias("__times"))
    missing = first_occurrence(lacking, ["cache_key"], [F.col("query")]).join(times, "cache_key")
    missing = cut_lineage(missing.filter("query IS NOT NULL"), "missing")
    found = _looked_up(missing, keyed, serp_pages, vocab, stopwords).withColumn("fetched_at", as_of.cast("timestamp"))
    found = cut_lineage(found, "found")
    cache.upsert(found, stored=True)
    # An entry that one row asks for is its answer; only those of several rows meet these by key.
    once = found.filter("__times = 1").select("query", "origin", *lists)
    several = found.filter("__times > 1").drop("query")
    return known.unionByName(once).unionByName(asked.select("query", "cache_key").join(several, "cache_key").select("query", "origin", *lists))


def _looked_up(missing: DataFrame, keyed: DataFrame, serp_pages: DataFrame, vocab: Vocabulary, stopwords: Sequence[str]) -> DataFrame:
    """New entries of ``missing``, a stored table ``cache_key, query, status, __times`` with one row per key.

    Pages and own texts are read only if some of the lookups need them.
    """
    failed = missing.filter("status = 'failed'")
    served = missing.filter("status <> 'failed' OR status IS NULL").drop("status")
    parts = []
    if not failed.isEmpty():
        chosen = failed.select("cache_key", F.col("query").alias("__chosen"), "__times")
        texts = keyed.filter("status = 'failed'").join(chosen, "cache_key").filter(F.col("query") == F.col("__chosen"))
        texts = first_occurrence(texts, ["cache_key"], [F.col("query")]).select("cache_key", "__times", "query", "headings", "text")
        parts.append(fallback_intel(texts, vocab, stopwords, ["cache_key", "__times"], alone=True).withColumn("origin", F.lit("fallback")))
    if not (parts and served.isEmpty()):
        parts.append(_served_intel(served, serp_pages, vocab, stopwords).withColumn("origin", F.lit("results")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --- keyword expansion and clusters ------------------------------------------------


def keyword_expansion(entity: Column) -> Column:
    """Five related keywords of a product entity."""
    low = F.lower(text_or_empty(entity))
    base = F.when(low == "", F.lit("custom product")).otherwise(low)
    # fixed values: expansion wording
    general = F.array(
        F.concat(base, F.lit(" printing")),
        F.concat(F.lit("custom "), base),
        F.concat(base, F.lit(" design")),
        F.concat(base, F.lit(" sizes")),
        F.concat(base, F.lit(" for business")),
    )
    return F.when(base.contains("mesh banner"), literal_array(MESH_BANNER_KEYWORDS)).otherwise(general)


def base_variants(core: Column) -> Column:
    """Five variants of a normalised keyword."""
    word = normalize_keyword(core)
    short = F.when(word == "", F.lit("custom product")).otherwise(word)
    return bind(
        short,
        lambda s: F.array(*[F.concat(s, F.lit(f" {suffix}")) for suffix in CLUSTER_SUFFIXES]),
    )


def keyword_clusters(
    pages: DataFrame,
    themes: str = "themes",
    groups: Sequence[tuple[str, Sequence[str]]] = CLUSTER_GROUPS,
    per_group: int = 8,
) -> DataFrame:
    """Add ``core_keyword`` and ``clusters: array<struct<topic,keywords>>``.

    ``pages`` has ``product_entity``, ``headings`` and the ``themes`` array.
    Row-local: the groups are a fixed short list.
    """
    first_heading = F.try_element_at("headings", F.lit(1))["text"]
    name = F.coalesce(
        F.nullif(text_or_empty(F.col("product_entity")), F.lit("")),
        F.nullif(text_or_empty(first_heading), F.lit("")),
        F.lit("product"),
    )
    cored = pages.withColumn("core_keyword", normalize_keyword(name))
    normal = F.filter(
        F.transform(list_or_empty(F.col(themes)), normalize_keyword), lambda t: t != ""
    )
    short = F.coalesce(F.nullif(F.col("core_keyword"), F.lit("")), F.lit("custom product"))
    variants = F.array(*[F.concat_ws(" ", short, F.lit(x)) for x in CLUSTER_SUFFIXES])
    sourced = cored.withColumn("__source", F.array_distinct(F.concat(normal, variants)))

    def cluster(topic: str, terms: Sequence[str]) -> Column:
        found = F.filter("__source", lambda p: holds_any(p, terms))
        # The core keyword is normal already, so its variants need no cleaning.
        base = F.concat_ws(" ", F.nullif(F.col("core_keyword"), F.lit("")), F.lit(topic))
        spare = F.array(*[F.concat_ws(" ", base, F.lit(x)) for x in CLUSTER_SUFFIXES[:3]])
        chosen = bind(found, lambda f: F.when(F.size(f) == 0, spare).otherwise(first_n(f, per_group)))
        return F.struct(F.lit(topic).alias("topic"), chosen.alias("keywords"))

    return sourced.withColumn("clusters", F.array(*[cluster(t, w) for t, w in groups])).drop(
        "__source"
    )
