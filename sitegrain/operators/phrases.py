"""Entities and phrases: top words, word pairs and word triples per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import any_of, content_tokens, first_n
from sitegrain.operators.ordered import top_k, unnest
from sitegrain.session import cut_lineage
from sitegrain.vocab import STOPWORDS, Vocabulary

# fixed values: terms kept per n-gram length, phrases kept in total
TOP_TERMS = {1: 30, 2: 30, 3: 20}
TOP_PHRASES = 40


def gram_counts(documents: DataFrame, doc: str, text: str, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """``(doc, n, term, term_count, first_pos)`` for n = 1, 2, 3.

    The text is shuffled once, by document, before it is split; counting and
    ranking then stay inside that partitioning, so the (three times larger)
    stream of n-grams is never shuffled.
    """
    placed = documents.select(doc, text).repartition(doc)
    tokens = placed.select(doc, content_tokens(F.col(text), stopwords).alias("w1"))
    shifted = F.arrays_zip(
        F.col("w1"),
        F.slice("w1", 2, F.greatest(F.size("w1"), F.lit(1))).alias("w2"),
        F.slice("w1", 3, F.greatest(F.size("w1"), F.lit(1))).alias("w3"),
    )
    zipped = unnest(tokens, [doc], shifted, "w", "pos")
    pair = F.when(F.col("w.w2").isNotNull(), F.concat_ws(" ", "w.w1", "w.w2"))
    triple = F.when(F.col("w.w3").isNotNull(), F.concat_ws(" ", "w.w1", "w.w2", "w.w3"))
    grams = zipped.select(
        doc, "pos", F.posexplode(F.array(F.col("w.w1"), pair, triple)).alias("n", "term")
    ).filter("term IS NOT NULL")
    return grams.groupBy(doc, (F.col("n") + 1).alias("n"), "term").agg(
        F.count("*").alias("term_count"), F.min("pos").alias("first_pos")
    )


def top_terms(documents: DataFrame, doc: str, text: str, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Most frequent terms per document and length, ties by first position."""
    order = [F.desc("term_count"), F.col("first_pos")]
    counts = gram_counts(documents, doc, text, stopwords)
    ranked = top_k(counts, [doc, "n"], order, max(TOP_TERMS.values()), "term_rank")
    allowed = F.lit(0)
    for n, limit in TOP_TERMS.items():
        allowed = F.when(F.col("n") == n, limit).otherwise(allowed)
    return ranked.filter(F.col("term_rank") <= allowed)


def _most_frequent(joined: pa.Array) -> pa.Array:
    """Top terms of each length, in rank order, of texts given as tokens joined by a space."""
    out = []
    for text in joined:
        tokens = (text.as_py() or "").split()
        grams = (tokens if n == 1 else zip(*(tokens[k:] for k in range(n))) for n in TOP_TERMS)
        # Equal counts keep the order of first places.
        best = [Counter(g).most_common(k) for g, k in zip(grams, TOP_TERMS.values())]
        out.append([[g if isinstance(g, str) else " ".join(g) for g, _ in row] for row in best])
    return pa.array(out, pa.list_(pa.list_(pa.string())))


def most_frequent(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Top terms of each length of a row's text; select it as a column before it is used twice."""
    return F.arrow_udf(_most_frequent, "array<array<string>>")(F.array_join(content_tokens(text, stopwords), " "))


def listed_terms(best: Column, vocab: Vocabulary = Vocabulary()) -> tuple[Column, Column]:
    """Entities and phrases from a column of :func:`most_frequent`."""
    entities = F.filter(best[0], lambda t: t.rlike(any_of(vocab.entity_terms)))
    return first_n(entities, TOP_PHRASES), first_n(F.concat(best[1], best[2]), TOP_PHRASES)


def _once_and_again(documents: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is theirs alone, and rows that share one."""
    rows = documents.select(doc, text)
    shared = cut_lineage(rows.groupBy(F.col(doc).alias("__doc")).count().filter("count > 1").select("__doc"), "shared-keys")
    same = F.col(doc).eqNullSafe(F.col("__doc"))
    return rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")


def entities_and_phrases(
    documents: DataFrame,
    doc: str,
    text: str,
    vocab: Vocabulary = Vocabulary(),
    stopwords: Sequence[str] = STOPWORDS,
) -> DataFrame:
    """``(doc, kind, pos, term)``: entities are top words that match the
    vocabulary, phrases the top pairs followed by the top triples.

    A document in one row is counted where it lies, one at a time; nothing is
    shuffled or spilled. Only rows that share a key meet by key.
    """
    once, again = _once_and_again(documents, doc, text)
    best = once.select(doc, most_frequent(F.col(text), stopwords).alias("best"))
    entities, phrases = listed_terms(F.col("best"), vocab)
    kinds = F.array(
        *(F.struct(F.lit(kind).alias("kind"), terms.alias("terms")) for kind, terms in (("entity", entities), ("phrase", phrases)))
    )
    listed = best.select(doc, F.explode(kinds).alias("k"))
    quick = unnest(listed, [doc, F.col("k.kind").alias("kind")], F.col("k.terms"), "term", "pos")
    return quick.select(doc, "kind", "pos", "term").unionByName(_merged(again, doc, text, vocab, stopwords))


def _merged(documents: DataFrame, doc: str, text: str, vocab: Vocabulary, stopwords: Sequence[str]) -> DataFrame:
    """The same of documents in several rows, whose counts are added up."""
    terms = top_terms(documents, doc, text, stopwords)
    wanted = terms.filter((F.col("n") > 1) | F.col("term").rlike(any_of(vocab.entity_terms)))
    labelled = wanted.withColumn("kind", F.when(F.col("n") == 1, "entity").otherwise("phrase"))
    return top_k(
        labelled, [doc, "kind"], [F.col("n"), F.col("term_rank")], TOP_PHRASES, "place"
    ).select(doc, "kind", (F.col("place") - 1).cast("long").alias("pos"), "term")
