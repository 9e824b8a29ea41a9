"""Corpus pipeline: five stages from raw documents to token ids.

Language ID, near-duplicate removal, substring dedup, mixing to target weights, BPE encoding. Each stage takes
``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns a DataFrame with the columns of
``documents`` (the last one: token ids). ``run`` writes each result in the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import langid
from sitegrain.llm.bpe import BpeFile, round_trip
from sitegrain.llm.minhash import deduplicated
from sitegrain.llm.mixing import mixed
from sitegrain.llm.substrings import without_repeats
from sitegrain.llm.tables import Scratch, quoted


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; a missing ``lang`` is filled with the prediction.

    What goes are texts that are null or have no letter. The model learns from all rows with text and lang; without
    any, and where it says so, the prediction is ``und``.
    """
    rows = langid.identified(docs, langid.fit(docs), letters="__letters")
    lang = F.when(F.col("lang").isNull(), F.col("lang_pred")).otherwise(F.col("lang"))
    return rows.filter("__letters").withColumn("lang", lang).select(*quoted(docs.columns))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id."""
    return deduplicated(docs)


def first_occurrences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 or more words that occur earlier; documents that lose all words go."""
    rows = without_repeats(docs, whole_texts=True).filter("n_removed = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", length).withColumnRenamed("kept", "text").select(*quoted(docs.columns))


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document comes as often, and with as many words, as the mix reads it.

    Sources meet their targets to the word, so small ones do not vanish.
    """
    return mixed(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*quoted(docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: ids of every text and the digest of what they decode to."""
    file = BpeFile.read(public_tokenizers.path("word_bpe_49k.json"))
    rows = round_trip(docs, file)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("substring dedup", first_occurrences),
    ("mixing sources", weighted_sources),
    ("BPE encoding", token_ids),
]

# SQL cannot express BPE; tests/llm compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
