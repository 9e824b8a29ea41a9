"""Tables whose columns have odd names or types, repeat their rows, hold only nulls or are empty: no operator minds."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitegrain.llm import langid, licenses, lines, mixing, toxicity
from sitegrain.llm.bpe import BpeFile, decoded, encoded
from sitegrain.llm.collocations import collocations
from sitegrain.llm.forest import nearest
from sitegrain.llm.minhash import deduplicated
from sitegrain.llm.simple8b import read_ids, write_ids
from sitegrain.llm.substrings import without_repeats
from sitegrain.llm.turns import repairs
from sitegrain.llm.vectors import near_vectors
from sitegrain.session import work_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, `a.b` string, Score double, N_Words struct<`x.y`:int>, `Lang_Pred` string, `q``t` int, quality int, toxic int"
WORDS = ["red green blue black white over under again", "der die das und nicht schön für mich", "la casa es muy grande y bonita hoy"]


def docs(spark, kind):
    rows = [(i, f"{WORDS[i % 3]} {i}", ["en", "de", "es"][i % 3], "ab"[i % 2], "x", 0.5, (i,), "p", 1, i % 2, int(i % 5 == 0)) for i in range(30)]
    rows = [(6, *r[1:]) for r in rows if r[2] == "en"] * 4 + rows + rows
    rows += [(None,) * 11] * 3 + [(1, *(None,) * 10), (None, "a text", *(None,) * 9)]
    return spark.createDataFrame([] if kind == "empty" else rows, SCHEMA)


def byte_ids(df):
    path = work_folder(df.sparkSession, "ids")
    write_ids(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(df.sparkSession, path)


FILE = BpeFile.read(public_tokenizers.path("word_bpe_49k.json"))
OPERATORS = {
    "deduplicated": deduplicated, "licenses": licenses.scanned, "languages": lambda d: langid.identified(d, langid.fit(d)),
    "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d, d.select("doc_id", "quality", "toxic"))), "mixture": mixing.mixture,
    "bpe": lambda d: decoded(encoded(d, FILE), FILE), "decoded": lambda d: decoded(d.withColumn("ids", F.array(F.lit(1))), FILE), "simple8b": byte_ids,
    "substrings": without_repeats, "lines": lambda d: lines.deduplicated_lines(d, work_folder(d.sparkSession, "t"))[1], "collocations": collocations,
}
PER_ROW = {"licenses", "languages", "toxicity", "mixture", "bpe", "decoded", "simple8b", "substrings", "lines"}


@pytest.mark.parametrize("kind", ["odd rows", "empty"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_text_operators(spark, name, kind):
    df = docs(spark, kind)
    out = OPERATORS[name](df)
    rows = out.collect()
    low = [c.lower() for c in out.columns]
    assert len(low) == len(set(low))
    if name in PER_ROW:
        assert len(rows) == df.count()


@pytest.mark.parametrize("kind", ["odd rows", "empty"])
def test_pipeline_stages(spark, kind):
    df = docs(spark, kind).drop("quality", "toxic").withColumn("n_chars", F.length("text").cast("bigint"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        df = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == df.count()


@pytest.mark.parametrize("kind", ["odd rows", "empty"])
def test_vector_operators(spark, kind):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1, 2.0) for i in range(40)]
    rows = [] if kind == "empty" else rows + rows + [(None, None, None, None), (1, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, `a.b` int, Score double")
    assert near_vectors(df).count() == len(rows)
    nearest(df, F.col("vec_id") % 20 == 0).collect()


@pytest.mark.parametrize("kind", ["odd rows", "empty"])
def test_conversations(spark, kind):
    rows = [(i // 4, i % 4, ["user", "assistant"][i % 2], "Yes.", 1, "x") for i in range(16)]
    rows = [] if kind == "empty" else rows + rows + [(None,) * 6] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, `a.b` int, Cost string")
    assert repairs(df).count() == len({r[0] for r in rows})


def test_a_language_survives_repeated_ids(spark):
    df = docs(spark, "repeated")
    rows = spark.createDataFrame([(6, f"la casa es muy grande {k}", "es") for k in range(2000)] + [(k, "der die das und nicht", "de") for k in range(100, 160)], "doc_id bigint, text string, lang string")
    model = langid.fit(rows)
    assert model.family.classes == ["germanic", "romance"]
    few = langid.fit(rows, langid.LanguageOptions(sample=1))
    assert few.family.classes == ["germanic"]  # of more languages than the sample holds, the largest
