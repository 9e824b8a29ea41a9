"""Registered queries against their SQL twins on the smallest tables, and the pipeline against brute force."""

import os
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from check import TABLES, rows_of
from sitegrain.llm import queries
from test_text_operators import brute_near, brute_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(name, spark, con):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, got) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_languages_of_held_out_documents(spark, con):
    got = {r.doc_id: r for r in entry.queries()["op5_languages"](spark, SF).collect()}
    rows = con.execute("SELECT doc_id, lang FROM documents").fetchall()
    assert {i for i, _ in rows} == set(got) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    held = [(i, lang) for i, lang in rows if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held)


def test_pipeline(spark, con):
    docs = con.execute("SELECT doc_id, text, source FROM documents ORDER BY 1").fetchall()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, frame, SF)
    left = [(i, t) for i, t, _ in docs if any(map(str.isalpha, t or ""))]
    assert known.columns == frame.columns and sorted(r.doc_id for r in known.collect()) == [i for i, _ in left]

    unique = stages["MinHash near-dedup"](spark, known, SF)
    near = brute_near(left)
    left = [(i, t) for i, t in left if near[i][1] == i]
    assert sorted((r.doc_id, r.text) for r in unique.collect()) == left

    cut = stages["substring dedup"](spark, unique, SF)
    repeats = brute_repeats(left)
    texts = {i: t if not repeats[i][1] else repeats[i][2] for i, t in left if not repeats[i][1] or repeats[i][1] < repeats[i][0]}
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got if repeats[r.doc_id][1])

    mix = stages["mixing sources"](spark, cut, SF).collect()
    taken = {}
    for r in mix:
        words = texts[r.doc_id].encode().split()
        assert set(r.text.encode().split()) <= set(words)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    assert all(n <= 2 * len(texts[i].encode().split()) for i, n in taken.items())
    total = sum(len(t.encode().split()) for t in texts.values())
    assert abs(sum(taken.values()) - 1.5 * total) < 0.05 * total

    ids = stages["BPE encoding"](spark, spark.createDataFrame(mix), SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in mix)
    assert sorted((r.doc_id, r.ids) for r in ids) == want
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == want
