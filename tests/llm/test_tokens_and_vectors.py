"""Token and vector operators against the libraries and brute force."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitegrain.llm import simple8b
from sitegrain.llm.bpe import BpeFile, WordTable, decoded, encoded, round_trip
from sitegrain.llm.forest import ForestOptions, nearest
from sitegrain.llm.tables import Scratch, connected_components
from sitegrain.llm.vectors import SignOptions, near_vectors

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    (1, "<|endoftext|> a<|startoftext|>B ΣΑΣ İ é é \x1c x　y 12³ ½ 'S don't\n\n  z"), (2, None), (3, ""), (4, "<|endoftext|>"),
    (5, "ＡＢＣ ßẞ ǅ 漢字 \U0001f600‍ <| x"), (5, "repeated id"), (None, "no id"), (6, "long " * 50_000),
]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id bigint, text string, decoded string")


def test_word_bpe_equals_the_library(spark):
    file, library = BpeFile.read(WORD), Tokenizer.from_file(WORD)
    rows = decoded(encoded(odd(spark), file), file).collect()
    want = [(i, ids, library.decode(ids, skip_special_tokens=False)) for i, t in ODD for ids in [library.encode(t or "", add_special_tokens=False).ids]]
    assert sorted(((str(r.doc_id), r.ids, r.decoded) for r in rows)) == sorted((str(i), x, d) for i, x, d in want)
    assert encoded(odd(spark).limit(0), file).count() == 0


def test_round_trip_of_word_bpe_equals_both_operators(spark):
    file = BpeFile.read(WORD)
    both, trip = decoded(encoded(odd(spark), file), file), round_trip(odd(spark), file)
    assert trip.schema == both.schema
    rows = lambda d: sorted((str(r.doc_id), r.ids, r.decoded) for r in d.collect())
    assert rows(trip) == rows(both)
    assert round_trip(odd(spark).limit(0), file).count() == 0


def test_pipeline_tokens_take_one_python_process(spark):
    rows = corpus_pipeline.token_ids(spark, odd(spark), "")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


_library, _table = Tokenizer.from_file(WORD), WordTable(open(WORD, encoding="utf-8").read())
_bytes, _encoding = Tokenizer.from_file(BYTE), simple8b.byte_encoding(open(BYTE, encoding="utf-8").read())
plain = st.text(st.characters(codec="utf-8", exclude_categories=("Cn", "Cs")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(plain)
def test_any_text_is_encoded_as_by_the_libraries(text):
    assert list(_table.encode([text])[0]) == _library.encode(text, add_special_tokens=False).ids
    ids = _encoding.encode(text, allowed_special="all")
    assert ids == _bytes.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 40), st.integers(0, 2**17), st.integers(0, 2**64 - 1)), max_size=400))
def test_words_round_trip(values):
    ids = np.array(values, np.uint64)
    offsets, words = simple8b.pack(ids)
    assert (simple8b.unpack(len(ids), offsets, words) == ids).all()


def test_words_are_dense():
    offsets, words = simple8b.pack(np.full(128 * 10, 30_000, np.uint64))
    assert len(words) == 32 * 10 and len(offsets) == 11  # four ids of 15 bits a word
    assert len(simple8b.pack(np.zeros(128, np.uint64))[1]) == 2


def test_id_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    simple8b.write_ids(odd(spark), path, BYTE, files=3)
    library = Tokenizer.from_file(BYTE)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in simple8b.read_ids(spark, path).orderBy("start").collect()]
    assert got == want
    simple8b.write_ids(odd(spark).limit(0), str(tmp_path / "none"), BYTE)
    assert simple8b.read_ids(spark, str(tmp_path / "none")).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, first int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in rows], VECTORS)


def cloud(n=400, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, 64))
    out = [base[int(20 * rng.random() ** 3)] + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.3]) for _ in range(n)]
    out += [out[5], out[5], out[9]]
    return [(i, x.astype(np.float32)) for i, x in enumerate(out)]


UNFIT = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] + [1.0] * 63), (2003, []), (None, [1.0] * 64), (2006, [None] + [1.0] * 63), (2007, [float("inf")] * 64)]


def test_near_vectors_equal_brute_force(spark):
    rows = cloud()
    got = {r.vec_id: r for r in near_vectors(vectors(spark, rows + UNFIT + [(2004, [1.0, 2.0]), (2005, [2.0, 4.0])]), SignOptions(block=32)).collect()}
    x = np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    part = np.arange(len(x))
    while True:
        new = np.minimum(part, np.where(near, part[None, :], len(x)).min(axis=1))
        if (new == part).all():
            break
        part = new
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(near[i].sum()), int(part[i])) for i in range(len(x))]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in UNFIT)
    assert got[2005].component_id == 2004 and near_vectors(vectors(spark, [])).count() == 0


def test_forest_recall_and_order(spark):
    rows = cloud(900, 8)
    got = {}
    for r in nearest(vectors(spark, rows + UNFIT), F.col("vec_id") % 20 == 0, ForestOptions(part_rows=1000, part_queries=16)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = 0
    for q in ids[ids % 20 == 0]:
        near = x @ x[q]
        order = [i for i in np.lexsort((ids, -near)) if i != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in [v for _, v, _ in mine]
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1])) and all(abs(s - near[v]) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(order))
    assert hits / (20 * (ids % 20 == 0).sum()) >= 0.9
    assert set(got) == set(ids[ids % 20 == 0].tolist())


@pytest.mark.parametrize("norms", [(0.1, 1.0), (0.3, 1.0)])
def test_forest_recall_of_mixed_norms(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 32))[rng.integers(0, 20, 6000)] + 0.6 * rng.standard_normal((6000, 32))
    x *= (rng.choice(norms, 6000) / np.sqrt((x * x).sum(axis=1)))[:, None]
    got = {}
    for r in nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 6000, 20)
    near = x[asked] @ x.T
    near[np.arange(300), asked] = -np.inf
    best = np.argpartition(-near, 20, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(b)) / 20 for q, b in zip(asked, best.tolist())]) >= 0.9


def test_forest_ties_go_to_the_smaller_id(spark):
    # Many different vectors tie at the border: each of 300 has a product of 1 with the query. Equal ranges take in all.
    rows = [(0, [1.0] + [0.0] * 20)] + [(1 + i, [1.0] + [float(i >> k & 1) for k in range(20)]) for i in np.random.default_rng(1).permutation(300).tolist()]
    for rows_of_a_part in (64, 32768):
        o = ForestOptions(bits=1, part_rows=rows_of_a_part)
        got = nearest(vectors(spark, rows[::-1]), F.col("vec_id") == 0, o).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 21)]


def test_forest_of_few_and_equal_vectors(spark):
    few = nearest(vectors(spark, [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(20, 1, 1, 1.0), (20, 2, 2, 0.0)]
    many = nearest(vectors(spark, [(i, [3.0, 4.0]) for i in range(100)]), F.col("vec_id") == 40).orderBy("rank").collect()
    assert [r.vec_id for r in many] == list(range(20))
    assert nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, int(k)) for k in rng.integers(200, 400, 150)] + [(5, 5), (399, 160), (1, 2), (2, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect())
    part = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                part[a] = part[b] = min(part[a], part[b])
    assert got == part
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0


def test_stars_need_no_round(spark):
    scratch = Scratch(spark, "test")
    stars = [(1, i) for i in range(2, 50)] + [(60, 61), (62, 60)]
    got = dict(connected_components(spark.createDataFrame(stars[:-1], "a bigint, b bigint"), scratch).collect())
    assert got == {1: 1, 60: 60, 61: 60} | {i: 1 for i in range(2, 50)}
    assert scratch.count == 1  # the edges; no round was written
    assert dict(connected_components(spark.createDataFrame(stars, "a bigint, b bigint"), scratch).collect())[62] == 60
