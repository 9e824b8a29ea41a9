"""Text operators against brute force, with the odd rows each must stand."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import langid, licenses, mixing, toxicity
from sitegrain.llm.minhash import MinHashOptions, deduplicated, near_duplicates, signature
from sitegrain.llm.substrings import without_repeats
from sitegrain.llm.words import shingle_set, slices

SCHEMA = "doc_id bigint, text string, spans string, kept string, part int"
ODD = [(900, None), (901, ""), (902, " \t\n\x0b "), (903, "one"), (904, "One two"), (905, "one TWO"), (906, "é É é"), (None, "one two")]


def table(spark, rows):
    """Rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "s", "k", 1) for i, t in rows], SCHEMA)


def texts(seed=5, n=160):
    """Texts with exact and near copies, shared passages and periodic runs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    passage = [word() for _ in range(30)]
    out = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.randint(5, 30)]
        if rng.random() < 0.1:
            w += [word()] * rng.randint(2, 60)
        if rng.random() < 0.1:
            w += ["x", "y", "z"] * rng.randint(2, 30)
        out.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return out


def lower(t):
    return (t or "").encode().lower().split()


def brute_near(rows, numerator=75):
    sets = {}
    for i, t in rows:
        w = lower(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    part = {i: i for i, _ in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])
    ]
    while True:
        new = dict(part)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == part:
            return {i: (len(sets[i]), part[i]) for i in sets}
        part = new


def test_minhash_equals_brute_force(spark):
    rows = texts() + ODD
    got = {r.doc_id: r for r in near_duplicates(table(spark, rows + rows[3:5]), MinHashOptions(held=4, streamed=8, beside=2)).collect()}
    want = brute_near([r for r in rows if r[0] is not None])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (i is None or r.component_id == i) for i, r in got.items())
    assert got[None].component_id is None
    kept = [r.doc_id for r in deduplicated(table(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(i for i, (_, p) in want.items() if i == p)


def test_minhash_without_rows(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    assert deduplicated(table(spark, [])).columns == ["doc_id", "text", "spans", "kept", "part"]


def test_dense_group_below_the_threshold(spark):
    """Many texts that are close to one, but not all to each other."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows), MinHashOptions(held=8, streamed=16)).collect()}
    assert got == brute_near(rows)


def test_both_ends_estimate_the_similarity():
    """Equal minima and equal maxima are each as likely as the sets are similar."""
    o = MinHashOptions(bands=400, rows=5)
    a, b = (np.arange(k, k + 400, dtype=np.uint64) * np.uint64(2654435761) for k in (0, 100))
    same = signature(a, o) == signature(b, o)
    half = len(same) // 2
    assert abs(same[:half].mean() - 0.6) < 0.06 and abs(same[half:].mean() - 0.6) < 0.06


def test_words_of_a_slice():
    import pyarrow as pa

    rows = ["a B\tc", None, "", "  x", "y ", "é\x0b\x1c"]
    (s,) = slices(pa.array(rows), lower=True)
    found = [bytes(s.data[a:b]) for a, b in zip(s.starts, s.ends)]
    assert found == [w for t in rows for w in lower(t)] and list(np.diff(s.words)) == [3, 0, 0, 1, 1, 2]
    assert len(shingle_set(s.hashes[:3], 5)) == 1 and len(shingle_set(s.hashes[:0], 5)) == 0
    small = list(slices(pa.array(rows), lower=True, most=4))
    assert len(small) > 1 and np.array_equal(np.concatenate([x.hashes for x in small]), s.hashes)


def brute_repeats(rows, window=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if tuple(w[p : p + window]) in seen:
                gone |= set(range(p, p + window))
            seen.setdefault(tuple(w[p : p + window]), (i, p))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_repeats_equal_brute_force(spark, rounds):
    rows = texts(rounds) + ODD
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(table(spark, rows), rounds=rounds).collect()}
    assert got.pop(None) == (2, 0, "one two")
    assert got == brute_repeats([r for r in rows if r[0] is not None])


def test_repeats_keep_columns_and_empty_tables(spark):
    out = without_repeats(table(spark, texts(2, 20)), whole_texts=True)
    assert out.columns == ["doc_id", "spans", "part", "n_words", "n_removed", "kept"]
    assert without_repeats(table(spark, [])).count() == 0


def test_long_text_of_one_word(spark):
    rows = [(1, "a " * 30_000), (2, "b")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(table(spark, rows)).collect()}
    assert got == brute_repeats(rows) and got[1] == (30_000, 29_999, "a")


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "the Apache License, Version 2.0 and the apache license"),
        (3, "GNU General Public License v3 only, SPDX-License-Identifier: BSD-3-Clause"), (4, "mitlicense summit license"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (6, "mit license " * 3000),
    ] + ODD
    got = {r.doc_id: r for r in licenses.scanned(table(spark, rows)).collect()}
    names = lambda i: sorted({d.label for d in got[i].detections})
    assert names(1) == ["mit"] and [(b.label, b.first) for b in got[1].base] == [("mit", 3)]
    assert [b.first for b in got[2].base] == [1, 8] and "apache-2.0" in names(2)
    assert [b.label for b in got[3].base] == ["gpl"] and "bsd-3-clause" in names(3)
    assert not got[4].base and not got[4].detections
    assert names(5) == ["mit"] and len(got[6].base) == 3000 and got[6].n_words == 6000
    assert got[900].n_words == 0 and got[900].detections == [] and got[906].n_words == 3


def test_signatures_of_versions(spark):
    expected = {
        "the Apache License, Version 2.0": "apache-2.0", "Apache Software License 1.1": "apache-1.1", "Apache-2.0": "apache-2.0", "Apache 2.0 licensed": "apache-2.0",
        "GNU General Public License version 3": "gpl-3.0", "GPLv3": "gpl-3.0", "GPL-3.0": "gpl-3.0", "GPL-2.0-or-later": "gpl-2.0-or-later", "GPL v2 only": "gpl-2.0-only",
        "GNU General Public License, version 2 or (at your option) any later version": "gpl-2.0-or-later", "GPL-3.0-only": "gpl-3.0-only", "gplv2": "gpl-2.0",
        "GNU Lesser General Public License version 2.1": "lgpl-2.1", "LGPL-2.1-or-later": "lgpl-2.1-or-later", "LGPLv3": "lgpl-3.0", "GNU Affero General Public License v3": "agpl-3.0",
        "AGPL-3.0-or-later": "agpl-3.0-or-later", "Mozilla Public License Version 2.0": "mpl-2.0", "MPL-2.0": "mpl-2.0", "MPL 1.1": "mpl-1.1", "Eclipse Public License v2.0": "epl-2.0",
        "EPL-1.0": "epl-1.0", "CDDL-1.0": "cddl-1.0", "EUPL-1.2": "eupl-1.2", "Artistic License 2.0": "artistic-2.0", "Boost Software License 1.0": "boost-1.0", "CC0-1.0": "cc0-1.0",
        "CC BY 4.0": "cc-by-4.0", "CC-BY-SA-3.0": "cc-by-sa-3.0", "Creative Commons Attribution 4.0 International License": "cc-by-4.0", "CC-BY-NC-SA-4.0": "cc-by-nc-sa-4.0",
        "SIL Open Font License 1.1": "ofl-1.1", "ODbL 1.0": "odbl-1.0", "OSL-3.0": "osl-3.0", "PSF": "", "Zope Public License 2.1": "zpl-2.1", "0BSD": "0bsd", "MIT-0": "mit-0",
        "Business Source License 1.1": "busl-1.1", "GNU Free Documentation License 1.3": "gfdl-1.3", "The PHP License": "php", "Universal Permissive License 1.0": "upl-1.0",
        "Redistributions of source code must retain the above copyright notice": "bsd", "You should have received a copy of the GNU Affero General Public License": "agpl",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document": "wtfpl", "a summit in the apaches": "", "version 2.0 of it": "",
    }
    rows = [(i, f"We say: {text}; so it is.") for i, text in enumerate(expected)]
    got = {r.doc_id: sorted({d.label for d in r.detections}) for r in licenses.scanned(table(spark, rows)).collect()}
    assert [(t, got[i]) for i, t in enumerate(expected)] == [(t, [e] if e else []) for t, e in expected.items()]


def test_many_mentions_take_time_in_proportion(spark):
    text = "Under the MIT license, x. " * 30_000
    (row,) = licenses.scanned(table(spark, [(1, text)])).collect()
    assert len(row.base) == len(row.detections) == 30_000 and row.base[-1].first == 5 * 29_999 + 2
    assert licenses.scanned(table(spark, [])).count() == 0


def test_license_suppression(spark):
    """The longest grant holds the title inside it down; nothing left lies in a stronger one."""
    (row,) = licenses.scanned(table(spark, [(1, "distributed under the terms of the GNU General Public License version 2 and more")])).collect()
    ends = [(d.first, d.first + d.words, d.priority) for d in row.detections]
    assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] and b[2] > a[2] for a in ends for b in ends)
    assert len(licenses.rules()) > 200


LANGUAGES = {"en": "the and of with that", "de": "der und nicht schön für", "fr": "le et avec été où", "es": "el y con niño más"}


def language_rows(n=200):
    rng = random.Random(0)
    return [(i, " ".join(rng.choice(LANGUAGES[c].split()) for _ in range(12)), c) for i in range(n) for c in [rng.choice(list(LANGUAGES))]]


def test_languages(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.filter(~held))
    got = {r.doc_id: r for r in langid.identified(docs, model).collect()}
    away = [(i, c) for i, _, c in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == c for i, c in away]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert model.family.classes == ["germanic", "romance"] and model.within["romance"].classes == ["es", "fr"]
    odd = langid.identified(table(spark, ODD + [(907, "123 !?"), (908, "字")]), model)
    assert {r.doc_id for r in odd.collect() if r.lang_pred == "und"} == {900, 901, 902, 907}


def test_only_weights_reach_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame(language_rows(), "doc_id bigint, text string, lang string")
    seen, collect = [], type(docs).collect

    def counted(df):
        rows = collect(df)
        seen.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    model = langid.fit(docs)
    assert model.within["romance"].weights.shape == (4096, 1) and model.within["germanic"].weights.shape == (4096, 1)
    assert sum(seen) == 3 * 4096 * 8  # vectors of the 200 rows stay in the tasks


def test_languages_of_few_rows(spark):
    none = langid.fit(spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id bigint, text string, lang string"))
    assert [r.lang_pred for r in langid.identified(table(spark, [(1, "abc")]), none).collect()] == ["und"]
    one = langid.fit(spark.createDataFrame([(1, "abc", "en")], "doc_id bigint, text string, lang string"))
    assert [r.lang_pred for r in langid.identified(table(spark, [(1, "abc")]), one).collect()] == ["en"]
    assert langid.identified(table(spark, []), one).count() == 0


@pytest.mark.parametrize("lang", [None, "und"])
def test_texts_of_unknown_language_stay_in_the_pipeline(spark, lang):
    docs = spark.createDataFrame([(1, "a clean text", lang), (2, "123", lang), (3, None, lang), (4, "字", None)], "doc_id bigint, text string, lang string")
    got = corpus_pipeline.known_language(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "a clean text", "und"), (4, "字", "und")]


def test_toxicity_chain(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = [f"w{rng.randrange(300)}x" for _ in range(30)]
        bad, low = rng.random() < 0.2, rng.random() < 0.3
        words[3] = rng.choice(["idiot!", "Moron"]) if bad else words[3]
        words[5:7] = ["junk", "junk"] if low else words[5:7]
        rows.append((i, " ".join(words), int(not low), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    labels = docs.select("doc_id", "quality", "toxic").filter("doc_id % 4 <> 2")
    chain = toxicity.fit(docs.select("doc_id", "text"), labels.union(labels.limit(3)))
    got = {r.doc_id: r for r in toxicity.scored(docs, chain).collect()}
    away = [r for r in rows if r[0] % 4 == 2]
    assert all(got[i].is_toxic == bool(bad) for i, _, _, bad in away)
    assert len(chain.links[1].weights) == len(chain.links[1].chosen) + 2  # it sees the first category
    odd = toxicity.scored(table(spark, ODD), chain).collect()
    assert len(odd) == len(ODD) and not any(r.is_toxic for r in odd)
    assert toxicity.scored(table(spark, []), chain).count() == 0


MIXED = "doc_id bigint, text string, source string, row int"


def mix_rows(n=300):
    rng = random.Random(4)
    return [(i % 290, " ".join("abc" for _ in range(rng.choice([0, 3, 50, 400]))), rng.choice(["a", "a", "a", "b", "c", None]), i) for i in range(n)] + [(999, None, "d", 1)]


def test_mixing(spark):
    docs = spark.createDataFrame(mix_rows(), MIXED)
    mix = mixing.mixture(docs, mixing.MixOptions(block=16)).withColumn("taken", mixing.taken_words())
    rows = mix.collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mixture(docs, mixing.MixOptions(block=16)).withColumn("taken", mixing.taken_words()).collect()))
    total = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        t = total.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0], t[1] = t[0] + r.size, t[1] + r.taken
    assert all(size == whole for size, _, _, whole in total.values())
    assert abs(sum(t[2] for t in total.values()) - 1.5 * sum(t[0] for t in total.values())) < 1e-6
    assert all(taken == math.floor(target + 0.5) for _, taken, target, _ in total.values())
    out = mixing.mixed(docs, mixing.MixOptions(block=16))
    assert out.columns == docs.columns
    words = out.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert words == sum(t[1] for t in total.values())


def test_exact_mixing_of_small_sources(spark):
    sizes = {"hot": [700, 900, 500, 40] * 5, "a": [20], "b": [129], "c": [150], "d": [1], "e": [128], None: [60, 0, 71, 5], "f": [0], "z": [3000]}
    rows = [(1000 * n + i, " ".join(f"{n}x{i}x{k}" for k in range(size)), source, i) for n, (source, own) in enumerate(sizes.items()) for i, size in enumerate(own)]
    docs = spark.createDataFrame(rows, MIXED)
    for percent in (100, 150, 190, 400):
        o = mixing.MixOptions(percent=percent)
        got = {}
        for r in mixing.mixture(docs, o).withColumn("taken", mixing.taken_words()).collect():
            assert all(p.words > 0 and p.first + p.words <= r.size for p in r.pieces or [])
            got.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert {s: n for s, (_, n) in got.items()} == {s: math.floor(target + 0.5) for s, (target, _) in got.items()}
        assert all(got[s][1] > 0 for s in sizes if s != "f")
        copies = Counter(w for r in mixing.mixed(docs, o).collect() for w in r.text.split())
        assert max(copies.values()) <= 2 and sum(copies.values()) == sum(n for _, n in got.values())
        # All words of a source are read before one is read again.
        times = {}
        for _, text, source, _ in rows:
            times.setdefault(source, []).extend(copies[w] for w in text.split())
        assert all(max(n) - min(n) <= 1 for n in times.values() if n)


def test_output_shards(spark):
    rows = [(i, " ".join(f"{c}{i}x{k}" for k in range(40 * (i % 7))), c, i) for i in range(140) for c in [random.Random(i).choice("aaaabc")]]
    docs = spark.createDataFrame(rows, MIXED)
    o = mixing.MixOptions(block=8, shard_slots=400)
    slots = mixing.mixed_shards(docs, o).collect()
    mix = mixing.mixture(docs, o).withColumn("taken", mixing.taken_words()).collect()
    assert len({r.slot for r in slots}) == len(slots) and all(r.shard == r.slot // 400 and 0 < len(r.text.split()) <= 8 for r in slots)
    words, whole = {}, {i: t.split() for i, t, _, _ in rows}
    for r in slots:
        words.setdefault(r.source, Counter()).update(r.text.split())
    for r in mix:
        assert r.taken == sum(words[r.source][w] for w in whole[r.doc_id]) if r.size else r.taken == 0
    # Sources share every shard as they share the mix, within what draws without replacement allow.
    all_of, per = Counter(r.source for r in slots), {}
    for r in slots:
        per.setdefault(r.shard, Counter())[r.source] += 1
    assert len(per) > 5
    for shard, count in per.items():
        n = sum(count.values())
        for source, k in all_of.items():
            p = k / len(slots)
            assert abs(count[source] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 3
    spread = [count["b"] for count in list(per.values())[:-1]]
    assert len(set(spread)) > 1


def test_mixing_is_a_permutation(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
        seed = F.lit(123456789012).cast("bigint")
        assert df.select(mixing.permuted(F.col("id"), F.col("n"), mixing.steps(seed, F.col("n"), 12)).alias("x")).distinct().filter("x >= 0").count() == n


def test_mixing_of_nothing(spark):
    assert mixing.mixture(spark.createDataFrame([], MIXED)).count() == 0
    (row,) = mixing.mixture(spark.createDataFrame([(1, None, "a", 1)], MIXED)).collect()
    assert row.target == 0 and row.pieces is None and mixing.mixed(spark.createDataFrame([], MIXED)).count() == 0


def test_digest_of_kept_words(spark):
    out = without_repeats(table(spark, [(1, " a\n b ")])).select(F.sha2("kept", 256)).first()[0]
    assert out == hashlib.sha256(b"a b").hexdigest()
