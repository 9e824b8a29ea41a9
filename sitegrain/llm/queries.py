"""Registered queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import langid, more_queries, toxicity
from sitegrain.llm.bpe import BpeFile, decoded, encoded
from sitegrain.llm.forest import nearest
from sitegrain.llm.licenses import BASE, rules, scanned
from sitegrain.llm.minhash import near_duplicates
from sitegrain.llm.mixing import PRIME, MixOptions, mixture, shards_of, taken_words
from sitegrain.llm.simple8b import read_ids, write_ids
from sitegrain.llm.substrings import without_repeats
from sitegrain.llm.vectors import near_vectors
from sitegrain.session import work_folder

BLANK = r"[\x20\x09-\x0D]+"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COMPONENTS_SQL = """
    reach(id, other) AS (
        SELECT a, b FROM links UNION SELECT b, a FROM links
        UNION SELECT r.id, l.other FROM reach r JOIN (SELECT a AS id, b AS other FROM links UNION SELECT b, a FROM links) l
            ON l.id = r.other
    ),
    parts AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf, "documents"))


OP1_SQL = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL}, '{BLANK}'), lambda x: x <> '') AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(
        list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM split
),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),{COMPONENTS_SQL}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN parts ON parts.id = sets.doc_id"""


def op10_recompression(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of what is left of every document without its repeated windows of 20 words."""
    left = without_repeats(table(spark, sf, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = rf"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w FROM documents
),
windows AS (
    SELECT doc_id, p, array_to_string(w[p + 1:p + 20], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS p FROM split)
),
again AS (
    SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(p + 1, p + 21)) AS i FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, (len(s.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
    sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)"""


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mix = mixture(table(spark, sf, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", taken_words().alias("taken"), shards_of().alias("shards"))


def _permuted_sql(x: str, size: str, seed: str, rounds: int) -> str:
    """Subqueries that apply mixing.permuted to column ``x`` of ``{}``."""
    def scrambled(value: str, shift: str, name: str, inner: str) -> str:
        """Adds column ``name``; intermediate values are columns of their own."""
        sql = f"SELECT *, (({value}) % {PRIME} + (({value}) >> 31) + ({shift})) % {PRIME} AS y FROM ({inner})"
        sql = f"SELECT *, (y * y + 40503) % {PRIME} AS z FROM ({sql})"
        return f"SELECT * EXCLUDE (y, z), (z * z) % {PRIME} AS {name} FROM ({sql})"

    sql = "{}"
    for k in range(rounds):
        for i in (1, 2, 3):
            sql = scrambled(seed, str(4 * k + i), f"s{i}", sql)
        sql = f"SELECT *, ((s1 * {PRIME} + s2) % {size} - {x} + {size}) % {size} AS o FROM ({sql})"
        sql = scrambled(f"greatest({x}, o)", "s3", "c", sql)
        sql = f"SELECT * EXCLUDE (s1, s2, s3, o, c) REPLACE (CASE WHEN (c >> 7) % 2 = 1 THEN o ELSE {x} END AS {x}) FROM ({sql})"
    return sql


def _mixing_sql(o: MixOptions) -> str:
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    weights = f"[{', '.join(map(str, o.weights))}]"
    seeds = ", ".join((number.format(f"'{o.seed}/source/' || coalesce('=' || source, 'null')") + " AS seed", number.format(f"'{o.seed}/slots'") + " AS slot_seed"))
    draws = f"SELECT *, k // blocks AS copy, k % blocks AS block, slot0 + k AS slot, {seeds} FROM (SELECT *, unnest(range(quota)) AS k FROM plan WHERE quota > 0)"
    draws = _permuted_sql("slot", "slots", "slot_seed", o.rounds).replace("{}", _permuted_sql("block", "blocks", "seed", o.rounds).replace("{}", draws))
    return rf"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
    SELECT source, source_size, source_size * {o.repeat} AS cap, (sum(source_size) OVER ())::BIGINT * {o.percent} / 100.0::DOUBLE AS total,
        {weights}[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(o.weights)} + 1] AS weight FROM per
),
filled AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS own
    FROM ranked
),
levels AS (SELECT *, CASE WHEN max(cap > own * weight) OVER () THEN max(own) OVER () END AS level FROM filled),
aims AS (
    SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * weight THEN cap::DOUBLE ELSE level * weight END AS target,
        CAST(ceil(source_size / {o.block}) AS BIGINT) AS blocks FROM levels
),
passed AS (SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN blocks > 0 THEN words // source_size ELSE 0 END AS passes FROM aims),
quotas AS (
    SELECT *, words - passes * source_size AS rest, CASE WHEN blocks > 0 THEN passes * blocks
        + CASE WHEN words > passes * source_size THEN least(ceil((words - passes * source_size + blocks * {o.block} - source_size) / {o.block})::BIGINT, blocks) ELSE 0 END
        ELSE 0 END AS quota FROM passed
),
plan AS (
    SELECT *, (sum(quota) OVER ())::BIGINT AS slots,
        coalesce(sum(quota) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS slot0 FROM quotas
),
drawn AS ({draws}),
filled_blocks AS (SELECT *, least({o.block}, source_size - block * {o.block}) AS own FROM drawn),
draws AS (
    SELECT source, block, copy, slot, CASE WHEN copy < passes THEN own ELSE greatest(0, least(own, rest
        - coalesce(sum(own) OVER (PARTITION BY source, copy ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END::BIGINT AS words FROM filled_blocks
),
lanes AS (
    SELECT *, {number.format(f"'{o.seed}/' || coalesce(doc_id::VARCHAR, 'null')")} % {o.lanes} AS lane FROM sizes
),
places AS (
    SELECT *, row_number() OVER () AS id, (sum(size) OVER (PARTITION BY source ORDER BY lane, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS begin FROM lanes
),
parts AS (
    SELECT id, source, size, begin, unnest(range(begin // {o.block}, (begin + size - 1) // {o.block} + 1)) AS block FROM places WHERE size > 0
),
pieces AS (
    SELECT id, least(p.block * {o.block} + d.words - begin, size) - greatest(p.block * {o.block} - begin, 0) AS n, slot // {o.shard_slots} AS shard
    FROM parts p JOIN draws d ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.block
),
taken AS (SELECT id, sum(n)::BIGINT AS taken, count(DISTINCT shard)::BIGINT AS shards FROM pieces WHERE n > 0 GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, 0)::BIGINT AS shards
FROM places p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source LEFT JOIN taken USING (id)"""


def op2_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licence labels of every document: base phrases and signature rules."""
    rows = scanned(table(spark, sf, "documents"))
    names = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(c)["label"] for c in columns)))), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(F.col("base")["first"]).alias("first_word"),
        F.array_max(F.col("base")["first"]).alias("last_word"), names("base").alias("base_labels"), names("base", "detections").alias("labels"),
        F.coalesce(F.array_max(F.col("detections")["confidence"]), F.lit(0.0)).alias("score"),
    )


def _licenses_sql() -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    table = ",\n".join(
        f"({r.number}, {quoted(r.label)}, {listed(r.forms)}, {listed(r.names)}, {quoted(r.pattern)}, {r.priority}, {r.confidence}::DOUBLE)" for r in rules()
    )
    base = ",\n".join(f"({quoted(phrase)}, {quoted(label)})" for phrase, label in BASE)
    blanks = lambda x: f"length({x}) - length(replace({x}, ' ', ''))"
    top = max(r.priority for r in rules())
    order = "PARTITION BY doc_id ORDER BY first, words DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ends = " ".join(f"WHEN priority = {p} THEN coalesce(max(first + words) FILTER (priority >= {p}) OVER ({order}), -1)" for p in range(1, top + 1))
    return rf"""
WITH rules(rule, label, forms, names, pattern, priority, confidence) AS (VALUES {table}),
phrases(phrase, label) AS (VALUES {base}),
split AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
flat AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM split),
places AS (
    SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM split) s
    JOIN phrases p ON array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase
),
ready AS (
    SELECT doc_id, t, rule, label, pattern, priority, confidence FROM flat JOIN rules
        ON len(list_filter(names, lambda x: contains(t, x))) > 0 AND len(list_filter(forms, lambda x: contains(t, x))) > 0
    WHERE regexp_matches(t, pattern)
),
cut AS (SELECT *, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS gaps FROM ready),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut),
found AS (
    SELECT doc_id, rule, label, priority, confidence, ({blanks("array_to_string(gaps[1:i], '')")} + {blanks("array_to_string(hits[1:i - 1], '')")}) // 2 AS first,
        ({blanks("hits[i]")}) // 2 AS words FROM each
),
kept AS (SELECT * FROM found QUALIFY CASE {ends} END < first + words),
named AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM kept)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM split s
LEFT JOIN (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, max(confidence) AS score FROM kept GROUP BY doc_id) USING (doc_id)"""


def op5_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document; a quarter of the documents is held out of training."""
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.fit(docs.filter("not held_out"))
    return langid.identified(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the token ids of every document and of the text decoded from them."""
    file = BpeFile.read(public_tokenizers.path("word_bpe_49k.json"))
    rows = decoded(encoded(table(spark, sf, "documents"), file), file)
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simple8b(spark: SparkSession, sf: str) -> DataFrame:
    """Place and checksum of every document's ids, read back from the files they were written to."""
    path = work_folder(spark, "ids")
    write_ids(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(table(spark, sf, "embeddings"))


OP3_SQL = rf"""
WITH RECURSIVE fit AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS norm FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
usable AS (SELECT * FROM fit WHERE norm > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
    WHERE list_inner_product(x.e, y.e) >= 0.95 * x.norm * y.norm
),{COMPONENTS_SQL},
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN parts p ON p.id = e.vec_id LEFT JOIN counts c ON c.id = e.vec_id"""


def op9_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest neighbours of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Category probabilities of every document; a quarter of the labels is held out of training."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return rows.select("doc_id", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"), F.col("p_low_quality").alias("low_quality_score"))


QUERIES = {"op1_minhash": op1_minhash, "op2_licenses": op2_licenses, "op3_signs": op3_signs, "op4_toxicity": op4_toxicity, "op5_languages": op5_languages, "op6_mixing": op6_mixing, "op7_bpe": op7_bpe, "op8_simple8b": op8_simple8b, "op9_forest": op9_forest, "op10_recompression": op10_recompression} | more_queries.QUERIES
ORACLES = {"op1_minhash": OP1_SQL, "op2_licenses": _licenses_sql(), "op3_signs": OP3_SQL, "op6_mixing": _mixing_sql(MixOptions()), "op10_recompression": OP10_SQL} | more_queries.ORACLES
