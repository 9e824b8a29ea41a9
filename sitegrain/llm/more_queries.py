"""Registered queries of line dedup, collocations and conversation repair, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm.collocations import CollocationOptions, collocations
from sitegrain.llm.lines import deduplicated_lines
from sitegrain.llm.turns import damaged, repairs
from sitegrain.session import work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op11_cuckoo(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every document without the lines that an earlier one holds; the index grows by two halves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, rows = deduplicated_lines(docs, work_folder(spark, "line-index"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, {BLANKS_SQL}), '{UPPER}', '{LOWER}') AS key FROM flat),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, coalesce(k.doc_id <> s.first, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op12_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """The phrases of every language that hold together best."""
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))


def _collocations_sql(o: CollocationOptions) -> str:
    return rf"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]+')) AS p FROM low),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS k)),
counts AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(k) AS k, count(*)::BIGINT AS f FROM grams
    GROUP BY lang, phrase HAVING count(*) >= {o.least}
),
candidates AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
parts AS (SELECT *, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM cut),
scored AS (
    SELECT p.lang, p.phrase, p.a, c, l.f AS l, r.f AS r, ((2000000::HUGEINT * p.a) // (l.f + r.f))::BIGINT AS score
    FROM parts p JOIN counts l ON l.lang = p.lang AND l.phrase = p.lp JOIN counts r ON r.lang = p.lang AND r.phrase = p.rp
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_lengths AS (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM candidates),
inner_places AS (SELECT *, unnest(range(1, k - m + 2)) AS i FROM inner_lengths),
around AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_places GROUP BY ALL),
kept AS (
    SELECT w.* FROM worst w LEFT JOIN around x ON x.lang = w.lang AND x.phrase = w.phrase
    WHERE longer IS NULL OR 100::HUGEINT * longer < {o.absorb}::HUGEINT * a
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= {o.top}
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang)"""


def op13_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after its rows are damaged."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return repairs(damaged(rows), rows)


def _audits_sql() -> str:
    """Best edits per state as strings: cost in twelve digits, then the edits."""
    add = lambda s, cost, edit: f"lpad((left({s}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({s}, 13) || '{edit}'"
    keep = lambda s, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(s, 'stay', 'K')} END"
    rerole = lambda s: f"CASE WHEN NOT gone THEN {add(s, 'stay + 1', 'R')} END"
    into_user = ", ".join(f"{keep(s, 'u')}, {rerole(s)}" for s in ("s0", "s1", "s3"))
    turned = f"""
        SELECT conv_id, i, {add('s0', 2, 'D')} AS n0, least({add('s1', 2, 'D')}, {keep('s0', 's')}) AS n1,
            least({add('s2', 2, 'D')}, {into_user}) AS n2, least({add('s3', 2, 'D')}, {keep('s2', 'a')}, {rerole('s2')}) AS n3 FROM {{}}"""
    inserted = (
        f"SELECT *, least(n2, {add('n0', 5, 'I')}, {add('n1', 5, 'I')}, {add('n3', 5, 'I')}) AS m2 FROM ({{}})",
        f"SELECT *, least(n3, {add('m2', 5, 'I')}) AS m3 FROM ({{}})",
        f"SELECT conv_id, i, n0 AS s0, n1 AS s1, least(m2, {add('m3', 5, 'I')}) AS s2, m3 AS s3 FROM ({{}})",
    )

    def closed(sql: str) -> str:
        for step in inserted:
            sql = step.replace("{}", sql)
        return sql

    turn = closed(turned.replace("{}", "(SELECT d.conv_id, r.i, s0, s1, s2, s3, gone, initial, stay FROM dp d JOIN faults r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1)"))
    start = closed("SELECT conv_id, 0::BIGINT AS i, '000000000000' AS n0, NULL::VARCHAR AS n1, NULL::VARCHAR AS n2, NULL::VARCHAR AS n3 FROM convs")
    place = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)"
    return rf"""
WITH RECURSIVE convs AS (SELECT DISTINCT conv_id FROM conversations),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
),
drawn AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384))) % 20 AS fault FROM keyed
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE fault <> 0
),
numbered AS (SELECT *, row_number() OVER ({place}) AS i, rtrim(text, {BLANKS_SQL}) AS solid FROM damaged),
compared AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered
),
faults AS (
    SELECT *, solid = '' AS blank, solid <> '' AND again AS duplicate, solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
        solid = '' OR again AS gone, left(role, 1) AS initial, CASE WHEN solid <> '' AND right(solid, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS stay
    FROM compared
),
sums AS (
    SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
),
dp AS ({start} UNION ALL {turn}),
ends AS (
    SELECT d.conv_id, least(s0, s3) AS best FROM dp d LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id WHERE d.i = coalesce(s.rows, 0)
),
edits AS (SELECT conv_id, unnest(string_split(substr(best, 13), '')) AS edit, unnest(range(length(best) - 12)) AS p FROM ends WHERE length(best) > 12),
placed AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
        count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) - 1 AS e FROM edits
),
turned AS (
    SELECT p.conv_id, p.e, p.edit, r.role, r.text, max(CASE WHEN p.e = 0 AND edit = 'K' AND left(r.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
    FROM placed p LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE edit <> 'D'
),
repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY e) AS t FROM turned GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(best, 12)::BIGINT AS cost, substr(best, 13) AS audit,
    sha256(coalesce(t, '')) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id"""


QUERIES = {"op11_cuckoo": op11_cuckoo, "op12_suffixes": op12_suffixes, "op13_audits": op13_audits}
ORACLES = {"op11_cuckoo": OP11_SQL, "op12_suffixes": _collocations_sql(CollocationOptions()), "op13_audits": _audits_sql()}
