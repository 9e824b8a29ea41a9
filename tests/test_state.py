"""Tables that are kept up to date, and numbering within hot groups."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain import session
from sitegrain.catalog import text_checks
from sitegrain.operators import links, patterns, serp
from sitegrain.operators.ordered import number_within
from sitegrain.session import work_folder
from sitegrain.sources.keyed_tables import KeyedTable


def test_numbers_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.random()) for k in range(2000)]
    df = spark.createDataFrame(rows, "g STRING, id BIGINT, x DOUBLE").repartition(6)
    got = {r["id"]: r["n"] for r in number_within(df, ["g"], [F.col("x"), F.col("id")], "n").collect()}
    want = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("x", "id"))).collect()}
    assert got == want
    assert number_within(df.limit(0), ["g"], [F.col("x")], "n").count() == 0


def spread(df, column):
    """Tasks that hold rows of the fullest value of a column, just before the last numbering step."""
    return df.groupBy(column, F.spark_partition_id().alias("p")).count().groupBy(column).count().agg(F.max("count")).first()[0]


def test_a_hot_group_is_ranked_in_many_tasks(spark):
    store = spark.range(20_000).select(
        F.lit("pdp").alias("page_type"), F.lit("t").alias("theme"), F.concat(F.lit("s"), "id").alias("signature"), (F.col("id") % 97).alias("usage_count")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        ranked = patterns.rank_patterns(store)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(page_type" in plan and "__part" in plan
        assert spread(ranked, "theme") > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 20_001)) and rows[0]["usage_count"] == 96


def test_one_site_with_most_links(spark):
    pages = [("s.com", f"https://s.com/{k}") for k in range(300)]
    edges = [("s.com", "https://s.com/0", k, f"https://s.com/{300 - k}") for k in range(1, 300)]
    out = links.reachable_pages(
        spark.createDataFrame(pages[:1], "site STRING, url STRING"), spark.createDataFrame(edges, "site STRING, source STRING, pos BIGINT, target STRING"),
        spark.createDataFrame(pages, "site STRING, url STRING"),
    )
    got = [r["url"] for r in out.orderBy("seq").collect()]
    assert got == ["https://s.com/0", *(f"https://s.com/{300 - k}" for k in range(1, 300))]


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k BIGINT, v STRING", ["k"], buckets=16)
    assert table.read().count() == 0
    table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(7, "new"), (5000, "new")], "k BIGINT, v STRING")
    for _ in range(2):  # the second time changes nothing
        table.upsert(new)
        assert table.read().count() == 1001
        assert {r["k"] for r in table.read().filter("v = 'new'").collect()} == {7, 5000}
    assert len({f.split("=")[1].split("/")[0] for f in before if files().get(f) != before[f]}) <= 2
    assert [tuple(r) for r in table.read(new.select("k")).orderBy("k").collect()] == [(7, "new"), (5000, "new")]


def test_cached_intel_looks_up_what_is_missing(spark):
    row = "query STRING, row_pos BIGINT, url STRING, headings ARRAY<STRUCT<tag:STRING,text:STRING>>, paragraph_text STRING, word_count BIGINT, faq_questions ARRAY<STRING>, schema_types ARRAY<STRING>"
    pages = spark.createDataFrame([("mesh", 0, "u", [("h2", "Sizes")], "wind rated mesh", 3, [], [])], row)
    ask = lambda *rows: spark.createDataFrame(list(rows), "query STRING, status STRING, headings ARRAY<STRUCT<tag:STRING,text:STRING>>, text STRING")
    cache = KeyedTable(spark, work_folder(spark, "intel"), serp.INTEL_CACHE, ["cache_key"], buckets=4)
    at = lambda hour: F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.expr(f"interval {hour} hours")
    mesh, lost = ("mesh", "ok", [], "x"), ("lost", "failed", [("h1", "Own")], "own words here")
    look = lambda queries, found, hour: {r["query"]: (r["origin"], r["heading_patterns"]) for r in serp.cached_intel(queries, cache, found, at(hour)).collect()}
    assert look(ask(mesh), pages, 0) == {"mesh": ("results", ["Sizes"])}
    # Within the day the entry holds, though the result pages are gone; a failed lookup is kept like any other.
    assert look(ask(mesh, lost), pages.limit(0), 24) == {"mesh": ("cache", ["Sizes"]), "lost": ("fallback", ["Own"])}
    assert look(ask(mesh, lost, (" Mesh ", "ok", [], "")), pages.limit(0), 25) == {"mesh": ("results", []), " Mesh ": ("results", []), "lost": ("cache", ["Own"])}
    assert cache.read().count() == 2
    assert look(ask(mesh).limit(0), pages, 26) == {}


def test_upserts_keep_one_row_a_key_and_the_files_that_need_no_change(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    for stored in (False, True):
        table = KeyedTable(spark, str(tmp_path / f"t{stored}"), "k BIGINT, v STRING", ["k"], buckets=3)
        want = {}
        for n in range(5):
            if n == 4:
                monkeypatch.setattr("sitegrain.sources.keyed_tables.MANY_FILES", 1)
            new = {k: f"{n}-{k}" for k in rng.sample(range(60), 12)}
            rows = spark.createDataFrame(list(new.items()), "k BIGINT, v STRING").repartition(3)
            if stored:
                rows.write.parquet(path := str(tmp_path / f"rows-{n}"))
                rows = spark.read.parquet(path)
            table.upsert(rows, stored=stored)
            want |= new
            assert sorted(map(tuple, table.read().collect())) == sorted(want.items())
        monkeypatch.undo()
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "u").rglob("*.parquet")}
    table = KeyedTable(spark, str(tmp_path / "u"), "k BIGINT, v STRING", ["k"], buckets=1)
    table.upsert(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = files()
    table.upsert(spark.range(50, 60).select(F.col("id").alias("k"), F.lit("new").alias("v")))
    assert before.items() < files().items() and table.read().count() == 60


def test_cached_intel_writes_what_is_new_and_what_is_answered(spark, tmp_path, monkeypatch):
    """Entries are written as found, in the cache and as an answer from it; texts and pages are not written at all."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = ["\n".join(" ".join(word() for _ in range(8)) for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, ("en", "de")[k % 3 == 0], "src") for k, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda top: sum(f.stat().st_size for f in top.rglob("*.parquet"))
    numbers = iter(range(1000))
    for module in (session, text_checks):
        monkeypatch.setattr(module, "work_folder", lambda _, name: f"{tmp_path}/kept/{name}-{next(numbers)}")
    rows = text_checks.cached_intel(spark, str(tmp_path)).collect()
    assert len(rows) == 800 and {(r["round"], r["origin"]) for r in rows} == {(1, "results"), (2, "cache"), (2, "fallback"), (3, "results"), (3, "cache")}
    (cache,) = (tmp_path / "kept").glob("intel-cache-*")
    assert size(tmp_path / "kept") < 6 * size(cache)


def test_queries_with_one_page_are_rolled_up_like_those_with_several(spark):
    rng = random.Random(9)
    some = lambda n: [rng.choice(["Wind rated", "mesh", "b c", "", None, "Sizes"]) for _ in range(rng.randrange(n))]
    pages, asked = [], [(None, "ok", [], None), ("bare", "ok", [], None), ("q1", "ok", [], None)]
    for k in range(40):
        for at in range(1 if k % 4 else 2):
            text = rng.choice([None, "", " ".join(rng.choice(["wind", "rated", "mesh", "x", "the", "banner"]) for _ in range(rng.randrange(120)))])
            headings = rng.choice([None, [("h2", h) for h in some(80)]])
            pages.append((f"q{k}", rng.choice([at, None]), rng.choice(["u", None]), headings, text, rng.choice([None, 0, 7]), rng.choice([None, some(40)]), some(30)))
        asked.append((f"q{k}", rng.choice(["ok", None]), [], None))
    row = "query STRING, row_pos BIGINT, url STRING, headings ARRAY<STRUCT<tag:STRING,text:STRING>>, paragraph_text STRING, word_count BIGINT, faq_questions ARRAY<STRING>, schema_types ARRAY<STRING>"
    pages = spark.createDataFrame(pages, row)
    asked = spark.createDataFrame(asked, "query STRING, status STRING, headings ARRAY<STRUCT<tag:STRING,text:STRING>>, text STRING")
    want = {r["query"]: tuple(r) for r in serp.aggregate_intel(pages).collect()}
    got = [tuple(r) for r in serp.serp_intel(asked, pages).collect()]
    assert len(got) == 43 and sum(r[0] == "q1" for r in got) == 2
    for r in got:
        assert r == want.get(r[0], (r[0], 0, [], [], [], [], [], [])), r[0]


def test_bucketed_tables_join_without_a_shuffle(spark):
    from sitegrain.operators import runs
    from sitegrain.sources.bucketed import open_bucketed, write_bucketed

    rows = lambda ids, value: spark.createDataFrame([(f"u{k}", value(k), "completed") for k in ids], "url STRING, content_hash STRING, status STRING")
    path = work_folder(spark, "crawl")
    old = write_bucketed(rows(range(50), str), path, ["url"], 8)
    new = write_bucketed(rows(range(25, 80), lambda k: str(k * (k % 2))), work_folder(spark, "crawl"), ["url"], 8)
    again = open_bucketed(spark, path, old.schema, ["url"], 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for before in (old, again):
            out = runs.snapshot_diff(before, new)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
            got = {r["url"]: r["change"] for r in out.collect()}
            assert len(got) == 80 and got["u0"] == "removed" and got["u25"] == "unchanged" and got["u26"] == "changed" and got["u79"] == "new"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
