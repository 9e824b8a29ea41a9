from pyspark.sql import functions as F

from sitegrain.operators import patterns as Pt
from sitegrain.operators import planning, quality, robots, runs, strategy
from sitegrain.operators.quality import Field

c = F.col


def test_robots(spark):
    body = (
        "# c\nUser-agent: *\nDisallow:\nDisallow: /a \nAllow: /a/x\r\nDisallow: /q?x=1\n"
        "User-agent: bot\nDisallow: /\nUser-Agent:*\n# Disallow: /n\nDisallow: /z"
    )
    rules = robots.robots_rules(spark.createDataFrame([("https://s.com", body)], "origin STRING, body STRING"))
    assert rules.first()["rules"] == ["/a", "/q?x=1", "/z"]
    urls = {"https://s.com/a/x": False, "https://s.com/q?x=12": False, "https://s.com/q": True,
            "https://s.com/Z": True, "https://S.com/z": False, "https://t.com/a": True, "https://s.com/n": True}
    pages = spark.createDataFrame([(u,) for u in urls], "url STRING")
    got = {r["url"]: r["robots_allowed"] for r in robots.apply_robots(pages, rules).collect()}
    assert got == urls


def test_resume(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "url STRING")
    made = spark.createDataFrame([("a", "optimized"), ("a", "schema"), ("b", "optimized"), ("b", "optimized")], "url STRING, type STRING")
    assert sorted(r[0] for r in runs.pages_to_process(pages, made).collect()) == ["b", "c"]
    assert sorted(r[0] for r in runs.pages_to_process(pages, made, ["optimized"]).collect()) == ["c"]


def test_unchanged_and_diff(spark):
    snaps = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "x"), (4, 3, "z")], "id BIGINT, page_id BIGINT, content_hash STRING")
    now = spark.createDataFrame([(1, "x"), (2, "x"), (3, "z")], "page_id BIGINT, content_hash STRING")
    made = spark.createDataFrame([(1,), (2,)], "page_id BIGINT")
    assert [r["page_id"] for r in runs.unchanged_pages(now, snaps, made).collect()] == [2]


def test_cost(spark):
    df = spark.createDataFrame([("claude-sonnet-4-20250514", 1000, 10), ("who", None, 1000), (None, 1, None)], "m STRING, i BIGINT, o BIGINT")
    got = [r[0] for r in df.select(runs.model_cost(c("m"), c("i"), c("o"))).collect()]
    assert got == [0.00315, 0.005, 0.000001]


def test_number_rows_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = runs.number_rows(df.repartition(7), [F.col("k")], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_get_or_create(spark):
    have = spark.createDataFrame([(5, "a"), (9, "b")], "id BIGINT, name STRING")
    want = spark.createDataFrame([("b", 1), ("d", 3), ("c", 2), ("d", 4)], "name STRING, seq BIGINT")
    got = {r["name"]: r["id"] for r in runs.get_or_create(have, want, ["name"], [F.col("seq")]).collect()}
    assert got == {"a": 5, "b": 9, "c": 10, "d": 11}


def test_finish_runs(spark):
    schema = "id BIGINT, finished_at STRING, status STRING, mode STRING, prompt_version STRING, template_version STRING, model STRING"
    started = runs.create_runs(spark.createDataFrame([(1, None, "", None, "p1", None, None), (2, None, None, "pdp", None, None, "m")], schema))
    updates = spark.createDataFrame([(1, "t", "completed", "", "p2", None, "m2")], schema)
    got = [tuple(r) for r in runs.finish_runs(started, updates).orderBy("id").collect()]
    assert got == [(1, "t", "completed", "full", "p2", "unknown", "m2"), (2, None, "running", "pdp", "unknown", "unknown", "m")]


def test_reports(spark):
    rows = [("r", "a", "completed", True, None), ("r", "b", "failed", True, ""), ("r", "c", "skipped", None, "m"), ("r", "d", "failed", False, "boom")]
    df = spark.createDataFrame(rows, "run_id STRING, url STRING, status STRING, product_page BOOLEAN, error STRING")
    assert tuple(runs.run_report(df).first()) == ("r", 4, 1, 1, 2, 1, 2)
    assert sorted((r["url"], r["error"]) for r in runs.run_errors(df).collect()) == [("b", "failed"), ("d", "boom")]


def test_keyword_gaps_use_first_audit(spark):
    clusters = spark.createDataFrame([("a", 1, "u", 0, "t", ["Mesh", "vinyl"]), ("a", 2, "v", 0, "t", ["x"]), ("b", 1, "u", 0, "t", ["y"])], "site STRING, idx BIGINT, url STRING, topic_pos INT, topic STRING, keywords ARRAY<STRING>")
    audits = spark.createDataFrame([("a", 1, "u", "has mesh"), ("a", 2, "u", "has vinyl")], "site STRING, idx BIGINT, url STRING, seo_recommendations STRING")
    got = sorted((r["site"], r["url"], r["missing_keywords"]) for r in strategy.keyword_gaps(clusters, audits).collect())
    assert got == [("a", "u", ["vinyl"]), ("a", "v", ["x"]), ("b", "u", ["y"])]
    # A limit holds per site.
    first = strategy.keyword_gaps(clusters, audits, limit=1).collect()
    assert sorted((r["site"], r["url"]) for r in first) == [("a", "u"), ("b", "u")]


def test_whole_text_decides_that_a_page_changed(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    pages = spark.createDataFrame(
        [("t", "d", text + end, []) for end in (" old", " new", " old")],
        "title STRING, meta_description STRING, body_text STRING, headings ARRAY<STRUCT<tag:STRING,text:STRING>>",
    )
    a, b, c_ = [r[0] for r in pages.select(runs.content_hash()).collect()]
    assert a == c_ and a != b


def test_blog_topics_of_every_site(spark):
    rows = [(s, i, 0, "item", "pricing") for s in "ab" for i in range(20)]
    patterns = spark.createDataFrame(rows, "site STRING, idx BIGINT, pos INT, core_keyword STRING, pattern STRING")
    assert sorted((r["site"], r["idx"]) for r in strategy.blog_topics(patterns).collect()) == [("a", 0), ("b", 0)]


def test_all_patterns_are_ranked(spark):
    store = spark.createDataFrame([(f"s{i:03d}", "home", "gym", 1) for i in range(250)], "signature STRING, page_type STRING, theme STRING, usage_count BIGINT")
    assert Pt.rank_patterns(store).count() == 250


def test_patterns(spark):
    sections = "ARRAY<STRUCT<component:STRING,variant:STRING>>"
    uses = spark.createDataFrame(
        [("home", "gym", [("hero", "a"), ("cta", "b")], "2024-01-02"), ("home", "gym", [("hero", "a"), ("cta", "b")], "2024-01-03")],
        f"page_type STRING, theme STRING, sections {sections}, used_at STRING",
    )
    store = spark.createDataFrame(
        [(f"s{i}", "home", "gym", 1, f"2023-01-01 {i:03d}") for i in range(205)],
        "signature STRING, page_type STRING, theme STRING, usage_count BIGINT, last_used STRING",
    )
    assert Pt.record_patterns(store, uses).count() == 206
    kept = Pt.record_patterns(store, uses, size=Pt.STORE_SIZE)
    rows = kept.collect()
    assert len(rows) == 200
    assert (rows[0]["signature"], rows[0]["usage_count"]) == ("home::gym::hero|cta::hero:a|cta:b", 2)
    bands = spark.createDataFrame([(1,), (3,), (6,), (None,)], "u BIGINT").select(Pt.confidence(c("u")))
    assert [r[0] for r in bands.collect()] == ["low", "medium", "high", "low"]
    requests = spark.createDataFrame([(1, "home", "gym"), (2, "x", "gym")], "id BIGINT, page_type STRING, theme STRING")
    assert all(r["signature"] is None for r in Pt.preferred_patterns(requests, kept, "id").collect())
    three = kept.limit(1).withColumn("usage_count", F.lit(3).cast("long"))
    got = {r["id"]: r["confidence"] for r in Pt.preferred_patterns(requests, three, "id").collect()}
    assert got == {1: "medium", 2: None}


def test_structure(spark):
    page = (
        "<section><h1>Welcome</h1><p>a</p><img></section><section><h2>Why Choose Us</h2><h3>Benefits</h3></section>"
        "<section><h2>Reviews</h2><img></section><section><h2>Get Started</h2><img><img><a href=x>Join <b>now</b></a><button>b</button></section>"
    )
    row = Pt.structure_signals(spark.createDataFrame([(page,)], "html STRING")).first()
    assert row["dominant_sections"] == ["benefits", "hero", "testimonials", "cta"]
    assert (row["layout_preference"], row["section_density"], row["cta_frequency"]) == ("visual", "low", "medium")


def test_site_plan(spark):
    df = spark.createDataFrame(
        [(1, "Physical Therapy Alexandria MN", None, None), (2, "Gym Home Page", None, "Workout 24/7")],
        "id INT, topic STRING, location STRING, brand STRING",
    )
    expanded = planning.expand_topics(df).orderBy("id").collect()
    assert expanded[0]["base_topic"] == "Physical Therapy" and expanded[0]["base_location"] == "Alexandria MN"
    assert expanded[0]["service_topics"] == ["Dry Needling", "Manual Therapy", "Sports Injury Therapy"]
    pages = planning.navigation(planning.site_pages(df, ["id"])).filter("id = 1").orderBy("pos").collect()
    assert [r["page_type"] for r in pages] == ["home"] + ["service"] * 3 + ["location"] * 3 + ["blog"] * 2
    assert pages[1]["topic"] == "Dry Needling Alexandria MN"
    assert pages[1]["href"] == "/service/dry-needling-alexandria-mn" and pages[0]["href"] == "/"
    assert pages[8]["topic"] == "What to Know About Manual Therapy in Alexandria MN"


def test_profiles_and_serp(spark):
    df = spark.createDataFrame(
        [(1, "Gym Home Page", None, None, "home"), (2, "Dry Needling", "Alexandria MN", None, "service"), (3, "Widgets", None, "B", None)],
        "id INT, topic STRING, location STRING, brand STRING, page_type STRING",
    )
    gym, dry, widgets = planning.profiles(df).orderBy("id").collect()
    assert gym["topic_type"] == "fitness" and gym["tone"] == ["energetic", "motivational"]
    assert dry["topic_type"] == "medical" and dry["location"] == "Alexandria MN" and dry["intent"] == "conversion"
    assert widgets["page_type"] == "service" and widgets["topic_type"] == "local-service"
    row = planning.serp_expansion(df.filter("id = 2")).first()
    assert "pricing" in row["entities"] and len(row["entities"]) == 12
    assert any("appointment" in q for q in row["questions"]) and len(row["questions"]) == 6
    assert any("Pricing" in h for h in row["headings"])
    plain = planning.serp_expansion(df.filter("id = 3")).first()
    assert plain["questions"] == [
        "Why Choose Widgets?", "What to Expect From Widgets?", "How does pricing work for Widgets?",
    ]


def test_contract(spark):
    df = spark.createDataFrame([(1, None, "x", [], None), (2, " ", "home", ["a"], "z"), (3, "ok", None, None, None)],
                               "id INT, topic STRING, kind STRING, items ARRAY<STRING>, other STRING")
    fields = (Field("topic", min_length=1), Field("kind", "enum", required=False, values=("home", "blog")), Field("items", "array", min_items=1))
    got = [r["violations"] for r in quality.check_contract(df, "In", fields, ("id",)).orderBy("id").collect()]
    assert got == [
        ["In.topic is required.", "In.kind must be one of: home, blog.", "In.items must contain at least 1 item(s)."],
        ["In.topic must be at least 1 characters.", "In.other is not allowed."],
        ["In.items is required."],
    ]
