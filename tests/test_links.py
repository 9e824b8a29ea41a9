import random

from pyspark.sql import functions as F

from sitegrain.operators import links as L
from sitegrain.operators import suggestions
from sitegrain.operators.linkplan import plan_links
from sitegrain.operators.suggestions import suggest_links
from sitegrain.vocab import Vocabulary


def anchor_of(url):
    part = [p for p in url.split("/", 3)[3].split("/") if p][-1:] or ["home"]
    return part[0].replace("-", " ").lower()


def section_of(url):
    return ([p for p in url.split("/", 3)[3].split("/") if p] or ["root"])[0]


def all_pairs_plan(pages):
    out = []
    for i, url, kind in pages:
        scored = []
        for j, target, other in pages:
            same = section_of(url) == section_of(target)
            score = (
                3 * (kind == "pdp" and other == "category")
                + 2 * (kind == "pdp" and other == "pdp" and same)
                + 2 * (kind == "category" and other == "pdp")
                + same
            )
            if j != i and score > 0:
                scored.append((-score, j, target))
        used = []
        for _, _, target in sorted(scored):
            anchor = anchor_of(target)
            if anchor not in used and len(used) < 5:
                used.append(anchor)
                out.append((i, len(used), anchor, target))
    return sorted(out)


def random_site(rng, size):
    kinds = ["pdp", "category", "blog", "generic"]
    rows = []
    for i in range(size):
        section = rng.choice(["a", "b", "c"])
        slug = f"{rng.choice('uvwxyz')}-{rng.choice('mn')}"
        rows.append((i, f"https://s.com/{section}/{slug}?i={i}".replace("?i=", "/") if rng.random() < 0.2 else f"https://s.com/{section}/{i}/{slug}", rng.choice(kinds)))
    return rows


def test_plan_equals_all_pairs(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for s in range(40):
        pages = random_site(rng, rng.choice([2, 3, 8, 25, 60]))
        expected[f"site{s}"] = all_pairs_plan(pages)
        rows += [(f"site{s}", *p) for p in pages]
    df = spark.createDataFrame(rows, "site STRING, idx BIGINT, url STRING, page_type STRING")
    got = {}
    for r in plan_links(df).collect():
        got.setdefault(r["site"], []).append((r["source_idx"], r["rank"], r["anchor"], r["target_page"]))
    for site, want in expected.items():
        assert sorted(got.get(site, [])) == want, site


def test_plan_first_copy_of_anchor_is_the_source(spark):
    rows = [("s", 0, "https://s.com/a/x", "generic"), ("s", 1, "https://s.com/a/2/x", "generic")]
    df = spark.createDataFrame(rows, "site STRING, idx BIGINT, url STRING, page_type STRING")
    assert plan_links(df).count() == 2


def all_pairs_suggestions(pages, words, terms):
    def tokens(text):
        return [t for t in text.lower().split() if len(t) > 2]

    out = []
    for i, url, kind in pages:
        page_words = set(words[i])
        scored = []
        for j, target, _ in pages:
            if j == i:
                continue
            toks = tokens(anchor_of(target))
            score = sum(2 * (t in page_words) + any(w in t for w in terms) for t in toks)
            score += kind == "pdp" and "/category/" in target
            scored.append((-score, j, anchor_of(target), target))
        picks = []
        for score, _, anchor, target in sorted(scored):
            if score < 0 and anchor not in [p[0] for p in picks] and len(picks) < 6:
                picks.append((anchor, target))
        if len(picks) < 3:
            for _, _, anchor, target in sorted(scored, key=lambda r: r[1]):
                if anchor not in [p[0] for p in picks] and len(picks) < 3:
                    picks.append((anchor, target))
        out += [(i, k + 1, *p) for k, p in enumerate(picks)]
    return sorted(out)


def test_suggestions_equal_all_pairs(spark):
    """Few words in many anchors: every set of tokens up to four becomes heavy."""
    rng = random.Random(11)
    vocabulary = ["red", "blue", "ring", "bolt", "zinc", "flag"]
    rows, expected = [], {}
    for s in range(12):
        pages, words = [], {}
        for i in range(rng.choice([3, 10, 60, 150])):
            slug = "-".join(rng.choice(vocabulary + [f"own{i}"]) for _ in range(rng.choice([1, 2, 3, 4, 4])))
            where = rng.choice(["category", "x", "y"])
            pages.append((i, f"https://s{s}.com/{where}/{i}/{slug}", rng.choice(["pdp", "blog"])))
            words[i] = rng.sample(vocabulary + ["own1", "own2"], rng.choice([0, 1, 3, 5]))
        expected[f"s{s}"] = all_pairs_suggestions(pages, words, ["flag"])
        rows += [(f"s{s}", i, u, k, " ".join(words[i]), "") for i, u, k in pages]
    df = spark.createDataFrame(
        rows, "site STRING, idx BIGINT, url STRING, page_type STRING, content STRING, product_entity STRING"
    )
    got = {}
    result = suggest_links(df, df, Vocabulary(product_terms=("flag",)), list_size=7)
    for r in result.collect():
        got.setdefault(r["site"], []).append((r["source_idx"], r["rank"], r["anchor"], r["target_page"]))
    for site, want in expected.items():
        assert sorted(got.get(site, [])) == want, site


def test_suggestions_with_a_dozen_shared_tokens(spark):
    """Anchors share twelve words; sets of them must not be multiplied out."""
    rng = random.Random(5)
    shared = [f"w{k:02d}" for k in range(12)]
    pages, words = [], {}
    for i in range(260):
        own = shared if i % 3 else rng.sample(shared, rng.choice([3, 8]))
        slug = "-".join([*own, f"n{i}"] if i % 5 else own[:-1])
        pages.append((i, f"https://s.com/{rng.choice(['category', 'x'])}/{i}/{slug}", rng.choice(["pdp", "blog"])))
        words[i] = rng.sample(shared + [f"n{k:d}" for k in range(100, 130)], rng.choice([2, 12, 30]))
    df = spark.createDataFrame(
        [("s", i, u, k, " ".join(words[i]), "") for i, u, k in pages],
        "site STRING, idx BIGINT, url STRING, page_type STRING, content STRING, product_entity STRING",
    )
    result = suggest_links(df, df, Vocabulary(product_terms=("w03",)))
    got = sorted((r["source_idx"], r["rank"], r["anchor"], r["target_page"]) for r in result.collect())
    assert got == all_pairs_suggestions(pages, words, ["w03"])


def test_lists_are_read_in_as_many_tasks_as_pages_ask(spark, monkeypatch):
    monkeypatch.setattr(suggestions, "ASKED", 8)
    asked = spark.range(40).selectExpr("'s' AS site", "id AS idx", "false AS for_pdp", "array('a') AS pool", "'' AS key").coalesce(1)
    entry = "named_struct('idx', 100 + id, 'url', 'u', 'anchor', string(id), 'tokens', array('a'), 'again', CAST(NULL AS array<string>), 'terms', 0, 'category', false)"
    lists = spark.range(3).selectExpr(f"array({entry}) AS holders").selectExpr("collect_list(holders) AS entries")
    postings = lists.selectExpr("'s' AS site", "false AS for_pdp", "'' AS key", "entries")
    rows = suggestions._read(asked, F.broadcast(postings))
    assert rows.count() == 120
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 2 and all(r.n < 120 for r in tasks)


def test_injection(one):
    link = F.array(F.struct(F.lit("vinyl banners").alias("anchor"), F.lit("/v").alias("url")))
    none = F.array().cast("array<struct<anchor:string,url:string>>")
    assert one(L.inject_links(F.col("t"), link), t="<p>Paragraph copy.</p><p>x</p>") == (
        "<p>Paragraph copy. See also [vinyl banners](/v).</p><p>x</p>"
    )
    assert one(L.inject_links(F.col("t"), link), t="a") == "a\n\nCONTEXTUAL INTERNAL LINKS\n- [vinyl banners](/v)"
    assert one(L.inject_links(F.col("t"), link, staged=True), t="a").startswith("a\n\nRelated links:")
    assert one(L.inject_links(F.col("t"), none), t="<p>a</p>") == "<p>a</p>"
    assert one(L.inject_links(F.col("t"), link), t="<p>open") == "<p>open"


def test_reach_cap_and_missing_pages(spark):
    seeds = spark.createDataFrame([("s.com", "https://s.com")], "site STRING, url STRING")
    edges = [("s.com", "https://s.com", i, f"https://s.com/{i}") for i in range(4)]
    edges += [("s.com", "https://s.com/1", 0, "https://s.com/deep"), ("s.com", "https://s.com/2", 0, "https://s.com/lost")]
    edges += [("s.com", "https://s.com", 9, "https://s.com/a.pdf"), ("s.com", "https://s.com", 8, "https://s.com/login")]
    links = spark.createDataFrame(edges, "site STRING, source STRING, pos BIGINT, target STRING")
    stored = spark.createDataFrame(
        [("s.com", u) for u in ("https://s.com", "https://s.com/0", "https://s.com/1", "https://s.com/deep")],
        "site STRING, url STRING",
    )
    got = [(r["url"], r["depth"], r["is_page"]) for r in L.reachable_pages(seeds, links, stored).orderBy("seq").collect()]
    assert got == [
        ("https://s.com", 0, True), ("https://s.com/0", 1, True), ("https://s.com/1", 1, True),
        ("https://s.com/2", 1, False), ("https://s.com/3", 1, False), ("https://s.com/deep", 2, True),
    ]
    assert L.reachable_pages(seeds, links, stored, max_pages=3).count() == 3
    assert L.reachable_pages(seeds, links, stored, max_depth=1).count() == 5


def test_every_broken_link_is_found(spark):
    pages = spark.createDataFrame([("s", 1, "u", [f"l{i}" for i in range(30)])], "site STRING, idx BIGINT, url STRING, internal_links ARRAY<STRING>")
    status = spark.createDataFrame([("l0", 200), ("l0", 500), ("l1", 200)], "url STRING, status INT")
    assert L.broken_links(pages, status).count() == 29
    assert L.broken_links(pages, status, checked=2).count() == 1


def test_seeds_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(url):
        reads.add(1)
        return url

    seeds = spark.createDataFrame([("s.com", "https://s.com/0")], "site string, url string").select("site", counted("url").alias("url"))
    stored = spark.createDataFrame([("s.com", f"https://s.com/{i}") for i in range(4)], "site string, url string")
    links = spark.createDataFrame([("s.com", f"https://s.com/{i}", 0, f"https://s.com/{i + 1}") for i in range(3)], "site string, source string, pos long, target string")
    got = L.reachable_pages(seeds, links, stored, page_filter=False)
    assert [(r["url"], r["depth"], r["seq"]) for r in got.orderBy("seq").collect()] == [(f"https://s.com/{i}", i, i + 1) for i in range(4)]
    assert reads.value == 1
