import json

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import reports
from sitegrain.sources import artifacts as A
from sitegrain.sources import url_lists as U
from sitegrain.sources.sitemaps import bad_locs, parse_sitemaps, read_sitemap_files, sitemap_pages


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("  https://a.com \nnope\n\nHTTP://b.com\nhttps://a.com\n# https://c.com\n")
    got = U.parse_url_list(U.read_lines(spark, str(path))).orderBy("line_no").collect()
    assert [r["url"] for r in got] == ["https://a.com", "HTTP://b.com"]


def test_strict_url_list(spark, tmp_path):
    good, bad, empty = tmp_path / "g", tmp_path / "b", tmp_path / "e"
    good.write_text("# x\nhttps://a.com\n\nhttps://a.com\n")
    bad.write_text("https://a.com\nftp://b\n")
    empty.write_text("# only\n")
    assert U.load_strict(spark, str(good)).count() == 2
    with pytest.raises(U.UrlListError, match="ftp://b"):
        U.load_strict(spark, str(bad))
    with pytest.raises(U.UrlListError, match="empty"):
        U.load_strict(spark, str(empty))


def xml(kind, entry, *locs):
    return f"<?xml version='1.0'?><{kind} xmlns='x'>" + "".join(f"<{entry}><loc> {u}\n</loc><x/></{entry}>" for u in locs) + f"</{kind}>"


STORED = [
    ("https://s.com/sitemap.xml", xml("sitemapindex", "sitemap", "https://s.com/a.xml", "https://s.com/sitemap.xml", "https://t.com/z.xml", "https://s.com/b.xml", "https://s.com/missing.xml")),
    ("https://s.com/a.xml", xml("urlset", "url", "https://s.com/2", "https://S.com/1#x", "https://s.com/login", "https://s.com/a.PDF", "https://t.com/9", "https://s.com/?a=1&amp;b=2")),
    ("https://s.com/b.xml", xml("urlset", "url", "https://s.com/1", "https://s.com/3", "bad", "https://s.com/4")),
]


def test_sitemaps(spark):
    stored = spark.createDataFrame(STORED, "url STRING, xml STRING")
    parsed = {r["url"]: r for r in parse_sitemaps(stored).collect()}
    assert len(parsed["https://s.com/sitemap.xml"]["sitemap_locs"]) == 5
    roots = spark.createDataFrame([("s.com",)], "base_url STRING")
    got = [r["url"] for r in sitemap_pages(roots, stored).orderBy("pos").collect()]
    # A bad entry is passed over; the index loop ends.
    assert got == ["https://s.com/2", "https://s.com/1", "https://s.com/?a=1&b=2", "https://s.com/3", "https://s.com/4"]
    assert [(r["url"], r["loc"]) for r in bad_locs(stored).collect()] == [("https://s.com/b.xml", "bad")]
    limited = sitemap_pages(roots, stored, max_sitemaps=2)
    assert limited.count() == 3
    audit = [r["url"] for r in sitemap_pages(roots, stored, audit=True).orderBy("pos").collect()]
    assert "https://s.com/login" in audit and "https://s.com/3" in audit


def test_every_sitemap_of_a_site_is_read(spark):
    maps = [("https://s.com/sitemap.xml", xml("sitemapindex", "sitemap", *(f"https://s.com/m{i}.xml" for i in range(60))))]
    maps += [(f"https://s.com/m{i}.xml", xml("urlset", "url", f"https://s.com/p{i}")) for i in range(60)]
    roots = spark.createDataFrame([("s.com",)], "base_url STRING")
    assert sitemap_pages(roots, spark.createDataFrame(maps, "url STRING, xml STRING")).count() == 60


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(STORED[1][1].replace(" xmlns='x'", ""))
    assert read_sitemap_files(spark, str(tmp_path)).count() == 6


def test_precedence_and_discovery(spark):
    schema = "site STRING, pos BIGINT, url STRING"
    none = spark.createDataFrame([], schema)
    crawl = spark.createDataFrame([("s", 0, "https://s/login"), ("s", 1, "https://s/a"), ("s", 2, "https://s/a"), ("s", 3, "https://s/b")], schema)
    got = [tuple(r) for r in U.discover(none, none, crawl).orderBy("idx").collect()]
    assert got == [("s", 1, "https://s/a", "crawl"), ("s", 3, "https://s/b", "crawl")]
    staged = U.discover(crawl, none, none, staged=True)
    assert staged.filter("method = 'explicit-list'").count() == 3


def test_scraped_directory(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"title": "plain"}))
    (tmp_path / "p1.dataset.json").write_text(json.dumps({"title": "dataset"}, indent=1))
    (tmp_path / "p2.scraped.json").write_text(json.dumps({"title": "scraped"}))
    (tmp_path / "p2.dataset.json").write_text("{broken")
    got = {r["slug"]: r["title"] for r in U.read_scraped_directory(spark, str(tmp_path), "title STRING").collect()}
    assert got == {"p1": "dataset", "p2": "scraped"}


def test_envelope_and_artifacts(spark, tmp_path):
    payload = spark.createDataFrame([(1, "own-model")], "id INT, model STRING")
    full = A.with_envelope(payload, F.lit("t0"), producer="", run_id="r", model="m")
    row = full.first()
    assert (row["schemaVersion"], row["producer"], row["runId"], row["promptVersion"], row["model"]) == ("1.0", "unknown", "r", "unknown", "own-model")
    path = str(tmp_path / "out")
    A.write_artifacts(full, path)
    (tmp_path / "out" / "producer=unknown" / "bad.json").write_text("{oops\n")
    back = A.read_artifacts(spark, path, "id INT, model STRING, runId STRING, producer STRING")
    assert [tuple(r) for r in back.collect()] == [(1, "own-model", "r", "unknown")]


def test_log(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00.5", "info", "metric", "x", 3)], "ts STRING, level STRING, event STRING, agent STRING, n INT")
    path = str(tmp_path / "log")
    A.write_log(df.withColumn("ts", F.to_timestamp("ts")), path, "ts", "level", "event")
    row = A.read_log(spark, path).first()
    assert row["ts"].microsecond == 500000 and row["extra"] == {"agent": "x", "n": "3"}


def test_output_index(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "slug STRING, generated_at BIGINT, v STRING")
    new = spark.createDataFrame([("a", 3, "y")], "slug STRING, generated_at BIGINT, v STRING")
    got = [tuple(r) for r in reports.output_index(old, new).orderBy(F.desc("generated_at")).collect()]
    assert got == [("a", 3, "y", True), ("b", 2, "x", False)]
