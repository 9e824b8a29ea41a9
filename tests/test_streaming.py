import random
from datetime import datetime, timedelta

import pytest

from sitegrain.catalog.audit_checks import streamed_pages
from sitegrain.streaming import page_stream as S


def test_stream_equals_batch(spark, tmp_path):
    schema = "page_id BIGINT, url STRING, html STRING"
    rows = [(i, f"https://s.com/blog/{i}", f"<title>t{i}</title><body><h1>h</h1><p>word {i}</p></body>") for i in range(9)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    pages = spark.read.parquet(src)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream = S.stream_folder(spark, src, pages.schema, files_per_batch=1)
        S.run_page_stream(stream, out, str(tmp_path / "ckpt")).awaitTermination()
    want = {tuple(r) for r in S.audited_pages(pages).select("idx", "title", "page_type", "word_count").collect()}
    got = spark.read.parquet(out).select("idx", "title", "page_type", "word_count").collect()
    assert len(got) == 9 and {tuple(r) for r in got} == want


@pytest.mark.parametrize("files", [0, 3])
def test_streamed_pages_read_a_file_or_a_folder(spark, tmp_path, files):
    rows = [(i, f"https://s.com/blog/{i}", f"<title>t{i}</title><body><p>word {i}</p></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    table = str(tmp_path / "pages.parquet")
    if files:
        pages.repartition(files).write.parquet(table)
    else:
        pages.toPandas().to_parquet(table)
    # Neighbours of the table are not part of it.
    pages.write.parquet(str(tmp_path / "pages.parquet.old"))
    got = streamed_pages(spark, str(tmp_path)).collect()
    assert sorted(r["idx"] for r in got) == list(range(9)) and {r["site"] for r in got} == {"s.com"}


CHANGES = "url STRING, content_hash STRING, seq BIGINT"


def changes_of(rows):
    """Rows whose hash differs from that of the row before, per url."""
    last, out = {}, []
    for url, value, seq in sorted(rows, key=lambda r: r[2]):
        if url not in last or last[url] != value:
            out.append((url, seq))
        last[url] = value
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_changes_do_not_depend_on_batches(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(f"u{rng.randrange(12)}", rng.choice(["x", "y", None]), k) for k in range(90)]
    write = S.changed_pages_writer(str(tmp_path), buckets=4)
    size = len(rows) // batches
    for b in range(batches):
        part = spark.createDataFrame(rows[b * size : (b + 1) * size] + rows[b * size : b * size + 1], CHANGES)
        write(part, b)
        if b == 1:
            write(part, b)  # a retried batch starts from the state before it
    got = sorted((r["url"], r["seq"]) for r in S.page_history(spark, str(tmp_path)).collect())
    assert got == changes_of(rows)
    latest = spark.read.parquet(f"{tmp_path}/latest")
    assert latest.count() == latest.select("url").distinct().count() == len({r[0] for r in rows})


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    write = S.changed_pages_writer(str(tmp_path), buckets=16)
    write(spark.createDataFrame([(f"u{k}", "x", k) for k in range(100)], CHANGES), 0)
    files = lambda: {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "latest").rglob("*.parquet")}
    before = files()
    write(spark.createDataFrame([("u7", "y", 200), ("u8", "y", 3), (None, "y", 201)], CHANGES), 1)  # u8 comes too late
    after = files()
    touched = {f.split("/")[1] for f in before if after.get(f) != before[f]}
    assert 1 <= len(touched) <= 2
    assert [(r["url"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/history/batch=1").collect()] == [("u7", 200)]


def progress(spark, tmp_path, arrivals, totals, idle="1 hour"):
    """Rows of all arrivals, one batch each, and the rows of state after every batch."""
    src, out = tmp_path / "in", tmp_path / "out"
    states = []
    table = spark.createDataFrame(totals, "run_id STRING, total BIGINT")
    for rows in arrivals:
        df = spark.createDataFrame(rows, "run_id STRING, status STRING, ts TIMESTAMP").coalesce(1)
        df.write.mode("append").parquet(str(src))
        query = S.run_progress_stream(S.run_progress(S.stream_folder(spark, str(src), df.schema), table, idle), str(out), str(tmp_path / "ckpt"))
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(tuple(r) for r in spark.read.schema(S.PROGRESS).parquet(str(out)).collect()), states


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_progress_fires_once_and_forgets(spark, tmp_path):
    arrivals = [
        [("r", "completed", at(0)), ("q", "failed", at(1)), ("a", "completed", at(2))],
        [("r", "failed", at(3)), ("r", "skipped", at(4)), ("unknown", "completed", at(5)), (None, "failed", at(5))],
        [("r", "completed", at(6))],  # more than was expected changes nothing
        [("late", "completed", at(500))],
        [("late", "running", at(501))],
    ]
    got, states = progress(spark, tmp_path, arrivals, [("r", 3), ("q", 1), ("a", 2), ("late", 5)])
    assert got == [("a", 2, 1, 0, "abandoned"), ("q", 1, 0, 1, "finished"), ("r", 3, 2, 1, "finished")]
    assert states[2] == 3 and states[-1] == 1


def test_state_of_progress_stays_bounded(spark, tmp_path):
    runs = [(f"r{k:04d}", k) for k in range(1000)]
    arrivals = [[(r, "completed", at(k)) for r, k in runs[b : b + 250] for _ in range(2)] for b in range(0, 1000, 250)]
    got, states = progress(spark, tmp_path, arrivals, [(r, 2) for r, _ in runs])
    assert got == [(r, 2, 2, 0, "finished") for r, _ in runs]
    assert max(states) <= 320  # the runs of one hour and one arrival


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "boom", "t")], "id INT, error STRING, failed_at STRING")
    good, dead = S.split_dead_letters(df, "scrape_page")
    assert [r["id"] for r in good.collect()] == [1]
    assert tuple(dead.first()) == ("scrape_page", '{"id":2}', "boom", "t")
