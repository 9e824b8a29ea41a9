"""Runs, snapshots, artifacts: change detection, resume, costs, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.functions.text import text_or_empty
from sitegrain.operators.ordered import first_occurrence, top_k
from sitegrain.session import cut_lineage
from sitegrain.sources.keyed_tables import KeyedTable
from sitegrain.vocab import MODEL_PRICES

HASHED_FIELDS = ("title", "meta_description", "body_text", "headings")
DONE, FAILED, SKIPPED = "completed", "failed", "skipped"


def content_hash(*fields: str) -> Column:
    """SHA-256 of the JSON of the fields that define a page's content (its whole text among them)."""
    names = fields or HASHED_FIELDS
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


# --- latest state -------------------------------------------------------------------


def latest_by(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Row with the highest ``version`` per key (snapshot of a page, status of a URL)."""
    return first_occurrence(df, keys, [F.desc(version)])


def overlay_states(states: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str]) -> DataFrame:
    """Merge partial states: for each column the latest value that is present."""
    seen = [
        F.max_by(
            F.col(c), F.when(F.col(c).isNotNull(), F.col(version))
        ).alias(c)
        for c in columns
    ]
    return states.groupBy(*keys).agg(*seen, F.max(version).alias(version))


# --- change detection and resume ------------------------------------------------------


def unchanged_pages(current: DataFrame, snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Current pages whose latest snapshot has the same hash and an artifact.

    ``current(page_id, content_hash)``, ``snapshots(id, page_id, content_hash)``,
    ``artifacts(page_id)``. All three are keyed by page, so the joins share one
    partitioning.
    """
    latest = latest_by(snapshots, ["page_id"], "id").select("page_id", "content_hash")
    return current.join(latest, ["page_id", "content_hash"], "left_semi").join(
        artifacts.select("page_id").distinct(), "page_id", "left_semi"
    )


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "url") -> DataFrame:
    """``(key, change)`` of two crawls: new, changed, unchanged, removed, failed.

    Both sides have ``key, content_hash``; ``current`` also has ``status``.
    """
    old = previous.select(key, F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    new = current.select(
        key, F.col("content_hash").alias("new_hash"), "status", F.lit(True).alias("now")
    )
    change = (
        F.when(F.col("now").isNull(), "removed")
        .when(F.col("status") == FAILED, "failed")
        .when(F.col("was").isNull(), "new")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, key, "full_outer").select(key, change.alias("change"))


def pages_to_process(
    pages: DataFrame, artifacts: DataFrame, kinds: Sequence[str] = ("optimized", "schema"), key: str = "url"
) -> DataFrame:
    """Pages that lack any artifact of ``kinds`` (resume)."""
    wanted = artifacts.filter(F.col("type").isin(list(kinds)))
    complete = (
        wanted.select(key, "type")
        .distinct()
        .groupBy(key)
        .agg(F.count("*").alias("found"))
        .filter(F.col("found") == len(kinds))
    )
    return pages.join(complete.select(key), key, "left_anti")


# --- costs -------------------------------------------------------------------------------


def model_cost(
    model: Column,
    tokens_in: Column,
    tokens_out: Column,
    prices: Sequence[tuple[str, float, float]] = MODEL_PRICES,
) -> Column:
    """Cost in USD, six decimals; unknown models cost the default price."""

    def price(position: int) -> Column:
        table = {name: row[position] for name, *row in prices}
        known = F.create_map(*[x for n, p in table.items() for x in (F.lit(n), F.lit(p))])
        return F.coalesce(F.try_element_at(known, model), F.lit(table["default"]))

    used = lambda tokens: F.coalesce(tokens, F.lit(0)) / F.lit(1_000_000)
    return F.round(used(tokens_in) * price(0) + used(tokens_out) * price(1), 6)


def cost_report(usage: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Token and cost sums of model calls."""
    return usage.groupBy(*group).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("estimated_cost_usd"),
    )


# --- reports ---------------------------------------------------------------------------------


def run_report(status: DataFrame, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts over the status table ``(run_id, url, status, product_page, …)``."""
    product = F.coalesce(F.col("product_page"), F.lit(False))
    return status.groupBy(*group).agg(
        F.count("*").alias("total_urls_discovered"),
        F.count_if(F.col("status") == DONE).alias("pages_audited"),
        F.count_if(F.col("status") == SKIPPED).alias("pages_skipped"),
        F.count_if(product).alias("product_pages_detected"),
        F.count_if(product & (F.col("status") == DONE)).alias("product_pages_optimized"),
        F.count_if(F.col("status") == FAILED).alias("errors"),
    )


def run_errors(status: DataFrame) -> DataFrame:
    """Failed pages with their first message; rows, because they can be many."""
    message = F.coalesce(F.nullif(text_or_empty(F.col("error")), F.lit("")), F.lit("failed"))
    return status.filter(F.col("status") == FAILED).select("run_id", "url", message.alias("error"))


def site_audit_summary(classified: DataFrame, group: Sequence[str] = ("site",)) -> DataFrame:
    """Site audit counts from ``(site, product, classify_error, status)`` rows."""
    product = F.coalesce(F.col("product"), F.lit(False))
    classify_error = F.col("classify_error").isNotNull() & ~product
    return classified.groupBy(*group).agg(
        F.count("*").alias("total_urls_discovered"),
        F.count_if(product).alias("product_pages_detected"),
        F.count_if(product & (F.col("status") == "ok")).alias("pages_audited"),
        F.count_if(~product).alias("pages_skipped"),
        F.count_if(classify_error | (product & (F.col("status") == "error"))).alias("errors"),
    )


def batch_summary(status: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """ok / skipped / error counts of a batch."""
    return status.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped"),
        F.count_if(F.col("status") == "error").alias("error"),
    )


# --- relational tables ----------------------------------------------------------------------------


def run_artifacts(runs: DataFrame, snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts of the snapshots of each run."""
    s = snapshots.select(F.col("id").alias("snapshot_id"), "run_id", "page_id", "status")
    return runs.select(F.col("id").alias("run_id")).join(s, "run_id").join(artifacts, "snapshot_id")


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add consecutive numbers from 1 in a global order without a single-task window.

    Rows are range-partitioned and sorted, the result is written once so that
    partitions keep their rows, and each partition adds the sizes of those
    before it. Only one row per partition meets in one task.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "__part": F.spark_partition_id(),
                "__local": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
    )
    saved = cut_lineage(ranged)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        saved.groupBy("__part")
        .count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    )
    numbered = saved.join(offsets, "__part").withColumn(
        name, F.col("__offset") + F.col("__local") + 1
    )
    return numbered.drop("__part", "__local", "__offset")


def get_or_create(
    existing: DataFrame, wanted: DataFrame, natural_key: Sequence[str], order: Sequence[Column], id_column: str = "id"
) -> DataFrame:
    """Dimension rows for all wanted keys; known keys keep their ids.

    New keys, one row each, get ids after the highest existing one in ``order``.
    """
    fresh = first_occurrence(wanted, natural_key, order).join(
        existing.select(*natural_key), list(natural_key), "left_anti"
    )
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("__top"))
    numbered = number_rows(fresh, order, "__n").crossJoin(F.broadcast(top))  # one row
    created = numbered.withColumn(id_column, F.col("__top") + F.col("__n"))
    columns = existing.columns
    return existing.unionByName(created.select(*columns))


# fixed values: run defaults
RUN_DEFAULTS = {
    "status": "completed", "mode": "full", "prompt_version": "unknown",
    "template_version": "unknown", "model": "unknown",
}


def create_runs(requests: DataFrame) -> DataFrame:
    """Run rows at their start, defaults filled, status running unless given."""
    filled = {
        c: F.coalesce(F.nullif(text_or_empty(F.col(c)), F.lit("")), F.lit("running" if c == "status" else d))
        for c, d in RUN_DEFAULTS.items()
    }
    return requests.withColumns(filled)


def finish_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Overlay updates on runs: the new value, else the current, else the default.

    Runs without an update row stay as they are. ``updates``: ``id,
    finished_at, status, mode, prompt_version, template_version, model``.
    """
    names = ["finished_at", *RUN_DEFAULTS]
    new = updates.select("id", *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("hit"))
    joined = runs.join(new, "id", "left")
    out = {"finished_at": F.coalesce("new_finished_at", "finished_at")}
    for c, default in RUN_DEFAULTS.items():
        blank = lambda x: F.nullif(F.col(x), F.lit(""))
        merged = F.coalesce(blank(f"new_{c}"), blank(c), F.lit(default))
        out[c] = F.when(F.col("hit"), merged).otherwise(F.col(c))
    return joined.withColumns(out).select(*runs.columns)


def update_stored_runs(stored: KeyedTable, updates: DataFrame) -> None:
    """:func:`finish_runs` on a stored table keyed by ``id``; buckets without updated runs stay as they are.

    Updates of runs that are not stored are passed over; of several updates of a run the one that finished last counts.
    """
    latest = latest_by(updates, ["id"], "finished_at")
    stored.upsert(finish_runs(stored.read(latest.select("id")), latest))


def updated_snapshots(snapshots: DataFrame, metrics: DataFrame) -> DataFrame:
    """Snapshots with the measures of ``metrics(id, tokens_in, tokens_out, cost_usd, status, error)``.

    A measured snapshot takes all five values: zero counts and blank errors are
    stored as null, a blank status as completed. Of several rows of an id the
    largest one counts. Other snapshots stay as they are.
    """
    names = ("tokens_in", "tokens_out", "cost_usd", "status", "error")
    given = {
        **{c: F.when(F.col(c) != 0, F.col(c)) for c in names[:3]},
        "status": F.coalesce(F.nullif(text_or_empty(F.col("status")), F.lit("")), F.lit(DONE)),
        "error": F.nullif(text_or_empty(F.col("error")), F.lit("")),
    }
    new = metrics.select("id", F.struct(*(v.alias(c) for c, v in given.items())).alias("__new"))
    new = new.groupBy("id").agg(F.max("__new").alias("__new"))
    joined = snapshots.join(new, "id", "left")
    hit = F.col("__new").isNotNull()
    out = joined.withColumns({c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in names})
    return out.select(*snapshots.columns)


def final_run_status(error_count: Column) -> Column:
    return F.when(error_count > 0, "completed_with_errors").otherwise("completed")


def final_snapshot_status(eval_score: Column, threshold: int = 85) -> Column:
    return F.when(eval_score < threshold, "low_score").otherwise("completed")


def skip_reason(
    optimized_exists: Column,
    changed_only: bool,
    database_hash: Column,
    checkpoint_hash: Column,
    current_hash: Column,
) -> Column:
    """Why a page is skipped before it is processed, or null."""
    same = lambda h: F.coalesce(h == current_hash, F.lit(False))
    by_artifact = optimized_exists & F.lit(not changed_only)
    return (
        F.when(by_artifact, "optimized_exists")
        .when(optimized_exists & same(database_hash), "unchanged_db_hash")
        .when(optimized_exists & same(checkpoint_hash), "unchanged_content_hash")
    )


def serp_budget(pages: DataFrame, max_calls: int, order: str = "idx", group: Sequence[str] = ("site",)) -> DataFrame:
    """Add ``within_budget``: the first ``max_calls`` pages per group may call.

    The in-budget set is a small top-k per group, joined back on the page, so
    no window orders a whole group in one task.
    """
    if max_calls <= 0:
        return pages.withColumn("within_budget", F.lit(True))
    first = top_k(pages.select(*group, order), list(group), [F.col(order)], max_calls)
    flagged = first.withColumn("__in", F.lit(True))
    joined = pages.join(flagged, [*group, order], "left")
    return joined.withColumn("within_budget", F.coalesce("__in", F.lit(False))).drop("__in")


def model_budget(pages: DataFrame, max_calls: int, order: str = "idx", group: Sequence[str] = ("site",)) -> DataFrame:
    """Add ``within_budget`` to product pages that each spend ``attempt`` calls.

    A page may call while the pages before it have spent less than ``max_calls``;
    later ones fail. Every page spends at least one call, so only the first
    ``max_calls`` pages per group can be within it, and the running sum is taken
    over those alone.
    """
    if max_calls <= 0:
        return pages.withColumn("within_budget", F.lit(True))
    first = top_k(pages.select(*group, order, "attempt"), list(group), [F.col(order)], max_calls)
    before = (
        Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    spent = F.coalesce(F.sum("attempt").over(before), F.lit(0))
    allowed = first.withColumn("__ok", spent < max_calls).drop("attempt")
    joined = pages.join(allowed, [*group, order], "left")
    return joined.withColumn("within_budget", F.coalesce("__ok", F.lit(False))).drop("__ok")
