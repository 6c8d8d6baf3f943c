"""Versions, files, retention and run history.

Where only the shape of a result is known, the rule is stated in the docstring of the function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.operators.paging import running_totals

MANIFEST = (
    "data string, version bigint, name string, dir string, content_type string, size bigint, "
    "storages array<string>, tags map<string,string>, created_at timestamp"
)
RUN_LOG = (
    "run_id bigint, flow string, step int, step_type string, status string, "
    "started_at timestamp, finished_at timestamp"
)
_ENTRY = ["dir", "content_type", "size", "tags", "created_at"]


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (data, version, name): storages united, all other fields from the first entry.

    Rows of ``old`` come before rows of ``new``. Storages are united as a set while aggregating,
    so a file recorded many times does not build up a long list.
    """
    keys = ["data", "version", "name"]
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    first = F.struct("_seq", "created_at", "size", "dir", "content_type")
    return (
        both.withColumn("_storage", F.explode_outer("storages"))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set("_storage")).alias("storages"),
            F.min_by(F.struct(*_ENTRY), first).alias("_entry"),
        )
        .select(*keys, "_entry.*", "storages")
        .select(*old.columns)
    )


def tag_filter(versions: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Rows that carry every requested tag with the requested value."""
    out = versions
    for key, value in tags.items():
        out = out.filter(F.try_element_at("tags", F.lit(key)) == F.lit(value))
    return out


def latest_version(versions: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """The newest row by ``created_at``, then by version number, among those with the tags."""
    return tag_filter(versions, tags or {}).orderBy(F.desc("created_at"), F.desc("version")).limit(1)


def data_summary(manifest: DataFrame) -> DataFrame:
    """Per data group: number of versions and files, total size, newest version.

    A file is one manifest row. Rows are first reduced to one per version, then to one per group;
    both steps combine before they shuffle.
    """
    versions = manifest.groupBy("data", "version").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.max("created_at").alias("created_at")
    )
    return versions.groupBy("data").agg(
        F.count(F.lit(1)).alias("version_count"),
        F.sum("files").alias("file_count"),
        F.sum("size").alias("size"),
        F.max_by("version", F.struct("created_at", "version")).alias("latest_version"),
    )


def retention_select(
    manifest: DataFrame, count_limit: int | None = None, size_limit: int | None = None
) -> DataFrame:
    """Versions to remove: data, version, created_at, size, rank, running.

    Per data group the versions are ordered newest first. Removed are those past ``count_limit``,
    and those with which the running size exceeds ``size_limit``; the newest version always stays.
    """
    versions = manifest.groupBy("data", "version").agg(
        F.max("created_at").alias("created_at"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")
    )
    ranked = running_totals(versions, ["data"], [F.desc("created_at"), F.desc("version")], "size")
    over = F.lit(False)
    if count_limit is not None:
        over = over | (F.col("rank") > count_limit)
    if size_limit is not None:
        over = over | (F.col("running") > size_limit)
    return ranked.filter(over & (F.col("rank") > 1))


def drop_versions(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """The manifest without the removed (data, version) pairs."""
    return manifest.join(removed.select("data", "version").distinct(), ["data", "version"], "left_anti")


def capacity_check(manifest: DataFrame, capacity: int, new_size: int) -> DataFrame:
    """One row: used_size, free_size, new_size, fits."""
    used = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    return (
        manifest.agg(used.alias("used_size"))
        .withColumn("free_size", F.lit(capacity) - F.col("used_size"))
        .withColumn("new_size", F.lit(new_size))
        .withColumn("fits", F.col("used_size") + F.lit(new_size) <= F.lit(capacity))
    )


def assert_capacity(manifest: DataFrame, capacity: int, new_size: int) -> None:
    row = capacity_check(manifest, capacity, new_size).head()
    if not row["fits"]:
        raise ValueError(f"not enough capacity: {row['free_size']} free, {new_size} needed")


def run_summary(run_log: DataFrame) -> DataFrame:
    """Per run: flow, status, completed and total steps, start, finish, duration in seconds.

    Status: FAILED with a failed step, else RUNNING with an unfinished one, else SKIPPED when every
    step was skipped, else SUCCESS. A step counts as completed when it ended in SUCCESS.
    """
    is_status = {s: F.count_if(F.col("status") == s) for s in ("SUCCESS", "FAILED", "SKIPPED", "RUNNING", "SCHEDULED")}
    total = F.count(F.lit(1))
    open_steps = is_status["RUNNING"] + is_status["SCHEDULED"]
    status = (
        F.when(is_status["FAILED"] > 0, F.lit("FAILED"))
        .when(open_steps > 0, F.lit("RUNNING"))
        .when(is_status["SKIPPED"] == total, F.lit("SKIPPED"))
        .otherwise(F.lit("SUCCESS"))
    )
    start, finish = F.min("started_at"), F.max("finished_at")
    seconds = F.timestamp_diff("MICROSECOND", start, finish) / F.lit(1_000_000.0)
    # A run belongs to one flow; as a second key it keeps the aggregation hash based.
    return run_log.groupBy("run_id", "flow").agg(
        status.alias("status"),
        is_status["SUCCESS"].alias("completed_steps"),
        total.alias("number_of_steps"),
        start.alias("started_at"),
        finish.alias("finished_at"),
        F.when(open_steps == 0, seconds).alias("duration_seconds"),
    )


def latest_run_per_flow(runs: DataFrame) -> DataFrame:
    """The last started run of each flow; the higher run id decides between equal times.

    The last start of each flow is a plain maximum over two columns; only rows with that start are
    looked at in full. Both steps reduce a flow with very many runs before they shuffle.
    """
    rest = [c for c in runs.columns if c != "flow"]
    last = runs.groupBy("flow").agg(F.max("started_at").alias("_last")).withColumnRenamed("flow", "_flow")
    hit = runs.join(
        last, F.col("flow").eqNullSafe(F.col("_flow")) & F.col("started_at").eqNullSafe(F.col("_last")), "left_semi"
    )
    best = F.max_by(F.struct(*rest), F.struct("run_id", *[c for c in ("step",) if c in rest]))
    return hit.groupBy("flow").agg(best.alias("_run")).select("flow", "_run.*").select(*runs.columns)
