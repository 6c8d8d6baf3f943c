"""Manifest, retention and run history, made from documents, pages, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import Registry, table
from snapforge.operators import manifest as mf

# One file per document: the source is the data group, a hundred documents make a version.
_FILES = """SELECT source AS data, doc_id // 100 AS version, concat('file-', doc_id) AS name, lang AS dir, 'text/plain' AS content_type,
    n_chars AS size, CASE WHEN lang = 'en' THEN ['disk', 'cloud'] ELSE ['disk'] END AS storages,
    TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id // 100) AS created_at FROM documents"""
_STEPS = """SELECT user_id AS run_id, concat('flow', user_id // 10) AS flow, (event_id)::INT AS step, event_type AS step_type,
    CASE event_type WHEN 'error' THEN CASE WHEN value > 100 THEN 'FAILED' ELSE 'SKIPPED' END WHEN 'view' THEN 'SKIPPED' ELSE 'SUCCESS' END AS status,
    ts AS started_at, ts + INTERVAL 2 SECOND AS finished_at FROM events"""


def files(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    version = F.expr("doc_id div 100")
    return docs.select(
        F.col("source").alias("data"),
        version.alias("version"),
        F.concat(F.lit("file-"), "doc_id").alias("name"),
        F.col("lang").alias("dir"),
        F.lit("text/plain").alias("content_type"),
        F.col("n_chars").alias("size"),
        F.when(F.col("lang") == "en", F.array(F.lit("disk"), F.lit("cloud"))).otherwise(F.array(F.lit("disk"))).alias("storages"),
        F.create_map(F.lit("lang"), "lang", F.lit("flow"), F.concat(F.lit("f"), "source")).alias("tags"),
        F.timestamp_add("HOUR", version.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
    )


def steps(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    kind = F.col("event_type")
    status = (
        F.when((kind == "error") & (F.col("value") > 100), "FAILED")
        .when(kind.isin("error", "view"), "SKIPPED")
        .otherwise("SUCCESS")
    )
    return events.select(
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("flow"), F.expr("user_id div 10")).alias("flow"),
        F.col("event_id").cast("int").alias("step"),
        kind.alias("step_type"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("interval 2 seconds")).alias("finished_at"),
    )


def register(r: Registry) -> None:
    # The second state holds the labelled documents again, in another storage and with another size.
    _again = """SELECT source AS data, d.doc_id // 100 AS version, concat('file-', d.doc_id) AS name, 'again' AS dir, n_chars + 1 AS size, ['tape', 'disk'] AS storages
                FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

    @r.add(
        f"""SELECT coalesce(o.data, n.data) AS data, coalesce(o.version, n.version) AS version, coalesce(o.name, n.name) AS name,
                   coalesce(o.dir, n.dir) AS dir, coalesce(o.size, n.size) AS size,
                   array_to_string(list_sort(list_distinct(list_concat(coalesce(o.storages, []), coalesce(n.storages, [])))), ',') AS storages
            FROM ({_FILES}) o FULL JOIN ({_again}
              UNION ALL SELECT source, doc_id // 100 + 1000, concat('file-', doc_id), 'new', n_chars, ['tape'] FROM documents) n
            ON o.data = n.data AND o.version = n.version AND o.name = n.name"""
    )
    def manifest_merge(spark, d):
        old = files(spark, d)
        labelled = table(spark, d, "labels").select(F.concat(F.lit("file-"), "doc_id").alias("name"))
        tape = F.array(F.lit("tape"), F.lit("disk"))
        again = old.join(labelled, "name", "left_semi").withColumns(
            {"dir": F.lit("again"), "size": F.col("size") + 1, "storages": tape}
        )
        new = old.withColumns({"version": F.col("version") + 1000, "dir": F.lit("new"), "storages": F.array(F.lit("tape"))})
        merged = mf.merge_manifest(old, again.select(*old.columns).unionByName(new))
        return merged.select("data", "version", "name", "dir", "size", F.concat_ws(",", "storages").alias("storages"))

    @r.add(
        f"""SELECT data, count(DISTINCT version) AS version_count, count(*) AS file_count, sum(size)::BIGINT AS size, max(version) AS latest_version
            FROM ({_FILES}) GROUP BY data"""
    )
    def data_summary(spark, d):
        return mf.data_summary(files(spark, d)).withColumn("file_count", F.col("file_count").cast("bigint"))

    _versions = f"""SELECT data, version, max(created_at) AS created_at, sum(size)::BIGINT AS size FROM ({_FILES}) GROUP BY data, version"""
    _ranked = f"""SELECT *, row_number() OVER w AS rank, (sum(size) OVER w)::BIGINT AS running FROM ({_versions})
        WINDOW w AS (PARTITION BY data ORDER BY created_at DESC, version DESC ROWS UNBOUNDED PRECEDING)"""

    @r.add(f"SELECT * FROM ({_ranked}) WHERE rank > 3")
    def retention_count(spark, d):
        return mf.retention_select(files(spark, d), count_limit=3)

    @r.add(f"SELECT * FROM ({_ranked}) WHERE rank > 1 AND (rank > 6 OR running > 100000)")
    def retention_count_and_size(spark, d):
        return mf.retention_select(files(spark, d), 6, 100_000)

    @r.add(f"SELECT data, version, name, size FROM ({_FILES}) f WHERE NOT EXISTS (SELECT 1 FROM ({_ranked}) v WHERE v.rank > 3 AND v.data = f.data AND v.version = f.version)")
    def retention_applied(spark, d):
        m = files(spark, d)
        return mf.drop_versions(m, mf.retention_select(m, 3)).select("data", "version", "name", "size")

    @r.add(f"SELECT data, version, name FROM ({_FILES}) WHERE dir = 'de' AND data = 'src6'")
    def tag_filter(spark, d):
        return mf.tag_filter(files(spark, d), {"lang": "de", "flow": "fsrc6"}).select("data", "version", "name")

    @r.add(
        f"""SELECT max(version) AS version, max(created_at) AS created_at FROM ({_FILES}) WHERE dir = 'fr'"""
    )
    def latest_version(spark, d):
        return mf.latest_version(files(spark, d), {"lang": "fr"}).select("version", "created_at")

    @r.add(
        """SELECT sum(n_chars)::BIGINT AS used_size, (9000000000 - sum(n_chars))::BIGINT AS free_size, 5000000 AS new_size,
                  sum(n_chars) + 5000000 <= 9000000000 AS fits FROM documents"""
    )
    def capacity_check(spark, d):
        return mf.capacity_check(files(spark, d), 9_000_000_000, 5_000_000)

    @r.add(
        f"""SELECT run_id, min(flow) AS flow,
                   CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED'
                        WHEN count(*) FILTER (WHERE status = 'SKIPPED') = count(*) THEN 'SKIPPED' ELSE 'SUCCESS' END AS status,
                   count(*) FILTER (WHERE status = 'SUCCESS') AS completed_steps, count(*) AS number_of_steps,
                   min(started_at) AS started_at, max(finished_at) AS finished_at,
                   date_diff('microsecond', min(started_at), max(finished_at)) / 1000000.0::DOUBLE AS duration_seconds
            FROM ({_STEPS}) GROUP BY run_id"""
    )
    def run_summary(spark, d):
        return mf.run_summary(steps(spark, d))

    @r.add(
        f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY started_at DESC, run_id DESC) AS rn FROM ({_STEPS}))
            WHERE rn = 1"""
    )
    def latest_run(spark, d):
        return mf.latest_run_per_flow(steps(spark, d))
