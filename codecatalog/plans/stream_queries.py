"""Streaming queries. Each runs its stream over all available input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog import corpus
from codecatalog.plans.change_queries import (
    EVENT_CHANGE, EVENT_PATH, V2_SYMBOLS, corpus_snapshot, event_changes,
)
from codecatalog.operators import diff as d
from codecatalog.plans.registry import expected_symbols, query, with_base
from codecatalog.session import new_run_dir
from codecatalog.sources import state
from codecatalog.streaming import feed
from codecatalog.streaming import refresh as r

EVENT_FEED = "event_id bigint, path string, change string, ts timestamp"


def _feed_rows(files: DataFrame, change: str, ts: str) -> DataFrame:
    return files.select(
        "path", F.lit(change).alias("change"), F.encode("content", "UTF-8").alias("content"),
        F.lit(ts).cast("timestamp").alias("ts"),
    )


def _first_feed(spark: SparkSession, sf: str, directory: str) -> None:
    _feed_rows(corpus_snapshot(spark, sf, 1), "added", "2024-01-01").write.mode("append").parquet(directory)


def _second_feed(spark: SparkSession, sf: str, directory: str) -> None:
    """All files of the second snapshot, changed or not, and a deletion for each missing one."""
    old, new = corpus_snapshot(spark, sf, 1), corpus_snapshot(spark, sf, 2)
    gone = d.deleted_files(new, old).select("path", F.lit(None).cast("string").alias("content"))
    rows = _feed_rows(new, "modified", "2024-01-02").unionByName(_feed_rows(gone, "deleted", "2024-01-02"))
    rows.write.mode("append").parquet(directory)


def _run(spark: SparkSession, run: str) -> None:
    changes = feed.watch_source(spark, f"{run}/feed")
    r.stream_refresh(changes, f"{run}/catalog", f"{run}/checkpoint").awaitTermination()


@query("stream_refresh", with_base(f"SELECT path, module_name, kind, name, parent_name, line_number FROM {V2_SYMBOLS} m"))
def stream_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of the stream; the catalog must equal a batch extraction of the second snapshot."""
    run = new_run_dir(spark, "refresh")
    _first_feed(spark, sf, f"{run}/feed")
    _run(spark, run)
    _second_feed(spark, sf, f"{run}/feed")
    _run(spark, run)
    return r.current_symbols(spark, f"{run}/catalog").select("path", "module_name", "kind", "name", "parent_name", "line_number")


@query("stream_no_change", with_base(
    f"SELECT CAST(0 AS BIGINT) AS last_version, count(*) AS n_files FROM base WHERE NOT ({corpus.EXCLUDED})"))
def stream_no_change(spark: SparkSession, sf: str) -> DataFrame:
    """The same feed twice: the second round writes no version."""
    run = new_run_dir(spark, "no-change")
    for _ in range(2):
        _first_feed(spark, sf, f"{run}/feed")
        _run(spark, run)
    out = f"{run}/catalog"
    known = r.current_state(spark, out).agg(F.count("*").alias("n_files"))
    return known.select(F.lit(state.current_version(spark, out)).cast("bigint").alias("last_version"), "n_files")


@query("stream_quarantine", with_base(
    f"SELECT path, CASE WHEN {corpus.UNDECODABLE} THEN 'not valid UTF-8' ELSE {corpus.BREAK_REASON} END AS reason FROM base "
    f"WHERE NOT ({corpus.EXCLUDED}) AND ({corpus.UNDECODABLE} OR (lang = 'python' AND {corpus.BROKEN} AND NOT ({corpus.EMPTY})))"))
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Bad files are set aside and the stream goes on."""
    run = new_run_dir(spark, "quarantine")
    base = corpus.corpus_base(spark, sf)
    base.selectExpr(
        "path", "'added' AS change",
        f"CASE WHEN {corpus.UNDECODABLE} THEN concat(unhex('FF'), encode({corpus._CONTENT}, 'UTF-8')) "
        f"ELSE encode({corpus._CONTENT}, 'UTF-8') END AS content",
        "timestamp'2024-01-01' AS ts",
    ).write.parquet(f"{run}/feed")
    _run(spark, run)
    return r.current_quarantine(spark, f"{run}/catalog")


def _event_feed(spark: SparkSession, sf: str, run: str) -> DataFrame:
    """Events as change rows, one directory per day, read a few files at a time."""
    rows = event_changes(spark, sf).withColumn("day", F.to_date("ts"))
    rows.repartition("day").write.partitionBy("day").parquet(f"{run}/events")
    return spark.readStream.schema(EVENT_FEED).option("maxFilesPerTrigger", 10).parquet(f"{run}/events/*")


@query("stream_relevant", f"SELECT event_id, path FROM (SELECT event_id, {EVENT_PATH} AS path FROM events) e WHERE ends_with(path, '.py')")
def stream_relevant(spark: SparkSession, sf: str) -> DataFrame:
    run = new_run_dir(spark, "relevant")
    wanted = feed.relevant(_event_feed(spark, sf, run), [".py"]).select("event_id", "path")
    r.stream_change_log(wanted, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    return spark.read.schema("event_id bigint, path string").parquet(f"{run}/out")


@query("stream_change_log", f"SELECT path, change, epoch_us(ts) AS ts_us FROM (SELECT {EVENT_PATH} AS path, {EVENT_CHANGE} AS change, ts FROM events) e")
def stream_change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Watcher rows with absolute paths and numeric codes become labelled, relative ones."""
    run = new_run_dir(spark, "labels")
    raw = _event_feed(spark, sf, run).withColumns(
        {
            "path": F.concat(F.lit("/corpus/"), "path"),
            "change": F.when(F.col("change") == "added", "1").when(F.col("change") == "modified", "2").otherwise("3"),
        }
    )
    r.stream_change_log(feed.change_log(raw, "/corpus"), f"{run}/out", f"{run}/checkpoint").awaitTermination()
    written = spark.read.schema("path string, change string, ts timestamp").parquet(f"{run}/out")
    return written.select("path", "change", F.unix_micros("ts").alias("ts_us"))


# Purchases play the push events; users are dealt to seven repositories.
GATED_SQL = f"""
    WITH e AS (
        SELECT event_type, 'repo' || (user_id % 7) AS repo, {EVENT_PATH} AS path, {EVENT_CHANGE} AS change, ts FROM events
    ), gates AS (
        SELECT repo, max(ts) AS opened FROM e WHERE event_type = 'purchase' GROUP BY repo
    )
    SELECT CASE WHEN ts <= opened THEN 'released' ELSE 'pending' END AS section, path AS name, change, epoch_us(ts) AS ts_us, count(*) AS n
    FROM e LEFT JOIN gates USING (repo) WHERE event_type <> 'purchase' GROUP BY ALL
    UNION ALL SELECT 'ignored', event_type, NULL, NULL, count(*) FROM e WHERE event_type <> 'purchase' GROUP BY event_type
"""


@query("stream_event_gate", GATED_SQL)
def stream_event_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What gated events have released, what is still held back, and the counts of the events that started nothing."""
    run = new_run_dir(spark, "gate")
    repo = F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string"))
    users = spark.read.parquet(f"{sf}/events.parquet").select("event_id", repo.alias("repo"), "event_type")
    rows = event_changes(spark, sf).join(users, "event_id").withColumn("day", F.to_date("ts"))
    rows.repartition("day").write.partitionBy("day").parquet(f"{run}/events")
    schema = "event_id bigint, path string, change string, ts timestamp, repo string, event_type string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"{run}/events/*")
    r.stream_gated(stream, "purchase", f"{run}/out", f"{run}/checkpoint").awaitTermination()
    last = state.current_version(spark, f"{run}/out")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{run}/out/{name}/data")
    log = lambda name, rows: rows.groupBy("path", "change", "ts").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("section"), F.col("path").alias("name"), "change", F.unix_micros("ts").alias("ts_us"), "n"
    )
    ignored = read("ignored", "event_type string, n_ignored bigint").groupBy("event_type").agg(F.sum("n_ignored").alias("n"))
    none = F.lit(None)
    counts = ignored.select(F.lit("ignored").alias("section"), F.col("event_type").alias("name"), none.cast("string").alias("change"), none.cast("bigint").alias("ts_us"), "n")
    pending = read("pending", f"{r.GATED}, v bigint").where(F.col("v") == last)
    return log("released", read("released", r.GATED)).unionByName(log("pending", pending)).unionByName(counts)
