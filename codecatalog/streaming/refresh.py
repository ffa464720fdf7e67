"""Continuous refresh: each micro-batch of file changes updates the catalog.

A batch writes only what it touched: the new symbol rows and the new state rows of its paths. The
catalog is the log of these writes; for each path its latest version counts. All of a batch's data is
written under the next version before that version is committed. A replayed batch either overwrites
its own uncommitted version or, once committed, finds every hash already known and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codecatalog.operators.symbols import extract_symbols
from codecatalog.plans.build import SYMBOL_SCHEMA, BuildOptions
from codecatalog.functions.text import sha256_hex
from codecatalog.sources import files as src
from codecatalog.sources import state
from codecatalog.streaming.feed import relevant

STATE_LOG = "path string, sha256 string, ts timestamp"
QUARANTINE_LOG = "path string, reason string"


def latest_state(spark: SparkSession, out: str, only: DataFrame | None = None) -> DataFrame:
    """``(path, v, sha256, ts)`` of every known path, or those in ``only``; a null hash marks a deleted file."""
    log = state.read_log(spark, f"{out}/state", STATE_LOG, state.current_version(spark, out))
    if only is not None:
        log = log.join(only.select("path"), "path", "left_semi")
    return (
        log.groupBy("path")
        .agg(F.max(F.struct("v", "sha256", "ts")).alias("last"))
        .select("path", "last.v", "last.sha256", "last.ts")
    )


def current_state(spark: SparkSession, out: str) -> DataFrame:
    return latest_state(spark, out).where("sha256 IS NOT NULL").select("path", "sha256", "ts")


def current_symbols(spark: SparkSession, out: str) -> DataFrame:
    last = state.current_version(spark, out)
    log = state.read_log(spark, f"{out}/symbols", SYMBOL_SCHEMA, last)
    return log.join(latest_state(spark, out).where("sha256 IS NOT NULL").select("path", "v"), ["path", "v"]).drop("v")


def current_quarantine(spark: SparkSession, out: str) -> DataFrame:
    last = state.current_version(spark, out)
    log = state.read_log(spark, f"{out}/quarantine", QUARANTINE_LOG, last)
    return log.join(latest_state(spark, out).select("path", "v"), ["path", "v"]).drop("v")


def refresh(batch: DataFrame, out: str, options: BuildOptions = BuildOptions()) -> bool:
    """Apply one batch of ``(path, change, content, ts)``; False if nothing really changed.

    The latest event of a path counts; of equally late ones that with the larger content hash, so a replay chooses
    the same. An event older than what the catalog has of its path changes nothing.
    """
    spark = batch.sparkSession
    committed = state.current_version(spark, out)
    version = 0 if committed is None else committed + 1
    last = (
        batch.groupBy("path")
        .agg(F.max_by(F.struct("change", "content", "ts"), F.struct("ts", F.sha2("content", 256), "change")).alias("c"))
        .select("path", "c.change", "c.content", F.col("c.ts").cast("timestamp").alias("ts"))
    )
    last = src.exclude_dirs(src.tag_language(last, options.specs), options.exclude)
    hashed = last.withColumn(
        "sha256", F.when(F.col("change") != "deleted", sha256_hex(F.col("content")))
    )
    known = latest_state(spark, out, only=hashed).select("path", F.col("sha256").alias("old"), F.col("ts").alias("old_ts"))
    newer = F.col("old_ts").isNull() | F.col("ts").isNull() | (F.col("ts") >= F.col("old_ts"))
    touched = hashed.join(known, "path", "left").where(newer & ~F.col("sha256").eqNullSafe(F.col("old"))).drop("old", "old_ts")
    touched = touched.persist()
    try:
        if touched.isEmpty():
            return False
        present = touched.where("change <> 'deleted'")
        decoded, undecodable = src.decode_text(present)
        good, broken = src.quarantine_syntax(
            src.skip_test_files(src.tag_language(decoded, options.specs), options.specs), options.specs
        )
        symbols = extract_symbols(good, options.specs, private=not options.exclude_private)
        state.write_data(symbols, f"{out}/symbols", version)
        state.write_data(undecodable.unionByName(broken), f"{out}/quarantine", version)
        state.write_data(touched.select("path", "sha256", "ts"), f"{out}/state", version)
        state.commit(spark, out, version)
        return True
    finally:
        touched.unpersist()


def stream_refresh(
    changes: DataFrame, out: str, checkpoint: str, options: BuildOptions = BuildOptions(), **trigger
) -> StreamingQuery:
    """Keep the catalog at ``out`` current with a change feed.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, as ``processingTime="30 seconds"`` for a refresh that keeps
    running; without one it runs what is available, then stops.
    """
    wanted = relevant(changes, [e for s in options.specs.values() for e in s.extensions])
    return (
        wanted.writeStream.foreachBatch(lambda batch, _: refresh(batch, out, options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact(spark: SparkSession, out: str, target: str, version: int) -> None:
    """Write the current catalog as the single version of a new log."""
    symbols, states = current_symbols(spark, out), current_state(spark, out)
    state.write_data(symbols, f"{target}/symbols", version)
    state.write_data(states, f"{target}/state", version)
    state.write_data(current_quarantine(spark, out), f"{target}/quarantine", version)
    state.commit(spark, target, version)


def stream_change_log(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append labelled changes to a Parquet table."""
    return (
        changes.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


GATED = "repo string, path string, change string, content binary, ts timestamp, event_type string"
_GATES = "repo string, ts timestamp"


def apply_gate(batch: DataFrame, batch_id: int, gate: str, out: str, options: BuildOptions | None = None) -> None:
    """Holds changes back until an event of type ``gate`` reaches their repository.

    A change is released once its repository has a gated event that isn't older. Version ``batch_id`` of the tables under ``out``
    follows from the version before and the batch alone, so a replayed batch writes the same: ``gates`` (last gated event of
    each repository), ``pending`` (what is still held), ``released`` and ``ignored`` (events of other types that came, and
    those without a path, which change nothing). A batch costs what is pending and new, not what was released before. With
    ``options`` released changes also refresh the catalog ``{out}/catalog``.
    """
    spark, last = batch.sparkSession, state.current_version(batch.sparkSession, out)
    if last is not None and last >= batch_id:
        last = batch_id - 1
    before = lambda name, schema: (
        spark.createDataFrame([], schema) if last is None or last < 0 else spark.read.schema(schema).parquet(f"{out}/{name}/data/v={last}")
    )
    fields = [c.split(" ")[0] for c in GATED.split(", ")]
    rows = batch.select(*(F.col(c) if c in batch.columns else F.lit(None).cast("binary").alias(c) for c in fields))
    rows.persist()
    try:
        gates = rows.where(F.col("event_type") == gate).select("repo", "ts")
        state.write_data(before("gates", _GATES).unionByName(gates).groupBy("repo").agg(F.max("ts").alias("ts")), f"{out}/gates", batch_id)
        opened = spark.read.schema(_GATES).parquet(f"{out}/gates/data/v={batch_id}").select("repo", F.col("ts").alias("opened"))
        held = before("pending", GATED).unionByName(rows.where((F.col("event_type") != gate) & F.col("path").isNotNull()))
        # A repository with very many changes may be split by adaptive execution: the other side has one row for it.
        judged = held.join(opened, "repo", "left")
        free = F.coalesce(F.col("ts") <= F.col("opened"), F.lit(False))
        state.write_data(judged.where(~free).drop("opened"), f"{out}/pending", batch_id)
        state.write_data(judged.where(free).drop("opened"), f"{out}/released", batch_id)
        ignored = rows.where(F.col("event_type") != gate).groupBy("event_type").agg(F.count("*").alias("n_ignored"))
        state.write_data(ignored, f"{out}/ignored", batch_id)
        if options is not None:
            released = spark.read.schema(GATED).parquet(f"{out}/released/data/v={batch_id}")
            refresh(released.select("path", "change", "content", "ts"), f"{out}/catalog", options)
        state.commit(spark, out, batch_id)
    finally:
        rows.unpersist()


def stream_gated(
    events: DataFrame, gate: str, out: str, checkpoint: str, options: BuildOptions | None = None, **trigger
) -> StreamingQuery:
    """A stream of events ``repo, path, change, content, ts, event_type`` through ``apply_gate``."""
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: apply_gate(batch, batch_id, gate, out, options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
