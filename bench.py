
from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import functions as F  # noqa: E402

from codecatalog import corpus  # noqa: E402
from codecatalog.operators import diff as d  # noqa: E402
from codecatalog.operators import modules, publish, render, symbols  # noqa: E402
from codecatalog.plans import change_queries, registry  # noqa: E402
from codecatalog.plans.build import BuildOptions, extract, select_files  # noqa: E402
from codecatalog.session import build_session, new_run_dir  # noqa: E402
from codecatalog.functions.text import sha256_hex  # noqa: E402
from codecatalog.streaming import feed, refresh  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": str(max(int(CPUS), 8)), "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = new_run_dir(spark, "bench")
    # The corpus and the tables that later steps read are written once and are not timed.
    corpus.corpus_files(spark, SF_DIR).withColumn("sha256", sha256_hex(F.col("content"))).write.parquet(f"{work}/files")
    files = spark.read.parquet(f"{work}/files")
    options = BuildOptions()
    selected = select_files(files, options)
    syms, mods, _ = extract(selected, options)
    syms.write.parquet(f"{work}/symbols")
    syms = spark.read.parquet(f"{work}/symbols")
    mods.write.parquet(f"{work}/modules")
    mods = spark.read.parquet(f"{work}/modules").where("n_functions > 0 OR n_classes > 0 OR docstring <> ''")
    state = files.select("path", "sha256")

    def changed_share(percent: int):
        edit = F.pmod(F.xxhash64("path"), F.lit(100)) < percent
        content = F.when(edit, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
        return files.select("path", content.alias("content")).withColumn("sha256", sha256_hex(F.col("content")))

    def refresh_share(percent: int):
        new = changed_share(percent)
        diff = d.snapshot_diff(new, state)
        fresh = extract(select_files(d.changed_files(new, diff), options), options)[0]
        return d.merge_catalog(syms, fresh, diff)

    def stream() -> None:
        run = new_run_dir(spark, "bench-stream")
        rows = files.select(
            "path", F.lit("added").alias("change"), F.encode("content", "UTF-8").alias("content"), F.current_timestamp().alias("ts")
        )
        rows.repartition(10).write.parquet(f"{run}/feed")
        source = feed.watch_source(spark, f"{run}/feed", max_files=5)
        refresh.stream_refresh(source, f"{run}/catalog", f"{run}/checkpoint").awaitTermination()

    placed = lambda suffix: modules.with_page_path(mods, suffix)
    steps = {
        "extract_symbols": lambda: sink(extract(selected, options)[0]),
        "content_hash": lambda: sink(files.select("path", sha256_hex(F.col("content")))),
        "snapshot_diff_0pct": lambda: sink(d.snapshot_diff(changed_share(0), state)),
        "snapshot_diff_10pct": lambda: sink(d.snapshot_diff(changed_share(10), state)),
        "incremental_1pct": lambda: sink(refresh_share(1)),
        "incremental_10pct": lambda: sink(refresh_share(10)),
        "render_markdown": lambda: sink(render.render_pages(syms, placed(".md"), "markdown")),
        "render_html": lambda: sink(render.render_pages(syms, placed(".html"), "html")),
        "module_order": lambda: sink(modules.module_order(mods)),
        "publish_manifest": lambda: sink(publish.publish_manifest(render.render_pages(syms, placed(".md"), "markdown"))),
        "doc_diff_report": lambda: sink(change_queries.doc_diff_report(spark, SF_DIR)),
        "stream_refresh_2_batches": stream,
    }
    timings = {}
    for name, step in steps.items():
        step()
        runs = []
        for _ in range(1 if name.startswith("stream") else RUNS):
            start = time.perf_counter()
            step()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "catalog_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "files": files.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
