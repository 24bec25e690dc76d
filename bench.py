"""Headline queries, and the same work in the phrasing they replace.

Prints one JSON line. ``queries`` are medians of repeated runs, ``compared`` are the
alternatives measured beside them: they are not part of ``value``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledeltas.operators import change_feed, deletes, fold_latest, inserts, updates
from tabledeltas.plans import catalog, fixture as fx
from tabledeltas.sources import files
from tabledeltas.streaming import read_changes

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
#: Ranges of the log in thousandths: nearly all of it, then batches that touch few keys.
TAIL, BATCHES = 990, 10


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_all(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(*works) -> list[float]:
    """Median of the repeats of each work after one warm-up, taking turns."""
    times: list[list[float]] = [[] for _ in works]
    for _ in range(REPEATS + 1):
        for taken, work in zip(times, works):
            start = time.perf_counter()
            work()
            taken.append(time.perf_counter() - start)
    return [round(statistics.median(t[1:]), 3) for t in times]


def three_joins(previous: DataFrame, latest: DataFrame, key: str) -> None:
    for part in (
        inserts(previous, latest, key),
        updates(previous, latest, key),
        deletes(previous, latest, key),
    ):
        run_all(part)


def outer_is_null(previous: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    l, p = latest.alias("l"), previous.alias("p")
    joined = l.join(p, F.col(f"l.{key}") == F.col(f"p.{key}"), "left_outer")
    return joined.where(F.col(f"p.{key}").isNull()).select("l.*")


def rows_written(spark: SparkSession) -> dict[str, int]:
    """Rows that a silver replay in micro-batches writes, and what rewriting the whole table
    in each of them would write."""
    base = files.scratch_directory(spark)
    recorded, layout = f"{base}/recorded", catalog.Layout(f"{base}/lake")
    rewritten = 0
    for first, last in [(0, TAIL)] + [(n, n + 1) for n in range(TAIL, TAIL + BATCHES)]:
        catalog.land(spark, SF_DIR, recorded, layout, (first, last), 1000)
        catalog.refresh(spark, layout)
        table = catalog.read_latest(spark, layout, "yy", ["userid"])
        rewritten += table.count()
    return {"changed_keys": read_changes(spark, layout, "yy").count(), "full_rewrite": rewritten}


def main() -> None:
    spark = session()
    key = "o_orderkey"
    previous, latest = fx.order_states(spark, SF_DIR)
    registered = {
        name: (lambda n=name: run_all(catalog.QUERIES[n](spark, SF_DIR)))
        for name in (
            "sample_join",
            "change_feed",
            "latest_schema_per_topic",
            "decode_json_value",
            "decode_writer_schemas",
            "bronze_append_replay",
            "silver_stream_replay",
            "first_run_all_inserts",
            "second_run_changes",
            "emit_upserts",
            "feed_over_left_join",
        )
    }
    headline = {
        "latest_per_key_with_tombstones": lambda: run_all(
            fold_latest(fx.yy_log(spark, SF_DIR), fx.KEYS)
        ),
        "change_feed_orders": lambda: run_all(change_feed(previous, latest, key)),
        "delta_inserts_orders": lambda: run_all(inserts(previous, latest, key)),
        **registered,
    }
    compared = {
        "change_feed_orders_as_three_joins": lambda: three_joins(previous, latest, key),
        "delta_inserts_orders_as_outer_is_null": lambda: run_all(
            outer_is_null(previous, latest, key)
        ),
    }
    queries = {name: timed(work)[0] for name, work in headline.items()}
    pairs = {
        "change_feed_orders": "change_feed_orders_as_three_joins",
        "delta_inserts_orders": "delta_inserts_orders_as_outer_is_null",
    }
    beside = {}
    for name, other in pairs.items():
        queries[name], beside[other] = timed(headline[name], compared[other])
    line = {
        "metric": "sum of median query times",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
        "compared": beside,
        "silver_rows_written": rows_written(spark),
        "cpus": int(CPUS),
        "repeats": REPEATS,
    }
    print(json.dumps(line))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
