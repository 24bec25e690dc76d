"""The operators on many copies of the driver's tables, with one hot key.

Copies of ``orders`` get keys of their own. In the copies of ``events`` a third of all rows
belongs to one user, the others to a user per copy. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_COPIES=100 python bench_scale.py
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bench import SF_DIR, outer_is_null, run_all, session, three_joins, timed
from tabledeltas.operators import change_feed, fold_latest, inserts
from tabledeltas.operators.changes import key_stats
from tabledeltas.plans import fixture as fx
from tabledeltas.sources import files, load_snapshot, write_snapshot
from tabledeltas.sources.batches import write_batch
from tabledeltas.sources.layout import Layout
from tabledeltas.streaming import read_latest

COPIES = int(os.environ.get("BENCH_COPIES", "100"))
HOT_USER = 0


def copies(spark: SparkSession, name: str) -> DataFrame:
    copy = F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy")
    return fx.table(spark, SF_DIR, name).repartition(32).select("*", copy)


def write_copies(spark: SparkSession, base: str) -> None:
    sizes = {n: fx.table(spark, SF_DIR, n).count() for n in ("orders", "events")}
    copies(spark, "orders").withColumn(
        "o_orderkey", F.col("o_orderkey") + F.col("copy") * sizes["orders"]
    ).drop("copy").write.parquet(f"{base}/orders.parquet")
    events = copies(spark, "events")
    user = F.when(F.col("event_id") % 3 == 0, HOT_USER).otherwise(
        F.col("user_id") * (COPIES + 1) + F.col("copy")
    )
    events.withColumn("event_id", F.col("event_id") + F.col("copy") * sizes["events"]).withColumn(
        "user_id", user.cast("long")
    ).drop("copy").write.parquet(f"{base}/events.parquet")


def compare_states(spark: SparkSession, base: str) -> dict[str, float]:
    key = "o_orderkey"
    previous, latest = fx.order_states(spark, base)
    saved = []

    def save():
        n = len(saved)
        for state in (previous, latest):
            run_ts = datetime(2024, 1, 1, tzinfo=timezone.utc)
            path = f"{base}/saved_{n}_{len(saved) % 2}"
            saved.append(write_snapshot(state, key, path, run_ts))

    names = ("one_pass", "three_joins", "anti_join", "outer_is_null", "save_both_in_buckets")
    times = timed(
        lambda: run_all(change_feed(previous, latest, key)),
        lambda: three_joins(previous, latest, key),
        lambda: run_all(inserts(previous, latest, key)),
        lambda: run_all(outer_is_null(previous, latest, key)),
        save,
    )
    before, after = (load_snapshot(spark, s) for s in saved[-2:])
    saved_names = ("one_pass_of_saved", "key_check", "key_check_of_saved")
    saved_times = timed(
        lambda: run_all(change_feed(before, after, key)),
        lambda: key_stats(latest, key),
        lambda: key_stats(after, key),
    )
    return dict(zip(names + saved_names, times + saved_times))


def read_silver(spark: SparkSession, base: str) -> dict[str, float]:
    """Orders as a silver table: all in one folded part, and then one per cent changed since."""
    layout, keys = Layout(f"{base}/lake"), {"key": "o_orderkey"}
    path = layout.of("silver", "orders").rows
    log = fx.table(spark, base, "orders").select(
        "o_orderkey", F.struct("*").alias("value"), F.col("o_orderkey").alias("offset")
    )

    def read() -> None:
        run_all(read_latest(spark, layout, "orders", ["key"]))

    write_batch(fold_latest(log, keys), f"{path}/epoch=00000000", "s", 0)
    (folded,) = timed(read)
    changed = log.where("o_orderkey % 100 = 0").withColumn("offset", F.col("offset") + 1)
    write_batch(fold_latest(changed, keys), f"{path}/epoch=00000000", "s", 1)
    (since,) = timed(read)
    return {"read_silver_folded": folded, "read_silver": since}


def main() -> None:
    spark = session()
    base = files.scratch_directory(spark)
    write_copies(spark, base)
    log = fx.yy_log(spark, base)
    names = ("scan_events", "fold_with_hot_key")
    times = timed(lambda: run_all(log), lambda: run_all(fold_latest(log, fx.KEYS)))
    line = {
        "copies": COPIES,
        "events": fx.table(spark, base, "events").count(),
        "orders": fx.table(spark, base, "orders").count(),
        "seconds": {
            **dict(zip(names, times)),
            **compare_states(spark, base),
            **read_silver(spark, base),
        },
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
