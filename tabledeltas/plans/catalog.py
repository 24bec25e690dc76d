"""The registered queries: every operator of the library over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabledeltas.functions.envelope import (
    accepted,
    decode_envelope,
    frame_body,
    frame_schema_id,
    is_framed,
    latest_schemas,
    rejected,
)
from tabledeltas.operators.changes import (
    apply_changes,
    change_feed,
    deletes,
    inserts,
    updates,
)
from tabledeltas.operators.latest import as_table, fold_latest, project_value
from tabledeltas.plans import fixture as fx
from tabledeltas.plans.runner import Run, run_query
from tabledeltas.sources import files
from tabledeltas.sources.layout import SILVER, Layout
from tabledeltas.sources.sinks import Sink, append_sink, file_sink, once
from tabledeltas.sources.snapshots import SnapshotStore, manifest
from tabledeltas.sources.topics import RecordedTopics, batch_table, read_topic
from tabledeltas.streaming.bronze import (
    ingest_topic,
    read_bronze,
    read_rejects,
    stream_bronze,
    topic_schema,
)
from tabledeltas.streaming.jobs import run_streams, run_until_idle
from tabledeltas.streaming.silver import (
    maintain_latest,
    read_changes,
    read_latest,
    register_topic,
)

Query = Callable[[SparkSession, str], DataFrame]

AVAILABLE_NOW = {"availableNow": True}
PK = "userid"
SAMPLE_COLUMNS = ["userid", "gender", "name", "regionid", "optional", "refcount"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def flat_value(df: DataFrame, *extra: str) -> DataFrame:
    """Folded ``yy`` rows with the value's fields as columns."""
    return df.select(
        "userid",
        F.col("value.refcount").alias("refcount"),
        F.col("value.optional").alias("optional"),
        F.col("value").isNull().alias("deleted"),
        *extra,
    )


def flat_feed(feed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    sides = [
        F.col(f"{side}.{c}").alias(f"{side}_{c}")
        for side in ("before", "after")
        for c in columns
        if c not in keys
    ]
    return feed.select("op", *keys, *sides)


# --- topics and payloads ------------------------------------------------------------------


def record_topic(df: DataFrame, base: str, topic: str) -> None:
    df.write.mode("append").parquet(f"{base}/{topic}")


def topic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream a recorded topic through the topic source; every column passes unchanged."""
    base = files.scratch_directory(spark)
    record_topic(fx.raw_topic(fx.yy_log(spark, sf_dir), "yy"), base, "yy")
    stream = (
        read_topic(spark, "yy", RecordedTopics(base))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/_checkpoints")
        .trigger(**AVAILABLE_NOW)
        .start(f"{base}/copy")
    )
    stream.awaitTermination()
    return batch_table(spark, f"{base}/copy").select(
        text("key"),
        text("value"),
        "topic",
        "partition",
        "offset",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("timestampType").alias("timestamp_type"),
    )


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_topic(fx.yy_log(spark, sf_dir), "yy")
    keyed = decode_envelope(raw, "key", fx.YY_KEY, required=True)
    return decode_envelope(keyed, "value", fx.YY_VALUE)


def decode_json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accepted(_decoded(spark, sf_dir)).where(F.col("value").isNotNull())
    return rows.select("offset", F.col("key.userId").alias("key_userid"), "value.*")


def decode_tombstone_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accepted(_decoded(spark, sf_dir)).where(F.col("value").isNull())
    return rows.select("offset", F.col("key.userId").alias("userid"))


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``yy`` with some payloads spoilt in one of four ways, by event type and ``k``."""
    log = fx.table(spark, sf_dir, "events").withColumn("k", fx.props_k())
    ok = F.concat(
        F.lit('{"userid":'),
        F.col("user_id"),
        F.lit(',"refcount":'),
        F.col("k") % 2,
        F.lit(',"optional":null}'),
    )
    kind = F.col("event_type")
    payload = (
        F.when(kind == "error", None)
        .when((kind == "signup") & (F.col("k") % 10 == 0), F.expr("concat('{\"userid\":', user_id)"))
        .when((kind == "purchase") & (F.col("k") % 10 == 1), "")
        .when(
            (kind == "view") & (F.col("k") % 10 == 2),
            F.expr("concat('{\"userid\":', user_id, ',\"refcount\":\"x\"}')"),
        )
        .when((kind == "view") & (F.col("k") % 10 == 3), F.expr("concat('{\"refcount\":', k, '}')"))
        .otherwise(ok)
    )
    return log.select(
        F.col("event_id").alias("offset"),
        F.struct(F.col("user_id").alias("userId")).alias("key"),
        payload.cast("binary").alias("value"),
    )


def decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not decode is set apart with its reason; tombstones are not among it."""
    rows = rejected(decode_envelope(_damaged(spark, sf_dir), "value", fx.YY_VALUE))
    return rows.select("offset", "column", "reason", text("payload"))


def decode_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of the same topic: rows and tombstones."""
    rows = accepted(decode_envelope(_damaged(spark, sf_dir), "value", fx.YY_VALUE))
    return rows.select("offset", "value.*")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``yy`` behind frames of two writers; records of the older one lack ``optional``."""
    old = F.to_json(F.struct("value.userid", "value.refcount"))
    new = F.to_json("value", {"ignoreNullFields": "false"})
    by_old = F.col("offset") % 3 == 0
    schema_id = F.when(by_old, fx.OLD_WRITER).otherwise(fx.NEW_WRITER)
    body = F.when(
        F.col("value").isNotNull(), fx.framed(schema_id, F.when(by_old, old).otherwise(new))
    )
    return fx.raw_topic(fx.yy_log(spark, sf_dir), "yy", body)


def frame_header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.col("value")
    return _framed(spark, sf_dir).select(
        "offset",
        F.coalesce(is_framed(payload), F.lit(False)).alias("framed"),
        frame_schema_id(payload).alias("schema_id"),
        frame_body(payload).cast("string").alias("body"),
    )


def decode_writer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record is read with the schema it was written with, into the topic's schema."""
    decoded = accepted(decode_envelope(_framed(spark, sf_dir), "value", fx.YY_VALUE, fx.FRAMED))
    return decoded.select("offset", "value.*", F.col("value").isNull().alias("deleted"))


def latest_schema_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version per topic and side, events standing for schema registrations."""
    registrations = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.when(F.col("user_id") % 2 == 0, "key").otherwise("value").alias("side"),
        F.col("event_id").alias("version"),
        (F.col("event_id") * 7 + F.col("user_id")).alias("schema_id"),
        F.col("props").alias("schema"),
    )
    return latest_schemas(registrations)


def decode_nested_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and maps of records whose writers did not know a field of the records yet: it gets
    its default in the list, and is null in the map."""
    log = fx.yy_log(spark, sf_dir).where(F.col("value").isNotNull())
    by_old = F.col("offset") % 3 == 0
    n = F.col("value.refcount")
    old = F.struct((F.col("offset") % 5).cast("int").alias("n"))
    new = F.struct((F.col("offset") % 5).cast("int").alias("n"), n.alias("unit"))

    def nested(item: Column) -> Column:
        items = F.transform(F.sequence(F.lit(0), n), lambda i: item)
        return F.to_json(
            F.struct(F.col("value.userid"), items.alias("items"), F.create_map(F.lit("a"), item).alias("by_name"))
        )

    schema_id = F.when(by_old, fx.OLD_WRITER).otherwise(fx.NEW_WRITER)
    body = fx.framed(schema_id, F.when(by_old, nested(old)).otherwise(nested(new)))
    decoded = decode_envelope(fx.raw_topic(log, "yy", body), "value", fx.NESTED, fx.NESTED_FRAMED)
    return accepted(decoded).select(
        "offset",
        F.size("value.items").alias("items"),
        F.get("value.items", F.lit(0))["n"].alias("n"),
        F.get("value.items", F.lit(0))["unit"].alias("unit"),
        F.col("value.by_name")["a"]["n"].alias("named_n"),
        F.col("value.by_name")["a"]["unit"].alias("named_unit"),
    )


# --- bronze and silver --------------------------------------------------------------------


def _layouts(spark: SparkSession) -> tuple[str, Layout]:
    base = files.scratch_directory(spark)
    return f"{base}/recorded", Layout(f"{base}/lake")


def land(
    spark: SparkSession,
    sf_dir: str,
    recorded: str,
    layout: Layout,
    part: int | tuple[int, int],
    parts: int,
) -> None:
    """Record the next range of ``yy`` and run the bronze stream over what is new."""
    new = fx.slice_of(spark, sf_dir, fx.yy_log(spark, sf_dir), part, parts)
    record_topic(fx.raw_topic(new, "yy"), recorded, "yy")
    ingest_topic(
        spark, "yy", RecordedTopics(recorded), fx.SCHEMAS["yy"], layout, AVAILABLE_NOW
    ).awaitTermination()


def refresh(
    spark: SparkSession, layout: Layout, fold_every: int = 50, stateful: bool = False
) -> None:
    """Run the silver stream over what is new in bronze."""
    maintain_latest(
        spark,
        stream_bronze(spark, layout, "yy", fx.SCHEMAS["yy"]),
        layout,
        "yy",
        fx.KEYS,
        fold_every=fold_every,
        stateful=stateful,
        trigger=AVAILABLE_NOW,
    ).awaitTermination()


def bronze_append_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the bronze stream: the second takes up where the first one stopped."""
    recorded, layout = _layouts(spark)
    for part in range(2):
        land(spark, sf_dir, recorded, layout, part, 2)
    rows = read_bronze(spark, layout, "yy", fx.SCHEMAS["yy"])
    return rows.select(
        "topic",
        "partition",
        "offset",
        F.col("key.userId").alias("userid"),
        F.col("value.refcount").alias("refcount"),
        F.col("value.optional").alias("optional"),
        F.col("value").isNull().alias("deleted"),
    )


def silver_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches over four ranges of the topic, folded into new epochs between."""
    recorded, layout = _layouts(spark)
    for part in range(4):
        land(spark, sf_dir, recorded, layout, part, 4)
        refresh(spark, layout, fold_every=2)
    return flat_value(read_latest(spark, layout, "yy", ["userid"]), "ord")


def silver_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream loses its checkpoint and replays everything onto the table it has."""
    recorded, layout = _layouts(spark)
    land(spark, sf_dir, recorded, layout, 0, 2)
    refresh(spark, layout)
    files.delete(spark, layout.of(SILVER, "yy").progress)
    land(spark, sf_dir, recorded, layout, 1, 2)
    refresh(spark, layout)
    return flat_value(read_latest(spark, layout, "yy", ["userid"]), "ord")


def silver_stateful_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold in Spark's own state, stopped and started again: what each of the two runs kept.
    The second one, though it reads new records only, knows the older values."""
    recorded, layout = _layouts(spark)
    for part in range(2):
        land(spark, sf_dir, recorded, layout, part, 2)
        refresh(spark, layout, stateful=True)
    return flat_value(read_changes(spark, layout, "yy"), "ord", F.col("batch_id").alias("run"))


def silver_topic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table under the topic's name, in SQL."""
    recorded, layout = _layouts(spark)
    land(spark, sf_dir, recorded, layout, 0, 1)
    refresh(spark, layout)
    register_topic(spark, layout, "yy", ["userid"])
    return spark.sql("SELECT userid, refcount, optional FROM yy")


def two_streams_one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded, layout = _layouts(spark)
    logs = {"xx": fx.xx_log(spark, sf_dir), "yy": fx.yy_log(spark, sf_dir)}
    for topic, log in logs.items():
        record_topic(fx.raw_topic(log, topic), recorded, topic)

    def start(topic: str):
        schema = fx.SCHEMAS[topic]
        source = RecordedTopics(recorded)
        return lambda: ingest_topic(spark, topic, source, schema, layout, AVAILABLE_NOW)

    run_streams([start(topic) for topic in logs])
    landed = [
        read_bronze(spark, layout, topic, fx.SCHEMAS[topic]).select(
            "topic", F.col("key.userId").alias("userid"), F.col("value").isNull().alias("deleted")
        )
        for topic in logs
    ]
    return (
        landed[0]
        .union(landed[1])
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("userid").alias("sum_userid"),
            F.count(F.when(F.col("deleted"), 1)).alias("tombstones"),
        )
    )


def bronze_default_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job with the default trigger, which would run for ever, until it has read its input."""
    recorded, layout = _layouts(spark)
    record_topic(fx.raw_topic(fx.xx_log(spark, sf_dir), "xx"), recorded, "xx")
    schema, source = fx.SCHEMAS["xx"], RecordedTopics(recorded)
    run_until_idle(spark, [lambda: ingest_topic(spark, "xx", source, schema, layout)])
    return read_bronze(spark, layout, "xx", schema).select("offset", "value.*")


def bronze_by_schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas come from a table of registered Avro records. Three writers are at work: the
    oldest has another type for a field, which cannot be read, the second calls it by a former
    name and lacks another one; the newest is the topic's schema."""
    recorded, layout = _layouts(spark)
    schemas = files.rows(spark, fx.REGISTERED, "topic, side, version, schema_id, schema")
    schemas.write.parquet(f"{recorded}/schemas")
    schema = topic_schema(spark.read.parquet(f"{recorded}/schemas"), "yy", json_bodies=True)
    record_topic(fx.registered_yy(spark, sf_dir), recorded, "yy")
    ingest_topic(
        spark, "yy", RecordedTopics(recorded), schema, layout, AVAILABLE_NOW
    ).awaitTermination()
    good = read_bronze(spark, layout, "yy", schema).select(
        "offset",
        F.lit(None).cast("string").alias("reason"),
        "value.userid",
        "value.refcount",
        "value.optional",
    )
    bad = read_rejects(spark, layout, "yy", schema).select("offset", "reason")
    return good.unionByName(bad, allowMissingColumns=True)


# --- latest value per key -----------------------------------------------------------------


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``xx``, projected to two of its fields before the fold."""
    log = project_value(fx.xx_log(spark, sf_dir), ["name", "regionid"])
    return fold_latest(log, fx.KEYS).select("userid", "value.*", "ord")


def latest_per_key_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_value(fold_latest(fx.yy_log(spark, sf_dir), fx.KEYS), "ord")


def latest_per_key_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by time and then offset, for keys that may change their partition."""
    folded = fold_latest(fx.yy_log(spark, sf_dir), fx.KEYS, order_by=["timestamp", "offset"])
    return flat_value(folded, F.col("ord.offset").alias("ord"))


def topic_table_xx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_table(fold_latest(fx.xx_log(spark, sf_dir), fx.KEYS))


def topic_table_yy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_table(fold_latest(fx.yy_log(spark, sf_dir), fx.KEYS))


def sample_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sample_result(spark, sf_dir)


# --- changes ------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.sample_result(spark, sf_dir, 9), fx.sample_result(spark, sf_dir)


def delta_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inserts(*_samples(spark, sf_dir), PK)


def delta_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes(*_samples(spark, sf_dir), PK)


def delta_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates(*_samples(spark, sf_dir), PK)


def delta_updates_sql_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates(*_samples(spark, sf_dir), PK, null_safe=False)


def change_feed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_feed(change_feed(*_samples(spark, sf_dir), PK), [PK], SAMPLE_COLUMNS)


def change_feed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(*fx.order_states(spark, sf_dir), "o_orderkey")
    return flat_feed(feed, ["o_orderkey"], ORDER_COLUMNS)


def change_feed_orders_sql_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(*fx.order_states(spark, sf_dir), "o_orderkey", null_safe=False)
    return flat_feed(feed, ["o_orderkey"], ORDER_COLUMNS)


def apply_changes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, latest = _samples(spark, sf_dir)
    return apply_changes(previous, change_feed(previous, latest, PK), PK)


def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold of several rows per key: the newest order of each customer."""
    log = fx.table(spark, sf_dir, "orders").select(
        F.struct(F.col("o_custkey").alias("custkey")).alias("key"),
        F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("value"),
        F.col("o_orderkey").alias("offset"),
    )
    folded = fold_latest(log, {"custkey": "key.custkey"})
    return folded.select("custkey", "value.*", "ord")


# --- query runs ---------------------------------------------------------------------------


def day(n: int) -> datetime:
    return datetime(2024, 1, n, 12, tzinfo=timezone.utc)


def run_at_cuts(
    spark: SparkSession,
    sf_dir: str,
    cuts: Sequence[int],
    sql: str = fx.SAMPLE_SQL,
    pk: str | Sequence[str] = PK,
    others: Sequence[str] = (),
    sink: Sink | None = None,
) -> tuple[Run, SnapshotStore, str]:
    """Run a query once per cut-off of ``yy``, a day apart; messages go to files, or the sink."""
    base = files.scratch_directory(spark)
    store = SnapshotStore(Layout(base), "sample")
    run = None
    for n, tenths in enumerate(cuts, start=1):
        tables = fx.topic_tables(spark, sf_dir, tenths)
        tables.update({name: fx.table(spark, sf_dir, name) for name in others})
        to = sink or file_sink(f"{base}/out")
        run = run_query(spark, sql, pk, tables, store, to, run_ts=day(n))
    return run, store, f"{base}/out"


def first_run_all_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, _, _ = run_at_cuts(spark, sf_dir, [10])
    return flat_feed(run.feed, [PK], SAMPLE_COLUMNS)


def second_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, _, _ = run_at_cuts(spark, sf_dir, [9, 10])
    return flat_feed(run.feed, [PK], SAMPLE_COLUMNS)


def third_run_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After three runs: the state of each, what it held, and how many are still on disk."""
    _, store, _ = run_at_cuts(spark, sf_dir, [5, 9, 10])
    on_disk = len(files.child_directories(spark, store.data_path))
    first_day = int(day(1).timestamp())
    return manifest(spark, store).select(
        (F.expr(f"(unix_seconds(run_ts) - {first_day}) DIV 86400") + 1).alias("run"),
        "status",
        "rows",
        F.lit(on_disk).alias("on_disk"),
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, out = run_at_cuts(spark, sf_dir, [9, 10])
    return batch_table(spark, f"{out}/run_ts={day(2):%Y%m%dT%H%M%S.%fZ}")


def emit_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).where(F.col("value").isNotNull())


def emit_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).where(F.col("value").isNull()).select("key")


def emitted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, each sent twice to a growing log, and read from it as a stream once."""
    base = files.scratch_directory(spark)
    send = append_sink(f"{base}/log", "sample")

    def twice(messages: DataFrame, run_ts: datetime) -> None:
        for _ in range(2):
            send(messages, run_ts)

    run_at_cuts(spark, sf_dir, [9, 10], sink=twice)
    log = spark.readStream.schema(spark.read.parquet(f"{base}/log").schema).parquet(f"{base}/log")
    stream = (
        once(log)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(**AVAILABLE_NOW)
        .start(f"{base}/once")
    )
    stream.awaitTermination()
    first_day = int(day(1).timestamp())
    return batch_table(spark, f"{base}/once").select(
        "query",
        (F.expr(f"(unix_seconds(run_ts) - {first_day}) DIV 86400") + 1).alias("run"),
        "key",
        "value",
    )


# Four shapes of query, each run at two cut-offs: the key, the columns and the text.
SHAPES: dict[str, tuple[list[str], list[str], str]] = {
    "feed_over_aggregate": (
        ["regionid"],
        ["regionid", "users", "total"],
        """
        SELECT x.regionid, count(*) AS users, CAST(sum(y.refcount) AS BIGINT) AS total
        FROM xx x INNER JOIN yy y ON x.userid = y.userid
        GROUP BY x.regionid
        """,
    ),
    "feed_over_left_join": (
        ["userid"],
        ["userid", "region", "refcount", "optional"],
        """
        SELECT x.userid, n.n_name AS region, y.refcount, y.optional
        FROM xx x
        LEFT JOIN nation n ON x.regionid = n.n_nationkey
        LEFT JOIN yy y ON x.userid = y.userid
        """,
    ),
    "feed_over_window": (
        ["regionid", "refcount"],
        ["regionid", "refcount", "users", "place"],
        """
        SELECT regionid, refcount, users,
               CAST(rank() OVER (PARTITION BY regionid ORDER BY users DESC) AS INT) AS place
        FROM (
          SELECT x.regionid, y.refcount, count(*) AS users
          FROM xx x INNER JOIN yy y ON x.userid = y.userid
          GROUP BY x.regionid, y.refcount
        ) per_count
        """,
    ),
    "feed_over_union": (
        ["topic", "userid"],
        ["topic", "userid", "detail"],
        """
        SELECT 'xx' AS topic, userid, name AS detail FROM xx
        UNION ALL
        SELECT 'yy' AS topic, userid, CAST(refcount AS STRING) AS detail FROM yy
        """,
    ),
}


def _shape(name: str) -> Query:
    keys, columns, sql = SHAPES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        run, _, _ = run_at_cuts(spark, sf_dir, [9, 10], sql, keys, others=["nation"])
        return flat_feed(run.feed, keys, columns)

    return query


QUERIES: dict[str, Query] = {
    "topic_envelope": topic_envelope,
    "decode_json_value": decode_json_value,
    "decode_tombstone_null": decode_tombstone_null,
    "decode_rejects": decode_rejects,
    "decode_accepts": decode_accepts,
    "frame_header_split": frame_header_split,
    "decode_writer_schemas": decode_writer_schemas,
    "latest_schema_per_topic": latest_schema_per_topic,
    "decode_nested_evolution": decode_nested_evolution,
    "bronze_append_replay": bronze_append_replay,
    "bronze_default_trigger": bronze_default_trigger,
    "bronze_by_schema_table": bronze_by_schema_table,
    "silver_stream_replay": silver_stream_replay,
    "silver_stateful_fold": silver_stateful_fold,
    "silver_restart": silver_restart,
    "silver_topic_view": silver_topic_view,
    "two_streams_one_job": two_streams_one_job,
    "latest_per_key": latest_per_key,
    "latest_order_per_customer": latest_order_per_customer,
    "latest_per_key_with_tombstones": latest_per_key_with_tombstones,
    "latest_per_key_by_time": latest_per_key_by_time,
    "topic_table_xx": topic_table_xx,
    "topic_table_yy": topic_table_yy,
    "sample_join": sample_join,
    "delta_inserts": delta_inserts,
    "delta_deletes": delta_deletes,
    "delta_updates": delta_updates,
    "delta_updates_sql_nulls": delta_updates_sql_nulls,
    "change_feed": change_feed_sample,
    "change_feed_orders": change_feed_orders,
    "change_feed_orders_sql_nulls": change_feed_orders_sql_nulls,
    "apply_changes_roundtrip": apply_changes_roundtrip,
    "first_run_all_inserts": first_run_all_inserts,
    "second_run_changes": second_run_changes,
    "third_run_retired": third_run_retired,
    "emit_upserts": emit_upserts,
    "emit_deletes": emit_deletes,
    "emitted_once": emitted_once,
    **{name: _shape(name) for name in SHAPES},
}
