"""The registered queries in plain SQL, to check results against another database."""

from __future__ import annotations

from collections.abc import Sequence

from tabledeltas.plans import fixture as fx
from tabledeltas.plans.catalog import ORDER_COLUMNS, SAMPLE_COLUMNS, SHAPES

EVENTS = "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"

YY_LOG = f"""
SELECT user_id AS userid, event_id AS "offset", event_type = 'error' AS deleted, ts,
       CASE WHEN event_type <> 'error' THEN CAST(k % 2 AS INTEGER) END AS refcount,
       CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(k // 50 AS INTEGER) END AS optional
FROM ({EVENTS}) e
"""

XX = """
SELECT c_custkey AS userid, c_name AS name, c_mktsegment AS gender, c_nationkey AS regionid
FROM customer
"""


def yy_folded(tenths: int = 10, order: str = '"offset"') -> str:
    """The row with the greatest offset per user, tombstones included."""
    return f"""
    SELECT userid, refcount, optional, deleted, "offset" AS ord FROM (
      SELECT *, row_number() OVER (PARTITION BY userid ORDER BY {order} DESC) AS rn
      FROM ({YY_LOG}) l
      WHERE "offset" * 10 < (SELECT count(*) FROM events) * {tenths}
    ) r WHERE rn = 1
    """


def yy_table(tenths: int = 10) -> str:
    return f"SELECT userid, refcount, optional FROM ({yy_folded(tenths)}) f WHERE NOT deleted"


def at(sql: str, tenths: int) -> str:
    """A query over ``xx`` and ``yy`` with ``yy`` as of a cut-off."""
    return f"WITH xx AS ({XX}), yy AS ({yy_table(tenths)}) {sql}"


def feed(previous: str, latest: str, keys: Sequence[str], columns: Sequence[str], null_safe=True) -> str:
    others = [c for c in columns if c not in keys]
    join = " AND ".join(f"p.{k} = l.{k}" for k in keys)
    if null_safe:
        changed = " OR ".join(f"p.{c} IS DISTINCT FROM l.{c}" for c in others)
    else:
        changed = "NOT (" + " AND ".join(f"p.{c} = l.{c}" for c in others) + ")"
    key = keys[0]
    selected = [f"coalesce(p.{k}, l.{k}) AS {k}" for k in keys]
    selected += [f"p.{c} AS before_{c}" for c in others] + [f"l.{c} AS after_{c}" for c in others]
    return f"""
    SELECT CASE WHEN p.{key} IS NULL THEN 'I' WHEN l.{key} IS NULL THEN 'D' ELSE 'U' END AS op,
           {', '.join(selected)}
    FROM ({previous}) p FULL OUTER JOIN ({latest}) l ON {join}
    WHERE p.{key} IS NULL OR l.{key} IS NULL OR ({changed})
    """


SAMPLE = fx.SAMPLE_SQL
PREVIOUS, LATEST = at(SAMPLE, 9), at(SAMPLE, 10)
EMPTY = f"SELECT * FROM ({PREVIOUS}) e WHERE false"


def updated(changed: str) -> str:
    return f"""
    SELECT l.* FROM ({LATEST}) l INNER JOIN ({PREVIOUS}) p ON p.userid = l.userid WHERE {changed}
    """


SAMPLE_OTHERS = [c for c in SAMPLE_COLUMNS if c != "userid"]
DISTINCT = " OR ".join(f"p.{c} IS DISTINCT FROM l.{c}" for c in SAMPLE_OTHERS)
UNEQUAL = "NOT (" + " AND ".join(f"p.{c} = l.{c}" for c in SAMPLE_OTHERS) + ")"

ORDERS_PREVIOUS = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 10 <> 0
"""
ORDERS_LATEST = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 10 = 2 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
       o_orderpriority
FROM orders WHERE o_orderkey % 10 <> 1
"""

BAD_PAYLOAD = """
SELECT event_id AS "offset", k, user_id,
  CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN 'malformed'
       WHEN event_type = 'purchase' AND k % 10 = 1 THEN 'malformed'
       WHEN event_type = 'view' AND k % 10 = 2 THEN 'malformed'
       WHEN event_type = 'view' AND k % 10 = 3 THEN 'missing userid' END AS reason,
  CASE WHEN event_type = 'signup' THEN '{"userid":' || user_id
       WHEN event_type = 'purchase' THEN ''
       WHEN k % 10 = 2 THEN '{"userid":' || user_id || ',"refcount":"x"}'
       ELSE '{"refcount":' || k || '}' END AS payload,
  event_type = 'error' AS deleted
""" + f"FROM ({EVENTS}) e"

YY_BODY = """'{"userid":' || userid || ',"refcount":' || refcount || ',"optional":'
  || coalesce(CAST(optional AS VARCHAR), 'null') || '}'"""

SAMPLE_MESSAGE = """'{"userid":' || userid || ',"gender":"' || after_gender
  || '","name":"' || after_name || '","regionid":' || after_regionid
  || ',"optional":' || coalesce(CAST(after_optional AS VARCHAR), 'null')
  || ',"refcount":' || after_refcount || '}'"""

FEED = feed(PREVIOUS, LATEST, ["userid"], SAMPLE_COLUMNS)
ROWS_AT = "(SELECT count(*) FROM ({}) c)"

ORACLE: dict[str, str] = {
    "topic_envelope": f"""
        SELECT '{{"userId":' || userid || '}}' AS key,
               CASE WHEN NOT deleted THEN {YY_BODY} END AS value,
               'yy' AS topic, CAST(userid % {fx.TOPIC_PARTITIONS} AS INTEGER) AS "partition",
               "offset", strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
               CAST(0 AS INTEGER) AS timestamp_type
        FROM ({YY_LOG}) l""",
    "decode_json_value": f"""
        SELECT "offset", userid AS key_userid, userid, refcount, optional
        FROM ({YY_LOG}) l WHERE NOT deleted""",
    "decode_tombstone_null": f'SELECT "offset", userid FROM ({YY_LOG}) l WHERE deleted',
    "decode_rejects": f"""
        SELECT "offset", 'value' AS "column", reason, payload
        FROM ({BAD_PAYLOAD}) b WHERE reason IS NOT NULL""",
    "decode_accepts": f"""
        SELECT "offset", CASE WHEN NOT deleted THEN user_id END AS userid,
               CASE WHEN NOT deleted THEN CAST(k % 2 AS INTEGER) END AS refcount,
               CAST(NULL AS INTEGER) AS optional
        FROM ({BAD_PAYLOAD}) b WHERE reason IS NULL""",
    "frame_header_split": f"""
        SELECT "offset", NOT deleted AS framed,
               CASE WHEN deleted THEN NULL WHEN "offset" % 3 = 0 THEN CAST({fx.OLD_WRITER} AS BIGINT)
                    ELSE CAST({fx.NEW_WRITER} AS BIGINT) END AS schema_id,
               CASE WHEN deleted THEN NULL
                    WHEN "offset" % 3 = 0 THEN '{{"userid":' || userid || ',"refcount":' || refcount || '}}'
                    ELSE {YY_BODY} END AS body
        FROM ({YY_LOG}) l""",
    "decode_writer_schemas": f"""
        SELECT "offset", CASE WHEN NOT deleted THEN userid END AS userid, refcount,
               CASE WHEN "offset" % 3 <> 0 THEN optional END AS optional, deleted
        FROM ({YY_LOG}) l""",
    "latest_schema_per_topic": """
        SELECT topic, side, version, schema_id, schema FROM (
          SELECT *, row_number() OVER (PARTITION BY topic, side ORDER BY version DESC) AS rn FROM (
            SELECT event_type AS topic, CASE WHEN user_id % 2 = 0 THEN 'key' ELSE 'value' END AS side,
                   event_id AS version, event_id * 7 + user_id AS schema_id, props AS schema
            FROM events) r
        ) n WHERE rn = 1""",
    "decode_nested_evolution": f"""
        SELECT "offset", CAST(refcount + 1 AS INTEGER) AS items, CAST("offset" % 5 AS INTEGER) AS n,
               CASE WHEN "offset" % 3 = 0 THEN CAST(-1 AS INTEGER) ELSE refcount END AS unit,
               CAST("offset" % 5 AS INTEGER) AS named_n,
               CASE WHEN "offset" % 3 <> 0 THEN refcount END AS named_unit
        FROM ({YY_LOG}) l WHERE NOT deleted""",
    "bronze_default_trigger": f'SELECT *, userid AS "offset" FROM ({XX}) x',
    "bronze_by_schema_table": f"""
        SELECT "offset", CASE WHEN "offset" % 3 = 0 AND NOT deleted THEN 'incompatible schema id' END AS reason,
               CASE WHEN "offset" % 3 <> 0 AND NOT deleted THEN userid END AS userid,
               CASE WHEN "offset" % 3 <> 0 THEN CAST(refcount AS BIGINT) END AS refcount,
               CASE WHEN deleted OR "offset" % 3 = 0 THEN NULL
                    WHEN "offset" % 3 = 1 THEN CAST(-1 AS INTEGER) ELSE optional END AS optional
        FROM ({YY_LOG}) l""",
    "bronze_append_replay": f"""
        SELECT 'yy' AS topic, CAST(userid % {fx.TOPIC_PARTITIONS} AS INTEGER) AS "partition",
               "offset", userid, refcount, optional, deleted
        FROM ({YY_LOG}) l""",
    "silver_stream_replay": yy_folded(),
    "silver_restart": yy_folded(),
    "silver_stateful_fold": f"""
        SELECT *, CAST(0 AS BIGINT) AS run FROM ({yy_folded(5)}) f
        UNION ALL
        SELECT *, CAST(1 AS BIGINT) FROM ({yy_folded()}) f
        WHERE userid IN (SELECT user_id FROM events WHERE event_id * 2 >= (SELECT count(*) FROM events))""",
    "silver_topic_view": yy_table(),
    "two_streams_one_job": f"""
        SELECT 'xx' AS topic, count(*) AS records, CAST(sum(c_custkey) AS BIGINT) AS sum_userid,
               CAST(0 AS BIGINT) AS tombstones FROM customer
        UNION ALL
        SELECT 'yy', count(*), CAST(sum(userid) AS BIGINT), count(*) FILTER (WHERE deleted)
        FROM ({YY_LOG}) l""",
    "latest_per_key": f"SELECT userid, name, regionid, userid AS ord FROM ({XX}) x",
    "latest_order_per_customer": """
        SELECT o_custkey AS custkey, o_orderkey, o_orderstatus, o_orderpriority, o_orderkey AS ord
        FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "latest_per_key_with_tombstones": yy_folded(),
    "latest_per_key_by_time": yy_folded(order='ts DESC, "offset"'),
    "topic_table_xx": XX,
    "topic_table_yy": yy_table(),
    "sample_join": LATEST,
    "delta_inserts": f"""
        SELECT l.* FROM ({LATEST}) l LEFT JOIN ({PREVIOUS}) p ON p.userid = l.userid
        WHERE p.userid IS NULL""",
    "delta_deletes": f"""
        SELECT p.* FROM ({PREVIOUS}) p LEFT JOIN ({LATEST}) l ON p.userid = l.userid
        WHERE l.userid IS NULL""",
    "delta_updates": updated(DISTINCT),
    "delta_updates_sql_nulls": updated(UNEQUAL),
    "change_feed": FEED,
    "change_feed_orders": feed(ORDERS_PREVIOUS, ORDERS_LATEST, ["o_orderkey"], ORDER_COLUMNS),
    "change_feed_orders_sql_nulls": feed(
        ORDERS_PREVIOUS, ORDERS_LATEST, ["o_orderkey"], ORDER_COLUMNS, null_safe=False
    ),
    "apply_changes_roundtrip": LATEST,
    "first_run_all_inserts": feed(EMPTY, LATEST, ["userid"], SAMPLE_COLUMNS),
    "second_run_changes": FEED,
    "third_run_retired": f"""
        SELECT CAST(run AS BIGINT) AS run, status, CAST(n AS BIGINT) AS rows, CAST(2 AS INTEGER) AS on_disk
        FROM (
          SELECT 1 AS run, 'retired' AS status, {ROWS_AT.format(at(SAMPLE, 5))} AS n
          UNION ALL SELECT 2, 'committed', {ROWS_AT.format(PREVIOUS)}
          UNION ALL SELECT 3, 'committed', {ROWS_AT.format(LATEST)}
        ) r""",
    "emit_upserts": f"""
        SELECT '{{"userid":' || userid || '}}' AS key,
               {SAMPLE_MESSAGE} AS value
        FROM ({FEED}) f WHERE op <> 'D'""",
    "emitted_once": f"""
        SELECT 'sample' AS query, CAST(run AS BIGINT) AS run,
               '{{"userid":' || userid || '}}' AS key,
               CASE WHEN op <> 'D' THEN {SAMPLE_MESSAGE} END AS value
        FROM (SELECT 1 AS run, * FROM ({feed(EMPTY, PREVIOUS, ["userid"], SAMPLE_COLUMNS)}) f
              UNION ALL SELECT 2, * FROM ({FEED}) f) r""",
    "emit_deletes": f"""
        SELECT '{{"userid":' || userid || '}}' AS key FROM ({FEED}) f WHERE op = 'D'""",
    **{
        name: feed(at(sql, 9), at(sql, 10), keys, columns)
        for name, (keys, columns, sql) in SHAPES.items()
    },
}
