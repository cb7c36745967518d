"""Core data-work queries: labelling, windowed statistics, records, points, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import labels, stats
from tidewatch.plans import sqlparts as S
from tidewatch.plans.catalog import register
from tidewatch.plans.inputs import SENSOR_COLS, rounded, sensor_events


def labelled_sensor(spark, sf):
    """events -> decode -> truncate to seconds -> interval label."""
    ev = labels.truncate_time(sensor_events(spark, sf), "ts", "second")
    return labels.label_intervals(ev, "ts", labels.interval_table(spark))


_WINDOW_SQL = f"""
WITH r AS (SELECT date_trunc('second', ts) AS ts, value, k FROM ({S.SENSOR})),
l AS (SELECT *, {S.label_case('ts')} AS attack_label FROM r),
b AS (SELECT *, make_timestamp(CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) * 300000000) AS base FROM l),
w AS (SELECT *, UNNEST([base, base - INTERVAL 5 MINUTE]) AS window_start FROM b)
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, attack_label, {S.stat_select(SENSOR_COLS)}
FROM w GROUP BY window_start, attack_label
"""


@register("window_stats", _WINDOW_SQL)
def window_stats(spark, sf):
    """P2 + P3 + A1: 10-minute windows every 5 minutes by label, 7 statistics per sensor."""
    df = labelled_sensor(spark, sf)
    return rounded(stats.window_stats(df, "ts", SENSOR_COLS, ["attack_label"], "10 minutes", "5 minutes"))


@register("label_intervals", f"""
SELECT event_id, date_trunc('second', ts) AS ts, {S.label_case("date_trunc('second', ts)")} AS attack_label
FROM events""")
def label_intervals_q(spark, sf):
    """P2 + P3 on every event."""
    return labelled_sensor(spark, sf).select("event_id", "ts", "attack_label")


@register("interval_match", f"""
WITH {S.intervals_cte()}
SELECT e.event_id, e.ts, iv.interval_id,
       CAST(epoch(e.ts) - epoch(iv.start) AS DOUBLE) AS seconds_since_start
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) e
LEFT JOIN iv ON e.ts BETWEEN iv.start AND iv."end"
""")
def interval_match_q(spark, sf):
    """Containing interval and seconds since its start, for every event."""
    ev = labels.truncate_time(sensor_events(spark, sf).select("event_id", "ts"), "ts")
    return labels.interval_match(ev, "ts", labels.interval_table(spark), row_key=["event_id"])


# --- S2 / S3 / S5: records -----------------------------------------------------------

@register("decode_json", f"""
SELECT event_id, ts, k FROM ({S.SENSOR})""")
def decode_json_q(spark, sf):
    """Events.props parsed by the fixed schema {k INT}, flattened."""
    return sensor_events(spark, sf).select("event_id", "ts", "k")


ENCODE_SQL = f"""
WITH l AS (SELECT event_id, date_trunc('second', ts) AS ts, value, k, {S.label_case("date_trunc('second', ts)")} AS attack_label
           FROM ({S.SENSOR}))
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS key, CAST(ts AS TIMESTAMP) AS timestamp,
       value, k, attack_label FROM l"""


@register("encode_json", ENCODE_SQL)
def encode_json_q(spark, sf):
    """S3: (key, JSON value) preprocessed records, parsed back to check the round trip."""
    from tidewatch.sources.records import decode_json, encode_json
    enc = encode_json(labelled_sensor(spark, sf), "ts", ["value", "k", "attack_label"])
    back = decode_json(enc, "value", "ts STRING, value DOUBLE, k INT, attack_label STRING", keep=["key"])
    return rounded(back.select("key", F.to_timestamp_ntz("ts").alias("timestamp"), "value", "k", "attack_label"))


@register("publish_table", f"""
SELECT CAST(ts AS TIMESTAMP) AS ts, value, k FROM ({S.SENSOR})""")
def publish_table_q(spark, sf):
    """One JSON record per event (time + chosen sensors), parsed back."""
    from tidewatch.sources.records import decode_json, publish_table
    pub = publish_table(sensor_events(spark, sf), "ts", ["value", "k"])
    back = decode_json(pub, "value", "value DOUBLE, k INT", keep=["key"])
    return rounded(back.select(F.to_timestamp_ntz("key").alias("ts"), "value", "k"))


@register("publish_files", f"""
SELECT CAST(ts AS TIMESTAMP) AS ts, value, k FROM ({S.SENSOR})""")
def publish_files_q(spark, sf):
    """The published records written to a target (JSON files) and read back from it."""
    import uuid

    from tidewatch.sources.points import shared_path
    from tidewatch.sources.records import decode_json, key_time, publish_table
    path = shared_path(spark, f"published-{uuid.uuid4().hex[:12]}")
    publish_table(sensor_events(spark, sf), "ts", ["value", "k"]).write.json(path)
    back = decode_json(spark.read.schema("key STRING, value STRING").json(path), "value", "value DOUBLE, k INT", keep=["key"])
    return rounded(back.select(key_time(F.col("key")).alias("ts"), "value", "k"))


# --- S6 - S9: ranges, points, upserts -------------------------------------------------

RANGE = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


@register("read_range", f"""
SELECT event_id, ts, user_id, value FROM events
WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts < TIMESTAMP '{RANGE[1]}'""")
def read_range_q(spark, sf):
    """Half-open time range (pushed to the Parquet scan)."""
    from tidewatch.sources.points import read_range
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(read_range(ev, "ts", *RANGE).select("event_id", "ts", "user_id", "value"))


_POINTS_SQL = f"""
WITH l AS (SELECT event_id, date_trunc('second', ts) AS ts, value, k,
                  {S.label_case("date_trunc('second', ts)")} AS attack_label FROM ({S.SENSOR}))
SELECT ts AS _time, event_id, 'value' AS _field, value AS _value, NULL::VARCHAR AS _value_str FROM l
UNION ALL SELECT ts, event_id, 'k', CAST(k AS DOUBLE), NULL FROM l
UNION ALL SELECT ts, event_id, 'attack_label', NULL, attack_label FROM l"""


@register("to_points", _POINTS_SQL)
def to_points_q(spark, sf):
    """Wide sensor rows -> long (time, field, value) points."""
    from tidewatch.sources.points import to_points
    return rounded(to_points(labelled_sensor(spark, sf), "ts", ["value", "k"], ["attack_label"],
                             tags=["event_id"]))


@register("pivot_points", f"""
WITH p AS ({_POINTS_SQL})
SELECT _time, event_id, max(CASE WHEN _field = 'value' THEN _value END) AS value,
       max(CASE WHEN _field = 'k' THEN _value END) AS k
FROM p WHERE _value IS NOT NULL GROUP BY _time, event_id""")
def pivot_points_q(spark, sf):
    """Long points back to wide rows (row key time + tag, explicit field list)."""
    from tidewatch.sources.points import pivot_points, to_points
    pts = to_points(labelled_sensor(spark, sf), "ts", ["value", "k"], ["attack_label"], tags=["event_id"])
    return rounded(pivot_points(pts.filter(F.col("_value").isNotNull()), ["_time", "event_id"],
                                "_field", "_value", ["value", "k"]))


@register("upsert_latest", f"""
SELECT ts, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value,
       arg_max(k, event_id) AS k
FROM (SELECT date_trunc('second', ts) AS ts, event_id, value, k FROM ({S.SENSOR})) GROUP BY ts""")
def upsert_latest_q(spark, sf):
    """Per truncated second the last written record (largest event_id) wins."""
    from tidewatch.sources.points import upsert_latest
    ev = labels.truncate_time(sensor_events(spark, sf), "ts")
    return rounded(upsert_latest(ev.select("ts", "event_id", "value", "k"), ["ts"], "event_id"))


# --- P1 / S12: projections and saving a selection -------------------------------------

@register("select_features", f"""
SELECT ts, value AS "LIT 301", k AS "P101 Status" FROM ({S.SENSOR})""")
def select_features_q(spark, sf):
    """Project and rename to names with spaces (back-tick quoting)."""
    from tidewatch.operators.encode import select_features
    return rounded(select_features(sensor_events(spark, sf), "ts", {"value": "LIT 301", "k": "P101 Status"}))


@register("save_selected", f"""
SELECT ts, value, k, {S.label_case("date_trunc('second', ts)")} AS attack_label FROM ({S.SENSOR})""")
def save_selected_q(spark, sf):
    """Selected features with time first and label last, written as Parquet and read back."""
    from tidewatch.sources.points import save_selected
    ev = sensor_events(spark, sf)
    lab = labels.label_intervals(labels.truncate_time(ev, "ts", out="ts_s"), "ts_s", labels.interval_table(spark))
    return rounded(save_selected(lab, "ts", ["value", "k"], "attack_label", "save_selected"))


# --- P4 - P6, P10, P11: time parsing, filters, positions --------------------------------

@register("parse_time", """
SELECT event_id, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS parsed FROM events""")
def parse_time_q(spark, sf):
    """Time kept as text in the raw layout, parsed back by pattern (second precision)."""
    from tidewatch.functions.scalars import parse_time
    ev = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("raw"))
    return parse_time(ev, "raw", "yyyy-MM-dd'T'HH:mm:ss", "parsed").select("event_id", "parsed")


@register("filter_label", f"""
SELECT event_id, date_trunc('second', ts) AS ts, value FROM ({S.SENSOR})
WHERE {S.label_case("date_trunc('second', ts)")} = 'attack'""")
def filter_label_q(spark, sf):
    """P5: keep only rows labelled attack."""
    return rounded(labelled_sensor(spark, sf).filter(F.col("attack_label") == "attack")
                   .select("event_id", "ts", "value"))


@register("skip_rows", """
SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events)
WHERE pos > 2""")
def skip_rows_q(spark, sf):
    """Drop the first 2 records of the whole table by position (un-keyed B-1)."""
    from tidewatch.operators.position import with_position
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return with_position(ev, [], ["ts", "event_id"], "pos").filter("pos > 2").select("event_id", "pos")


@register("row_position", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events""")
def row_position_q(spark, sf):
    """P11 / B-1: record number within each user (hot-key-safe range numbering)."""
    from tidewatch.operators.position import with_position
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    return with_position(ev, ["user_id"], ["ts", "event_id"], "pos").select("event_id", "user_id", "pos")


@register("with_previous", """
SELECT event_id, user_id, value,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
       lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
FROM events""")
def with_previous_q(spark, sf):
    """P10: previous record of the same series beside the current one."""
    from tidewatch.operators.history import with_previous
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "value")
    out = with_previous(ev, ["user_id"], ["ts", "event_id"], ["value", "ts"])
    return rounded(out.select("event_id", "user_id", "value", "prev_value", "prev_ts"))


# --- P7 - P9: cleaning, type inference, one-hot ----------------------------------------

@register("clean_numeric", """
SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_text_num,
       event_type, TRY_CAST(event_type AS DOUBLE) AS event_type_num FROM events""")
def clean_numeric_q(spark, sf):
    """Try-convert text fields to numbers, keeping the text."""
    from tidewatch.sources.records import clean_numeric
    ev = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"), "event_type")
    return clean_numeric(ev, ["k_text", "event_type"]).select(
        "event_id", "k_text", "k_text_num", "event_type", "event_type_num")


_LINE_TEXT = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def _infer_sql() -> str:
    parts = []
    for c in _LINE_TEXT:
        t = f"CAST({c} AS VARCHAR)"
        if c == "l_shipdate":
            t = f"strftime({c}, '%Y-%m-%d')"
        parts.append(f"""SELECT '{c}' AS column_name,
  bool_and(TRY_CAST({t} AS DOUBLE) IS NOT NULL) AS all_numeric,
  bool_and(regexp_full_match({t}, '[0-9]+')) AS all_digits,
  bool_or({t} IS NULL) AS any_null,
  CASE WHEN bool_or({t} IS NULL) OR NOT bool_and(TRY_CAST({t} AS DOUBLE) IS NOT NULL) THEN 'string'
       WHEN bool_and(regexp_full_match({t}, '[0-9]+')) THEN 'bigint' ELSE 'double' END AS inferred
FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


@register("infer_numeric", _infer_sql())
def infer_numeric_q(spark, sf):
    """Per text column, numeric only if every value parses; integer if all digit strings."""
    from tidewatch.operators.encode import infer_numeric_report
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    txt = li.select(*[(F.date_format(c, "yyyy-MM-dd") if c == "l_shipdate" else F.col(c).cast("string")).alias(c)
                      for c in _LINE_TEXT])
    return infer_numeric_report(txt)


@register("cast_numeric", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
       CAST(l_discount AS DOUBLE) AS l_discount, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem""")
def cast_numeric_q(spark, sf):
    """The text columns cast to the types that their values allow."""
    from tidewatch.operators.encode import infer_numeric
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    txt = li.select(*[(F.date_format(c, "yyyy-MM-dd") if c == "l_shipdate" else F.col(c).cast("string")).alias(c)
                      for c in _LINE_TEXT])
    return rounded(infer_numeric(txt))


@register("one_hot", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS "l_returnflag-A",
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag-N",
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag-R",
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS "l_linestatus-F",
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS "l_linestatus-O"
FROM lineitem""")
def one_hot_q(spark, sf):
    """One-hot encode text columns into name-value columns (values found by one job)."""
    from tidewatch.operators.encode import one_hot
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return one_hot(li, ["l_returnflag", "l_linestatus"])
