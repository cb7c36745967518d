"""Profiling queries (A2-A7) and head rows (O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import profile
from tidewatch.plans import sqlparts as S
from tidewatch.plans.catalog import register
from tidewatch.plans.inputs import rounded, sensor_events, table
from tidewatch.plans.q_core import labelled_sensor


def _describe_sql(cols, src):
    parts = [f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM ({src})""" for c in cols]
    return "\nUNION ALL\n".join(parts)


@register("describe", _describe_sql(["value", "k"], S.SENSOR))
def describe_q(spark, sf):
    """A2: numeric summary of the sensor columns with exact quartiles."""
    return rounded(profile.describe(sensor_events(spark, sf), ["value", "k"]))


@register("describe_text", """
WITH vc AS (SELECT event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT 'event_type' AS column_name, CAST((SELECT sum(n) FROM vc) AS BIGINT) AS count,
       (SELECT count(*) FROM vc) AS unique, v AS top, n AS freq
FROM vc ORDER BY n DESC, v LIMIT 1""")
def describe_text_q(spark, sf):
    """A2 (text): count, distinct, most frequent value and its frequency."""
    return profile.describe_text(table(spark, sf, "events"), ["event_type"])


@register("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def value_counts_q(spark, sf):
    """A3: rows per event type."""
    return profile.value_counts(table(spark, sf, "events"), "event_type")


_LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("null_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM lineitem" for c in _LINE_COLS))
def null_counts_q(spark, sf):
    """A4: NULL count per lineitem column."""
    return profile.null_counts(table(spark, sf, "lineitem").select(*_LINE_COLS))


@register("unique_values", "SELECT DISTINCT user_id FROM events")
def unique_values_q(spark, sf):
    """A5: distinct users."""
    return profile.unique(table(spark, sf, "events"), "user_id")


@register("class_share", f"""
SELECT attack_label, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM (SELECT {S.label_case("date_trunc('second', ts)")} AS attack_label FROM events) GROUP BY attack_label""")
def class_share_q(spark, sf):
    """Share of attack and normal rows in percent."""
    return rounded(profile.class_share(labelled_sensor(spark, sf), "attack_label"))


_INFO_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"}


@register("table_info", "\nUNION ALL\n".join(
    f"""SELECT (SELECT count(*) FROM events) AS rows, '{c}' AS column_name, count({c}) AS non_null,
       CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
            WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' ELSE 'other' END AS dtype,
       CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'DOUBLE', 'INTEGER') THEN 'numeric' ELSE 'text' END AS kind
FROM events""" for c in _INFO_TYPES))
def table_info_q(spark, sf):
    """Rows, non-NULL count, type and kind per events column."""
    return profile.table_info(table(spark, sf, "events"))


@register("head_rows", """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts, event_id LIMIT 5""")
def head_rows_q(spark, sf):
    """O2: the first 5 records in time order (deterministic tie-break; plans as a
    top-k, so only 5 rows per task reach the final merge)."""
    ev = table(spark, sf, "events")
    return rounded(ev.orderBy("ts", "event_id").limit(5).select("event_id", "ts", "user_id", "event_type", "value"))


@register("top_users", """
SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id
ORDER BY n DESC, user_id LIMIT 10""")
def top_users_q(spark, sf):
    """O1 + O2: top-10 users by record count (sort + limit is the feature here)."""
    ev = table(spark, sf, "events")
    g = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(g.orderBy(F.desc("n"), "user_id").limit(10))


@register("daily_sketches")
def daily_sketches_q(spark, sf):
    """A2 + A5, approximate: quantile and distinct sketches of the sensors per day, and (day
    NULL) the same merged over all days."""
    from tidewatch.operators import sketches
    ev = sensor_events(spark, sf).withColumn("day", F.to_date("ts"))
    daily = sketches.sketch_table(ev, ["day"], ["value", "k"]).checkpoint(eager=True)
    whole = sketches.approximate_profile(sketches.merge_sketches(daily))
    return rounded(sketches.approximate_profile(daily).unionByName(whole.withColumn("day", F.lit(None).cast("date"))))
