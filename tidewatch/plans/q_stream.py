"""Streaming queries: each runs a checkpointed Structured Streaming query over the events
table as a file stream (``availableNow``) and returns the sink table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import labels, stats
from tidewatch.plans import sqlparts as S
from tidewatch.plans.catalog import oracle, register
from tidewatch.plans.inputs import SENSOR_COLS, rounded
from tidewatch.plans.q_core import _WINDOW_SQL, ENCODE_SQL
from tidewatch.plans.q_detect import W_USER, cusum_sql, cvm_sql, kswin_reset_sql
from tidewatch.sources.records import decode_json
from tidewatch.streaming import io as SIO
from tidewatch.streaming import ordered
from tidewatch.streaming import stateful as ST


def _event_stream(spark, sf, max_files: int | None = None, n_files: int = 1):
    src = f"{sf}/events.parquet"
    schema = spark.read.parquet(src).schema
    if n_files > 1:
        src = SIO.staged_copy(spark, spark.read.parquet(src), "events", "ts", n_files)
    raw = SIO.read_stream(spark, "parquet", src, schema, max_per_trigger=max_files)
    return decode_json(raw, "props", "k INT", keep=["event_id", "ts", "user_id", "event_type", "value"])


def _stream_window_stats(spark, sf, mode: str):
    ev = labels.truncate_time(_event_stream(spark, sf), "ts")
    ev = labels.label_intervals(ev, "ts", labels.interval_table(spark))
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    agg = stats.window_stats(ev, "ts", SENSOR_COLS, ["attack_label"], "10 minutes", "5 minutes", flatten=False)
    run = SIO.new_run(spark, f"window-stats-{mode}")
    if mode == "complete":
        q = SIO.write_complete(agg, f"{run}/out", f"{run}/ckpt")
    else:
        q = SIO.write_stream(agg, "parquet", f"{run}/out", f"{run}/ckpt", mode="append")
    SIO.await_all([q])
    out = spark.read.parquet(f"{run}/out")
    out = out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                     *[c for c in out.columns if c != "window"])
    return rounded(out)


@register("window_stats_stream", _WINDOW_SQL)
def window_stats_stream_q(spark, sf):
    """S1 + S4 + T1 + T2 + T3: the sliding-window statistics as a stream with a 10-minute
    watermark in complete mode (all state kept, same result as batch)."""
    return _stream_window_stats(spark, sf, "complete")


@register("window_stats_append", f"""
SELECT * FROM ({_WINDOW_SQL})
WHERE window_end <= (SELECT max(date_trunc('second', ts)) FROM events) - INTERVAL 10 MINUTE""")
def window_stats_append_q(spark, sf):
    """Append mode: a window is emitted once the watermark (max event time - 10 min)
    passes its end, so state stays bounded; windows still open at the end are held back."""
    return _stream_window_stats(spark, sf, "append")


@register("cusum_stream", f"""
SELECT user_id, event_id, value, cusum, alarm FROM ({cusum_sql(W_USER)})""")
def cusum_stream_q(spark, sf):
    """T6 + T4: CUSUM per user over a stream, history kept in the state store
    (4 time-ordered files, one per micro-batch)."""
    ev = _event_stream(spark, sf, max_files=1, n_files=4)
    det = ST.cusum_stream(ev, ["user_id"], ["ts", "event_id"], "value", "event_id", 10, 1.0, 5.0)
    run = SIO.new_run(spark, "cusum")
    SIO.await_all([SIO.write_stream(det, "parquet", f"{run}/out", f"{run}/ckpt")])
    return rounded(spark.read.parquet(f"{run}/out"))


@register("kswin_stream", kswin_reset_sql(0.01))
def kswin_stream_q(spark, sf):
    """T6 + D3 with reset: KSWIN per event type over a stream (window 200, stat 100,
    alpha 0.01); after an alarm the window restarts from its newest 100 values."""
    ev = _event_stream(spark, sf, max_files=1, n_files=4)
    det = ST.kswin_stream(ev, ["event_type"], ["ts", "event_id"], "value", "event_id", 200, 100, 0.01)
    run = SIO.new_run(spark, "kswin")
    SIO.await_all([SIO.write_stream(det, "parquet", f"{run}/out", f"{run}/ckpt")])
    return rounded(spark.read.parquet(f"{run}/out"))


@register("drift_points_stream", f"""
WITH s AS ({S.SENSOR}),
p AS (SELECT *, [value, CAST(k AS DOUBLE)] AS cur, lag([value, CAST(k AS DOUBLE)]) OVER ({W_USER}) AS prev FROM s)
SELECT user_id, event_id, ts,
       round(list_avg(list_transform(cur, lambda x: list_sort(list_transform(prev, lambda q: abs(x - q)))[2])), 6) AS avg_nn,
       false AS drift_detected, CAST(0.0 AS DOUBLE) AS kl_divergence
FROM p WHERE prev IS NOT NULL""")
def drift_points_stream_q(spark, sf):
    """S11 + S13 + T5: drift points per record (nearest-neighbour distance to the previous
    record, divergence, flag) from a rate-limited stream (one file per trigger), run
    beside a second query on the same source; both are awaited."""
    ev = _event_stream(spark, sf, max_files=1, n_files=4)
    det = ST.nn_stream(ev, ["user_id"], ["ts", "event_id"], ["value", "k"], "event_id", "ts")
    run = SIO.new_run(spark, "drift")
    q1 = SIO.write_batches(det, f"{run}/out", f"{run}/ckpt")
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    q2 = SIO.write_complete(counts, f"{run}/counts", f"{run}/ckpt2")
    SIO.await_all([q1, q2])
    return rounded(spark.read.parquet(f"{run}/out").drop("epoch"))


@register("cvm_stream", f"""
SELECT user_id, event_id, value, cvm_w2, shift, alarm FROM ({cvm_sql(False)})""")
def cvm_stream_q(spark, sf):
    """Cramer-von Mises per user over a stream; same normal CDF polynomial as the
    batch form, so the batch oracle applies."""
    ev = _event_stream(spark, sf, max_files=1, n_files=4)
    det = ST.cvm_stream(ev, ["user_id"], ["ts", "event_id"], "value", "event_id", 10, 0.461, 10.0)
    run = SIO.new_run(spark, "cvm")
    SIO.await_all([SIO.write_stream(det, "parquet", f"{run}/out", f"{run}/ckpt")])
    return rounded(spark.read.parquet(f"{run}/out"))


@register("upsert_stream", f"""
SELECT ts, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value,
       arg_max(k, event_id) AS k
FROM (SELECT date_trunc('second', ts) AS ts, event_id, value, k FROM ({S.SENSOR})) GROUP BY ts""")
def upsert_stream_q(spark, sf):
    """S9 as a stream: per truncated second the latest event wins, merged micro-batch by
    micro-batch into a day-partitioned table (4 files, one per trigger)."""
    ev = labels.truncate_time(_event_stream(spark, sf, max_files=1, n_files=4), "ts")
    ev = ev.select("ts", "event_id", "value", "k", F.to_date("ts").alias("day"))
    run = SIO.new_run(spark, "upsert")
    SIO.await_all([SIO.upsert_stream(ev, ["ts"], "event_id", f"{run}/out", f"{run}/ckpt", "day")])
    return rounded(spark.read.parquet(f"{run}/out").select("ts", "event_id", "value", "k"))


def _published(spark, sf):
    """S1 + S2 + P2 + P3 + S3 + T4 + T5: key/value records are streamed from files, decoded,
    keyed by time, truncated, labelled and published as key/value records by a checkpointed
    query, while a second query on the same source keeps windowed statistics. Returns the
    two sinks."""
    from tidewatch.plans.inputs import sensor_events
    from tidewatch.sources.records import encode_json, key_time, publish_table
    ev = sensor_events(spark, sf)
    src = publish_table(ev, "ts", ["value", "k"]).withColumn("ts", key_time(F.col("key")))
    path = SIO.staged_copy(spark, src, "records", "ts", 4)
    raw = SIO.read_stream(spark, "parquet", path, "key STRING, value STRING", max_per_trigger=1)
    rec = decode_json(raw, "value", "value DOUBLE, k INT", key_col="key", key_as="ts")
    rec = labels.truncate_time(rec.withColumn("ts", key_time(F.col("ts"))), "ts")
    rec = labels.label_intervals(rec, "ts", labels.interval_table(spark))
    run = SIO.new_run(spark, "publish")
    out = encode_json(rec, "ts", ["value", "k", "attack_label"])
    timed = rec.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    agg = stats.window_stats(timed, "ts", SENSOR_COLS, ["attack_label"], "10 minutes", "5 minutes", flatten=False)
    SIO.await_all([SIO.write_stream(out, "json", f"{run}/records", f"{run}/ckpt"),
                   SIO.write_complete(agg, f"{run}/stats", f"{run}/ckpt2")])
    return f"{run}/records", f"{run}/stats"


@register("publish_stream", ENCODE_SQL)
def publish_stream_q(spark, sf):
    """The published records of the preprocessing stream, read back from its files."""
    records, _ = _published(spark, sf)
    back = decode_json(spark.read.schema("key STRING, value STRING").json(records), "value",
                       "ts STRING, value DOUBLE, k INT, attack_label STRING", keep=["key"])
    return rounded(back.select("key", F.to_timestamp_ntz("ts").alias("timestamp"), "value", "k", "attack_label"))


@register("publish_stream_stats", _WINDOW_SQL)
def publish_stream_stats_q(spark, sf):
    """The windowed statistics that the second query of the preprocessing stream keeps."""
    _, kept = _published(spark, sf)
    out = spark.read.parquet(kept)
    return rounded(out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                              F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                              *[c for c in out.columns if c != "window"]))


@register("one_class_svm_stream")
def one_class_svm_stream_q(spark, sf):
    """D6 streaming form: per-supplier linear one-class SVM fitted in batch (unscaled
    lineitem 4-vectors), then a lineitem file stream scored by a stream-static join with
    the model table (w, rho, 0.995 threshold)."""
    from tidewatch.operators.detect.ocsvm import fit_scorer, score_stream
    from tidewatch.plans.inputs import LINE_VECTOR
    src = f"{sf}/lineitem.parquet"
    li = spark.read.parquet(src).select("l_orderkey", "l_linenumber", "l_suppkey", *LINE_VECTOR)
    model = fit_scorer(li, ["l_suppkey"], LINE_VECTOR, nu=0.1, q=0.995)
    stream = SIO.read_stream(spark, "parquet", src, spark.read.parquet(src).schema).select(
        "l_orderkey", "l_linenumber", "l_suppkey", *LINE_VECTOR)
    det = score_stream(stream, model, ["l_suppkey"], LINE_VECTOR)
    run = SIO.new_run(spark, "ocsvm")
    SIO.await_all([SIO.write_stream(det.select("l_orderkey", "l_linenumber", "l_suppkey", "score", "threshold",
                                                "alarm"), "parquet", f"{run}/out", f"{run}/ckpt")])
    return rounded(spark.read.parquet(f"{run}/out"))


def _displaced_events(spark, sf):
    """(event stream whose rows arrive up to a quarter of the whole time late, that delay)."""
    src, delay = SIO.displaced_copy(spark, spark.read.parquet(f"{sf}/events.parquet"), "events", "ts", "event_id", 4)
    raw = SIO.read_stream(spark, "parquet", src, spark.read.parquet(src).schema, max_per_trigger=1)
    return decode_json(raw, "props", "k INT", keep=["event_id", "ts", "user_id", "event_type", "value"]), delay


def _ordered_run(spark, name: str, det):
    run = SIO.new_run(spark, name)
    with SIO.rocksdb_state(spark):
        q = SIO.write_stream(det, "parquet", f"{run}/out", f"{run}/ckpt")
    SIO.await_all([q])
    return rounded(spark.read.parquet(f"{run}/out"))


@register("cusum_event_order", f"""
SELECT user_id, event_id, value, cusum, alarm FROM ({cusum_sql(W_USER)})""")
def cusum_event_order_q(spark, sf):
    """CUSUM per user over a stream whose rows arrive out of order, in event-time order:
    rows wait in keyed state until the watermark passes them. Same rows as the batch SQL."""
    ev, delay = _displaced_events(spark, sf)
    return _ordered_run(spark, "cusum-ordered", ordered.cusum_in_order(
        ev, ["user_id"], "ts", "value", "event_id", delay, 10, 1.0, 5.0))


@register("density_ratio_stream", oracle("density_ratio"))
def density_ratio_stream_q(spark, sf):
    """T6 + D7: density ratio of consecutive records per user over a stream whose rows arrive
    out of order; state: previous vector, queue of the running maximum, waiting rows."""
    ev, delay = _displaced_events(spark, sf)
    return _ordered_run(spark, "density-ordered", ordered.density_ratio_stream(
        ev, ["user_id"], "ts", ["value", "k"], "event_id", delay, 0.2, 10, 1.5))


@register("one_class_svm_online")
def one_class_svm_online_q(spark, sf):
    """D6 as it is run live: per event type every micro-batch is scored with the model before
    it, compared with the running 0.995 quantile of earlier scores, then learned."""
    from tidewatch.operators.detect.online_svm import score_then_learn
    ev = _event_stream(spark, sf, max_files=1, n_files=4)
    run = SIO.new_run(spark, "ocsvm-online")
    SIO.await_all([score_then_learn(ev, ["event_type"], ["value", "k"], f"{run}/out", f"{run}/model", f"{run}/ckpt")])
    out = spark.read.parquet(f"{run}/out")
    return rounded(out.select("event_type", "event_id", "score", "threshold", "alarm", F.col("epoch").cast("long").alias("epoch")))
