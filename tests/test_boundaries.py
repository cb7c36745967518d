"""Metamorphic and boundary checks."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import labels, score
from tidewatch.operators.detect import univariate as U
from tests.conftest import SF_MID


def test_cusum_invariant_to_partitioning_and_other_keys(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet").select("event_id", "ts", "user_id", "value")
    base = U.cusum(ev, ["user_id"], ["ts", "event_id"], "value", 10, 1.0, 5.0)
    shuffled = ev.repartition(13).orderBy(F.rand(seed=3))
    extra = spark.range(500).select((F.col("id") + 10 ** 9).alias("event_id"),
                                    F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_interval(0,0,0,0,0,0,id)").alias("ts"),
                                    F.lit(-7).cast("long").alias("user_id"), (F.col("id") % 17).cast("double").alias("value"))
    other = U.cusum(shuffled.unionByName(extra), ["user_id"], ["ts", "event_id"], "value", 10, 1.0, 5.0)
    other = other.filter(F.col("user_id") != -7)
    assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


def _alarms(spark, times):
    rows = [(i, dt.datetime.fromisoformat(t), lab) for i, (t, lab) in enumerate(times)]
    return spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, attack_label STRING")


def test_interval_ends_inclusive_and_labels(spark):
    iv = labels.interval_table(spark)
    df = _alarms(spark, [("2024-01-03 06:00:00", ""), ("2024-01-03 12:30:00", ""), ("2024-01-03 12:30:01", ""),
                         ("2024-01-03 05:59:59", "")])
    got = {r.event_id: r.attack_label for r in labels.label_intervals(df, "ts", iv).collect()}
    assert got == {0: "attack", 1: "attack", 2: "normal", 3: "normal"}
    m = {r.event_id: (r.interval_id, r.seconds_since_start)
         for r in labels.interval_match(df, "ts", iv, row_key=["event_id"]).collect()}
    assert m[0] == (1, 0.0) and m[1] == (1, 23400.0) and m[2] == (None, None)


def test_scoreboard_delay_zero_is_unset_and_no_detection_gives_null_average(spark):
    iv = labels.interval_table(spark)
    # alarm exactly at interval 2's start (delay 0, not recorded), later one 30 s in,
    # one alarm on a normal row
    al = _alarms(spark, [("2024-01-07 09:15:00", "attack"), ("2024-01-07 09:15:30", "attack"),
                         ("2024-01-09 00:00:00", "normal")])
    b = score.scoreboard(al, "ts", "attack_label", iv, "x", row_key=["event_id"]).first()
    assert (b["detections"], b["false-alarms"]) == (2, 1)
    assert b["attack2-detected"] == 1 and b["attack2-delay"] == 30.0
    assert b["attack1-detected"] == 0 and b["attack1-delay"] == 0.0
    none = score.scoreboard(al.filter("attack_label = 'normal'"), "ts", "attack_label", iv, "y",
                            row_key=["event_id"])
    s = score.summarise_scores(none).first()
    assert s["attacks-detected"] == 0 and s["average-delay"] is None


def test_window_stats_by_panes_equal_expanded_rows(spark):
    """60-minute windows every minute: panes are copied, rows are not; nulls, groups, large means."""
    import random

    from pyspark.sql import functions as F

    from tidewatch.operators import stats

    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), 1_700_000_000 + rnd.randint(0, 9_000), None if rnd.random() < 0.2 else 1e6 + rnd.gauss(0, 1),
             rnd.choice([None, 1, 5])) for _ in range(400)] + [("c", 1_700_000_000, None, None), ("a", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g STRING, s BIGINT, v DOUBLE, k INT").select(
        "g", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v", "k")
    for size, slide in (("10 minutes", "5 minutes"), ("20 minutes", "4 minutes"), ("60 minutes", "1 minute")):
        fast = stats.window_stats(df, "ts", ["v", "k"], ["g"], size, slide)
        plain = df.groupBy(F.window("ts", size, slide).alias("window"), "g").agg(*stats.stat_columns(["v", "k"], size))
        plain = plain.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                             *[c for c in plain.columns if c != "window"])
        assert fast.columns == plain.columns and fast.dtypes == plain.dtypes

        def keyed(frame):
            return {(r.window_start, r.g): [None if x is None else round(float(x), 5) for x in r[3:]] for r in frame.collect()}

        assert keyed(fast) == keyed(plain)
    assert "Expand" not in fast._jdf.queryExecution().executedPlan().toString()
