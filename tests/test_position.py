"""B-1 / B-2: hot-key-safe positions and halo blocks equal plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import history
from tidewatch.operators.position import bounded_frames, with_position
from tests.conftest import SF_MID


def _events(spark):
    return spark.read.parquet(f"{SF_MID}/events.parquet").select("event_id", "ts", "user_id", "value")


def test_position_matches_row_number_keyed_and_unkeyed(spark):
    ev = _events(spark)
    for keys in ([], ["user_id"]):
        p = with_position(ev, keys, ["ts", "event_id"], "pos", force_range=True)
        ref = ev.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")))
        j = p.join(ref.select("event_id", "rn"), "event_id")
        assert j.count() == ev.count()
        assert j.filter("pos != rn").count() == 0


def test_position_hot_key_spread(spark):
    # one key holding every row: still numbered 1..n without gaps
    ev = _events(spark).withColumn("k", F.lit(1))
    p = with_position(ev, ["k"], ["ts", "event_id"], "pos", num_slices=7)
    r = p.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()
    assert (r[0], r[1], r[2]) == (1, 10000, 10000)


def test_halo_blocks_equal_single_window(spark):
    ev = _events(spark)

    def cols(fr):
        return {"h": F.collect_list("value").over(fr(-9, 0)), "lagv": F.lag("value", 1).over(fr())}

    a = bounded_frames(ev, ["user_id"], ["ts", "event_id"], 10, cols)
    b = bounded_frames(ev, ["user_id"], ["ts", "event_id"], 10, cols, block_rows=13, force_blocks=True)
    c = bounded_frames(ev, [], ["ts", "event_id"], 10, cols, block_rows=777, force_blocks=True)
    d = bounded_frames(ev, [], ["ts", "event_id"], 10, cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert c.exceptAll(d).count() == 0 and d.exceptAll(c).count() == 0


def test_running_blocked_equals_window(spark):
    ev = _events(spark)
    spec = {"s": ("sum", F.col("value")), "mn": ("min", F.col("value"))}
    a = history.running(ev, ["user_id"], ["ts", "event_id"], spec)
    b = history.running(ev, ["user_id"], ["ts", "event_id"], spec, block_rows=11, force_blocks=True)
    j = a.alias("a").join(b.alias("b"), "event_id")
    assert j.filter((F.abs(F.col("a.s") - F.col("b.s")) > 1e-6) | (F.col("a.mn") != F.col("b.mn"))).count() == 0


def test_interval_match_bucketed_path_equals_broadcast(spark):
    import tidewatch.operators.labels as L
    ev = _events(spark).withColumn("ts", F.date_trunc("second", "ts"))
    iv = L.interval_table(spark)
    a = L.interval_match(ev, "ts", iv, row_key=["event_id"])
    old = L.BROADCAST_INTERVALS
    try:
        L.BROADCAST_INTERVALS = 0  # force the bucketed equi-join
        b = L.interval_match(ev, "ts", iv, row_key=["event_id"])
        assert "BroadcastNestedLoopJoin" not in b._jdf.queryExecution().executedPlan().toString()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        L.BROADCAST_INTERVALS = old


def test_hot_key_is_spread_and_detectors_agree(spark):
    """One key holding a third of the rows: the range numbering puts it in several
    slices, and block/halo detectors equal the plain keyed window."""
    from tidewatch.operators.detect import univariate as U
    ev = _events(spark)
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    sliced = (hot.repartitionByRange(8, "user_id", "ts", "event_id")
              .withColumn("_s", F.spark_partition_id()).filter("user_id = -1")
              .select("_s").distinct().count())
    assert sliced > 1
    c = U.cusum(hot, ["user_id"], ["ts", "event_id"], "value", 10, 1.0, 5.0)
    d = U.cusum(hot, ["user_id"], ["ts", "event_id"], "value", 10, 1.0, 5.0, block_rows=500, force_blocks=True)
    j = c.alias("c").join(d.alias("d"), "event_id")
    assert j.count() == c.count() == d.count()
    assert j.filter((F.abs(F.col("c.cusum") - F.col("d.cusum")) > 1e-9) | (F.col("c.alarm") != F.col("d.alarm"))).count() == 0
