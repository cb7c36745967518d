"""Detectors in event-time order over shuffled streams, the online one-class SVM against a
loop, and mergeable sketches against exact values."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tidewatch.operators import sketches
from tidewatch.operators.detect import online_svm
from tidewatch.operators.detect import univariate as U
from tidewatch.operators.detect import vector as V
from tidewatch.streaming import io as SIO
from tidewatch.streaming import ordered

SCHEMA = "key STRING, id BIGINT, at TIMESTAMP, x DOUBLE, y DOUBLE"


def series(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for key in ("a", "b"):
        for i in range(n):
            x = None if rnd.random() < 0.05 else round(rnd.gauss(0, 1) + (3 if i > n // 2 else 0), 3)
            rows.append((key, len(rows), 86_400 + (i // 2) * 60, x, round(rnd.gauss(5, 2), 3)))  # times in pairs: ties
    df = spark.createDataFrame(rows, "key STRING, id BIGINT, s BIGINT, x DOUBLE, y DOUBLE")
    return df.select("key", "id", F.timestamp_seconds("s").alias("at"), "x", "y")


def run(spark, folder, build, first=None):
    """The sink of a stream over the files in ``folder``; ``first`` runs up to so many files, then
    the query starts again from its checkpoint."""
    src = f"file://{folder}/src"
    for k in range(2 if first else 1):
        s = SIO.read_stream(spark, "parquet", src, SCHEMA, max_per_trigger=1)
        with SIO.rocksdb_state(spark):
            q = SIO.write_stream(build(s), "parquet", f"file://{folder}/out", f"file://{folder}/ck")
        SIO.await_all([q])
        if first and k == 0:
            first()
    return spark.read.parquet(f"file://{folder}/out")


def arrive(spark, df, folder, parts):
    """Write the row groups one file after another, the last with a heartbeat."""
    src = f"file://{folder}/src"
    for p in parts:
        p.select("key", "id", "at", "x", "y").coalesce(1).write.mode("append").parquet(src)


def heartbeat(spark, seconds):
    return spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("id"),
                                 F.timestamp_seconds(F.lit(seconds)).alias("at"), F.lit(None).cast("double").alias("x"),
                                 F.lit(None).cast("double").alias("y"))


def as_dict(df, *cols):
    out = {}
    for r in df.collect():
        assert r["id"] not in out  # every row once
        out[r["id"]] = tuple(None if r[c] is None else round(float(r[c]), 6) for c in cols)
    return out


def displaced(df, ranges=3, seconds=9000):
    """Row groups: half of each time range arrives with the next one."""
    step = seconds // ranges
    arrives = F.floor((F.unix_seconds("at") - 86_400) / step) + F.pmod(F.xxhash64("id"), F.lit(2))
    return [df.where(arrives == i) for i in range(ranges + 1)], f"{step + 1} seconds"


def test_cusum_in_event_order_equals_batch_over_a_restart(spark, tmp_path):
    df = series(spark)
    parts, delay = displaced(df)
    arrive(spark, df, tmp_path, parts[:2])
    got = run(spark, tmp_path, lambda s: ordered.cusum_in_order(s, ["key"], "at", "x", "id", delay, 10, 0.5, 3.0),
              first=lambda: arrive(spark, df, tmp_path, [*parts[2:], heartbeat(spark, 200_000)]))
    want = U.cusum(df, ["key"], ["at", "id"], "x", 10, 0.5, 3.0)
    assert as_dict(got, "x", "cusum", "alarm") == as_dict(want, "x", "cusum", "alarm")


def test_density_ratio_in_event_order_equals_batch(spark, tmp_path):
    df = series(spark, seed=2)
    parts, delay = displaced(df)
    arrive(spark, df, tmp_path, [*parts, heartbeat(spark, 200_000)])
    got = run(spark, tmp_path, lambda s: ordered.density_ratio_stream(s, ["key"], "at", ["x", "y"], "id", delay))
    want = V.density_ratio(df, ["key"], ["at", "id"], ["x", "y"])
    cols = ("log_rdr", "log_rdr_max", "alarm")
    assert as_dict(got, *cols) == as_dict(want, *cols)


def test_rows_wait_for_the_watermark_and_idle_keys_are_forgotten(spark, tmp_path):
    df = series(spark, n=40)
    late = df.withColumn("id", F.col("id") + 1000).withColumn("at", F.col("at") + F.expr("INTERVAL 2 DAYS"))
    arrive(spark, df, tmp_path, [df, late])
    got = run(spark, tmp_path, lambda s: ordered.cusum_in_order(s, ["key"], "at", "x", "id", "60 seconds", 5,
                                                                idle_ms=3_600_000))
    ids = {r["id"] for r in got.collect()}
    first = as_dict(U.cusum(df, ["key"], ["at", "id"], "x", 5), "cusum")
    again = as_dict(U.cusum(late, ["key"], ["at", "id"], "x", 5), "cusum")  # a new series, not the old one's tail
    held_back = {r["id"] for r in late.orderBy("at").collect()
                 if r["at"].timestamp() > late.agg(F.max("at")).first()[0].timestamp() - 60}
    assert held_back and ids == (first.keys() | again.keys()) - held_back
    assert {i: v for i, v in as_dict(got, "cusum").items()} == {
        i: v for i, v in (first | again).items() if i not in held_back}


def test_keys_share_a_bucket_and_large_ids_and_null_keys_stay(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(None if k == 0 else f"k{k}", 2 ** 60 + 3 * (25 * k + i), 86_400 + i * 300 + k, rnd.gauss(0, 1), 1.0)
            for k in range(30) for i in range(25)]
    df = spark.createDataFrame(rows, "key STRING, id BIGINT, s BIGINT, x DOUBLE, y DOUBLE").select(
        "key", "id", F.timestamp_seconds("s").alias("at"), "x", "y")
    parts, delay = displaced(df)
    arrive(spark, df, tmp_path, [*parts, heartbeat(spark, 200_000)])
    got = run(spark, tmp_path, lambda s: ordered.cusum_in_order(s, ["key"], "at", "x", "id", delay, 10, 0.5, 3.0, buckets=2))
    want = as_dict(U.cusum(df, ["key"], ["at", "id"], "x", 10, 0.5, 3.0), "x", "cusum", "alarm")
    assert len(want) == 30 * 16 and as_dict(got, "x", "cusum", "alarm") == want
    assert sum(r.key is None for r in got.collect()) == 16


@pytest.mark.parametrize("idle", [None, 50])
def test_a_bucket_in_runs_equals_its_keys_one_by_one(idle):
    """Runs over the rows of many keys against a loop over one key after the other."""
    rnd = random.Random(7)
    rows = sorted((rnd.randint(0, 900), i, rnd.randint(0, 6), math.nan if rnd.random() < 0.2 else rnd.gauss(0, 1))
                  for i in range(400))

    def frame(part):
        return pd.DataFrame({"key0": [r[2] for r in part], "key0_null": False, "kind": ordered.NEW, "micros": [r[0] for r in part],
                             "id": [r[1] for r in part], "id_null": False, "x0": [r[3] for r in part], "x1": 2.0})

    def loop(series, detector):
        x = np.array([[r[3], 2.0] for r in series])
        if detector.known_only:
            series = [r for r in series if r[3] == r[3]]
            x = x[~np.isnan(x[:, 0])]
        if not series:
            return {}
        columns = detector.run(x, np.arange(len(x)))
        return {series[i][1]: [None if m[i] else float(v[i]) for v, m in columns] for i in range(detector.first, len(x))}

    for detector in (ordered.cusum_detector(4, 0.1, 1.0), ordered.density_ratio_detector(0.5, 3, 1.1)):
        want = {}
        for key in range(7):
            mine = [r for r in rows if r[2] == key]
            cuts = [i for i in range(1, len(mine)) if idle and mine[i][0] - mine[i - 1][0] >= idle]
            for a, b in zip([0, *cuts], [*cuts, len(mine)]):
                want |= loop(mine[a:b], detector)
            if detector.known_only:
                want |= {r[1]: [None] * 3 for r in mine if r[3] != r[3]}
        got, kept = {}, None
        for at in range(0, 1000, 130):
            part = frame([r for r in rows if at <= r[0] < at + 130]).sample(frac=1, random_state=at)
            part = part if kept is None else pd.concat([kept, part])
            found, kept = ordered.run_series(part.reset_index(drop=True), ["key0", "key0_null"], 2, detector, idle)
            for r in found.itertuples():
                got[r.id] = [None if pd.isna(v) else float(v) for v in (r.out0, r.out1, getattr(r, "out2"))]
            assert (kept["kind"] == ordered.TAIL).sum() <= 7 * detector.tail
        assert got.keys() == want.keys()
        for i, row in want.items():
            assert [None if v is None else round(v, 9) for v in got[i]] == [None if v is None else round(v, 9) for v in row]


def test_sliding_maximum_of_many_series_equals_the_queue():
    rnd = random.Random(5)
    values, place, want = [], [], []
    for size in (1, 2, 40, 5):
        q = ordered.MaxQueue(4)
        for i in range(size):
            values.append(math.nan if rnd.random() < 0.5 else rnd.choice([-math.inf, 1.0, 2.0, 3.0]))
            place.append(i)
            want.append(q.push(values[-1]))
    top, known = ordered.sliding_max(np.array(values), np.array(place), 4)
    assert [t if k else None for t, k in zip(top, known)] == [None if w != w else w for w in want]


def test_max_queue_equals_sliding_maximum():
    rnd = random.Random(4)
    values = [math.nan if rnd.random() < 0.2 else rnd.randint(0, 9) for _ in range(300)]
    q = ordered.MaxQueue(7)
    for i, v in enumerate(values):
        if i == 150:  # as it comes back from the state
            q = ordered.MaxQueue(7, [p for p, _ in q.queue], [x for _, x in q.queue], q.at)
        known = [x for x in values[max(0, i - 6):i + 1] if x == x]
        got = q.push(v)
        assert got == max(known) if known else math.isnan(got)


# --- D6 online ---------------------------------------------------------------------------------

def learn_loop(batches, nu, q, rate):
    """Score, compare, learn in numpy: [(scores, threshold, alarms)] per batch and the model."""
    n, s1, s2, w, rho, seen, out = 0, 0.0, 0.0, None, None, [], []
    for k, x in enumerate(batches):
        if w is None:
            scores, alarms, threshold = None, np.zeros(len(x), bool), None
        else:
            scores = rho - (x / s) @ w
            threshold = sorted(seen)[math.ceil(q * len(seen)) - 1] if seen else None
            alarms = scores >= threshold if seen else np.zeros(len(x), bool)
            seen = seen + scores.tolist()
        out.append((scores, threshold, alarms))
        n, s1, s2 = n + len(x), s1 + x.sum(axis=0), s2 + (x * x).sum(axis=0)
        new_s = np.sqrt(np.maximum(0, s2 / n - (s1 / n) ** 2))
        new_s = np.where(new_s > 0, new_s, 1.0)
        if w is None:
            w = x.mean(axis=0) / new_s
            rho = float(np.quantile((x / new_s) @ w, nu, method="inverted_cdf"))
        else:
            step, taught = rate / math.sqrt(k + 1), x[~alarms]
            if len(taught):
                bad = scores[~alarms] > 0
                v = (taught[bad] / s).sum(axis=0) / len(taught)
                w = w - step * (w - v / nu)
                rho = rho + step * (1 - bad.sum() / len(taught) / nu)
            w = w / s * new_s
        s = new_s
    return out, (w, rho, s)


@pytest.fixture()
def batches():
    rng = np.random.default_rng(8)
    return [np.round(rng.normal([4, 9], [1, 3], (60, 2)) + (2 if k == 2 else 0), 4) for k in range(4)]


def svm_stream(spark, folder, batches, **options):
    for x in batches:
        rows = [("k", i, a, b) for i, (a, b) in enumerate(x.tolist())]
        spark.createDataFrame(rows, "key STRING, id BIGINT, x DOUBLE, y DOUBLE").coalesce(1).write.mode("append").parquet(
            f"file://{folder}/src")
    s = SIO.read_stream(spark, "parquet", f"file://{folder}/src", "key STRING, id BIGINT, x DOUBLE, y DOUBLE", max_per_trigger=1)
    SIO.await_all([online_svm.score_then_learn(s, ["key"], ["x", "y"], f"file://{folder}/out", f"file://{folder}/model",
                                               f"file://{folder}/ck", **options)])
    return spark.read.parquet(f"file://{folder}/out")


def test_online_svm_scores_then_learns_as_the_loop(spark, tmp_path, batches):
    got = svm_stream(spark, tmp_path, batches, nu=0.1, q=0.9, rate=0.2).collect()
    want, (w, rho, s) = learn_loop(batches, 0.1, 0.9, 0.2)
    for epoch, (scores, threshold, alarms) in enumerate(want):
        rows = sorted((r for r in got if r.epoch == epoch), key=lambda r: r.id)
        assert len(rows) == 60 and [r.alarm for r in rows] == alarms.tolist()
        if scores is not None:
            assert np.allclose([r.score for r in rows], scores)
        if threshold is not None:  # fewer scores than the sketch keeps: exact
            assert {round(r.threshold, 9) for r in rows} == {round(threshold, 9)}
    model = online_svm.model_at(spark, f"file://{tmp_path}/model", 3).collect()
    assert len(model) == 1 and model[0].n == 240 and model[0].batches == 4
    assert np.allclose([model[0].w_0, model[0].w_1, model[0].rho, model[0].s_0, model[0].s_1], [*w, rho, *s])


def test_online_svm_a_batch_changes_later_batches_only(spark, tmp_path, batches):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    other = [*batches[:2], batches[2] * 3, batches[3]]
    one, two = (svm_stream(spark, tmp_path / d, b).collect() for d, b in (("a", batches), ("b", other)))

    def scores(rows, epoch):
        return [(r.score, r.threshold) for r in sorted(rows, key=lambda r: r.id) if r.epoch == epoch]

    assert scores(one, 0) == scores(two, 0) and scores(one, 1) == scores(two, 1)
    assert scores(one, 3) != scores(two, 3)


def test_online_svm_nulls_and_new_keys(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame(rows, "key STRING, id BIGINT, x DOUBLE, y DOUBLE")

    first = online_svm.learned(online_svm.scored_batch(batch([("a", 1, 1.0, 2.0), ("a", 2, None, 1.0), ("n", 3, None, None)]),
                                                       None, ["key"], ["x", "y"], 0.9), None, ["key"], ["x", "y"], 0.1, 0.1, 64, True)
    assert [(r.key, r.n) for r in first.collect()] == [("a", 1)]
    first = first.checkpoint()
    scored = online_svm.scored_batch(batch([("a", 4, None, 2.0), ("b", 5, 1.0, 1.0)]), first, ["key"], ["x", "y"], 0.9)
    assert all(r.score is None and not r.alarm for r in scored.collect())
    after = {r.key: r for r in online_svm.learned(scored, first, ["key"], ["x", "y"], 0.1, 0.1, 64, True).collect()}
    before = first.first()
    assert set(after) == {"a", "b"} and (after["a"].w_0, after["a"].rho, after["a"].n) == (before.w_0, before.rho, 1)


# --- sketches ------------------------------------------------------------------------------------

def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), ((F.col("id") * 7919) % 50_021).cast("double").alias("v"),
                                      F.when(F.col("id") % 3 == 0, F.col("id") % 500).alias("w"))
    daily = sketches.sketch_table(rows.repartition(6), ["day"], ["v", "w"]).checkpoint()
    whole = {r["column"]: r for r in sketches.approximate_profile(sketches.merge_sketches(daily)).collect()}
    once = {r["column"]: r for r in sketches.approximate_profile(sketches.sketch_table(rows, [], ["v", "w"])).collect()}
    for c in ("v", "w"):
        values = np.sort(np.array([r[0] for r in rows.select(c).where(f"{c} is not null").collect()], dtype=float))
        for found in (whole[c], once[c]):
            assert (found["count"], found["nulls"]) == (len(values), 60_000 - len(values))
            assert (found["min"], found["max"]) == (values[0], values[-1])
            for p in (0.25, 0.5, 0.75):
                v = found[f"q{round(100 * p)}"]
                lo, hi = np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)
                assert lo - 0.01 <= p <= hi + 0.01
            exact = len(np.unique(values))
            assert abs(found["approx_distinct"] - exact) <= 0.04 * exact


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 4.0)], "day INT, v DOUBLE")
    daily = {r["day"]: r for r in sketches.approximate_profile(sketches.sketch_table(rows, ["day"], ["v"])).collect()}
    assert (daily[1]["count"], daily[1]["nulls"], daily[1]["q50"], daily[1]["approx_distinct"]) == (0, 2, None, 0)
    assert daily[2]["q50"] == 4.0
    merged = sketches.approximate_profile(sketches.merge_sketches(sketches.sketch_table(rows, ["day"], ["v"]))).first()
    assert (merged["count"], merged["q25"], merged["approx_distinct"]) == (1, 4.0, 1)
    assert sketches.sketch_table(rows.limit(0), ["day"], ["v"]).count() == 0


def test_daily_profile_query_covers_every_day(spark):
    import __spark_entry__ as E
    got = E.queries()["daily_sketches"](spark, SF_MID).collect()
    assert sum(r["count"] + r["nulls"] for r in got if r["column"] == "value" and r["day"] is not None) == 10_000
    assert sum(r["day"] is None for r in got) == 2
