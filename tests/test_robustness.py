"""Edges at which results must not change or rows get lost: NULLs, overlapping intervals,
URI paths, unfinished streams, large offsets, hot values."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import encode, labels, ml, profile
from tidewatch.operators.detect import univariate as U
from tidewatch.operators.detect import vector as V
from tidewatch.operators.detect.ocsvm_fit import fit_one_class_svm, fit_rows, svm_scores
from tidewatch.operators.detect.pca import reference_components
from tidewatch.operators.detect.reset import kswin_reset
from tidewatch.streaming import io as SIO
from tidewatch.streaming import stateful as ST


@pytest.mark.parametrize("n", [16, 17, 70])
def test_overlapping_intervals_label_alike_at_any_count(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, (t0 + dt.timedelta(minutes=i)).isoformat(" "), (t0 + dt.timedelta(minutes=i + 5)).isoformat(" "))
            for i in range(n)]
    iv = labels.interval_table(spark, rows)
    times = [(i, t0 + dt.timedelta(minutes=m)) for i, m in enumerate([-1, 0, n // 2, n + 4, n + 5])] + [(9, None)]
    df = spark.createDataFrame(times, "id INT, ts TIMESTAMP_NTZ")
    got = {r.id: r.attack_label for r in labels.label_intervals(df, "ts", iv).collect()}
    assert got == {0: "normal", 1: "attack", 2: "attack", 3: "attack", 4: "normal", 9: "normal"}


def _nulled(spark, n=300, at=(60, 61, 140)):
    rnd = random.Random(5)
    rows = [("k", t, None if t in at else rnd.gauss(0, 1) + (6.0 if (t // 75) % 2 else 0.0)) for t in range(n)]
    return rows, spark.createDataFrame(rows, "key STRING, t BIGINT, x DOUBLE")


def _as_dict(df, *cols):
    return {r["t"]: tuple(None if r[c] is None else round(float(r[c]), 6) for c in cols) for r in df.collect()}


def _stream_of(spark, df, tmp_path, detector):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    for lo in range(0, 300, 100):
        df.where((F.col("t") >= lo) & (F.col("t") < lo + 100)).coalesce(1).write.mode("append").parquet(src)
    s = SIO.read_stream(spark, "parquet", src, df.schema, max_per_trigger=1)
    SIO.await_all([SIO.write_stream(detector(s), "parquet", out, f"file://{tmp_path}/ck")])
    return spark.read.parquet(out)


def test_cusum_with_nulls_batch_equals_stream_equals_loop(spark, tmp_path):
    rows, df = _nulled(spark)
    batch = _as_dict(U.cusum(df, ["key"], ["t"], "x", 10, 0.5, 3.0), "cusum", "alarm")
    stream = _as_dict(_stream_of(spark, df, tmp_path, lambda s: ST.cusum_stream(s, ["key"], ["t"], "x", "t", 10, 0.5, 3.0)),
                      "cusum", "alarm")
    assert batch == stream and len(batch) == 291
    hist, want = [], {}
    for _, t, x in rows:
        if x is None:
            want[t] = (None, None)
            continue
        hist = (hist + [x])[-10:]
        if len(hist) == 10:
            m, s = sum(hist) / 10, 0.0
            for v in hist:
                s = max(0.0, s + v - m - 0.5)
            want[t] = (round(s, 6), float(s > 3.0))
    assert batch == want


def test_kswin_reset_with_nulls_keeps_the_later_alarms(spark, tmp_path):
    rows, df = _nulled(spark)
    args = (["key"], ["t"], "x")
    batch = _as_dict(kswin_reset(df, *args, 40, 20, 0.01), "ks_count", "alarm")
    stream = _as_dict(_stream_of(spark, df, tmp_path, lambda s: ST.kswin_stream(s, *args, "t", 40, 20, 0.01)),
                      "ks_count", "alarm")
    assert batch == stream
    assert max(t for t, (_, a) in batch.items() if a) > 200
    plain = _as_dict(kswin_reset(df.where("x is not null"), *args, 40, 20, 0.01), "ks_count", "alarm")
    assert {t: v for t, v in batch.items() if v[0] is not None} == plain


def test_page_hinkley_ignores_nulls(spark):
    _, df = _nulled(spark)
    got = _as_dict(U.page_hinkley(df, ["key"], ["t"], "x", 0.1, 5.0), "ph_stat")
    want = _as_dict(U.page_hinkley(df.where("x is not null"), ["key"], ["t"], "x", 0.1, 5.0), "ph_stat")
    assert {t: v for t, v in got.items() if v[0] is not None} == want and got[60] == (None,)


def test_unfinished_stream_raises(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/src")
    s = SIO.read_stream(spark, "parquet", f"{tmp_path}/src", "id BIGINT")
    q = SIO.write_stream(s, "parquet", f"{tmp_path}/out", f"{tmp_path}/ck", available_now=False)
    try:
        with pytest.raises(TimeoutError):
            SIO.await_all([q], timeout_s=1)
    finally:
        q.stop()


def test_upsert_on_a_uri_keeps_every_key(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    for lo in (0, 10):
        spark.range(lo, lo + 10).selectExpr("id", "id AS v", "DATE'2024-01-01' AS day").coalesce(1).write.mode(
            "append").parquet(src)
    s = SIO.read_stream(spark, "parquet", src, "id BIGINT, v BIGINT, day DATE", max_per_trigger=1)
    SIO.await_all([SIO.upsert_stream(s, ["id"], "v", out, f"file://{tmp_path}/ck", "day")])
    assert spark.read.parquet(out).count() == 20


def test_staged_copies_do_not_add_up_and_keep_rows_without_a_time(spark):
    src = spark.sql("SELECT id, IF(id = 3, NULL, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id)) AS ts FROM range(100)")
    for _ in range(2):
        path = SIO.staged_copy(spark, src, "test", "ts", 4)
        assert spark.read.parquet(path).count() == 100


def test_repeated_epoch_does_not_repeat_rows(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/src")
    s = SIO.read_stream(spark, "parquet", f"{tmp_path}/src", "id BIGINT")
    for ck in ("a", "b"):  # a second run of epoch 0, as after a failure
        SIO.await_all([SIO.write_batches(s, f"{tmp_path}/out", f"{tmp_path}/{ck}")])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_svm_share_and_gap(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal([5.0, 50.0, 0.0], [1.0, 10.0, 0.0], (2000, 3))
    w, rho, gap = fit_rows(x, 0.1)
    assert gap <= 1e-3 and rho > 0 and abs(np.mean(x @ w < rho) - 0.1) < 0.01
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    objective = 0.5 * np.sum((w * scale) ** 2) - rho + np.maximum(0, rho - x @ w).mean() / 0.1
    assert objective < 0  # that of w = 0
    df = spark.createDataFrame([("a", *map(float, r)) for r in x], "key STRING, p DOUBLE, q DOUBLE, r DOUBLE")
    out = svm_scores(df.union(df.limit(1).selectExpr("key", "p * 0", "q * 0", "r")),
                     fit_one_class_svm(df, ["key"], ["p", "q", "r"]), ["key"], ["p", "q", "r"])
    assert out.orderBy(F.desc("score")).first()["p"] == 0.0  # the planted outlier is the most unusual row


def test_svm_over_all_tasks_agrees_with_one_task(spark, monkeypatch):
    from tidewatch.operators.detect import ocsvm_fit
    rnd = np.random.default_rng(4)
    x = rnd.normal([4.0, 3.0], [1.0, 0.5], (800, 2))
    df = spark.createDataFrame([("a", *map(float, r)) for r in x], "key STRING, p DOUBLE, q DOUBLE")
    one = fit_one_class_svm(df, ["key"], ["p", "q"]).first()
    monkeypatch.setattr(ocsvm_fit, "GROUP_ROWS", 100)
    many = fit_one_class_svm(df, ["key"], ["p", "q"]).first()  # the same limit and tolerance
    assert max(one["gap"], many["gap"]) <= ocsvm_fit.TOLERANCE
    assert all(many[c] == pytest.approx(one[c], rel=1e-6) for c in ("w_0", "w_1"))
    assert many["rho"] == pytest.approx(one["rho"], rel=1e-2)  # the values at the share's two sides


def test_svm_that_does_not_converge_is_an_error(spark):
    rnd = np.random.default_rng(4)
    df = spark.createDataFrame([("a", *map(float, r)) for r in rnd.normal([1.0, 0.5], [2.0, 2.0], (300, 2))],
                               "key STRING, p DOUBLE, q DOUBLE")
    with pytest.raises(RuntimeError, match="duality gap"):
        fit_one_class_svm(df, ["key"], ["p", "q"], steps=1)
    assert fit_one_class_svm(df, ["key"], ["p", "q"], steps=1, take_gap=True).first()["gap"] > 1e-3


def test_pca_axes_do_not_depend_on_the_offset(spark):
    rnd = random.Random(1)
    pts = [(rnd.gauss(0, 2), rnd.gauss(0, 0.01)) for _ in range(200)]
    rows = [("k", 0.9 * a - 0.45 * b, 0.45 * a + 0.9 * b) for a, b in pts]
    for offset in (0.0, 1e8):
        df = spark.createDataFrame([(k, x + offset, y + offset) for k, x, y in rows], "key STRING, x DOUBLE, y DOUBLE")
        axes = reference_components(df, ["key"], ["x", "y"]).collect()
        assert len(axes) == 1 and axes[0]["w_0"] == pytest.approx(0.894, abs=0.01)


def test_density_ratio_of_wide_records(spark):
    rnd = random.Random(2)
    xs = [f"x{i}" for i in range(14)]
    rows = [("k", t, *[rnd.gauss(0, 1) for _ in xs]) for t in range(30)]
    df = spark.createDataFrame(rows, "key STRING, t BIGINT, " + ", ".join(f"{c} DOUBLE" for c in xs))
    got = {r["t"]: r["log_rdr"] for r in V.density_ratio(df, ["key"], ["t"], xs, 0.2).collect()}
    for t in range(1, 30):
        cur, prev = np.array(rows[t][2:]), np.array(rows[t - 1][2:])

        def lse(s, x):
            a = -((x - s) ** 2) / 0.08
            return a.max() + math.log(np.exp(a - a.max()).sum())
        d = np.array([lse(cur, x) - lse(prev, x) for x in cur])
        assert got[t] == pytest.approx(d.max() + math.log(np.exp(d - d.max()).sum()) - math.log(14), abs=1e-9)


def test_quantiles_of_a_two_valued_column(spark):
    df = spark.range(1000).selectExpr("IF(id < 900, 0.0D, 1.0D) AS v")
    r = profile.describe(df, ["v"]).first()
    assert (r["p25"], r["p50"], r["p75"]) == (0.0, 0.0, 0.0)
    one = profile.keyed_quantiles(df, [], "v", [0.95], "p").first()["p95"]
    assert one == 1.0


def test_numeric_inference_edges(spark):
    df = spark.createDataFrame([("1", "1", "NaN", "1d", "99999999999999999999"), ("2", "-1.5e3", "1", "2", "1")],
                               "a STRING, b STRING, c STRING, d STRING, e STRING")
    kinds = {r["column_name"]: r["inferred"] for r in encode.infer_numeric_report(df).collect()}
    assert kinds == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "double"}
    cast = encode.infer_numeric(df)
    assert [t for _, t in cast.dtypes] == ["bigint", "double", "string", "string", "double"]
    assert cast.first()["e"] == 1e20


def test_wide_columns_become_one_vector(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_ONE_HOT", 3)
    df = spark.createDataFrame([(i, f"v{i % 5}", "ab"[i % 2]) for i in range(20)], "id INT, wide STRING, narrow STRING")
    out = encode.one_hot(df, ["wide", "narrow"])
    assert out.columns == ["id", "wide-vector", "narrow-a", "narrow-b"]
    assert all(int(r["wide-vector"].indices[0]) == r["id"] % 5 and r["narrow-a"] == 1 - r["id"] % 2 for r in out.collect())


def test_keyed_ordered_split(spark):
    df = spark.range(100).selectExpr("id", "IF(id < 90, 'hot', 'cold') AS key")
    n = {(r["key"], r["split"]): r["count"] for r in
         ml.ordered_split(df, ["id"], train_fraction=0.5, keys=["key"]).groupBy("key", "split").count().collect()}
    assert n == {("hot", "train"): 45, ("hot", "test"): 45, ("cold", "train"): 5, ("cold", "test"): 5}


def test_staged_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    monkeypatch.setattr(SIO, "ROW_GROUP_BYTES", 20_000)
    src = spark.range(40_000).selectExpr("id", "timestamp_micros(id) AS ts", "hash(id) AS x")
    moved, _ = SIO.displaced_copy(spark, src, "groups", "ts", "id", 2)
    for path, files in ((SIO.staged_copy(spark, src, "groups", "ts", 2), 2), (moved, 4)):
        found = [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path.removeprefix('file:')}/*.parquet"))]
        assert len(found) == files and sum(f.metadata.num_rows for f in found) == 40_000 + (files == 4)
        assert max(f.metadata.num_row_groups for f in found) > 1


def test_ks_counts_of_all_windows():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 6, 90).astype(float)
    want = [max(abs(int((w[:12] <= g).sum()) - int((w[12:] <= g).sum())) for g in w)
            for w in (v[i:i + 20] for i in range(71))]
    assert ST.ks_counts(v, 20, 8).tolist() == want


def test_kswin_stream_hands_results_on_in_pieces(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(m, 1, 90) for m in (0, 4, 0, 5)])
    df = spark.createDataFrame([("a", i, float(v) if i % 40 else None) for i, v in enumerate(vals)], "key string, t long, x double")
    held = []
    monkeypatch.setattr(ST, "_run", lambda df, keys, fn, *schemas: held.append(fn))
    monkeypatch.setattr(ST, "KSWIN_ROWS", 16)
    ST.kswin_stream(df, ["key"], ["t"], "x", "t", 40, 20, 0.01)

    class State:
        exists, got = False, None

        def update(self, new):
            self.got = new

    state, pdf = State(), df.toPandas()
    frames = list(held[0](("a",), iter([pdf]), state))
    assert max(map(len, frames)) <= 16 and sum(f["alarm"].eq(True).sum() for f in frames) >= 3
    assert state.got[1] == int(pdf["x"].notna().sum()) and len(state.got[0]) <= 40


def test_nn_stream_scores_a_batch_at_once(spark, monkeypatch):
    import pandas as pd
    held = []
    monkeypatch.setattr(ST, "_run", lambda df, keys, fn, *schemas: held.append(fn))
    df = spark.createDataFrame([], "key string, t long, x double, y double")
    ST.nn_stream(df, ["key"], ["t"], ["x", "y"], "t", "t")

    class State:
        exists, get = True, [[1.0, 2.0]]

        def update(self, new):
            self.get = list(new)

    state = State()
    rows = pd.DataFrame({"key": "a", "t": [2, 1], "x": [5.0, 3.0], "y": [9.0, 2.5]})
    (out,) = held[0](("a",), iter([rows]), state)
    assert out["t"].tolist() == [1, 2] and out["avg_nn"].tolist() == [(2.0 + 1.5) / 2, (2.5 + 6.5) / 2]
    assert state.get[0] == [5.0, 9.0] and not out["drift_detected"].any()


def test_walks_of_small_keys_are_not_put_into_one_task(spark):
    from tidewatch.operators.detect.chain import walk_blocks
    from pyspark.sql import functions as F
    blk = spark.range(40 * 100).select((F.col("id") % 40).cast("string").alias("key"), F.expr("id div 400").alias("block"),
                                       F.col("id").cast("double").alias("x"))

    def fit(x, known, _):
        return lambda blocks, _: {"v": np.zeros(len(blocks)), "_drift": np.zeros(len(blocks), dtype=bool)}

    found = walk_blocks(blk, ["key"], ["x"], 10, fit, "v double")
    assert found.count() == 40 * 9
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_kswin_pieces_agree_with_the_array_fold(spark, monkeypatch):
    from tidewatch.operators.detect import univariate as U
    monkeypatch.setattr(U, "KS_PIECE", 50)  # pieces of 80 rows
    rng = np.random.default_rng(3)
    rows = [(k, t, float(rng.integers(0, 12)) + (6.0 if t > 170 else 0.0)) for k in ("a", "b") for t in range(333)]
    rows += [("c", t, 1.0) for t in range(19)]
    df = spark.createDataFrame(rows, "key string, t long, x double")
    for warmup in (0, 60):
        one, two = ({(r.key, r.t): (r.ks_count, r.ks_d, r.alarm) for r in U.kswin(
            df, ["key"], ["t"], "x", 20, 10, 0.05, warmup=warmup, method=m).collect()} for m in ("arrow", "sql"))
        assert one == two and len(one) == 2 * (333 - (19 if not warmup else 60))
        assert any(alarm for _, _, alarm in one.values())
    plan = U.kswin(df, ["key"], ["t"], "x", 20, 10, 0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # a row is handed to Python once


def test_quantile_of_a_spread_fit_is_the_rows_own(spark, monkeypatch):
    from tidewatch.operators.detect import ocsvm_fit
    monkeypatch.setattr(ocsvm_fit, "GROUP_ROWS", 100)
    monkeypatch.setattr(ocsvm_fit, "BINS", 4)  # several rounds
    rng = np.random.default_rng(5)
    x = {k: np.round(rng.lognormal(1.0, 2.0, (n, 2)), 1) for k, n in (("a", 1001), ("b", 400), ("same", 300))}
    x["same"][:] = 2.5
    df = spark.createDataFrame([(k, *map(float, r)) for k, v in x.items() for r in v], "key string, p double, q double")
    found = {r.key: r for r in fit_one_class_svm(df, ["key"], ["p", "q"]).collect()}
    for k, v in x.items():
        r = found[k]
        dots = np.sort(v @ np.array([r.w_0, r.w_1]))
        assert r.rho == pytest.approx(dots[max(int(np.ceil(len(v) * 0.1)), 1) - 1], rel=1e-9)
        w, rho, gap = fit_rows(v, 0.1)
        assert max(gap, r.gap) <= ocsvm_fit.TOLERANCE and (r.w_0, r.w_1) == pytest.approx(tuple(w), rel=1e-6)
