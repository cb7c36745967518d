
import pytest

from tidewatch import fixed
from tidewatch.operators import score

# --- Fixed values: the six published detector result rows ---------------------------
# (algorithm, detections, false-alarms, then attack1..6 detected flag and delay in s)
PUBLISHED_RESULTS = [
    ("kdq-tree", 1, 6, [0, 0, 0, 0, 1, 0], [0.0, 0.0, 0.0, 0.0, 63.0, 0.0]),
    ("pca-cd", 4, 11, [0, 1, 1, 1, 0, 1], [0.0, 140.0, 25.0, 196.0, 0.0, 422.0]),
    ("ks-win", 11, 56, [1, 1, 1, 1, 0, 1], [23.0, 49.0, 132.0, 19.0, 0.0, 29.0]),
    ("one-class-svm", 177, 603, [0, 0, 0, 0, 0, 1], [0.0, 0.0, 0.0, 0.0, 0.0, 585.0]),
    ("cusum", 2, 54, [0, 0, 0, 1, 0, 0], [0.0, 0.0, 0.0, 118.0, 0.0, 0.0]),
    ("cvm", 9, 9, [0, 1, 0, 0, 0, 0], [0.0, 168.0, 0.0, 0.0, 0.0, 0.0]),
]


def test_summary_of_published_rows(spark):
    cols = ["algorithm", "detections", "false-alarms"]
    rows = []
    for alg, det, fa, flags, delays in PUBLISHED_RESULTS:
        row = [alg, det, fa]
        for f, d in zip(flags, delays):
            row += [f, d]
        rows.append(row)
    for i in range(1, 7):
        cols += [f"attack{i}-detected", f"attack{i}-delay"]
    df = spark.createDataFrame(rows, cols)
    got = {r["algorithm"]: (r["attacks-detected"], r["average-delay"])
           for r in score.summarise_scores(df).collect()}
    assert got["kdq-tree"] == (1, pytest.approx(63.0))
    assert got["pca-cd"] == (4, pytest.approx(195.75))
    assert got["ks-win"] == (5, pytest.approx(50.4))
    assert got["one-class-svm"] == (1, pytest.approx(585.0))
    assert got["cusum"] == (1, pytest.approx(118.0))
    assert got["cvm"] == (1, pytest.approx(168.0))
    order = [r["algorithm"] for r in score.rank_scores(score.summarise_scores(df), "average-delay", False).collect()]
    assert order[0] == "one-class-svm" and order[-1] == "ks-win"


def test_cluster_settings_scale_with_input():
    from tidewatch.session import cluster_settings
    small = cluster_settings(10 * 2 ** 30, total_cores=64)
    big = cluster_settings(100 * 2 ** 40, total_cores=4000)
    assert int(small["spark.sql.shuffle.partitions"]) >= 192
    assert int(big["spark.sql.shuffle.partitions"]) > 500_000 // 2
    assert int(big["spark.sql.files.maxPartitionBytes"]) <= 256 * 2 ** 20
