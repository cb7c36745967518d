"""ML checks: separable data, planted features, deterministic splits."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import ml


def _planted(spark, n=600, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        useful = (2.0 if y else -2.0) + rnd.gauss(0, 0.5)
        rows.append((i, y, "b" if y else "a", useful, rnd.gauss(0, 1), rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "id BIGINT, y INT, cls STRING, good DOUBLE, noise1 DOUBLE, noise2 DOUBLE")


def test_tree_beats_majority_on_separable_data(spark):
    df = ml.ordered_split(_planted(spark), ["id"], train_fraction=0.7)
    pred = ml.decision_tree(df.filter("split = 'train'"), df.filter("split = 'test'"),
                            ["good", "noise1", "noise2"], "cls", max_depth=5)
    acc = ml.accuracy(pred, "cls", "prediction").first()["accuracy"]
    assert acc > 0.95
    cm = {r["cls"]: (r["pred_a"], r["pred_b"]) for r in ml.confusion_matrix(pred, "cls", "prediction", ["a", "b"]).collect()}
    assert sum(sum(v) for v in cm.values()) == pred.count()


def test_l1_keeps_planted_feature_and_drops_noise(spark):
    df = _planted(spark)
    split = ml.random_split(df, ["id"], 80, 0)
    scaled = ml.standard_scale(split, ["good", "noise1", "noise2"], fit_on=split.filter("split = 'train'"))
    sel = {r["feature"]: r["selected"] for r in
           ml.l1_select(scaled.filter("split = 'train'"), ["good", "noise1", "noise2"], "y", c=0.05).collect()}
    assert sel["good"] and not sel["noise1"] and not sel["noise2"]


def test_hash_split_is_stable_under_repartitioning(spark):
    df = _planted(spark)
    a = ml.random_split(df, ["id"], 80, 0).select("id", "split")
    b = ml.random_split(df.repartition(7).orderBy(F.rand(1)), ["id"], 80, 0).select("id", "split")
    assert a.exceptAll(b).count() == 0
    share = a.agg(F.avg((F.col("split") == "train").cast("double"))).first()[0]
    assert 0.7 < share < 0.9
