"""Machine-learning queries: splits, scaling, tree, L1 selection, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import ml
from tidewatch.plans.catalog import register
from tidewatch.plans.inputs import LINE_ORDER, LINE_VECTOR, rounded, table

TRAIN_FRACTION = 11 / 15  # the reference trains on its first 11,000 of about 15,000 records


@register("ordered_split", f"""
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * CAST({TRAIN_FRACTION!r} AS DOUBLE))
                      THEN 'train' ELSE 'test' END AS split FROM events""")
def ordered_split_q(spark, sf):
    """M1: first 11/15 of the records in time order train, the rest test."""
    ev = table(spark, sf, "events").select("event_id", "ts")
    return ml.ordered_split(ev, ["ts", "event_id"], train_fraction=TRAIN_FRACTION).select("event_id", "split")


def _scale_sql() -> str:
    order = ", ".join(LINE_ORDER)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                      for c in LINE_VECTOR)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in LINE_VECTOR)
    return f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos, count(*) OVER () AS n FROM lineitem),
st AS (SELECT {stats} FROM p WHERE pos <= floor(n * CAST({TRAIN_FRACTION!r} AS DOUBLE)))
SELECT l_orderkey, l_linenumber, l_suppkey, {scaled} FROM lineitem, st"""


@register("standard_scale", _scale_sql())
def standard_scale_q(spark, sf):
    """M4: lineitem 4-vector scaled to mean 0 / population std 1 with train-only statistics."""
    li = table(spark, sf, "lineitem")
    split = ml.ordered_split(li, LINE_ORDER, train_fraction=TRAIN_FRACTION)
    out = ml.standard_scale(split, LINE_VECTOR, fit_on=split.filter("split = 'train'"))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey", *LINE_VECTOR))


@register("accuracy", """
SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM labels""")
def accuracy_q(spark, sf):
    """A10: accuracy of `toxic` taken as a prediction of `quality`."""
    return rounded(ml.accuracy(table(spark, sf, "labels"), "quality", "toxic"))


@register("confusion_matrix", """
SELECT quality, count(CASE WHEN toxic = 0 THEN 1 END) AS pred_0, count(CASE WHEN toxic = 1 THEN 1 END) AS pred_1
FROM labels GROUP BY quality""")
def confusion_matrix_q(spark, sf):
    """Confusion matrix, rows = true quality, columns = predicted (toxic) class."""
    return ml.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@register("decision_tree")
def decision_tree_q(spark, sf):
    """M1 + M2 + A10 + A11: tree on lineitem 4-vectors predicting l_returnflag, trained on
    the first 11/15 in ship order, confusion matrix and accuracy on the rest."""
    li = table(spark, sf, "lineitem")
    split = ml.ordered_split(li, LINE_ORDER, train_fraction=TRAIN_FRACTION)
    pred = ml.decision_tree(split.filter("split = 'train'"), split.filter("split = 'test'"),
                            LINE_VECTOR, "l_returnflag", seed=0)
    pred = pred.select("l_returnflag", "prediction").checkpoint(eager=True)
    cm = ml.confusion_matrix(pred, "l_returnflag", "prediction", ["A", "N", "R"])
    acc = ml.accuracy(pred, "l_returnflag", "prediction").first()["accuracy"]
    return rounded(cm.withColumn("accuracy", F.lit(acc)))


@register("random_split", """
SELECT vec_id, CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|0'), 1, 8) AS BIGINT) % 100 < 80
                    THEN 'train' ELSE 'test' END AS split FROM embeddings""")
def random_split_q(spark, sf):
    """M3: 80/20 hash split of embeddings on vec_id (seed 0), row by row."""
    emb = table(spark, sf, "embeddings")
    return ml.random_split(emb, ["vec_id"], 80, 0).select("vec_id", "split")


@register("l1_select")
def l1_select_q(spark, sf):
    """M3 + M4 + M5 + M6: scale embedding dimensions on the train split, fit an
    L1 logistic regression (C 0.5), keep features with non-zero coefficients."""
    emb = table(spark, sf, "embeddings")
    low, dim = emb.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != dim:
        raise ValueError(f"embeddings of {low} to {dim} dimensions")
    feats = [f"e{i}" for i in range(dim)]
    wide = emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)])
    split = ml.random_split(wide, ["vec_id"], 80, 0)
    scaled = ml.standard_scale(split, feats, fit_on=split.filter("split = 'train'"))
    sel = ml.l1_select(scaled.filter("split = 'train'"), feats, "label", c=0.5)
    return rounded(sel)
