"""Splits, scaling, classifiers and feature selection on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.position import with_position


MAX_CLASSES = 1_000  # columns that a confusion matrix makes of its own accord


def q(c: str):
    return F.col(f"`{c}`")


def ordered_split(df: DataFrame, order: Sequence[str], n_train: int | None = None,
                  train_fraction: float | None = None, keys: Sequence[str] = (),
                  split_col: str = "split") -> DataFrame:
    """M1: the first ``n_train`` records (or the first ``train_fraction`` of them) in
    ``order`` are 'train', the rest 'test'. Position numbering is hot-key safe."""
    pos = with_position(df, list(keys), order, "_pos")
    if n_train is None:
        if train_fraction is None:
            raise ValueError("give n_train or train_fraction")
        if keys:  # sizes by a grouped count (map-side partials), not by a window over whole keys
            sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tot"))
            pos = pos.join(sizes, list(keys))
            limit = F.floor(F.col("_tot") * F.lit(train_fraction))
        else:
            limit = F.lit(int(df.count() * train_fraction))
    else:
        limit = F.lit(int(n_train))
    return pos.withColumn(split_col, F.when(F.col("_pos") <= limit, "train").otherwise("test")).drop("_pos", "_tot")


def random_split(df: DataFrame, id_cols: Sequence[str], train_percent: int = 80, seed: int = 0,
                 split_col: str = "split") -> DataFrame:
    """M3: hash split on the row id (md5 of ``id|...|seed``, so any engine can repeat it):
    stable under repartitioning and re-execution (unlike ``randomSplit``, whose result
    depends on partition layout)."""
    text = F.concat_ws("|", *[q(c).cast("string") for c in id_cols], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn(split_col, F.when(h < train_percent, "train").otherwise("test"))


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                   suffix: str = "") -> DataFrame:
    """M4: (x - mean) / population std with statistics from ``fit_on`` (train rows);
    a zero std divides by 1. One aggregate; the scaling is plain column arithmetic."""
    src = fit_on if fit_on is not None else df
    stats = src.agg(*[F.avg(q(c)).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(q(c)).alias(f"s_{c}") for c in cols]).first()
    out = df
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        s = 1.0 if (s is None or s == 0.0) else s
        out = out.withColumn(f"{c}{suffix}", (q(c) - F.lit(m)) / F.lit(s))
    return out


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """A10: share of rows whose prediction equals the label."""
    return df.agg(F.avg((q(label) == q(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence | None = None) -> DataFrame:
    """rows = true class, one column per predicted class (sorted), counts (0 if none)."""
    if classes is None:
        found = df.select(q(label).alias("c")).union(df.select(q(pred))).distinct().limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes: give the classes that should become columns")
        classes = sorted(r[0] for r in found if r[0] is not None)
    g = df.groupBy(q(label).alias(label)).pivot(pred, list(classes)).count()
    return g.select(q(label), *[F.coalesce(q(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes])


def decision_tree(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                  max_depth: int = 10, seed: int = 0, max_bins: int = 64) -> DataFrame:
    """M2: label indexed in alphabetical order, features assembled, Gini decision tree
    (Spark trains it as distributed histogram aggregation). ``max_depth`` (at most 30,
    Spark's limit) costs one pass over the rows per level; ``max_bins`` is the number of
    split candidates per feature. Returns test
    rows with ``label``, ``prediction`` (original label values)."""
    idx = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")
    vec = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", impurity="gini", maxDepth=max_depth,
                                  seed=seed, maxBins=max_bins, maxMemoryInMB=1024, cacheNodeIds=True)
    model = Pipeline(stages=[idx, vec, tree]).fit(train)
    labels = model.stages[0].labels
    pred = model.transform(test)
    mapping = F.array(*[F.lit(v) for v in labels])
    return pred.withColumn("prediction", F.element_at(mapping, F.col("prediction").cast("int") + 1)).drop(
        "_y", "_x", "rawPrediction", "probability")


def l1_select(train: DataFrame, features: Sequence[str], label: str, c: float = 0.5,
              threshold: float = 1e-5, max_iter: int = 100) -> DataFrame:
    """M5 + M6: L1-penalised logistic regression (elastic net 1, reg = 1/(C n)) on the
    given (already scaled) features; one row per feature with its coefficient and whether
    it is kept (|coef| > threshold)."""
    n = train.count()
    vec = VectorAssembler(inputCols=list(features), outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=label, elasticNetParam=1.0, regParam=1.0 / (c * n),
                            standardization=False, maxIter=max_iter, family="auto")
    model = lr.fit(vec.transform(train))
    coefs = model.coefficientMatrix.toArray()
    spark = train.sparkSession
    rows = [(f, float(abs(coefs[:, i]).max())) for i, f in enumerate(features)]
    out = spark.createDataFrame(rows, "feature STRING, abs_coef DOUBLE")
    return out.withColumn("selected", F.col("abs_coef") > threshold)


__all__ = ["ordered_split", "random_split", "standard_scale", "accuracy", "confusion_matrix",
           "decision_tree", "l1_select"]
