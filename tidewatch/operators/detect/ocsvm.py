"""One-class linear SVM score and quantile threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.position import BROADCAST_ROWS
from tidewatch.operators.profile import keyed_quantile


def quantile_filter(df: DataFrame, keys: Sequence[str], score: str, q: float = 0.995,
                    fit_on: DataFrame | None = None) -> DataFrame:
    """Alarm when ``score`` >= the exact ``q``-quantile of the scores of its key
    (quantile taken over ``fit_on`` if given, e.g. the training rows)."""
    keys = list(keys)
    thr = keyed_quantile(fit_on if fit_on is not None else df, keys, score, q, "threshold")
    if keys:
        small = thr.count() <= BROADCAST_ROWS
        out = df.join(F.broadcast(thr) if small else thr, keys, "left")
    else:
        out = df.withColumn("threshold", F.lit(thr.first()["threshold"]))
    return out.withColumn("alarm", F.col(score) >= F.col("threshold"))


def one_class_svm(df: DataFrame, keys: Sequence[str], xs: Sequence[str], nu: float = 0.1, q: float = 0.995,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Fit a linear one-class SVM per key (on ``fit_on`` if given, e.g. earlier rows, so
    that neither the model nor the threshold sees the rows it judges; else on all rows),
    score every row (rho - w.x) and alarm on scores at or above the key's exact ``q``
    quantile of the fitted rows' scores."""
    from tidewatch.operators.detect.ocsvm_fit import fit_one_class_svm, svm_scores
    train = fit_on if fit_on is not None else df
    params = fit_one_class_svm(train, keys, xs, nu).checkpoint(eager=True)
    scored = svm_scores(df, params, keys, xs)
    fitted = svm_scores(fit_on, params, keys, xs) if fit_on is not None else None
    return quantile_filter(scored, keys, "score", q, fitted)


def fit_scorer(train: DataFrame, keys: Sequence[str], xs: Sequence[str], nu: float = 0.1,
               q: float = 0.995) -> DataFrame:
    """D6 model table for streams: per key (w, rho) and the ``q`` quantile of the training
    scores. Small (one row per key); a stream is scored by a stream-static join."""
    from tidewatch.operators.detect.ocsvm_fit import fit_one_class_svm, svm_scores
    keys = list(keys)
    params = fit_one_class_svm(train, keys, xs, nu).checkpoint(eager=True)
    thr = keyed_quantile(svm_scores(train, params, keys, xs), keys, "score", q, "threshold")
    return params.drop("gap").join(thr, keys).checkpoint(eager=True)


def score_stream(stream: DataFrame, model: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Score a streaming DataFrame with a fitted model table (stream-static join; the
    model is re-read each micro-batch, so a refit written to its location is picked up)."""
    keys = list(keys)
    dot = sum(F.col(f"`{c}`").cast("double") * F.col(f"w_{i}") for i, c in enumerate(xs))
    scored = stream.join(F.broadcast(model) if model.count() <= BROADCAST_ROWS else model, keys)
    return (scored.withColumn("score", F.col("rho") - dot)
            .withColumn("alarm", F.col("score") >= F.col("threshold"))
            .drop(*[f"w_{i}" for i in range(len(xs))], "rho"))
