"""D6 as a stream learns it: score a row, compare with a running quantile, then learn.

Every micro-batch is scored with the model of the batch before, its alarms are the scores at or
above the running quantile of all earlier scores, and only then model and quantile take the
batch in. Model and quantile of every key are one row of a versioned table: batch ``n`` reads
``version=n-1`` and writes ``version=n``, so a batch that is run again after a failure gives
the same model, and any version can be read or rolled back to.

The model is the linear one-class SVM of ``ocsvm_fit`` learned by one subgradient step a batch
(a grouped sum, so a hot key is added up over all tasks): features are divided by their running
standard deviation, never centred; w starts at the mean of the first batch, rho at the ``nu``
quantile of its w.z. The quantile is a KLL sketch, merged batch by batch: its rank error is
about 2 / k whatever the number of rows.

Rows with a NULL feature have no score and teach nothing. ``protect`` keeps rows with an alarm
from teaching the model (the quantile sees them all). The first batch of a key has no scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.position import BROADCAST_ROWS

SKETCH_K = 1_024


def _sum_of(terms):
    terms = list(terms)
    return sum(terms[1:], terms[0])


def scored_batch(batch: DataFrame, model: DataFrame | None, keys: Sequence[str], xs: Sequence[str], q: float) -> DataFrame:
    """``batch`` with score (rho - w.z), threshold and alarm from the model before it."""
    if model is None:
        null = F.lit(None).cast("double")
        return batch.withColumns({"score": null, "threshold": null, "alarm": F.lit(False)})
    names = [f"__{c}" for c in model.columns if c not in keys]
    held = model.select(*keys, *[F.col(c).alias(f"__{c}") for c in model.columns if c not in keys])
    small = held.count() <= BROADCAST_ROWS  # one row a key
    rows = batch.join(F.broadcast(held) if small else held, list(keys), "left")
    dot = _sum_of(F.col(f"`{c}`").cast("double") / F.col(f"__s_{i}") * F.col(f"__w_{i}") for i, c in enumerate(xs))
    rows = rows.withColumns({
        "score": F.col("__rho") - dot,
        "threshold": F.when(F.col("__sketch").isNotNull(), F.kll_sketch_get_quantile_double("__sketch", F.lit(q)))})
    return rows.withColumn("alarm", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))).drop(*names)


def learned(scored: DataFrame, model: DataFrame | None, keys: Sequence[str], xs: Sequence[str], nu: float,
            rate: float, sketch_k: int, protect: bool) -> DataFrame:
    """The model after a scored batch: (keys, n, batches, s1_i, s2_i, s_i, w_i, rho, sketch)."""
    keys, d = list(keys), len(xs)
    x = [F.col(f"`{c}`").cast("double") for c in xs]
    known = F.lit(True)
    for c in x:
        known = known & c.isNotNull()
    teaching = known & ~F.col("alarm") if protect else known
    rows = scored.withColumn("__score", F.when(known, F.col("score")))
    sums = rows.groupBy(*keys).agg(
        F.count_if(known).alias("__n"), *[F.sum(F.when(known, c)).alias(f"__a{i}") for i, c in enumerate(x)],
        *[F.sum(F.when(known, c * c)).alias(f"__b{i}") for i, c in enumerate(x)],
        F.count_if(teaching).alias("__taught"), F.count_if(teaching & (F.col("score") > 0)).alias("__violating"),
        *[F.sum(F.when(teaching & (F.col("score") > 0), c)).alias(f"__v{i}") for i, c in enumerate(x)],
        F.kll_sketch_agg_double("__score", sketch_k).alias("__new"))
    if model is None:
        model = sums.select(*keys).limit(0).select(
            *keys, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("batches"),
            *[F.lit(0.0).alias(f"{p}_{i}") for p in ("s1", "s2", "s", "w") for i in range(d)], F.lit(0.0).alias("rho"),
            F.lit(None).cast("binary").alias("sketch"))
    both = model.join(sums.where("__n > 0"), keys, "full")
    zero = F.lit(0.0)
    n = F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))
    cols = {"n": n.cast("long"), "batches": (F.coalesce("batches", F.lit(0)) + F.when(F.col("__n") > 0, 1).otherwise(0)).cast("long")}
    for i in range(d):
        cols[f"s1_{i}"] = F.coalesce(f"s1_{i}", zero) + F.coalesce(f"__a{i}", zero)
        cols[f"s2_{i}"] = F.coalesce(f"s2_{i}", zero) + F.coalesce(f"__b{i}", zero)
        spread = F.sqrt(F.greatest(zero, cols[f"s2_{i}"] / n - (cols[f"s1_{i}"] / n) * (cols[f"s1_{i}"] / n)))
        cols[f"s_{i}"] = F.when(spread > 0, spread).otherwise(F.lit(1.0))
    step = F.lit(rate) / F.sqrt(cols["batches"].cast("double"))
    share = F.try_divide(F.col("__violating"), F.col("__taught"))
    first, still = F.col("w_0").isNull(), F.coalesce(F.col("__taught") == 0, F.lit(True))
    for i in range(d):
        # the mean of the violating rows' z over all taught rows, in the scale of the old model
        v = F.try_divide(F.coalesce(F.col(f"__v{i}"), zero) / F.col(f"s_{i}"), F.col("__taught"))
        moved = F.col(f"w_{i}") - step * (F.col(f"w_{i}") - v / nu)
        # w.x stays what it was when the scale changes: w is kept per unit of the new scale
        cols[f"w_{i}"] = (F.when(first, F.col(f"__a{i}") / F.col("__n") / cols[f"s_{i}"])
                          .otherwise(F.when(still, F.col(f"w_{i}")).otherwise(moved) / F.col(f"s_{i}") * cols[f"s_{i}"]))
    cols["rho"] = (F.when(first, F.lit(None).cast("double"))
                   .otherwise(F.when(still, F.col("rho")).otherwise(F.col("rho") + step * (1 - share / nu))))
    # a key's first batch has no scores, its sketch starts empty
    has_new = F.coalesce(F.kll_sketch_get_n_double("__new") > 0, F.lit(False))
    cols["sketch"] = F.when(has_new & F.col("sketch").isNotNull(), F.kll_sketch_merge_double("sketch", "__new")).otherwise(
        F.when(has_new, F.col("__new")).otherwise(F.col("sketch")))
    after = both.select(*keys, *[c.alias(name) for name, c in cols.items()])
    new = after.where("rho is null")
    small = F.broadcast(new) if new.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else new
    dot = _sum_of(c / F.col(f"s_{i}") * F.col(f"w_{i}") for i, c in enumerate(x))
    starts = (scored.where(known).join(small, keys).groupBy(*keys)
              .agg(F.percentile_approx(dot, nu, 10_000).alias("__rho")))
    return after.join(starts, keys, "left").withColumn("rho", F.coalesce("rho", "__rho")).drop("__rho")


def model_at(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The model table as it was after batch ``version``."""
    return spark.read.parquet(f"{folder}/version={version}")


def score_then_learn(stream: DataFrame, keys: Sequence[str], xs: Sequence[str], target: str, model_folder: str,
                     checkpoint: str, nu: float = 0.1, q: float = 0.995, rate: float = 0.1,
                     sketch_k: int = SKETCH_K, protect: bool = True, available_now: bool = True) -> StreamingQuery:
    """D6 over a stream: writes the scored rows to ``target`` (partition ``epoch``) and the model
    after every batch to ``model_folder`` (partition ``version``)."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        model = model_at(spark, model_folder, epoch_id - 1) if epoch_id else None
        scored = scored_batch(batch, model, keys, xs, q).persist(StorageLevel.DISK_ONLY)
        try:
            scored.write.mode("overwrite").parquet(f"{target}/epoch={epoch_id}")
            learned(scored, model, keys, xs, nu, rate, sketch_k, protect).write.mode("overwrite").parquet(
                f"{model_folder}/version={epoch_id}")
        finally:
            scored.unpersist()

    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
