"""Quality: a compression classifier with zstandard dictionaries.

One dictionary is trained on good and one on bad labelled text. A text is cut into pieces of
``PIECE`` bytes and every piece is compressed with either dictionary; text like the good
samples gets smaller with the good dictionary. The score is a logistic function of

* the compressed-size difference (bad minus good) per byte, shrunk towards zero for texts of
  few bytes, and
* how much the length shrinks it (so that a text too short to tell gets the usual share),

whose three coefficients are fitted on labelled documents that trained no dictionary.

Rules for special rows: null and empty texts score as a text of no bytes; repeated rows score
alike; extra columns are ignored; labels that are null count as no label, contradicting labels
of one doc_id as bad; a doc_id with several texts is fitted on the smallest of them. Without
labelled rows of both kinds the score is the share of good rows (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read

PIECE = 1024              # bytes compressed at a time
DICTIONARY = 65_536       # bytes of a dictionary
LEVEL = 3
SHORT = 50                # bytes at which the difference counts half
FIT_ROWS = 1_200          # at most so many labelled documents of either class are fitted
FIT_CHARS = 20_000        # longer documents are scored, but not fitted


@dataclass
class Model:
    """Dictionaries (empty: none) and coefficients of difference, shortness and constant."""
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def pieces_of(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.tools = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                       write_content_size=False, write_dict_id=False))

    def features(self, texts) -> object:
        """Rows of (difference per byte, shortness)."""
        import numpy as np

        good, bad = (t.compress for t in self.tools)
        rows = np.zeros((len(texts), 2))
        for k, text in enumerate(texts):
            parts = pieces_of(text)
            n = sum(map(len, parts)) + SHORT
            rows[k] = (sum(len(bad(p)) - len(good(p)) for p in parts) / n, SHORT / n)
        return rows


def probability(features, weights):
    import numpy as np

    z = features @ np.array(weights[:2]) + weights[2]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def calibrate(features, labels, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression (ridge on standardised columns keeps it finite) by Newton steps."""
    import numpy as np

    y = np.array(labels, dtype=np.float64)
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - centre) / spread, np.ones(len(y))])
    w, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge @ w)
    slopes = w[:2] / spread
    return float(slopes[0]), float(slopes[1]), float(w[2] - slopes @ centre)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Every third text of a class calibrates, the others train its dictionary."""
    import math

    by_class = [[t for t, y in zip(texts, labels) if y == q] for q in (0, 1)]
    trained = [[p for k, t in enumerate(ts) if k % 3 != 2 for p in pieces_of(t)] for ts in by_class]
    kept_out = [(t, q) for q, ts in enumerate(by_class) for k, t in enumerate(ts) if k % 3 == 2]
    if not trained[0] or not trained[1] or len({q for _, q in kept_out}) < 2:
        share = (len(by_class[1]) / len(texts)) if texts else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (0.0, 0.0, math.log(share / (1 - share))))
    bad, good = map(dictionary, trained)
    features = Sizes(good, bad).features([t for t, _ in kept_out])
    return Model(good, bad, calibrate(features, [q for _, q in kept_out]))


def held_out() -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Model of a bounded sample: for each class the ``fit_rows`` labelled documents of the
    training share with the smallest hashed ids, of at most ``fit_chars`` characters."""
    known = (labels.where("quality is not null and doc_id is not null").where(~held_out())
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("quality") == q).orderBy(*order).limit(fit_rows) for q in (0, 1)]
    rows = (docs.select("doc_id", "text").where(F.char_length("text") <= fit_chars)
            .join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # at most 2 * fit_rows ids
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(*order).collect())
    return fit([r.text for r in rows], [r.quality for r in rows])


_SIZES: dict[str, Sizes] = {}


def score_column(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """Column expression: the score of a text."""
    import uuid

    if not model.good:
        import numpy as np
        return F.lit(float(probability(np.zeros(2), model.weights)))
    shipped, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if key not in _SIZES:  # kept while the worker is reused
            _SIZES.clear()
            _SIZES[key] = Sizes(shipped.value.good, shipped.value.bad)
        return pd.Series(probability(_SIZES[key].features(texts.tolist()), shipped.value.weights))

    return score(F.coalesce(F.col(text_col), F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= threshold)."""
    model = fitted_model(docs, labels)
    return (docs.select("doc_id", held_out().alias("held_out"), score_column(docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
