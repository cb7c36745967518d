"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and itself) in hash buckets; a window of a few
words is the average of its words' average embeddings; a linear softmax over the average
separates toxic windows from clean ones. A document counts as toxic when any of its
windows does: in training only the strongest window of a toxic document must be toxic,
and every window of a clean document must be clean. The strongest logit is calibrated to
a probability on documents kept out of the fit.

Since the softmax reads a plain average, a word's share of the logit is one number; the
scorers keep those numbers in a bounded cache per Python worker.

Rules for special rows: null and empty texts get the score of a window without words;
repeated rows are scored alike; extra columns are ignored; labels that are null count as
no label, contradicting labels of one doc_id as toxic. Without labelled rows of both
kinds the score is the share of toxic rows (0 without any).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read

BUCKETS, DIM, WINDOW = 1 << 17, 8, 3
GRAMS = (3, 4, 5)
FIT_ROWS = 1_200          # at most so many labelled documents of either class are fitted
FIT_CHARS = 20_000        # longer documents are scored, but not fitted
EDGE = ".,;:!?\"'()[]{}|<>*_-"
CACHE_ENTRIES = 400_000
LONGEST_CACHED = 48
SCORED_TOGETHER = 256     # texts


def grams_of(words: list[str]):
    """Subwords of the words: (word number, bucket) of every byte n-gram of ``<word>`` and of
    the word itself, and the number of subwords of each word. All words are hashed at once."""
    import numpy as np

    marked = [b"<" + w.strip(EDGE).encode("utf-8", "surrogatepass") + b">" for w in words]
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes up to the word's end
    who, bucket, size = [np.arange(len(words), dtype=np.int32)], [
        np.array([zlib.crc32(m) % BUCKETS for m in marked], dtype=np.int32)], np.ones(len(words))
    h = data * np.uint32(0x9E3779B1)
    for n in range(2, GRAMS[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1:] if len(h) > 1 else h[:0]
        if n not in GRAMS:
            continue
        whole = np.nonzero(rest[:len(h)] >= n)[0]
        mixed = h[whole] ^ (h[whole] >> np.uint32(15))
        who.append(owner[whole])
        bucket.append(((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(15)).astype(np.int32))  # 17 bits: BUCKETS
        size += np.bincount(who[-1], minlength=len(words))
    return np.concatenate(who), np.concatenate(bucket), size


@dataclass
class Model:
    """Logit of a window = bias + mean over its words of the mean of ``gram[bucket]``;
    probability = 1 / (1 + exp(-(scale * strongest logit + shift)))."""
    gram: object
    bias: float
    scale: float
    shift: float

    def words(self, words: list[str]):
        """The value of each word: the average over its subwords."""
        import numpy as np

        who, bucket, size = grams_of(words)
        return np.bincount(who, weights=self.gram[bucket], minlength=len(words)) / size

    def probability(self, logit):
        import numpy as np
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40)))


def strongest(values, bias: float) -> float:
    """Largest window average of word values, plus the bias."""
    import numpy as np

    if not len(values):
        return bias
    if len(values) <= WINDOW:
        return float(np.mean(values)) + bias
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW + bias


def fit(texts: list[str], labels: list[int], epochs: int = 90, seed: int = 11) -> Model:
    """Joint training of bucket embeddings and softmax weights by Adam on all windows."""
    import numpy as np

    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in t.lower().split()], dtype=np.int64) for t in texts]
    filled = [k for k, d in enumerate(docs) if len(d)]
    docs, y = [docs[k] for k in filled], y[filled]
    who, bucket, size = grams_of(list(index))

    first_doc = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    words = np.concatenate(docs)
    lo, width, owner = [], [], []
    for k, d in enumerate(docs):
        n = max(1, len(d) - WINDOW + 1)
        lo.append(first_doc[k] + np.arange(n))
        width.append(np.full(n, min(WINDOW, len(d))))
        owner.append(np.full(n, k))
    lo, width, owner = np.concatenate(lo), np.concatenate(width), np.concatenate(owner)
    first_window = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])

    held = np.arange(len(docs)) % 5 == 4  # calibrates
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM))
    W = rng.normal(0, 0.5, (DIM, 2))
    b = np.zeros(2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, W, b)]
    fitted, positive = ~held[owner], y[owner] == 1
    clean = fitted & ~positive
    n_pos = max(1, int((y[~held] == 1).sum()))

    def logits():
        u = E @ (W[:, 1] - W[:, 0])
        per_word = np.bincount(who, weights=u[bucket], minlength=len(size)) / size
        sums = np.concatenate([[0.0], np.cumsum(per_word[words])])
        return (sums[lo + width] - sums[lo]) / width + b[1] - b[0]

    def top_windows(z):
        best = np.maximum.reduceat(z, first_window)
        hit = np.nonzero(z >= best[owner])[0]
        _, k = np.unique(owner[hit], return_index=True)
        return hit[k], best

    for step in range(1, epochs + 1):
        z = logits()
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        weight = np.zeros(len(z))
        if step <= epochs // 4:  # every window inherits its document's label
            per_class = np.array([clean.sum(), (fitted & positive).sum()], dtype=np.float64)
            weight[fitted] = 1 / per_class[positive[fitted].astype(int)]
        else:
            top, _ = top_windows(z)
            top = top[positive[top] & fitted[top]]
            weight[clean] = 30.0 / clean.sum()
            hard = clean & (p > 0.2)
            weight[hard] += 1.0 / n_pos
            weight[top] = 1.0 / n_pos
        err = weight * (p - positive) / width
        spread = (np.bincount(lo, weights=err, minlength=len(words) + 1)  # each window hands its error to its words
                  - np.bincount(lo + width, weights=err, minlength=len(words) + 1))
        per_word = np.bincount(words, weights=np.cumsum(spread)[:-1], minlength=len(size)) / size
        per_gram = np.bincount(bucket, weights=per_word[who], minlength=BUCKETS)
        pull = per_gram @ E
        total = float((weight * (p - positive)).sum())
        grads = [np.outer(per_gram, W[:, 1] - W[:, 0]), np.stack([-pull, pull], axis=1) + 1e-5 * W,
                 np.array([-total, total])]
        for param, g, (m, v), rate in zip((E, W, b), grads, moments, (0.05, 0.05, 0.1)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)

    z = logits()
    _, best = top_windows(z)
    scale, shift = calibrate(best[held], y[held]) if 0 < y[held].sum() < held.sum() else (1.0, 0.0)
    return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0]), scale, shift)


def calibrate(logit, y, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on one number (ridge keeps it finite), by Newton steps."""
    import numpy as np

    centre, spread = logit.mean(), logit.std() + 1e-9
    x = np.stack([(logit - centre) / spread, np.ones(len(logit))], axis=1)
    w, ridge = np.zeros(2), np.diag([0.5, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(2), x.T @ (p - y) + ridge @ w)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def fitted_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Model of a bounded sample: for each class the ``fit_rows`` labelled documents of the
    training share with the smallest hashed ids; longer documents than ``fit_chars`` are
    not fitted. Rows whose crc32(doc_id) mod 4 is 2 are held out."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("toxic"))
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    picked = None
    for label in (0, 1):
        one = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        picked = one if picked is None else picked.union(one)
    rows = (docs.select("doc_id", "text").where(F.char_length("text") <= fit_chars)
            .join(F.broadcast(picked), "doc_id")  # at most 2 * fit_rows ids
            .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    return fit([r.text for r in rows], [r.toxic for r in rows])


class Scorer:
    """Worker-side scorer with a bounded cache of word values."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def logits(self, texts: list[str | None]) -> list[float]:
        """The strongest logit of each text."""
        import numpy as np

        split = [(t or "").lower().split() for t in texts]
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.cache))
        local = dict(zip(fresh, self.model.words(fresh).tolist())) if fresh else {}
        if len(self.cache) + len(local) > CACHE_ENTRIES:
            local |= {w: self.cache[w] for words in split for w in words if w in self.cache}
            self.cache = {}
        self.cache.update(local)
        values = self.cache
        out = [strongest(np.array([values[w] for w in words]), self.model.bias) for words in split]
        for w in local:
            if len(w) > LONGEST_CACHED:
                del values[w]
        return out


_SCORERS: dict[str, Scorer] = {}


def score_column(spark: SparkSession, model: Model, text_col: str = "text"):
    """Column expression: the score of a text."""
    import uuid

    shipped, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts):
        import numpy as np
        import pandas as pd

        if key not in _SCORERS:  # kept while the worker is reused
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shipped.value)
        scorer, texts = _SCORERS[key], texts.tolist()
        logits = [z for at in range(0, len(texts), SCORED_TOGETHER)
                  for z in scorer.logits(texts[at:at + SCORED_TOGETHER])]
        return pd.Series(scorer.model.probability(np.array(logits, dtype=np.float64)))

    return score(F.coalesce(F.col(text_col), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= threshold)."""
    model = fitted_model(docs, labels)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return (docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"),
                        score_column(docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
