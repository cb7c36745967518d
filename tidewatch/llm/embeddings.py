"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

A normalised vector gets, in each of ``tables`` tables, ``bits`` quantised random
projections floor((a . v + b) / width); vectors with the same label that agree on all
projections of a table meet in a bucket. Cosines are computed there in double precision.
With the default parameters a pair at cosine 0.98 meets in some table with probability
about 0.95, closer pairs almost surely, unrelated ones with less than 1e-6.

Identical vectors of a label are one node with a weight and the smallest of their ids, so
copies are never paired up (nodes have numbers of their own: a vec_id may stand in several).
A full bucket is dealt out in pairs of chunks: each task compares one chunk with one other
(or with itself) and returns a row per vector, never a row per pair. A pair that meets in
several tables is counted in the first of them.

Rules for special rows: null labels, null vectors, zero vectors and vectors with null or
non-finite components (or of another length than most: compared only with their own
length) link with nothing, each is its own component; a repeated row is a vector of its
own (another row with the same vec_id counts as a link); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import components, cut, read

TABLES, BITS, WIDTH = 24, 20, 1.6
CHUNK = 512  # vectors of a bucket that are compared as one block


def projections(dim: int, tables: int, bits: int, seed: int = 5):
    """Gaussian directions (tables * bits, dim) and offsets in [0, 1) of the quantisers."""
    import numpy as np

    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(tables * bits, dim)), rng.random(tables * bits)


def signatures(vectors, tables: int, bits: int, width: float):
    """One 32-bit number per vector and table: a hash of the table's quantised projections."""
    import numpy as np

    directions, offsets = projections(vectors.shape[1], tables, bits)
    cells = np.floor(vectors @ directions.T / width + offsets).astype(np.int64).astype(np.uint64)
    odd = np.random.default_rng(17).integers(1, 1 << 62, bits, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (cells.reshape(len(vectors), tables, bits) * odd).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)


def compared(a, sig_a, b, sig_b, table: int, same: bool, threshold: float):
    """Links between two chunks whose first common table is ``table``: a boolean matrix."""
    import numpy as np

    close = a @ b.T >= threshold
    for t in range(table):
        close &= sig_a[:, t][:, None] != sig_b[:, t][None, :]
    if same:
        np.fill_diagonal(close, False)
    return close


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, bits: int = BITS,
                    width: float = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (see the module's rules)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"),
                          F.col(label_col).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = (F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~bad
             & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    nodes = cut(rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("m")))
    nodes = nodes.withColumn("rep", F.monotonically_increasing_id())  # the same at every reading of the written table

    def sign(batches):
        import numpy as np
        import pandas as pd

        for p in batches:
            for _, g in p.groupby(p["v"].map(len)):
                x = np.stack(g["v"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"label": g["label"], "rep": g["rep"], "m": g["m"], "unit": list(x),
                                    "sig": list(signatures(x, tables, bits, width))})

    label_type = vectors.schema[label_col].dataType.simpleString()
    signed = cut(nodes.select("label", "v", "rep", "m").mapInPandas(sign, f"label {label_type}, rep long, m long, unit array<double>, sig array<int>"))
    met = signed.select("label", F.size("unit").alias("dim"), "rep", F.posexplode("sig").alias("t", "h"))
    bucket = ["label", "dim", "t", "h"]
    sizes = met.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = (met.join(sizes, bucket).withColumn("chunks", chunks)
             .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    work = dealt.select(*bucket, "i", "j", "mine", "rep").join(signed.select("rep", "m", "unit", "sig"), "rep")

    def compare(key, p):
        import numpy as np
        import pandas as pd

        t, i, j = int(key[2]), int(key[4]), int(key[5])
        left, right = p[p["mine"] == i], p[p["mine"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        side = [(np.stack(x["unit"].to_numpy()), np.stack(x["sig"].to_numpy()), x["rep"].to_numpy(), x["m"].to_numpy())
                for x in (left, right)]
        (a, sa, ra, ma), (b, sb, rb, mb) = side
        close = compared(a, sa, b, sb, t, i == j, threshold)
        links, first, second = [], close.any(axis=1), close.any(axis=0)
        # a linked vector's root: its smallest linked partner's smallest partner and so on, within the block
        root_a, root_b = ra.copy(), (ra if i == j else rb).copy()
        big = np.iinfo(np.int64).max
        while True:
            best_a = np.minimum(root_a, np.where(close, root_b[None, :], big).min(axis=1))
            best_b = np.minimum(root_b, np.where(close, best_a[:, None], big).min(axis=0))
            if i == j:
                best_a = best_b = np.minimum(best_a, best_b)
            if (best_a == root_a).all() and (best_b == root_b).all():
                break
            root_a, root_b = best_a, best_b
        links.append(pd.DataFrame({"rep": ra[first], "links": (close @ mb)[first], "root": root_a[first]}))
        if i != j:
            links.append(pd.DataFrame({"rep": rb[second], "links": (ma @ close)[second], "root": root_b[second]}))
        return pd.concat(links)

    found = cut(work.groupBy(*bucket, "i", "j").applyInPandas(compare, "rep long, links long, root long"))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (nodes.join(counted, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
             .select("label", "v", "first_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"),
                     F.coalesce("component", "rep").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component"))
    out = rows.join(named.join(lowest, "root").select("label", "v", F.lit(True).alias("valid"), "links", "component"),
                    ["label", "v", "valid"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


# Exact links and components (all pairs of a label): equal to the query where hashing misses no link.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
