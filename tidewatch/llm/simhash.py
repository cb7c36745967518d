"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance.

Rules for special rows: a null text counts as empty; a text without words has fingerprint
zero and is linked like any other; a text with fewer words than a shingle is one shingle;
repeated rows share a fingerprint and so a component; rows with a null doc_id get a
fingerprint but can neither name nor enter a component (component_id null). Extra columns
of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import components, cut, read

CHUNK = 1 << 16  # shingles hashed before their bits are added up


def fingerprint_bytes(text: str | None, words_per_shingle: int = 3) -> int:
    """Fingerprint of one whole text as an unsigned integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII space
    if not words:
        return 0
    h, n = xxhash.xxh64_intdigest, words_per_shingle
    if len(words) < n:
        return h(b" ".join(words), 42)
    total = len(words) - n + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        part = words[at:at + CHUNK + n - 1]
        hashes = [h(s, 42) for s in map(b" ".join, zip(*(part[k:] for k in range(n))))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint_bytes(t.as_py(), words_per_shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    kind = "bigint" if kind in ("tinyint", "smallint", "int") else kind
    return (docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, fp long"))


def links(nodes: DataFrame, max_bits: int = 2, blocks: int = 4, bucket_rows: int = 64) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` that are at most
    ``max_bits`` bits apart.

    The 64 bits are cut into ``blocks`` blocks; a close pair agrees on at least
    ``blocks - max_bits`` of them, so it meets under one key made of that many blocks.
    Keys shared by up to ``bucket_rows`` fingerprints are joined and verified pair by
    pair. A fuller key (many near copies of one text) is not paired up: each of its
    fingerprints there goes to the neighbours one half of the distance away, and close
    fingerprints meet at a common neighbour (linear in the size of the group, and exact).
    """
    if not 0 <= max_bits < blocks:
        raise ValueError("blocks must exceed max_bits")
    edges_at = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = []
    for group in combinations(range(blocks), blocks - max_bits):
        m = sum(((1 << (edges_at[g + 1] - edges_at[g])) - 1) << edges_at[g] for g in group)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                         .alias("k", "block"))
    sizes = keyed.groupBy("k", "block").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(sizes, ["k", "block"]))
    light = met.where(F.col("n") <= bucket_rows)
    right = light.select("k", "block", F.col("fp").alias("other"))
    pairs = (light.join(right, ["k", "block"])
             .where((F.col("fp") < F.col("other"))
                    & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits))
             .select(F.col("fp").alias("a"), F.col("other").alias("b")))
    full = met.where(F.col("n") > bucket_rows).select("fp").distinct()
    half, odd = divmod(max_bits, 2)
    near = [0]
    for r in range(1, half + odd + 1):
        near += [sum(1 << i for i in c) for c in combinations(range(64), r)]
    near = [m - (1 << 64) if m >> 63 else m for m in near]
    around = (full.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in near])).alias("at")))
    if not odd:  # two fingerprints with a common neighbour are at most max_bits apart
        low = around.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
        star = around.join(low, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")
    else:
        star = (around.join(around.select("at", F.col("fp").alias("b")), "at")
                .where((F.col("fp") > F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits))
                .select(F.col("fp").alias("a"), "b"))
    return pairs.union(star)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable over links between fingerprints at most ``max_bits`` bits apart).
    Rows with equal fingerprints are one node, so copies are never paired up."""
    fps = cut(fingerprints(docs, words_per_shingle, id_col, text_col))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(links(nodes, max_bits))
    classes = nodes.join(comp, nodes.fp == comp.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(lowest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
