"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without that
    setting gets a scratch folder of its own."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidewatch-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_forest(edges: DataFrame) -> DataFrame:
    """Spanning forest of the edges (a, b) of each partition: (node, smallest node of its
    local tree). Connectivity is kept, the number of edges drops to the number of nodes."""
    def contract(batches):
        import pandas as pd
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for p in batches:
            for a, b in zip(p["a"].tolist(), p["b"].tolist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if find(x) != x]
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, dtype="int64")

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(contract, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (node, component), where
    component is the smallest node reachable. Nodes without an edge are not returned.

    Alternating large-star and small-star rounds (logarithmically many) over a spanning
    forest of each partition; each round is cut by a checkpoint. Self edges and repeated
    edges are allowed; an empty input gives an empty result.
    """
    e = cut(local_forest(edges.where("a is not null and b is not null and a <> b")).distinct())
    before = None
    for _ in range(max_rounds):
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large holds (node, smaller); now each node points its smaller neighbours at the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.union(roots.join(nodes.select("node"), "node", "left_anti"))


def keep(df: DataFrame) -> DataFrame:
    """Cache on disk; a lost block is computed again from its lineage."""
    return df.persist(StorageLevel.DISK_ONLY)
