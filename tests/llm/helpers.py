"""Small tables with every edge: nulls, empty and white texts, repeated rows, clashing names."""

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))

EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, 5), (4, "one", "en", "b", 3),
    (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (6, "Straße 日本語 \U0001f600 café▁x", "de", "b", 9),
    (7, LONG, "en", "a", len(LONG)), (8, LONG, "en", "", len(LONG)), (None, "no id", "en", "a", 5),
    (9, "a" * 5_000, "en", "a", 5_000), (-3, "negative id  two  spaces ", "en", "c", 25),
]


def edges(spark):
    """The edge rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("fp", "n", "slot", "score", "chunk", "n_tokens", "spans", "src", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def classes(ids, linked):
    """Smallest id reachable from each id over the pairs ``linked``."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}
