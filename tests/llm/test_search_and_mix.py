"""op1 against BM25 by hand, op2 against its scheduling rules."""

import math
import random
from collections import Counter

import duckdb
import numpy as np

from scripts.check_oracle import rows_of
from tests.conftest import SF_SMALL
from tests.llm.helpers import SCHEMA, edges, empty
from tidewatch.llm import mixing, topk


def bm25(docs, query, k):
    bags = {i: Counter(topk.terms_of(t)) for i, t in docs}
    n, total = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(w for b in bags.values() for w in b)
    scores = []
    for i, b in bags.items():
        s = 0.0
        for w in sorted(set(topk.terms_of(query))):
            if w in b:
                norm = topk.K1 * (1 - topk.B + topk.B * sum(b.values()) * n / total)
                s += math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * (topk.K1 + 1) / (b[w] + norm)
        if s > 0:
            scores.append((round(s, 6), i))
    return [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]


def test_search_is_exact_over_shards_and_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(4_000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(400)]
    docs += [(400 + i, docs[i][1]) for i in range(30)]  # ties
    monkeypatch.setattr(topk, "BLOCK_TERMS", 100)
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    asked = df.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text")
    got = {}
    for r in topk.search(asked, df, k=7, shard_docs=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, text in docs:
        if q % 50 == 0:
            assert got.get(q, []) == bm25(docs, text, 7), q


def test_search_bounds_queries_in_groups(monkeypatch):
    """Frequent terms' sums and block maxima of many queries are products of matrices, and the best are exact."""
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.5)) % 3000}" for _ in range(20_000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 80)))) for i in range(1500)]
    monkeypatch.setattr(topk, "GROUP", 7)
    total = sum(len(topk.terms_of(t)) for _, t in docs)
    shard = topk.Shard(topk.pack_shard(*zip(*docs)), total / len(docs))
    assert min(len(shard.rough), len(shard.peak)) > 0 and len(shard.rough) + len(shard.peak) < len(shard.number)
    df = Counter(w for _, t in docs for w in set(topk.terms_of(t)))
    asked = [t for _, t in docs[:40]]
    for share in (None, 0.5, 1.0):  # no k-th score from elsewhere, a low one, the very one
        queries, want = [], []
        for text in asked:
            names = sorted(set(topk.terms_of(text))) + ["nowhere"]
            best = bm25(docs, text, 6)
            least = -1.0 if share is None or len(best) < 6 else share * best[-1][1]
            weights = np.array([math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w in names])
            queries.append((shard.numbers(names), weights, least))
            want.append(best)
        for (scores, ids), best in zip(shard.search(queries, 6), want):
            got = sorted(zip(ids.tolist(), scores.tolist()), key=lambda x: (-x[1], x[0]))
            assert [(i, round(s, 5)) for i, s in got[:6]] == [(i, round(s, 5)) for i, s in best]


def test_search_edges(spark):
    docs = edges(spark)
    asked = docs.selectExpr("doc_id AS query_id", "text")
    rows = topk.search(asked, docs, k=3).collect()
    best = {r.query_id: r.doc_id for r in rows if r["rank"] == 1}
    assert best[4] == 4 and best[7] == 7 and 1 not in best and 2 not in best and None not in best
    assert [r.doc_id for r in rows if r.query_id == 4] == [4, 5, 5]
    assert topk.search(asked, empty(spark)).count() == 0
    assert topk.search(empty(spark).selectExpr("doc_id AS query_id", "text"), docs).count() == 0


def test_search_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert rows_of(topk.op1_topk_search(spark, SF_SMALL).toPandas()) == rows_of(con.execute(topk.ORACLE_SQL).df())


def test_mix_meets_every_deadline_and_deviates_by_less_than_a_block(spark):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["hot"] * 900 + ["b"] * 300 + ["c"] * 200 + ["d"] * 40)]
    weights = {"hot": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, block_rows=4, period=100).collect()
    assert sorted(r.doc_id for r in out) == list(range(1440))
    assert all(r.release <= r.slot < r.deadline for r in out)
    served = {(r.source, r.block): r.slot for r in out}
    assert len(set(served.values())) == len(served)  # one block a slot
    live = min(max(s for (x, _), s in served.items() if x == name) for name in weights)
    for t in range(1, live + 1):
        for name, w in weights.items():
            n = sum(1 for (x, _), s in served.items() if x == name and s < t)
            assert abs(n - w * t) < 1, (t, name)
    assert max(r.in_block for r in out) == 3


def test_mix_numbers_hot_sources_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 16)
    rows = [(i, "t", "en", "hot" if i % 3 else "b", 1) for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_rows=1).collect()
    for s in ("hot", "b"):
        assert sorted(r.block for r in out if r.source == s) == list(range(sum(r.source == s for r in out)))


def test_mix_edges(spark):
    docs = edges(spark)
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.where("slot is null").count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    nodes = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert rows_of(mixing.op2_mix_sources(spark, SF_SMALL).toPandas()) == rows_of(con.execute(mixing.ORACLE_SQL).df())


def test_mix_with_more_sources_than_slots(spark):
    rows = [(i, "t", "en", f"s{i}", 1) for i in range(50)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), period=10).collect()
    assert sorted(r.slot for r in out) == list(range(50))


def test_mix_meets_the_given_weights_not_rounded_ones(spark):
    weights = {"a": 0.9991, "b": 0.0005, "c": 0.0004}
    assert mixing.whole_slots(weights) == {"a": 9991, "b": 5, "c": 4}
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["a"] * 19_982 + ["b"] * 10 + ["c"] * 8)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights, block_rows=1).select("source", "slot").collect()
    assert sorted(r.slot for r in out) == list(range(20_000))
    for name, w in weights.items():
        slots = sorted(r.slot for r in out if r.source == name)
        for k, slot in enumerate(slots):  # the k-th block: k served before it, k + 1 after it
            assert abs(k - w * slot) < 1 and abs(k + 1 - w * (slot + 1)) < 1, (name, k)


def test_whole_slots_rounds_only_beyond_the_longest_period():
    assert mixing.whole_slots({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0}) == {"a": 10, "b": 6, "c": 3, "d": 1}
    assert mixing.whole_slots({}) == {} and mixing.whole_slots({"a": 3}) == {"a": 1}
    many = {f"s{i}": 1 / 7 + i * 1e-7 for i in range(7)}
    got = mixing.whole_slots(many)
    assert sum(got.values()) == mixing.LONGEST_PERIOD
    assert all(abs(got[k] - w / sum(many.values()) * mixing.LONGEST_PERIOD) < 1 for k, w in many.items())
