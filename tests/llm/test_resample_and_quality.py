"""op12 against brute force, the radix sort against sorted(); op13 by held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import SCHEMA, edges, empty
from tidewatch.llm import resample, zipquality
from tidewatch.llm.common import cut, read


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(rows, target):
    """(doc_id, n_features, weight, score, rank) of every row."""
    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_resample_equals_brute_force(spark):
    docs, target = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert rows_of(resample.op12_importance_resample(spark, SF_SMALL)) == want
    assert rows_of(resample.resample(docs.repartition(7), target, block_rows=3)) == want
    assert sum(r[4] is not None for r in want) > 3


def test_resample_edges_and_ties(spark):
    docs = edges(spark)
    target = empty(spark).select("text")
    many = docs.union(docs).union(docs.where("length(text) > 1000")).repartition(3)
    want = brute([(r.doc_id, r.text) for r in many.collect()], [])
    assert rows_of(resample.resample(many, target)) == want
    assert rows_of(resample.resample(many, target, share=100, block_rows=2))  # every able row is drawn
    assert resample.resample(empty(spark), docs.select("text")).count() == 0


def test_radix_ranks_equal_sorted(spark):
    rnd = random.Random(5)
    big = [(rnd.choice([-(1 << 63), (1 << 63) - 1, 0, -5, 7, None]), rnd.randint(-3, 3), i) for i in range(300)]
    small = [(rnd.randint(-5000, 5000) if rnd.random() > 0.4 else 17, None if rnd.random() < 0.1 else rnd.randint(0, 4), i)
             for i in range(700)]
    for rows, size in ((big, 40), (small, 7), ([(1, 1, 0)], None), ([(None, None, i) for i in range(3)], 1)):
        df = cut(spark.createDataFrame(rows, "x BIGINT, y BIGINT, id BIGINT").repartition(4))
        got = resample.radix_ranked(df, [("x", True), ("y", False), ("id", False)], size).collect()
        want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2]))
        assert [(r.x, r.y, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    assert resample.radix_ranked(cut(df.limit(0)), [("x", True)]).count() == 0


def test_quality_on_held_out_rows(spark):
    got = zipquality.op13_compression_quality(spark, SF_MID)
    known = got.join(read(spark, SF_MID, "labels").where("quality is not null"), "doc_id").where("held_out").collect()
    assert len(known) > 60
    for label, least in ((1, 0.95), (0, 0.8)):
        mine = [r.predicted == label for r in known if r.quality == label]
        assert sum(mine) / len(mine) >= least, label
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.5) for r in got.collect())


def test_quality_score_is_the_stated_formula(spark):
    import zstandard

    docs, labels = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "labels")
    model = zipquality.fitted_model(docs, labels)
    rows = {r.doc_id: r for r in zipquality.quality(docs, labels).collect()}
    for r in docs.limit(40).collect():
        data, size = (r.text or "").encode(), {}
        for name in ("good", "bad"):
            d = zstandard.ZstdCompressionDict(getattr(model, name))
            d.precompute_compress(level=zipquality.LEVEL)
            c = zstandard.ZstdCompressor(level=zipquality.LEVEL, dict_data=d, write_checksum=False,
                                         write_content_size=False, write_dict_id=False)
            size[name] = sum(len(c.compress(data[i:i + 1024])) for i in range(0, len(data), 1024))
        n = len(data) + 50
        z = model.weights[0] * (size["bad"] - size["good"]) / n + model.weights[1] * 50 / n + model.weights[2]
        assert abs(rows[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_learns_no_held_out_label(spark):
    docs, labels = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 "
                                         "THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert zipquality.fitted_model(docs, labels) == zipquality.fitted_model(docs, turned)


def test_quality_edges(spark):
    docs = edges(spark)
    got = zipquality.quality(docs, read(spark, SF_SMALL, "labels")).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by_id.values()) and by_id[1] == by_id[2] and by_id[7] == by_id[8]
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert {r.score for r in zipquality.quality(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (7, 1)], "doc_id BIGINT, quality INT")
    assert len({r.score for r in zipquality.quality(docs, odd).collect()}) == 1
    assert zipquality.quality(empty(spark, SCHEMA), odd).count() == 0
