"""op4, op5 and op7 against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import EDGES, classes, edges, empty
from tidewatch.llm import embeddings, passages, simhash
from tidewatch.llm.common import components


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, i) for i in range(1001, 1200)]
    loose = [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(150)]
    pairs = chain + star + loose + [(5, 5)]
    df = spark.createDataFrame(pairs, "a BIGINT, b BIGINT").repartition(5)
    got = {r.node: r.component for r in components(df).collect()}
    want = classes({x for p in pairs for x in p}, pairs)
    assert got == {k: want[k] for k in got}
    assert set(want) - set(got) <= {a for a, b in loose if a == b}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rnd = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"W{rnd.randint(0, 60)}" for _ in range(rnd.randint(1, 80))]
        texts += [" ".join(words), "\t".join(words).upper()]
        for _ in range(3):
            k = rnd.randrange(len(words))
            texts.append(" ".join(words[:k] + ["edit"] + words[k + 1:]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    for r in simhash.near_duplicates(df).collect():
        assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])


def test_simhash_full_buckets_lose_no_link(spark):
    rnd = random.Random(6)
    fps = {rnd.getrandbits(64) for _ in range(200)}
    for _ in range(4):  # many near copies of one text: chains of flips within the last 16 bits
        base = rnd.getrandbits(64)
        for _ in range(150):
            fps.add(base)
            base ^= sum(1 << rnd.randrange(16) for _ in range(rnd.choice([1, 2, 3])))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp BIGINT")
    ids = [s for s, in signed]
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    for bits in (0, 10_000):  # all by neighbours, all by pairs
        edges_found = [(r.a, r.b) for r in simhash.links(nodes, 2, bucket_rows=bits or 1).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges_found)
        assert classes(ids, edges_found) == want
    one = classes(ids, [(r.a, r.b) for r in simhash.links(nodes, 1, bucket_rows=3).collect()])
    assert one == classes(ids, [(a, b) for a in ids for b in ids if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 1])


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(edges(spark)).collect()
    assert len(rows) == len(EDGES)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == "0" * 16 and {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[4].component_id == by_id[5].component_id == 4 and by_id[7].component_id == by_id[8].component_id == 7
    assert by_id[None].component_id is None
    assert simhash.near_duplicates(empty(spark)).count() == 0


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def slow_links(rows, threshold=0.98):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, label in rows
          if label is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    label = {i: x for i, _, x in rows}
    out = []
    for p, (i, x) in enumerate(ok):
        for j, y in ok[:p]:
            if label[i] == label[j] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                out.append((j, i))
    return out


def test_embeddings_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rnd = np.random.default_rng(8)
    rows = []
    for g in range(30):
        base = rnd.normal(size=32)
        for _ in range(int(rnd.integers(1, 40))):
            v = (base + rnd.normal(size=32) * rnd.choice([0.0, 0.05, 0.1])) * rnd.choice([1.0, 3.0])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(g % 3)))
    found = embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    pairs = slow_links(rows)
    n = {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    got = {r.vec_id: r for r in found}
    assert all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in found) >= 0.95 * sum(n.values())
    want = classes(n, pairs)
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in n)


def test_embeddings_match_sql(spark):
    import duckdb

    from scripts.check_oracle import rows_of
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rnd.normal(size=16) * 0.01 * (i % 4)], i % 2) for i in range(90)]
    df = spark.createDataFrame([*rows, (90, None, 1), (91, [0.0] * 16, 1), (92, rows[0][1], None)], VECTORS)
    got = embeddings.near_duplicates(df).toPandas()
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert rows_of(got) == rows_of(con.execute(embeddings.ORACLE_SQL).df())


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 2.0], 1),
            (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [2.0, 4.0, 6.0], 1), (11, [], 1), (12, [1.0, 2.0], 1),
            (13, [0.0] * 3, 1)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {
        (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 3, 1),
        (11, 0, 11), (12, 0, 12), (13, 0, 13)}
    assert embeddings.near_duplicates(empty(spark, VECTORS)).count() == 0


def planted(seed=9):
    """Texts of random words; some hold one of a few passages, verbatim or slightly edited."""
    rnd = random.Random(seed)

    def text(n):
        return [f"w{rnd.randint(0, 5000)}" for _ in range(n)]

    shared = [text(60) for _ in range(4)]
    docs, holds = [], {}
    for i in range(120):
        words = text(rnd.randint(60, 200))
        if i % 3 == 0:
            g = (i // 3) % 4
            piece = list(shared[g])
            if i % 2:
                piece[rnd.randrange(60)] = "edited"
            at = rnd.randrange(len(words))
            words[at:at] = piece
            holds[i] = g
        docs.append((i, " ".join(words)))
    return docs, holds


def test_passages_are_found_and_clean_documents_left_alone(spark, monkeypatch):
    monkeypatch.setattr(passages, "TASK_TOKENS", 3_000)
    docs, holds = planted()
    out = {r.doc_id: r for r in passages.dedup(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()}
    first = {g: min(i for i in holds if holds[i] == g) for g in set(holds.values())}
    for i, _ in docs:
        if i in holds:
            assert out[i].class_id == first[holds[i]] and out[i].n_links > 0 and 50 <= out[i].n_words <= 66
        else:
            assert out[i].class_id == i and out[i].n_links == 0 and out[i].passages == ""


def test_short_repeats_are_no_passages(spark):
    rnd = random.Random(3)
    line = " ".join(f"l{i}" for i in range(35))
    docs = [(i, " ".join([*(f"u{rnd.randint(0, 10**6)}" for _ in range(80)), line, *(f"v{rnd.randint(0, 10**6)}" for _ in range(80))]))
            for i in range(40)]
    out = passages.dedup(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()
    assert all(r.n_links == 0 for r in out)


def test_windows_are_the_nodes_of_the_cartesian_tree():
    rnd = random.Random(5)
    texts = [[rnd.randint(0, 30) for _ in range(rnd.randint(1, 40))] for _ in range(30)]
    tokens = np.array([x for t in texts for x in t], dtype=np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    value = passages.mixed(tokens * np.uint64(7) + np.uint64(3 * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(32)
    for t in (1, 4, 9):
        got = {tuple(x) for x in passages.compact_windows(tokens, ends, owner, t, 3).T.tolist()}
        want = set()
        for e, text in zip(ends.tolist(), texts):
            todo = [(e - len(text), e - 1)]
            while todo:
                lo, hi = todo.pop()
                if hi - lo + 1 < t:
                    continue
                c = lo + int(np.argmin(value[lo:hi + 1]))
                want.add((lo, c, hi))
                todo += [(lo, c - 1), (c + 1, hi)]
        assert got == want


def test_passage_edges(spark):
    rows = passages.dedup(edges(spark)).collect()
    assert len(rows) == len(EDGES)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].class_id == by_id[8].class_id == 7 and by_id[8].n_words == 60_000
    assert by_id[5].class_id == 5 and by_id[None].class_id is None and by_id[1].n_links == 0
    assert passages.dedup(empty(spark)).count() == 0


def one_edit_copies(n=100):
    """A passage in a document of middling doc_id, and ``n`` copies with one other word edited."""
    rnd = random.Random(11)
    passage = [f"p{k}" for k in range(50)]
    docs = []
    for i in range(n + 1):
        words = list(passage)
        if i != n // 2:
            words[4 + i % 42] = f"edit{i}"
        docs.append((i, " ".join([*(f"u{rnd.randint(0, 10**9)}" for _ in range(70)), *words,
                                  *(f"v{rnd.randint(0, 10**9)}" for _ in range(70))])))
    return docs


def brute_links(docs, first=70, words=50):
    """Pairs whose passages (words from ``first`` on) reach a Jaccard similarity of 0.8."""
    sets = {}
    for i, text in docs:
        w = text.split()[first:first + words]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    return [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_passages_of_a_full_key_are_compared_all_with_all(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 16)
    docs = one_edit_copies()
    pairs = brute_links(docs)
    want = classes([i for i, _ in docs], pairs)
    n = {i: sum(i in p for p in pairs) for i, _ in docs}
    assert n[50] == 100 and set(want.values()) == {0}
    out = {r.doc_id: r for r in passages.dedup(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()}
    assert {i: out[i].class_id for i in want} == want
    assert {i: out[i].n_links for i in n} == n


def test_passages_do_not_depend_on_the_layout(spark, monkeypatch):
    docs = one_edit_copies(60) + [(100 + i, text) for i, (_, text) in enumerate(planted()[0][:60])]
    docs += [(200 + i, docs[i][1]) for i in range(0, 60, 7)]  # exact copies
    want = None
    for parts, tokens in ((1, 1 << 20), (7, 1_000), (3, 300)):
        monkeypatch.setattr(passages, "TASK_TOKENS", tokens)
        random.Random(parts).shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(parts, "text")
        got = sorted(map(tuple, passages.dedup(df).collect()))
        want = want or got
        assert got == want
    by_id = {r[0]: r for r in want}
    assert by_id[30][2] == 60 + sum(1 for i in range(0, 60, 7))


def test_every_passage_of_a_pair_is_reported(spark):
    def words(c, n):
        return [f"{c}{k}" for k in range(n)]

    one, two = words("one", 60), words("two", 60)
    edited = [*two[:30], "edited", *two[31:]]
    docs = [(1, " ".join([*one, *words("a", 60), *two])), (2, " ".join([*one, *words("b", 60), *edited]))]
    out = {r.doc_id: r for r in passages.dedup(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()}
    assert [(r.class_id, r.n_links, r.n_words, r.passages) for r in (out[1], out[2])] == [(1, 1, 120, "0:59,120:179")] * 2
    x, y = (passages.tokens_of(t) for _, t in docs)
    spans = passages.verified_passages(x, y, 46, 0.8)
    assert sorted(spans) == [((0, 55), (0, 55)), ((120, 175), (120, 175))]


def test_embeddings_of_one_id_with_several_vectors(spark):
    from tidewatch.llm import embeddings

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 1), (1, b, 2), (1, c, 1), (2, a, 1), (3, b, 2), (2, [1.0, 0.01, 0.0], 1), (None, a, 1)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    for name in ("rep", "m", "v", "valid", "links", "component", "node", "root"):
        df = df.withColumn(name, F.lit("x"))  # clashing names
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=repr)
    want = [(1, 2, 1, True), (1, 1, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False),
            (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_compared_pairs_equal_the_pair_by_pair_form():
    rnd = random.Random(4)

    def words(n):
        return [rnd.randint(0, 10**9) for _ in range(n)]

    tokens = []
    for _ in range(40):
        base = words(rnd.randint(46, 93))
        tokens.append(base)
        for _ in range(4):
            t = list(base)
            for _ in range(rnd.randint(0, 12)):
                t[rnd.randrange(len(t))] = rnd.randint(0, 10**9)
            if rnd.random() < 0.4:
                at = rnd.randrange(len(t))
                t[at:at] = words(rnd.randint(1, 20))
            if rnd.random() < 0.5:
                t[3:6] = t[10:13]  # repeated shingles
            if rnd.random() < 0.5:
                k = rnd.randrange(40)
                t = words(k) + t
            tokens.append(t[:93])
    tokens = [np.array(t, dtype=np.uint32) for t in tokens]
    x, y = np.array([(5 * g + i, 5 * g + j) for g in range(40) for i in range(5) for j in range(i + 1, 5)]).T
    matched = 46 * 8 / 9 - 1e-9
    got = sorted(zip(*(c.tolist() for c in passages.compared(tokens, x, y, 46, 0.8, matched))))
    want = []
    for a, b in zip(x.tolist(), y.tolist()):
        u, v = tokens[a], tokens[b]
        p, q = np.flatnonzero(np.isin(u, v)), np.flatnonzero(np.isin(v, u))
        if min(len(p), len(q)) < matched:
            continue
        common, both = len(np.intersect1d(u, v)), len(np.union1d(u, v))
        spans = [((p[0], p[-1]), (q[0], q[-1]))] if common >= 0.8 * both else passages.verified_passages(u, v, 46, 0.8)
        want += [(a, b, *map(int, one), *map(int, two)) for one, two in spans]
    assert len(want) > 100 and got == sorted(want)


def test_rarest_shared_min_hash_is_indexed_on_both_sides():
    rnd = np.random.default_rng(2)
    keys = rnd.integers(0, 40, (6, 400)).astype(np.uint64) + 100 * np.arange(6, dtype=np.uint64)[:, None]
    counts = (passages.mixed(keys) % np.uint64(50)).astype(np.int64)
    kept = passages.rare_first(keys, counts, 3)
    assert kept.sum(axis=0).min() >= 4
    for a in range(400):
        same = keys == keys[:, [a]]
        both = same & kept & kept[:, [a]]
        assert both.any(axis=0)[same.sum(axis=0) >= 3].all()
