"""op11 against both libraries on whole texts, pair by pair; the perfect hash on its own."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.helpers import edges, empty
from tidewatch.llm import alignment
from tidewatch.llm.common import read
from tidewatch.llm.perfecthash import PerfectHash, build, shard_of

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def token_bytes(libraries):
    a, b = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in shown}
    alphabet |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
    return (lambda i: bytes(alphabet[c] for c in a.id_to_token(i))), piece


def brute(texts, libraries):
    a, b = libraries
    a_bytes, b_bytes = token_bytes(libraries)
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        spans = []
        for ids, f in ((x, a_bytes), (y, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(f(i))))
                at = out[-1][1]
            spans.append(out)
        data = (" " + t).encode()
        if b"".join(map(a_bytes, x)) != data or b"".join(map(b_bytes, y)) != data:
            docs.append(None)
            continue
        links, j = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while j and spans[1][j][0] > lo:
                j -= 1
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(y) and spans[1][k][0] < hi:
                links.append((x[i], y[k]))
                k += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for c in common:
            g, h = [], []
            while i < len(x) and spans[0][i][1] <= c:
                g.append(str(x[i]))
                i += 1
            while j < len(y) and spans[1][j][1] <= c:
                h.append(str(y[j]))
                j += 1
            groups.append(",".join(g) + "|" + ",".join(h))
        docs.append((len(x), len(y), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(p for d in docs if d for p in set(d[3]))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (*d[:3], len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), d[4]) for d in docs]


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64))
    shards = [build(keys[shard_of(keys, 5) == s]) for s in range(5)]
    h = PerfectHash(shards)
    got = h.numbers(keys)
    assert sorted(got.tolist()) == list(range(len(keys))) and (h.keys[got] == keys).all()
    assert (h.numbers(keys + np.uint64(1 << 41)) == -1).all()
    none = PerfectHash([build(keys[:0])] * 2)
    assert none.numbers(keys[:3]).tolist() == [-1, -1, -1]
    assert len(np.concatenate([w for _, w, _ in shards])) * 64 < 4 * len(keys) + 64 * 5 * 60


TRICKY = ["a", " a", "a ", "  a  b", "a\n\n b", "a \n b\t c", "it's  we'll 12,345.67%", "▁x", "x▁y", "<|endoftext|> z",
          "<s> </s> <0x41> <unk>", " x y 　 z", "é ​ ᠎ a ᠎b", "日本語 テスト 🙂🙂", "a\x00b \x1c c",
          "﻿x", "ab" * 3000, "\n", " ", "…—“”’s", "Ünïcödé ǅ ß ﬁ", "a\r\nb \r\n c", "ＡＢ １２", " x   y"]


def test_alignment_equals_the_libraries(spark, libraries):
    texts = [r.text for r in read(spark, SF_SMALL, "documents").orderBy("doc_id").collect()] + TRICKY * 2 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(5)
    want = brute(texts, libraries)
    for most in (alignment.MAX_PAIRS, 0):  # broadcast and joined
        rows = alignment.aligned_counts(docs, max_pairs=most).collect()
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}
        assert len(rows) == len(texts)
        for i, w in enumerate(want):
            assert got[i] == w, (most, texts[i] and texts[i][:60])


def test_alignment_does_not_depend_on_memory_and_trees(spark, monkeypatch):
    docs = read(spark, SF_SMALL, "documents").limit(60)
    docs = docs.union(docs).repartition(9)
    want = sorted(map(tuple, alignment.aligned_counts(docs).collect()))
    tok = alignment.Tokenizers(*alignment.model_files())
    monkeypatch.setattr(tok, "fast", None)
    words = ["the", "and,", "Straße", "x\ny", "12ab", "isn't"]
    with_library, together = tok.align(words), alignment.Tokenizers(*alignment.model_files()).align(words)
    pick = {w: t for w, t in zip(with_library.words, alignment.group_texts(with_library))}
    assert pick == {w: t for w, t in zip(together.words, alignment.group_texts(together))}
    for name, value in (("FAN_IN", 2), ("SHARDS", 3), ("SEGMENT", 512)):
        monkeypatch.setattr(alignment, name, value)
    assert sorted(map(tuple, alignment.aligned_counts(docs).collect())) == want


def test_alignment_edges(spark, libraries):
    docs = edges(spark)
    texts = [r.text for r in docs.collect()]
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.aligned_counts(docs).collect())
    assert got == Counter((r.doc_id, *w) for r, w in zip(docs.collect(), brute(texts, libraries)))
    assert alignment.aligned_counts(empty(spark)).count() == 0
    nothing = alignment.aligned_counts(docs.where("text is null or text = ''")).collect()
    assert len(nothing) == 2 and all(r.n_a == 0 and r.groups_sha256 == "" for r in nothing)
