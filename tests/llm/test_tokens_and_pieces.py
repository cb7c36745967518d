"""op3 against the library, op6 against Viterbi by hand and round trips."""

import random

import pytest
import sentencepiece

from tests.conftest import SF_SMALL
from tests.llm.helpers import EDGES, edges, empty
from tidewatch.llm import pieces, tokencount

ODD = ["", " ", "  ", " a", "a ", "a  b", "  lead", "tail   ", "x\n\ny\tz", "a▁b", "▁", "<s> </s> <unk>",
       "日本語 テスト", "\U0001f600① ﬁ", "nul\x00byte", "=" * 200, "word" * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=tokencount.model_bytes())


def test_counts_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), len(library.encode(r.text))) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.token_counts(docs).collect()}
    assert got == want


def test_counts_of_odd_texts_with_a_small_cache(spark, library, monkeypatch):
    monkeypatch.setattr(tokencount, "WORKER_ENTRIES", 5)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id BIGINT, text STRING").coalesce(1)
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in tokencount.token_counts(df, limit=3).collect()}
    assert got == {i: (len(library.encode(t)), len(library.encode(t)) > 3) for i, t in enumerate(ODD)}


def test_count_edges(spark, library):
    rows = tokencount.token_counts(edges(spark)).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted(
        (len((t or "").encode()), len(library.encode(t or ""))) for _, t, *_ in EDGES)
    assert tokencount.token_counts(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.load_pieces(tokencount.model_bytes())


def by_hand(text, model):
    """Unigram Viterbi over a dictionary of pieces, one character at a time."""
    known = {bytes(s).decode(): i for i, s in enumerate(model.surface) if s is not None and i not in model.byte_id}
    s = "▁" + text.replace(" ", "▁") if text else ""
    best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 16) + 1):
            k = known.get(s[i:j])
            if k is not None and best[i] + model.score[k] > best[j]:
                best[j], back[j] = best[i] + model.score[k], (i, [k])
        if s[i] not in known and best[i] + model.unknown_score > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + model.unknown_score, (i, [model.byte_id[c] for c in s[i].encode()])
    out, at = [], len(s)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_encoding_equals_viterbi_by_hand(model):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choices("abeinrst  éß中\U0001f600\n.", k=rnd.randint(1, 60))) for _ in range(150)]
    offsets, ids = pieces.Encoder(model).encode_batch(texts)
    for t, s, e in zip(texts, offsets, offsets[1:]):
        assert ids[s:e].tolist() == by_hand(t, model), t
        assert pieces.decode(ids[s:e].tolist(), model) == t.replace("▁", " ")


def test_encoding_equals_the_library_in_unigram_mode(model):
    """The same pieces read by the library as a unigram model (model_type 1 of its file), on
    texts of known characters and single spaces (its single precision scores tie now and then)."""
    raw = tokencount.model_bytes()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    uni = sentencepiece.SentencePieceProcessor(model_proto=raw[:at + 9] + b"\x01" + raw[at + 10:])
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choices("aeioubcdnrst", k=rnd.randint(1, 12))) for _ in range(20)) for _ in range(100)]
    offsets, ids = pieces.Encoder(model).encode_batch(texts)
    same = sum(ids[s:e].tolist() == uni.encode(t) for t, s, e in zip(texts, offsets, offsets[1:]))
    assert same >= 0.95 * len(texts)


def test_a_full_cache_and_long_words_change_nothing(model, monkeypatch):
    texts = ODD * 2
    want = pieces.Encoder(model).encode_batch(texts)[1].tolist()
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 2)
    monkeypatch.setattr(pieces, "CELLS", 64)
    encoder = pieces.Encoder(model)
    assert [i for t in texts for i in encoder.encode_batch([t])[1].tolist()] == want


def test_piece_edges(spark, model):
    rows = pieces.encode(edges(spark)).collect()
    assert len(rows) == len(EDGES) and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows}[1] == 0 and {r.doc_id: list(r.piece_ids) for r in rows}[2] == []
    assert pieces.encode(empty(spark)).count() == 0
    back = pieces.encode(edges(spark)).select(pieces.decode_column(spark, "piece_ids").alias("t")).collect()
    assert sorted(r.t for r in back) == sorted((t or "").replace("▁", " ") for _, t, *_ in EDGES)


def test_invalid_byte_pieces_decode_to_the_replacement_character(model):
    assert pieces.decode([model.byte_id[0xE9]], model) == "�"
