"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their scores come from the model file; the scores are used as log scores and
the path with the largest sum wins. On equal sums the path whose last piece starts
earlier is kept. A character that no single-character piece covers may be taken as
unknown (lowest score minus 10) and is written as its UTF-8 byte pieces (byte fallback).
Spaces become the mark U+2581 and one mark is put in front of the text; decoding joins
the pieces, turns byte pieces back into characters and marks back into spaces.

No piece holds a mark after another character, so the best path of a text is made of the
best paths of its pre-tokens (a run of marks and the characters up to the next one).
Those are found in batches: the trie is walked and the lattice is filled for all new
pre-tokens of an Arrow batch at once, and the results stay in a bounded worker cache.

Rules for special rows: null and empty texts have no pieces; repeated rows and rows with
a null doc_id are encoded like any other; extra columns are ignored; U+2581 in a text is
the mark itself and decodes to a space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read
from tidewatch.llm.tokencount import MARK, model_bytes, pretokens, splits_at_spaces

CACHE_ENTRIES = 400_000
LONGEST_CACHED = 48
CELLS = 1 << 20          # lattice cells that are filled at once
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """A double-array trie over the bytes of the pieces (a child of state s by byte c is at
    base[s] + c + 1, if check there is s) and what the ids stand for."""
    base: object
    check: object
    piece: object         # id of the piece that ends in a state, or -1
    score: object         # by id
    surface: list         # bytes by id; None for pieces without a surface
    byte_id: list         # id of each byte's piece
    longest: int
    unknown_score: float


def load_pieces(model: bytes) -> Pieces:
    """The pieces of a SentencePiece model file, with byte fallback."""
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    if not splits_at_spaces(sp):
        raise ValueError("a piece of this model spans a space")
    surface: list = [None] * n
    byte_id = [-1] * 256
    score = np.array([sp.get_score(i) for i in range(n)], dtype=np.float64)
    entries = {}
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
            surface[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            surface[i] = sp.id_to_piece(i).encode()
            entries[surface[i]] = i
    if -1 in byte_id:
        raise ValueError("the model has no byte fallback")
    base, check, piece = build_trie(entries)
    lowest = min(score[i] for i in entries.values())
    return Pieces(base, check, piece, score, surface, byte_id, max(map(len, entries)), lowest - UNKNOWN_PENALTY)


def build_trie(entries: dict[bytes, int]):
    """Double-array trie (base, check, piece) of the byte strings."""
    import numpy as np

    size = 8 * sum(map(len, entries)) + 4096
    base = np.zeros(size, dtype=np.int32)
    check = np.full(size, -1, dtype=np.int32)
    piece = np.full(size, -1, dtype=np.int32)
    check[0] = 0
    free, top = 1, 1  # first free place; first place behind all taken ones
    taken = bytearray(size)
    taken[0] = 1
    keys = sorted(entries)
    todo = [(0, 0, len(keys), 0)]  # state, range of keys below it, depth
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(keys[lo]) == depth:
            piece[state] = entries[keys[lo]]
            lo += 1
        children = []
        while lo < hi:
            c, start = keys[lo][depth], lo
            while lo < hi and keys[lo][depth] == c:
                lo += 1
            children.append((c, start, lo))
        if not children:
            continue
        while taken[free]:
            free += 1
        at = max(1, free - children[0][0] - 1)
        for _ in range(50):  # first fit near the first hole, else behind everything
            if not any(taken[at + c + 1] for c, _, _ in children):
                break
            at += 1
        else:
            at = max(1, top - children[0][0] - 1)
            while any(taken[at + c + 1] for c, _, _ in children):
                at += 1
        base[state] = at
        top = max(top, at + children[-1][0] + 2)
        for c, start, end in children:
            taken[at + c + 1] = 1
            check[at + c + 1] = state
            todo.append((at + c + 1, start, end, depth + 1))
    end = max(k for k, t in enumerate(taken) if t) + 258  # any byte of any state stays in range
    return base[:end], check[:end], piece[:end]


def best_paths(words: list[bytes], p: Pieces) -> list[list[int]]:
    """Ids of the best path of each UTF-8 string. Strings of like length share a lattice."""
    out: list = [None] * len(words)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        end, longest = at, 0
        while end < len(order):
            size = len(words[order[end]])
            if end > at and (end - at + 1) * (size + 1) > CELLS:
                break
            longest, end = size, end + 1
        for k, ids in zip(order[at:end], _lattice([words[k] for k in order[at:end]], longest, p)):
            out[k] = ids
        at = end
    return out


def _lattice(words: list[bytes], longest: int, p: Pieces) -> list[list[int]]:
    import numpy as np

    n = len(words)
    sizes = np.array([len(w) for w in words])
    text = np.frombuffer(b"".join(w.ljust(longest + 4, b"\x80") for w in words), dtype=np.uint8).reshape(n, longest + 4)
    text = np.ascontiguousarray(text.T)  # one row for each position
    starts = (text & 0xC0) != 0x80       # first bytes of characters; the padding is none
    best = np.full((longest + 1, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((longest + 1, n), dtype=np.int32)
    chosen = np.full((longest + 1, n), -1, dtype=np.int32)  # -1: unknown character
    for i in range(longest):
        live = np.nonzero(starts[i])[0]
        if not len(live):
            continue
        lead = text[i, live]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(live), dtype=bool)
        state, who, row = np.zeros(len(live), dtype=np.int32), live, np.arange(len(live))
        for d in range(1, min(p.longest, longest - i) + 1):
            to = p.base[state] + text[i + d - 1, who].astype(np.int32) + 1
            good = (p.check[to] == state) & (to > 0) & (i + d <= sizes[who])
            if not good.any():
                break
            state, who, row = to[good], who[good], row[good]
            ids = p.piece[state]
            ends = np.nonzero(ids >= 0)[0]
            if len(ends):
                w, found = who[ends], ids[ends]
                single[row[ends[width[row[ends]] == d]]] = True
                total = best[i, w] + p.score[found]
                up = total > best[i + d, w]
                best[i + d, w[up]] = total[up]
                back[i + d, w[up]] = i
                chosen[i + d, w[up]] = found[up]
        lone = ~single
        if lone.any():
            w, to = live[lone], i + width[lone]
            total = best[i, w] + p.unknown_score
            up = total > best[to, w]
            best[to[up], w[up]] = total[up]
            back[to[up], w[up]] = i
            chosen[to[up], w[up]] = -1
    paths: list[list[int]] = []
    for k, word in enumerate(words):
        ids, at = [], len(word)
        column_back, column_ids = back[:, k], chosen[:, k]
        while at > 0:
            start, found = int(column_back[at]), int(column_ids[at])
            if found >= 0:
                ids.append(found)
            else:
                ids += [p.byte_id[c] for c in reversed(word[start:at])]
            at = start
        paths.append(ids[::-1])
    return paths


class Encoder:
    """Worker-side encoder with a bounded cache of pre-tokens."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cache = pieces, {}

    def encode_batch(self, texts: list[str | None]):
        """Ids of the texts: (offsets, ids)."""
        import numpy as np

        split = [pretokens(t) for t in texts]
        fresh = dict.fromkeys(w for words in split for w in words if w not in self.cache)
        local = {}
        if fresh:
            marked = [(MARK + w.replace(" ", MARK)).encode("utf-8", "surrogatepass") for w in fresh]
            local = {w: np.array(ids, dtype=np.int32).tobytes()
                     for w, ids in zip(fresh, best_paths(marked, self.pieces))}
        if len(self.cache) + len(local) > CACHE_ENTRIES:
            local |= {w: self.cache[w] for words in split for w in words if w in self.cache}
            self.cache = {}
        known = self.cache
        parts, offsets, total = [], [0], 0
        for words in split:
            ids = b"".join([known[w] if w in known else local[w] for w in words])
            parts.append(ids)
            total += len(ids) // 4
            offsets.append(total)
        known.update((w, v) for w, v in local.items() if len(w) <= LONGEST_CACHED)
        return np.array(offsets, dtype=np.int64), np.frombuffer(b"".join(parts), dtype=np.int32)


def decode(ids, pieces: Pieces) -> str:
    """Text of the ids: byte pieces become characters (invalid bytes the replacement
    character), marks become spaces and the space in front is taken away."""
    raw = b"".join([s for s in map(pieces.surface.__getitem__, ids) if s is not None])
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def _worker_encoder(key: str, shipped) -> Encoder:
    if key not in _ENCODERS:  # kept while the worker is reused
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shipped.value)
    return _ENCODERS[key]


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pieces, piece_ids, round_trip (whether the decoded
    ids give the text back, with U+2581 read as a space)."""
    import uuid

    shipped = docs.sparkSession.sparkContext.broadcast(load_pieces(model_bytes(model_path)))
    key = uuid.uuid4().hex

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = _worker_encoder(key, shipped)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                offsets, ids = encoder.encode_batch(texts)
                plain = ids.tolist()
                same = [decode(plain[s:e], encoder.pieces) == (t or "").replace(MARK, " ")
                        for t, s, e in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(offsets), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                     pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "piece_ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode_column(spark: SparkSession, ids, model_path: str | None = None):
    """Column expression: the text of an array of ids (null for null)."""
    shipped = spark.sparkContext.broadcast(load_pieces(model_bytes(model_path)))

    @F.pandas_udf("string")
    def text(arrays):
        return arrays.map(lambda a: None if a is None else decode(a, shipped.value))

    return text(ids)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
