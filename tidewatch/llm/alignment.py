"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

A text is encoded by a byte-level BPE (A, over a space and the text) and a piece model (B, over
the text, which gets a space from the model), so both cut the same bytes. A token of A and one
of B are linked where their byte ranges overlap; byte offsets at which both end cut the tokens
into groups. The count of an id pair is the number of documents that hold it linked.

1. First pass: every task gathers the pairs of its documents in a sorted table of counts.
2. The distinct pairs get numbers by minimal perfect hashing, shard by shard; the tables
   become dense vectors of counts by number, which are summed in a tree of bounded groups.
3. Second pass: the documents are aligned again, their pairs looked up by number (the stored
   key must agree) and the counts summed.

The numbers, keys and counts are broadcast, 16 bytes and a few bits a pair, after a count of
the pairs: beyond ``max_pairs`` the pairs are joined with their counts instead.

Neither tokenizer joins a character with a space that follows it, so a text is cut at single
spaces between other characters and equal words are aligned once while a worker remembers them.

Rules for special rows: a text that is null or empty, or that the tokens do not spell byte by
byte, has no tokens: zeros and an empty digest; repeated rows are documents of their own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, read
from tidewatch.llm.perfecthash import PerfectHash, build, shard_of

MAX_PAIRS = 4_000_000      # pairs that are broadcast: 64 MB of keys and counts
SHARDS = 32                # of the perfect hash
FAN_IN = 16                # tables or vectors that one task of a tree sums
SEGMENT = 1 << 16          # counts of a piece of a dense vector
TABLE_PAIRS = 1 << 20      # gathered pairs after which a task sorts them into its table
TOGETHER = 1 << 20         # characters that are aligned together
REMEMBERED = 250_000       # words of a generation of a worker's memory
LONGEST_REMEMBERED = 48
SALTS = 16

# Fixed value: the pattern by which the byte-level model splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
# Characters on whose classes all Unicode versions agree; other words go to the library one by one.
UNUSUAL = re.compile("[^\t\n\x20-\x7e¡-ɏ]")
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the entries of a byte-level vocabulary: a printable
    Latin-1 character for itself, the others from U+0100 on in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def model_files(a_path: str | None = None, b_path: str | None = None) -> tuple[str, bytes]:
    """The vocabulary of A (JSON) and the model of B; paths are parameters."""
    import public_tokenizers
    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return a, f.read()


@dataclass
class Aligned:
    """Aligned words, as flat arrays and the end of each word in them."""
    words: list
    a: object
    b: object
    a_end: object
    b_end: object
    pairs: object             # key of every link
    pair_end: object
    groups: list              # (end in a, end in b) of every group
    group_end: object


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        import os

        import numpy as np
        import sentencepiece
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(a_json)
        self.library.encode_special_tokens = True  # their strings are plain text
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec, alphabet = json.loads(a_json), byte_alphabet()
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = {v: bytes(alphabet[c] for c in k) for k, v in spec["model"]["vocab"].items() if v not in special}
        self.a_size, self.b_size = self.library.get_vocab_size(), self.sp.get_piece_size()
        self.a_bytes = [vocab.get(i, b"") for i in range(self.a_size)]
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b_size)]
        self.a_len = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_len = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        before = spec["pre_tokenizer"] or {}
        by_space = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
                    and all(MARK not in self.sp.id_to_piece(i).lstrip(MARK) for i in range(self.b_size)))
        self.cuts = bool(by_space and not before.get("add_prefix_space"))
        # where entry 256 + k is what merge k makes, ranks give the library's own merges, faster
        made = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ranked = all(spec["model"]["vocab"].get(m) == 256 + k for k, m in enumerate(made))
        self.fast = tiktoken.Encoding("vocabulary of A", pat_str=SPLIT, special_tokens={}, mergeable_ranks={
            v: k for k, v in vocab.items()}) if self.cuts and ranked and len(vocab) == 256 + len(made) else None

    def piece_bytes(self, i: int) -> bytes:
        piece = self.sp.id_to_piece(i)
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.sp.is_control(i) or self.sp.is_unknown(i):
            return b""
        return piece.replace(MARK, " ").encode("utf-8")

    def encode_together(self, words: list[str]):
        """(a ids, tokens of A per word, b ids, tokens of B per word) of words without white space
        at their ends, or None where the tokens do not spell them."""
        import numpy as np

        text = " " + " ".join(words)
        stops = np.cumsum([len(w.encode("utf-8")) + 1 for w in words])
        few = [" ".join(words[i:i + 64]) for i in range(0, len(words), 64)]
        a = np.array(self.fast.encode_ordinary(text), dtype=np.int64)
        b = np.array([i for ids in self.sp.encode(few, num_threads=1) for i in ids], dtype=np.int64)
        spelled = text.encode("utf-8")
        out = []
        for ids, table, lengths in ((a, self.a_bytes, self.a_len), (b, self.b_bytes, self.b_len)):
            if b"".join(map(table.__getitem__, ids.tolist())) != spelled:
                return None
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, stops)
            if not np.array_equal(ends[at], stops):
                return None
            out += [ids, np.diff(np.concatenate([[0], at + 1]))]
        return out

    def encode_apart(self, words: list[str]):
        """(words that their tokens spell, and the same four arrays for them)."""
        import numpy as np

        a_ids = [e.ids for e in self.library.encode_batch([" " + w for w in words], add_special_tokens=False)]
        good, a, b = [], [], []
        for w, x, y in zip(words, a_ids, self.sp.encode(words, num_threads=1)):
            data = (" " + w).encode("utf-8", "surrogatepass")
            if b"".join(map(self.a_bytes.__getitem__, x)) == data == b"".join(map(self.b_bytes.__getitem__, y)):
                good.append(w)
                a.append(x)
                b.append(y)
        flat = [np.array([i for ids in side for i in ids], dtype=np.int64) for side in (a, b)]
        per_word = [np.array(list(map(len, side)), dtype=np.int64) for side in (a, b)]
        return good, [flat[0], per_word[0], flat[1], per_word[1]]

    def align(self, words: list[str]) -> Aligned:
        """Alignment of the words that their tokens spell (the others are left out)."""
        import numpy as np

        usual = [w for w in words if self.fast and w and not UNUSUAL.search(w) and w == w.strip()]
        sides = self.encode_together(usual) if usual else None
        if sides is None:
            usual, sides = [], [np.zeros(0, dtype=np.int64)] * 4
        seen = set(usual)
        apart = [w for w in words if w not in seen]
        if apart:
            good, more = self.encode_apart(apart)
            usual, sides = usual + good, [np.concatenate(x) for x in zip(sides, more)]
        a, a_n, b, b_n = sides
        a_end, b_end = np.cumsum(a_n), np.cumsum(b_n)
        a_stop, b_stop = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])  # byte offsets
        stops = np.union1d(a_stop, b_stop)
        common = np.intersect1d(a_stop, b_stop, assume_unique=True)
        pairs = a[np.searchsorted(a_stop, stops)] * self.b_size + b[np.searchsorted(b_stop, stops)]
        word_stop = a_stop[a_end - 1] if len(a) else a_stop
        groups = zip((np.searchsorted(a_stop, common) + 1).tolist(), (np.searchsorted(b_stop, common) + 1).tolist())
        return Aligned(usual, a, b, a_end, b_end, pairs.astype(np.uint64), np.searchsorted(stops, word_stop) + 1,
                       list(groups), np.searchsorted(common, word_stop) + 1)


def group_texts(x: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every word."""
    a, b = list(map(str, x.a.tolist())), list(map(str, x.b.tolist()))
    parts, i, j = [], 0, 0
    for to_i, to_j in x.groups:
        parts.append(f"{','.join(a[i:to_i])}|{','.join(b[j:to_j])}")
        i, j = to_i, to_j
    out, at = [], 0
    for end in x.group_end.tolist():
        out.append(";".join(parts[at:end]))
        at = end
    return out


class Memory:
    """Words and what ``value(aligned words)`` says of them, in two generations."""

    def __init__(self, tokenizers: Tokenizers, value):
        self.tokenizers, self.value = tokenizers, value
        self.new, self.old = {}, {}

    def texts(self, texts: list[str | None]):
        """For each text the values of its words; None where it has no tokens."""
        lists = [((t.split(" ") if self.tokenizers.cuts else [t]) if t else []) for t in texts]
        missing = set().union(*lists) - self.new.keys()
        odd = {w for w in missing if not w or w[0].isspace() or w[-1].isspace()}  # never remembered
        if odd and self.tokenizers.cuts:
            for k, words in enumerate(lists):
                if not odd.isdisjoint(words):
                    lists[k] = BETWEEN.split(texts[k])
            missing = set().union(*lists) - self.new.keys()
        known = missing & self.old.keys()
        self.new.update((w, self.old[w]) for w in known)
        fresh = sorted(missing - known)
        if fresh:
            x = self.tokenizers.align(fresh)
            self.new.update(zip(x.words, self.value(x)))
        out = []
        for words in lists:
            values = list(map(self.new.get, words))
            out.append(None if not values or None in values else values)
        for w in fresh:
            if len(w) > LONGEST_REMEMBERED or not w or w[0].isspace() or w[-1].isspace():
                self.new.pop(w, None)
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return out


def portions(texts: list[str | None]):
    """Runs of texts of about ``TOGETHER`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER or k + 1 == len(texts):
            yield texts[at:k + 1]
            at, size = k + 1, 0


_WORKER: dict[int, Tokenizers] = {}


def worker_tokenizers(files: tuple[str, bytes]) -> Tokenizers:
    key = hash(files)
    if key not in _WORKER:  # kept while the worker is reused
        _WORKER.clear()
        _WORKER[key] = Tokenizers(*files)
    return _WORKER[key]


_MEMORY: dict[str, Memory] = {}


def worker_memory(key: str, files: tuple[str, bytes], value) -> Memory:
    """The memory of a pass over the documents, kept from task to task of a worker."""
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = Memory(worker_tokenizers(files), value)
    return _MEMORY[key]


def word_pairs(x: Aligned) -> list[bytes]:
    """The link keys of every word, as bytes."""
    data, ends = x.pairs.tobytes(), (x.pair_end * 8).tolist()
    return [data[i:j] for i, j in zip([0, *ends], ends)]


def summed(keys, counts):
    """Sorted distinct keys and the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else []
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def pair_tables(docs: DataFrame, files, text_col: str) -> DataFrame:
    """(keys, counts) as bytes: the linked pairs of each task's documents and in how many of
    them they are. A table has at most ``TABLE_PAIRS`` new pairs; a task may return several."""
    shipped, key = docs.sparkSession.sparkContext.broadcast(files), uuid.uuid4().hex

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memory = worker_memory(key, shipped.value, word_pairs)
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held, size = [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, counts)],
                                              ["keys", "counts"])

        for b in batches:
            for texts in portions(b.column(0).to_pylist()):
                for values in memory.texts(texts):
                    if values is None:
                        continue
                    mine = np.unique(np.frombuffer(b"".join(set(values)), dtype=np.uint64))
                    held.append(mine)
                    size += len(mine)
                    if size >= TABLE_PAIRS:
                        new, n = np.unique(np.concatenate(held), return_counts=True)
                        keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, n]))
                        held, size = [], 0
                        if len(keys) >= TABLE_PAIRS:
                            yield row()
                            keys, counts = keys[:0], counts[:0]
        if held:
            new, n = np.unique(np.concatenate(held), return_counts=True)
            keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, n]))
        if len(keys):
            yield row()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "keys binary, counts binary")


def tree(rows: DataFrame, parts: int, merge) -> DataFrame:
    """Rows (slot int, part int, data binary) brought down to one row a slot: groups of
    ``FAN_IN`` parts are merged until one is left."""
    def run(table):
        import pyarrow as pa

        slot, part = table.column("slot")[0].as_py(), table.column("part")[0].as_py()
        data = merge([d.as_py() for d in table.column("data")])
        return pa.table({"slot": pa.array([slot], pa.int32()), "part": pa.array([part // FAN_IN], pa.int32()),
                         "data": pa.array([data], pa.binary())})

    while True:
        grouped = rows.groupBy("slot", F.expr(f"part div {FAN_IN}").alias("__group"))
        rows = grouped.applyInArrow(run, "slot int, part int, data binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return rows


def merge_keys(parts: list[bytes]) -> bytes:
    import numpy as np
    return np.unique(np.frombuffer(b"".join(parts), dtype=np.uint64)).tobytes()


def merge_counts(parts: list[bytes]) -> bytes:
    import numpy as np
    total = np.frombuffer(parts[0], dtype=np.int64).copy()
    for p in parts[1:]:
        total += np.frombuffer(p, dtype=np.int64)
    return total.tobytes()


def sharded_keys(tables: DataFrame, parts: int) -> DataFrame:
    """(slot, data): the distinct keys of every shard."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            for data in b.column(0):
                keys = np.frombuffer(data.as_py(), dtype=np.uint64)
                shard = shard_of(keys, SHARDS)
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(SHARDS + 1))
                chunks = [keys[order[i:j]].tobytes() for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(SHARDS), pa.int32()), pa.array([part] * SHARDS, pa.int32()),
                     pa.array(chunks, pa.binary())], ["slot", "part", "data"])

    return tree(tables.select("keys").mapInArrow(run, "slot int, part int, data binary"), parts, merge_keys)


def hashed_shards(keys: DataFrame) -> DataFrame:
    """(slot, n, sizes, words, keys): what ``perfecthash.build`` makes of every shard."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for slot, data in zip(b.column(0), b.column(1)):
                sizes, words, ordered = build(np.frombuffer(data.as_py(), dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot.as_py()], pa.int32()), pa.array([len(ordered)], pa.int64()),
                     pa.array([sizes], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()),
                     pa.array([ordered.tobytes()], pa.binary())], ["slot", "n", "sizes", "words", "keys"])

    return keys.select("slot", "data").mapInArrow(
        run, "slot int, n long, sizes array<long>, words binary, keys binary")


def dense_counts(tables: DataFrame, parts: int, shards: list):
    """Counts by number: every task turns its tables into one dense vector, the vectors are
    summed piece by piece in a tree."""
    import numpy as np

    hashed = PerfectHash(shards)
    n = len(hashed.keys)
    shipped = tables.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        hashed, dense = PerfectHash(shipped.value), np.zeros(n, dtype=np.int64)
        for b in batches:
            for keys, counts in zip(b.column(0), b.column(1)):
                at = hashed.numbers(np.frombuffer(keys.as_py(), dtype=np.uint64))
                dense[at] += np.frombuffer(counts.as_py(), dtype=np.int64)  # keys of a table are distinct
        part, slots = TaskContext.get().partitionId(), range(-(-n // SEGMENT))
        for s in slots:
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([dense[s * SEGMENT:(s + 1) * SEGMENT].tobytes()], pa.binary())], ["slot", "part", "data"])

    vectors = tables.mapInArrow(run, "slot int, part int, data binary")
    rows = tree(vectors, parts, merge_counts).collect()  # 8 bytes a pair, at most max_pairs
    return hashed, np.frombuffer(b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.slot)), dtype=np.int64)


OUT = ["n_a", "n_b", "n_groups", "n_links"]
SCHEMA = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def word_numbers(x: Aligned, extra):
    """(numbers as bytes, groups as text) of every word: tokens, groups, links and ``extra``."""
    import numpy as np

    ends = (x.a_end, x.b_end, x.group_end, x.pair_end)
    columns = [np.diff(np.concatenate([[0], e])) for e in ends]
    numbers = np.column_stack([*columns, *extra]).astype(np.int64)
    data, width = numbers.tobytes(), 8 * numbers.shape[1]
    return zip([data[i:i + width] for i in range(0, len(data), width)], group_texts(x))


def digested(values, width: int):
    """Sums of the words' numbers and the digest of their groups."""
    import hashlib

    import numpy as np

    if values is None:
        return [0] * width, ""
    numbers, texts = zip(*values)
    return (np.frombuffer(b"".join(numbers), dtype=np.int64).reshape(-1, width).sum(axis=0).tolist(),
            hashlib.sha256(";".join(texts).encode("ascii")).hexdigest())


def looked_up(docs: DataFrame, files, hashed: PerfectHash, counts, text_col: str) -> DataFrame:
    """Second pass with broadcast numbers, keys and counts."""
    import numpy as np

    b_size = Tokenizers(*files).b_size
    a_of = (hashed.keys // np.uint64(b_size)).astype(np.int64)
    best = np.zeros(int(a_of.max()) + 1 if len(a_of) else 0, dtype=np.int64)
    np.maximum.at(best, a_of, counts)
    shipped, key = docs.sparkSession.sparkContext.broadcast((files, hashed, counts, best)), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        files, hashed, counts, best = shipped.value

        def value(x: Aligned):
            if not x.words:
                return []
            at = hashed.numbers(x.pairs)  # -1: in no document but such that count as without tokens
            known = at >= 0
            n = np.zeros(len(at), dtype=np.int64)
            n[known] = counts[at[known]]
            top = np.zeros(len(at), dtype=np.int64)
            top[known] = n[known] == best[(x.pairs[known] // np.uint64(b_size)).astype(np.int64)]
            first = np.concatenate([[0], x.pair_end[:-1]])
            return word_numbers(x, [np.add.reduceat(top, first), np.add.reduceat(n, first)])

        memory = worker_memory(key, files, value)
        for b in batches:
            rows = [digested(v, 6) for texts in portions(b.column(1).to_pylist()) for v in memory.texts(texts)]
            columns = list(zip(*(r[0] for r in rows))) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([r[1] for r in rows], pa.string())],
                ["doc_id", *OUT, "n_best", "count_sum", "groups_sha256"])

    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(
        run, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def joined_up(docs: DataFrame, files, tables: DataFrame, text_col: str) -> DataFrame:
    """Second pass for more pairs than may be broadcast: the distinct pairs of each document are
    joined with their counts. Frequent pairs are spread over ``SALTS`` keys."""
    shipped = docs.sparkSession.sparkContext.broadcast(files)
    b_size = Tokenizers(*files).b_size

    def explode_table(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for keys, counts in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(keys.as_py(), dtype=np.uint64).astype(np.int64)),
                     pa.array(np.frombuffer(counts.as_py(), dtype=np.int64))], ["pair", "n"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memory = Memory(worker_tokenizers(shipped.value),
                        lambda x: zip(word_numbers(x, []), word_pairs(x)) if x.words else [])
        for b in batches:
            rows, pairs, times = [], [], []
            for texts in portions(b.column(1).to_pylist()):
                for v in memory.texts(texts):
                    rows.append(digested(v and [n for n, _ in v], 4))
                    keys, n = np.unique(np.frombuffer(b"".join(p for _, p in v or ()), dtype=np.uint64), return_counts=True)
                    pairs.append(keys.astype(np.int64))
                    times.append(n)
            columns = list(zip(*(r[0] for r in rows))) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([r[1] for r in rows], pa.string()),
                 pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", *OUT, "groups_sha256", "pairs", "times"])

    counts = cut(tables.mapInArrow(explode_table, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    best = counts.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("n").alias("best"))
    judged = (counts.withColumn("a", F.expr(f"pair div {b_size}")).join(F.broadcast(best), "a")  # at most the ids of A
              .select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top"),
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = cut(docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    links = (held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
             .select("row", "p.*").withColumnsRenamed({"pairs": "pair"})
             .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")))
    sums = links.join(judged, ["pair", "salt"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("top")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return held.join(sums, "row", "left").select(
        "doc_id", *OUT, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256")


def aligned_counts(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
                   max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links
    whose pair has the highest count of its A id), count_sum (over links), groups_sha256."""
    files = model_files(a_path, b_path)
    tables = cut(pair_tables(docs, files, text_col))
    parts = max(1, tables.rdd.getNumPartitions())
    shards = cut(hashed_shards(sharded_keys(tables, parts)))
    total = shards.agg(F.sum("n")).first()[0] or 0
    if total > max_pairs:
        return joined_up(docs, files, tables, text_col)
    by_slot = {r.slot: r for r in shards.collect()}  # 8 bytes and a few bits a pair, at most max_pairs
    built = [unpacked(by_slot.get(s)) for s in range(SHARDS)]
    return looked_up(docs, files, *dense_counts(tables, parts, built), text_col)


def unpacked(row):
    import numpy as np
    if row is None:
        none = np.zeros(0, dtype=np.uint64)
        return [], none, none
    return list(row.sizes), np.frombuffer(bytes(row.words), dtype=np.uint64), np.frombuffer(bytes(row["keys"]), dtype=np.uint64)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(read(spark, sf_dir, "documents"))
