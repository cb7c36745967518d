"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

A pre-token is a run of spaces with the characters up to the next space. No piece of the
model spans the start of a later run, so a text has as many pieces as its pre-tokens.
Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a cache in
each Python worker, filled by the library itself; pre-tokens are never shuffled.

Rules for special rows: a null text counts as empty (no bytes, no tokens); repeated rows
and rows with a null doc_id are returned like any other; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read

RUN = re.compile(" +[^ ]*")
LONGEST_CACHED = 48        # characters of a pre-token that is worth remembering
WORKER_ENTRIES = 400_000   # cached pre-tokens of a worker; a full cache is emptied
FREQUENT = 65_536          # entries of the broadcast table
PER_TASK = 8_192           # candidates that one task of the first pass hands on
MARK = "▁"


def model_bytes(path: str | None = None) -> bytes:
    """The model file (a parameter; default: the public 32k piece model)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def pretokens(text: str | None) -> list[str]:
    """Pre-tokens without their first space (the library puts that one back)."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")  # the library's own mark for a space
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [p[1:] for p in RUN.findall(" " + text)]


def splits_at_spaces(processor) -> bool:
    """Whether pre-tokens can be counted one by one: no piece has a space mark after
    another character."""
    return all(MARK not in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


def frequent_pretokens(docs: DataFrame, entries: int = FREQUENT, text_col: str = "text") -> DataFrame:
    """(pretoken, n): candidates for tier one from all texts. Each task counts in a bounded
    table and hands on its most frequent entries; only those summaries are shuffled."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(pretokens(t.as_py()))
            if len(seen) > WORKER_ENTRIES:
                seen = Counter(dict(seen.most_common(WORKER_ENTRIES // 8)))
        top = [(p, n) for p, n in seen.most_common(PER_TASK) if len(p) <= LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    tops = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pretoken string, n long")
    return (tops.groupBy("pretoken").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "pretoken").limit(entries))


class Lengths:
    """Worker-side lookup: the broadcast table, then the cache, then the library."""

    def __init__(self, model: bytes, table: tuple[str, bytes]):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        words, sizes = table
        self.first = dict(zip(words.split(" "), sizes)) if sizes else {}
        self.alone = len(self.sp.encode("a ")) - len(self.sp.encode("a"))  # a space by itself
        self.first[""] = self.alone
        self.cache = dict(self.first)

    def count(self, text: str | None) -> int:
        words = pretokens(text)
        if not words:
            return 0
        got = list(map(self.cache.get, words))
        if None not in got:
            return sum(got)
        total = sum(n for n in got if n is not None)
        missed = [w for w, n in zip(words, got) if n is None]
        fresh = list(dict.fromkeys(missed))
        sizes = dict(zip(fresh, map(len, self.sp.encode(fresh, num_threads=1))))
        if len(self.cache) + len(sizes) > WORKER_ENTRIES:
            self.cache = dict(self.first)
        self.cache.update((w, n) for w, n in sizes.items() if len(w) <= LONGEST_CACHED)
        return total + sum(map(sizes.__getitem__, missed))


_LENGTHS: dict[int, Lengths] = {}


def token_counts(docs: DataFrame, limit: int = 4096, model_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    import sentencepiece

    spark = docs.sparkSession
    model = model_bytes(model_path)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if not splits_at_spaces(sp):
        raise ValueError("a piece of this model spans a space; its texts cannot be counted by pre-token")
    rows = [r.pretoken for r in frequent_pretokens(docs, text_col=text_col).collect()]  # at most FREQUENT rows
    sizes = list(map(len, sp.encode(rows, num_threads=1))) if rows else []
    packed = [(w, n) for w, n in zip(rows, sizes) if w and " " not in w and n < 256]
    shipped = spark.sparkContext.broadcast((model, (" ".join(w for w, _ in packed), bytes(n for _, n in packed))))

    def run(batches):
        import pyarrow as pa

        key = hash(shipped.value)
        if key not in _LENGTHS:  # kept while the worker is reused
            _LENGTHS.clear()
            _LENGTHS[key] = Lengths(*shipped.value)
        lengths = _LENGTHS[key]
        for b in batches:
            n = [lengths.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
            .mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
