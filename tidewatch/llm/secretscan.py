"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The patterns give the base spans. The method adds spans of kind ``markov`` outside of them:
stretches in long runs of key characters that a model of random strings explains better
than a model of ordinary identifiers, whether or not they hold digits, out to the next
joining characters (``JOINTS``). What a base span leaves of a run is judged too. Both models are first-order character
chains fitted on labelled strings: label 1 are seeded random strings and the values of
base spans, label 0 the other words and numbers of the fitting sample, identifiers made of
them, and decimal numbers, dates and versions (a run of decimal digits is no secret).

Rules for special rows: a null or empty text has no spans; repeated rows and rows with a
null doc_id are returned like any other; extra columns are ignored by the scan and kept
by ``redact``. Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import read

# Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

RUNS = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
NUMBER = re.compile(r"[0-9]+(?:[+/_=-]+[0-9]+)*")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # the last symbol is the start of a string
CODE = {c: i for i, c in enumerate(ALPHABET)}
FIT_DOCUMENTS = 4_000     # about so many documents are the fitting sample
BACKOFF = 8.0             # weight of the single character in a transition's estimate
MIN_RATIO = 12.0          # log-likelihood ratio of a reported stretch, and at least 1 a character
SHORTEST, CUT_SHORTEST = 16, 6  # characters of a reported span; of one that a base span cuts
JOINTS = "/_=-"           # characters that join keys to words


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def random_strings(count: int = 4_000, seed: int = 7) -> list[str]:
    """Random strings over hexadecimal, alphanumeric and base64 characters."""
    import random

    r = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return ["".join(r.choices(kinds[k % len(kinds)], k=r.randint(16, 48))) for k in range(count)]


def numbers(count: int = 4_000, seed: int = 9) -> list[str]:
    """Decimal numbers, times, dates and numbered parts."""
    import random

    r = random.Random(seed)

    def digits(low, high):
        return "".join(r.choices("0123456789", k=r.randint(low, high)))

    out = [digits(1, 24) for _ in range(count)]
    for _ in range(count // 4):
        day = f"{r.randint(1970, 2069)}{r.randint(1, 12):02}{r.randint(1, 28):02}"
        out += [day + digits(6, 8), f"{day[:4]}-{day[4:6]}-{day[6:]}", f"{digits(3, 4)}-{digits(3, 4)}-{digits(4, 6)}",
                f"{digits(1, 3)}_{digits(1, 3)}_{digits(1, 4)}"]
    return out


def add_transitions(counts, strings) -> None:
    """Add the character transitions of the strings (of ALPHABET) to a SIZE x SIZE table."""
    import numpy as np

    lookup = np.full(256, SIZE - 1, dtype=np.int64)
    lookup[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(SIZE - 1)
    codes = lookup[np.frombuffer("\n".join(["", *strings]).encode(), dtype=np.uint8)]
    a, b = codes[:-1], codes[1:]
    inside = b < SIZE - 1
    counts += np.bincount(a[inside] * SIZE + b[inside], minlength=SIZE * SIZE).reshape(SIZE, SIZE)


def identifiers(words: list[str]) -> list[str]:
    """The words, and the usual identifiers that are made of them: camel case, snake case,
    paths, numbered names. Long words with digits are what the scan judges: they have no label,
    unless they are numbers (decimal digits, joined or not)."""
    words = [w for w in words if len(w) < 16 or not any(map(str.isdigit, w)) or NUMBER.fullmatch(w)]
    pairs = list(zip(words[::2], words[1::2]))
    return [*words, *(f"{a}{b.capitalize()}" for a, b in pairs), *(f"{a}_{b}" for a, b in pairs),
            *(f"{a}-{b}/{a}{len(b)}" for a, b in pairs)]


def fit(docs: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS):
    """log P(next | previous, random) - log P(next | previous, identifier) as a table.

    The sample is about ``fit_documents`` documents chosen by the hash of their text; each
    task returns two count tables, so nothing that grows with the texts is collected.
    """
    import numpy as np

    docs = docs.select(F.col(text_col).alias("text")).where("text is not null")
    rows = docs.count()
    share = min(1.0, fit_documents / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)

    def run(batches):
        import pandas as pd

        tables = np.zeros((2, SIZE, SIZE), dtype=np.int64)
        plain = re.compile(f"[{re.escape(ALPHABET)}]+")
        for b in batches:
            for t in b["text"]:
                spans, at = base_spans(t), 0
                for start, _, end in spans:
                    if start >= at:
                        add_transitions(tables[0], identifiers(plain.findall(t[at:start])))
                    add_transitions(tables[1], plain.findall(t[start:end].split("=")[-1].split(":")[-1]))
                    at = max(at, end)
                add_transitions(tables[0], identifiers(plain.findall(t[at:])))
        label, a, b = np.nonzero(tables)
        yield pd.DataFrame({"label": label, "a": a, "b": b, "n": tables[label, a, b]})

    counted = (sample.mapInPandas(run, "label int, a int, b int, n long").groupBy("label", "a", "b")
               .agg(F.sum("n").alias("n")).collect())  # at most 2 * SIZE * SIZE rows
    tables = np.zeros((2, SIZE, SIZE))
    for r in counted:
        tables[r.label, r.a, r.b] = r.n
    add_transitions(tables[0], numbers())
    add_transitions(tables[1], random_strings())
    single = tables.sum(axis=1, keepdims=True) + 0.5  # rarely seen contexts fall back on the character alone
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((tables + BACKOFF * single) / (tables.sum(axis=2, keepdims=True) + BACKOFF))
    return logs[1] - logs[0]


def gains(run: str, table):
    """Log-likelihood ratio of each character of a run of ALPHABET characters."""
    codes = [SIZE - 1, *map(CODE.__getitem__, run)]
    return table[codes[:-1], codes[1:]]


def best_stretch(gain) -> tuple[int, int, float]:
    """(first, end, sum) of the stretch with the largest sum of ratios."""
    import numpy as np

    total = np.concatenate([[0.0], np.cumsum(gain)])
    rise = total[1:] - np.minimum.accumulate(total)[:-1]
    end = int(np.argmax(rise)) + 1
    first = int(np.argmin(total[:end]))
    return first, end, float(rise[end - 1])


def keys_of(run: str, table, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(start, end) of the random keys in a run: the whole run if it reaches the least ratio,
    else the stretch of the largest ratio, out to the next joining characters on both sides,
    if that does; then the same of what is left on both sides."""
    if len(run) < shortest or len(set(run)) < 6:
        return []
    gain = gains(run, table)
    if gain.sum() >= max(MIN_RATIO, len(run)):
        return [(0, len(run))]
    start, stop, total = best_stretch(gain)
    if total < MIN_RATIO:
        return []
    while start and run[start - 1] not in JOINTS:
        start -= 1
    while stop < len(run) and run[stop] not in JOINTS:
        stop += 1
    out = [(start, stop)]
    if stop - start < shortest or total < stop - start or len(set(run[start:stop])) < 6:
        out = []
    left, right = keys_of(run[:start], table, shortest), keys_of(run[stop:], table, shortest)
    return [*left, *out, *((stop + s, stop + e) for s, e in right)]


def all_spans(text: str | None, table) -> tuple[list, list]:
    """(base spans, all spans), each (start, kind number, end) in order."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    for m in RUNS.finditer(text):
        at = m.start()
        shortest = CUT_SHORTEST if any(e > at and s < m.end() for s, _, e in base) else SHORTEST
        for s, e in [*((s, e) for s, _, e in base if e > m.start() and s < m.end()), (m.end(), m.end())]:
            if s > at:
                added += [(at + a, 3, at + b) for a, b in keys_of(text[at:s], table, shortest)]
            at = max(at, e)
    return base, (sorted(base + added) if added else base)


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, table=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col) if table is None else table)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = all_spans(t.as_py(), shipped.value)
                n = [0, 0, 0, 0]
                for _, k, _ in spans:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(_text(base).encode()).hexdigest(), _text(spans)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]", table=None, text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by ``mask`` and ``length_col``
    set to the new number of characters where the text changed."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col) if table is None else table)

    @F.pandas_udf("string")
    def masked(texts):
        def one(t):
            if t is None:
                return None
            parts, at = [], 0
            for start, _, end in all_spans(t, shipped.value)[1]:
                if start >= at:
                    parts += [t[at:start], mask]
                at = max(at, end)
            return "".join([*parts, t[at:]]) if at else t
        return texts.map(one)

    columns = [F.col(c) for c in docs.columns if c not in (text_col, length_col)]
    out = docs.select("*", masked(text_col).alias("__masked"))
    changed = ~F.col(text_col).eqNullSafe(F.col("__masked"))
    fields = {text_col: F.col("__masked")}
    if length_col in docs.columns:
        fields[length_col] = F.when(changed, F.char_length("__masked")).otherwise(F.col(length_col)).cast(
            docs.schema[length_col].dataType)
    return out.select(*(fields[c].alias(c) if c in fields else F.col(c) for c in docs.columns)) if columns else out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
