"""Corpus pipeline over ``documents``: toxicity filter, SimHash near-duplicates, secret
redaction, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a
DataFrame that is written as Parquet and reread for the next one. All but the last return
the columns of documents.

* toxicity: rows whose score reaches the threshold go; clean rows stay as they are.
* simhash: of each group of near-duplicates the row with the smallest doc_id stays (of several
  texts of that doc_id the one with the smallest md5, of equal ones the first by the other
  columns). Rows with a null doc_id belong to no group and stay. A row is judged by its own
  text: a unique text stays even if another row repeats its doc_id.
* secrets: every secret is replaced by a mask, n_chars follows; no row goes.
* mixing: all rows stay; the rows are written in the order of the mixture, so the files
  read one after the other are the mixed stream.
* pieces: doc_id, n_pieces, piece_ids, round_trip of every row, and position, its place in
  the mixed stream from 0 (null for rows that were not read from files).

Null and empty texts, repeated rows, empty tables and extra columns are handled by the
operators as their docstrings say; extra columns of the input end with the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import mixing, pieces, secretscan, simhash, toxicity
from tidewatch.llm.common import DOCUMENT_COLUMNS, cut, read, shared_dir

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = toxicity.fitted_model(docs, read(spark, sf_dir, "labels"))
    scored = docs.withColumn("score", toxicity.score_column(spark, model))
    return scored.where(F.col("score") < TOXIC_FROM).drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = docs.select(*DOCUMENT_COLUMNS, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", digest.alias("md5")))
                        .alias("__row"))
    found = cut(simhash.near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text")).groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("n")).where("doc_id is not null"))
    kept = keyed.join(found.where("doc_id <> component_id or n > 1").select(F.col("doc_id").alias("__row")), "__row", "left_anti")
    repeated = keyed.join(found.where("doc_id = component_id and n > 1").select(F.col("doc_id").alias("__row")), "__row",
                          "left_semi")
    whole = F.struct("lang", "source", "n_chars", "text")  # equal ids and texts: one row, the first by the other columns
    one = repeated.groupBy("__row").agg(F.min(whole).alias("first"), F.first("doc_id").alias("doc_id"))
    return kept.select(*DOCUMENT_COLUMNS).unionByName(one.select("doc_id", "first.*").select(*DOCUMENT_COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs.select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*DOCUMENT_COLUMNS))
    return mixed.orderBy("slot", "in_block").select(*DOCUMENT_COLUMNS)


def stream_positions(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``: the place of the row in its files, read one after the other."""
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # no files
        return docs.withColumn("position", F.lit(None).cast("long"))
    number = F.coalesce(F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    before = Window.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = placed.groupBy("__file").agg(F.count("*").alias("__n")).select(
        "__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(files), "__file").withColumn(
        "position", F.col("__before") + F.col("__row")).select(*docs.columns, "position")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = stream_positions(docs.select("doc_id", "text"))
    encoded = pieces.encode(placed.select(F.struct("doc_id", "position").alias("doc_id"), "text"))
    return encoded.select("doc_id.doc_id", "n_pieces", "piece_ids", "round_trip", "doc_id.position")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None  # a trained classifier and hashed fingerprints have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
