"""From raw documents to packed training sequences, in five stages that each write Parquet for the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``. Rows travel
as one struct beside the columns that a stage needs, so extra columns come through whatever their names are.

A stage's result must be written before the next stage is called, as ``run`` does: on entry a stage deletes what the one
before it has left in the shared folder (in the same thread), so intermediates don't pile up.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dup, packing, quality, secrets
from tidemark.llm.common import collected, discard, free_shuffles, n_words, stash, table

_of = threading.local()


def _left() -> list[DataFrame]:
    """What the stage before has left in this thread: pipelines in other threads have their own."""
    if not hasattr(_of, "left"):
        _of.left = []
    return _of.left


def _tidy() -> None:
    discard(*_left())
    _left().clear()


def _stage(work):
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tidy()
        free_shuffles(spark)
        with collected(_left()):
            return work(spark, docs, sf_dir)

    return run


def _quoted(names: list[str]) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in names]


def _row(docs: DataFrame):
    return F.struct(*_quoted(docs.columns)).alias("row")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have too few words, so they go; repeated rows fare alike."""
    return quality.quality(docs.select("text", "lang", _row(docs)), ("row", "lang")).where("kept").select("row.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id; null ids stay.

    Rows of one doc_id are one document, of which the row with the least text (null last), and then the least values of the
    other columns, stays.
    """
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    if not ids.where("count > 1").isEmpty():
        order = F.struct(F.col("text").isNull(), F.col("text"), *[F.col(c).cast("string") for c in _quoted([c for c in docs.columns if c not in ("doc_id", "text")])])
        one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(_row(docs), order).alias("row")).select("row.*")
        docs = stash(one.unionByName(docs.where("doc_id IS NULL")), "pipeline-one-row")
    found = near_dup.near_duplicates(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(_quoted(docs.columns))


@_stage
def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes, and a null text stays null."""
    clean = docs.withColumn("text", secrets.redacted(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are never taken.

    The mix is planned on slim rows; then every row is decided where it is, so texts are neither copied nor shuffled.
    """
    plan = mixing.plan(mixing.sized(docs))
    mixed = mixing.apply(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _row(docs)), plan)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


@_stage
def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. Null and empty texts are an end id each; repeated rows are packed each."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scan", secret_redaction), ("source mix", source_mix), ("best-fit packing", best_fit)]

#: SQL can express neither token ids nor packing; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    _tidy()
    return docs
