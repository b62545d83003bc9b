"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents; the last
returns each row's place in the mix. ``run`` writes each stage's result as Parquet into the shared folder the cluster
names in ``spark.checkpoint.dir`` and reads it back for the next one; what was written is left to the keeper of that folder.

Defined cases, for all stages: a row counts for itself, by a key of its own, whatever its id is, null and repeated ids
included; null text is empty; very long texts are read whole, by one row at a time; an empty table gives an empty result;
further columns are kept as they are, whatever their names, but for the last stage, which leaves them out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, mixing, near_copies, quality, suffix_dedup
from keyloom.llm.common import keyed, shared, table

#: No stage but the last can be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Documents by a row key that is unique and never null, whatever their ids are."""
    return keyed(docs, [c for c in docs.columns if c not in ("doc_id", "text")])


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(c if c in ("doc_id", "text") else f"rest.`{c}`").alias(c) for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees do not reject; rows of one id are scored by their own texts."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, in the order (id, nulls first; text), of each component of near copies; texts without words are copies."""
    rows = _rows(docs)
    return rows.join(near_copies.later_copies(rows).hint("merge"), "rid", "left_anti").select(*_columns(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages; those that nothing is left of go."""
    out = suffix_dedup.dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")], as_text=True)
    left = out.where("n_removed = 0 or n_removed < n_bytes").withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row counts for itself, whatever its id."""
    rows = _rows(docs)
    leaked = decontaminate.leaks(rows.select(F.col("rid").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(leaked.select(F.col("doc_id").alias("rid")).distinct(), "rid", "left_anti").select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the mix of its sources."""
    return mixing.mixed(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("benchmark", benchmark_filter), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
