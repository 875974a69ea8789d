"""The stages of the corpus pipeline: functions of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import near, packing, pii, quality, repeats
from .common import bounded, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of documents in docs."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.select_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the least doc_id. Rows are told apart
    by "near row": the doc_id, or for further rows of one doc_id and rows without one a number above all."""
    row, columns = "near row", docs.columns
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    again = materialize(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "ids")
    keyed = docs.withColumn(row, F.col("doc_id").cast("long"))
    if not again.isEmpty():
        top = ids.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        repeated = keyed.join(again.where("doc_id is not null").select(F.col("doc_id").alias(row)), row, "left_semi")
        first = F.row_number().over(Window.partitionBy(row).orderBy("text"))
        odd = repeated.withColumn("near first", first == 1).unionByName(keyed.where(F.col(row).isNull()).withColumn("near first", F.lit(False)))
        odd = odd.withColumn(row, F.when(F.col("near first"), F.col(row)).otherwise(F.lit(top) + 1 + F.monotonically_increasing_id()))
        odd = materialize(odd.select(*columns, row), "rows")
        keyed = keyed.where(F.col(row).isNotNull()).join(again.select(F.col("doc_id").alias(row)), row, "left_anti").select(*columns, row).unionByName(odd)
    groups = near.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"))
    gone = groups.where("not kept").select(F.col("doc_id").alias(row))
    return keyed.join(gone, row, "left_anti").select(*columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur elsewhere too are cut out of the texts; n_chars follows."""
    return with_length(repeats.cut_repeats(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    bounded(spark)
    return with_length(pii.redact_column(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
