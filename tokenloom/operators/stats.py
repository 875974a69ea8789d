"""Statistics and checks of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import free_name, materialize, running_sums


def classified(docs: DataFrame, top: int, text: str = "text", unreadable: str = "unreadable") -> DataFrame:
    """docs with code: null for documents that are kept, else why not, in the order of the checks.
    docs has unreadable (a reason or null), n_pieces and highest (the greatest id)."""
    code = (
        F.when(F.col(unreadable).isNotNull(), "D206").when(F.coalesce(F.col(text), F.lit("")) == "", "D203")
        .when(F.col("highest") > top, "D202").when(F.col("n_pieces") == 0, "D203")
    )
    return docs.withColumn("code", code)


def skip_guard(docs: DataFrame, order: str, limit: float, least: int) -> DataFrame:
    """order, n_input, n_skipped, tripped: is the running share of skipped inputs over the limit here?"""
    bad = F.col("code").isNotNull().cast("int")
    d = running_sums(docs.select(order, bad.alias("bad")), order, {"n_input": F.lit(1), "n_skipped": F.col("bad")})
    return d.select(order, "n_input", "n_skipped", ((F.col("n_input") >= least) & (F.col("n_skipped") / F.col("n_input") > limit)).alias("tripped"))


def length_stats(sized: DataFrame) -> DataFrame:
    """Counts and lengths; fractions to six digits, as engines interpolate in different orders."""
    n = F.col("n_items")
    return sized.agg(
        F.count("*").alias("n_docs"), F.sum(n).alias("n_items"), F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("median"),
        F.round(F.percentile(n, F.lit(0.9)), 6).alias("p90"), F.max(n).alias("longest"), F.max_by(F.col("doc_id"), F.struct(n, -F.col("doc_id"))).alias("longest_id"),
    )


def duplicates(ids: DataFrame) -> DataFrame:
    """ids (id) -> n_duplicates (rows that repeat an earlier non-null id), n_ids that do, an example."""
    g = ids.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.count("*").alias("n_ids"), F.min("id").alias("example"))


def not_increasing(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before, across partitions too: order, value, before."""
    part, carry = (free_name(df.columns, n) for n in ("part", "carry"))
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.select(order, value).repartitionByRange(count, order).withColumn(part, F.spark_partition_id()), "ordered")
    ends = rows.groupBy(part).agg(F.max_by(value, order).alias(carry)).withColumn(carry, F.lag(carry).over(Window.orderBy(part)))  # a row per partition
    before = F.coalesce(F.lag(value).over(Window.partitionBy(part).orderBy(order)), F.col(carry))
    return rows.join(ends, part).withColumn("before", before).where(F.col(value) < F.col("before")).select(order, value, "before")
