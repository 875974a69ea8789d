"""The queries op1 to op10, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, media, near, packing, pii, quality, repeats, topk
from .common import table


def tokenizer_path() -> str:
    """TOKENLOOM_BPE, or the public vocabulary of the environment."""
    path = os.environ.get("TOKENLOOM_BPE")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, tail probabilities and whether it is selected."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_not_toxic", "p_good", (~quality.rejects()).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_ogg, op4_topk, op5_bpe, op6_langid, op7_minhash, op8_licenses, op9_packing, op10_quality)}

ORACLE = {
    "op4_topk": """
with good as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as hugeint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from good q join good c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20""",
}
