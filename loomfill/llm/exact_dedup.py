"""Exact deduplication with skew-safe combining, in native Spark operations.

Three combining stages, each of which groups by digest *and* full content:

1. locally, by the partial aggregation inside every map task;
2. per (content, salt), where the salt is the map task's number modulo
   ``salts``, so that a content found in every task meets in ``salts``
   reducers instead of one;
3. globally over the few salt winners of each content.

Rows then look their group up by SHA-256 digest, a second hash and the byte
length: the one step without contents, since groups with full contents would
have to travel twice. Groups that hold more than 1/4,096 of all rows are looked
up by broadcast, so no task gathers a group's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfill.llm.common import ascii_lower, keyed_rows, look_up, odd_ids, one_of_each, only_keys, written

SALTS = 32


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        "norm",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("n_bytes"),
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, check, n_bytes, keep_id, group_size."""
    key = ["digest", "norm", "check", "n_bytes"]
    salted = (
        _keyed(docs, id_col, text_col)
        .withColumn("salt", F.spark_partition_id() % salts)
        .groupBy(*key, "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return (
        salted.groupBy(*key)
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .drop("norm")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Mark the copies among ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. The row with the largest id stays. Returns one row per input row:
    ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null id ranks below every other; a group of null ids only has a null
    ``keep_id`` and keeps those rows. Repeated rows with the winning id are all
    marked kept. Texts of any length are hashed and compared whole, once in each
    stage. Empty input gives an empty result; columns other than the id and the
    text are not read, so theirs may have any name.
    """
    rows = _keyed(docs, id_col, text_col).drop("norm")
    found = written(copy_groups(docs, id_col, text_col, salts).withColumn("rows", F.col("group_size")), "groups")
    return look_up(rows, found, ["digest", "check", "n_bytes"], "rows").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with all its columns and exactly one row of each normalised text: one with the largest id.

    A null id ranks below every other. Where an id is null or repeated, rows go by
    id and text digest in place of the id; of repeated rows any one stays. Null
    texts count as empty, empty input gives an empty result, and all columns are
    returned as they are, whatever their names.
    """
    if odd_ids(docs, id_col):
        keyed = keyed_rows(docs, F.col(id_col).isNotNull(), id_col, text_col)
        keep = copy_groups(keyed, "key", "text", salts).select(F.col("keep_id").alias("key"))
        return one_of_each(keyed, written(keep, "kept", share=4))
    keep = copy_groups(docs, id_col, text_col, salts).select(F.col("keep_id").alias(id_col))
    return only_keys(docs, written(keep, "kept", share=4), id_col)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
