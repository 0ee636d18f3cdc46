"""File-level splits and seeded samples. Chance is an MD5 rank, the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRAIN_SHARE = 0.98
SEED, TRAIN_SEED = 42, 3407


def chance(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def split_files(files: DataFrame, seed: int = SEED, share: float = TRAIN_SHARE) -> DataFrame:
    """``path, split``: exactly ``floor(n * share)`` paths train, by rank.

    A window without partitions would gather all paths in one task. Ranks come
    from counts instead: paths are bucketed by their digest's first digits,
    buckets below the cut are decided whole, and only the bucket that holds
    the cut is ranked.
    """
    paths = files.select("path").distinct().withColumn("chance", chance(F.col("path"), seed)).withColumn("bucket", F.substring("chance", 1, 3))
    counts = paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 4096 rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cuts = counts.select("bucket", before.alias("before"), "n", F.floor(total * F.lit(float(share))).alias("cut"))
    placed = paths.join(F.broadcast(cuts), "bucket")
    inside = (F.col("before") < F.col("cut")) & (F.col("before") + F.col("n") > F.col("cut"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("chance", "path"))
    split = lambda train: F.when(train, "train").otherwise("test").alias("split")
    whole = placed.where(~inside).select("path", split(F.col("before") + F.col("n") <= F.col("cut")))
    ranked = placed.where(inside).withColumn("k", rank + F.col("before")).select("path", split(F.col("k") <= F.col("cut")))
    return whole.unionByName(ranked)


def split_by_hash(files: DataFrame, seed: int = SEED, share: float = TRAIN_SHARE) -> DataFrame:
    """``path, split`` without counting: each path alone decides, so shares are approximate."""
    part = F.conv(F.substring(chance(F.col("path"), seed), 1, 8), 16, 10).cast("long") % 10_000
    return files.select("path").distinct().select("path", F.when(part < int(share * 10_000), "train").otherwise("test").alias("split"))


def take_random(rows: DataFrame, key: str, m: int | None, seed: int = SEED, in_order: bool = True) -> DataFrame:
    """A seeded sample of m rows without replacement; all rows if m is not set.

    ``in_order`` sorts the sample by ``key`` again; otherwise it stays in drawn order.
    """
    if m:
        rows = rows.orderBy(chance(F.col(key), seed), key).limit(m)
    return rows.orderBy(key) if in_order else rows.orderBy(chance(F.col(key), seed), key)


def train_rows(rows: DataFrame, splits: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is in the training split."""
    return rows.join(splits.where("split = 'train'").select(F.col("path").alias(path)), path, "left_semi")


def test_rows(rows: DataFrame, splits: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is not in the training split."""
    return rows.join(splits.where("split = 'train'").select(F.col("path").alias(path)), path, "left_anti")


def split_counts(files: DataFrame, samples: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: files, files with code, and samples by split."""
    kinds = samples.select("file_path").join(splits.withColumnRenamed("path", "file_path"), "file_path", "left")
    flags = lambda *on: [F.lit(0).alias(n) if c is None else c.cast("int").alias(n) for n, c in zip(("files", "success", "train", "test"), on)]
    train = F.coalesce(F.col("split"), F.lit("test")) == "train"
    rows = files.select(*flags(F.lit(True), F.col("code").isNotNull(), None, None)).unionByName(kinds.select(*flags(None, None, train, ~train)))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "success", "train", "test")])


def latest(rows: DataFrame, name: str, time: str) -> DataFrame:
    """The name with the latest time, ties to the greatest name."""
    return rows.agg(F.max(F.struct(F.col(time), F.col(name))).alias("m")).select(F.col(f"m.{name}").alias(name))
