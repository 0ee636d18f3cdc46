"""Source files, syntax nodes and completions made of the ``documents`` table.

The driver's tables hold prose, so its lines are wrapped as items by turns and
stand in for code. The SQL in ``plans.oracle`` states the same rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.operators.samples import fim_samples

NODE_TYPES = ["Use", "Function", "Struct", "Const"]
MODELS = ["tuned", "baseline"]
DRAWS = 5
#: Room for line numbers in the sample ids of ``tests``; posexplode counts in 32 bits.
LINE_IDS = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, code, nodes``."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")

    def wrap(line: Column, i: Column) -> Column:
        number = i.cast("string")
        made = [
            F.concat(F.lit("use "), line, F.lit(";")),
            F.concat(F.lit("fn l"), number, F.lit("() { "), line, F.lit(" }")),
            F.concat(F.lit("struct S"), number, F.lit(" { "), line, F.lit(" }")),
            F.concat(F.lit('const C: &str = "'), line, F.lit('";')),
        ]
        return reduce(lambda c, k: c.when(i % 4 == k, made[k]), (1, 2, 3), F.when(i % 4 == 0, made[0]))

    def node(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        kind = F.element_at(F.array(*map(F.lit, NODE_TYPES)), (i % 4 + 1).cast("int"))
        return F.struct(kind.alias("node_type"), F.concat(number, F.lit(":"), number).alias("span"), F.when(i % 4 == 1, line).alias("body"))

    return docs.select(
        F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.array_join(F.transform(lines, wrap), "\n"), F.lit("\n")).alias("code"),
        F.transform(lines, node).alias("nodes"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.explode("nodes").alias("n")).select("path", "n.*")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_samples(files(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, NODE_TYPES)), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("sample_id"),
        F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("file_path"),
        kind.alias("node_type"),
        "text",
    )


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation samples of whole texts: every line of every document as an expected middle.

    ``sample_id`` is ``doc_id * LINE_IDS`` plus the line's number from 0. A
    null text is one sample with a null middle.
    """
    rows = _documents(spark, sf_dir).select("*", F.posexplode_outer(F.split("text", "\n")).alias("line", "middle"))
    number = (F.col("sample_id") * LINE_IDS + F.coalesce("line", F.lit(0))).alias("sample_id")
    return rows.select(number, "file_path", "node_type", "middle")


def _draw(model: str, draw: int) -> Column:
    """By a digest: the middle itself, its first half, or its words from the second on."""
    digit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{model}|{draw}|"), F.col("sample_id").cast("string")).cast("binary")), 1, 2), 16, 10).cast("int")
    exact = 96 if model == "tuned" else 32
    half = F.substring("middle", 1, F.floor(F.length("middle") / 2).cast("int"))
    rest = F.when(F.instr("middle", " ") > 0, F.substring("middle", F.instr("middle", " ") + 1, F.length("middle"))).otherwise("")
    return F.when(digit < exact, F.col("middle")).when(digit < 176, half).otherwise(rest)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, model, text, k_samples, time_ms, tokens`` of :func:`tests`."""
    rows = tests(spark, sf_dir)

    def of(model: str) -> DataFrame:
        code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{model}|time|"), F.col("sample_id").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int")
        return rows.select(
            "sample_id",
            F.lit(model).alias("model"),
            _draw(model, 0).alias("text"),
            F.array(*[_draw(model, k) for k in range(1, DRAWS + 1)]).alias("k_samples"),
            (code / 7.0).alias("time_ms"),
            (code % 128).cast("int").alias("tokens"),
        )

    return of(MODELS[0]).unionByName(of(MODELS[1]))
