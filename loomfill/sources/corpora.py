"""Readers and writers of corpora, samples and evaluation outputs. Schemas are declared, never inferred."""

from __future__ import annotations

import os
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.functions.text import stop_markers

_DATA = "struct<name:string,span:string,body:string,params:array<array<string>>,return_type:string>"
_AST = f"array<map<string,{_DATA}>>"
SAMPLE = "filePath string, prefix string, middle string, suffix string, nodeType string"


def require(path: str) -> str:
    """The path, if it exists; checked for local paths only."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(path)
    return path


def _normal_nodes(rows: DataFrame) -> DataFrame:
    """Single-key maps to structs of node type and fields; a missing list is empty."""
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("type"))

    def node(m):
        kind = F.get(F.map_keys(m), F.lit(0))
        data = F.get(F.map_values(m), F.lit(0))
        return F.struct(
            kind.alias("node_type"),
            data["name"].alias("name"),
            data["span"].alias("span"),
            data["body"].alias("body"),
            F.transform(data["params"], pair).alias("params"),
            data["return_type"].alias("return_type"),
        )

    nodes = F.transform(F.coalesce("ast", F.array().cast(_AST)), node)
    return rows.select("path", "code", nodes.alias("nodes"))


def read_corpus_map(spark: SparkSession, path: str) -> DataFrame:
    """``path, code, nodes`` of a corpus in one JSON object keyed by path.

    One document can't be split between tasks: rewrite it by :func:`write_corpus` once.
    """
    kind = f"map<string,struct<code:string,ast:{_AST}>>"
    text = spark.read.text(require(path), wholetext=True)
    rows = text.select(F.explode(F.from_json("value", kind)).alias("path", "d")).select("path", "d.code", "d.ast")
    return _normal_nodes(rows)


def read_corpus_lines(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """``path, code, nodes`` of a corpus with a JSON object per line; ``bad`` holds lines that don't parse, if kept."""
    schema = f"path string, code string, ast {_AST}, bad string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = spark.read.text(require(path)).select(parsed.alias("r")).select("r.*")
    if keep_bad:
        return _normal_nodes(rows.where("bad IS NULL")).withColumn("bad", F.lit(None).cast("string")).unionByName(
            rows.where("bad IS NOT NULL").select("bad"), allowMissingColumns=True
        )
    return _normal_nodes(rows.where("bad IS NULL"))


def _tagged(parsed: DataFrame) -> DataFrame:
    """Back to single-key maps; fields that are null are left out of the JSON."""
    def tag(n):
        params = F.transform(n["params"], lambda p: F.array(p["name"], p["type"]))
        return F.create_map(n["node_type"], F.struct(n["name"].alias("name"), n["span"].alias("span"), n["body"].alias("body"), params.alias("params"), n["return_type"].alias("return_type")))

    return parsed.select("path", "code", F.transform("nodes", tag).alias("ast"))


def write_corpus(parsed: DataFrame, path: str) -> None:
    """One JSON object per line, the splittable form."""
    _tagged(parsed).write.json(path)


def corpus_lines(parsed: DataFrame) -> DataFrame:
    """The same as rows of one column ``line``."""
    rows = _tagged(parsed)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def corpus_document(parsed: DataFrame) -> DataFrame:
    """The one-object form as a single row; for small corpora only."""
    one = F.struct("code", "ast")
    return _tagged(parsed).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", one)))).alias("json"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SAMPLE).json(require(path))
    return rows.select(F.col("filePath").alias("file_path"), "prefix", "middle", "suffix", F.col("nodeType").alias("node_type"))


def read_splits(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both sample sets with a ``split`` column."""
    return read_samples(spark, train).withColumn("split", F.lit("train")).unionByName(read_samples(spark, test).withColumn("split", F.lit("test")))


def write_samples(samples: DataFrame, prefix: str) -> None:
    """``{prefix}_train.jsonl`` and ``{prefix}_test.jsonl`` folders of samples with a ``split``."""
    wire = samples.select(F.col("file_path").alias("filePath"), "prefix", "middle", "suffix", F.col("node_type").alias("nodeType"), "split")
    for split in ("train", "test"):
        wire.where(F.col("split") == split).drop("split").write.option("ignoreNullFields", "false").json(f"{prefix}_{split}.jsonl")


def write_manifest(rows: DataFrame, path: str) -> None:
    """Tab-separated rows after a ``#`` header line, as one text file."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns])
    names = "\t".join(rows.columns)
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, f"# {names}")], "o int, value string")
    body = rows.select(F.lit(1).alias("o"), line.alias("value"), F.col(rows.columns[0]).alias("k"))
    head.withColumn("k", F.lit(None).cast(dict(rows.dtypes)[rows.columns[0]])).unionByName(body).coalesce(1).sortWithinPartitions("o", "k").select("value").write.text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines ``section, ord, line`` as one text file."""
    lines.coalesce(1).sortWithinPartitions("section", "ord").select("line").write.text(path)


def read_config(path: str) -> dict:
    """A YAML configuration, on the driver."""
    import yaml

    with open(require(path), encoding="utf-8") as f:
        return yaml.safe_load(f)


def merged_config(config: dict, overrides: dict) -> dict:
    """``config`` with overrides that are not None; keys may be dotted."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in config.items()}
    for key, value in overrides.items():
        if value is None:
            continue
        *parents, last = key.split(".")
        spot = out
        for p in parents:
            spot[p] = dict(spot.get(p) or {})
            spot = spot[p]
        spot[last] = value
    return out


def write_config(config: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False, allow_unicode=True)


_MODELFILE = Template('FROM $model\n\nTEMPLATE """{{ .Prompt }}"""\n\nPARAMETER temperature $temperature\nPARAMETER num_predict $num_predict\nPARAMETER num_ctx $num_ctx\n$stops\n')


def model_file(run_dir: str, temperature: float = 0.2, num_predict: int = 128, num_ctx: int = 4096, merged: bool = True, style: str = "psm") -> str:
    """Deployment file of a training run: its merged model if asked for and there, else its final one."""
    paths = [os.path.join(run_dir, name) for name in (["merged_model"] if merged else []) + ["final_model"]]
    model = next((p for p in paths if os.path.exists(p)), None)
    if model is None:
        raise FileNotFoundError(paths[-1])
    stops = "\n".join(f"PARAMETER stop {t}" for t in stop_markers(style))
    return _MODELFILE.substitute(model=os.path.abspath(model), temperature=temperature, num_predict=num_predict, num_ctx=num_ctx, stops=stops)


def folder_size(path: str) -> int:
    """Bytes of the files right in a folder."""
    with os.scandir(require(path)) as entries:
        return sum(e.stat().st_size for e in entries if e.is_file())
