"""Command line: ``python -m loomfill COMMAND``; see ``--help`` of each command."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfill.operators import evaluate, extract, generate, quick, samples, split
from loomfill.operators.blocks import node_type_counts
from loomfill.sources import corpora, repo_files

#: The stand-in generator.
STUB = "loomfill.operators.generate:StubGenerator"
LANGUAGES = {"python": (".py", "all", "fold"), "rust": (".rs", "ignore", "keep")}


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    repo_files.register(spark)
    extension, rules, newlines = LANGUAGES[a.language]
    source = spark.read.format("repo_files").options(path=corpora.require(a.source), extensions=extension, rules=rules, newlines=newlines).load()
    parsed = extract.extract_nodes(source, a.language)
    if a.output == "-":
        for line in corpora.corpus_lines(parsed).toLocalIterator():  # one partition at a time
            print(line[0])
        return
    corpora.write_corpus(parsed, a.output)
    print(f"{a.output}: {corpora.folder_size(a.output) / 1e6:.2f} MB" if os.path.exists(a.output) else a.output)
    node_type_counts(extract.explode_nodes(corpora.read_corpus_lines(spark, a.output))).show(50, truncate=False)


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    """Either form of a corpus: a folder or ``.jsonl`` file holds lines, other files one object."""
    return corpora.read_corpus_lines(spark, path) if os.path.isdir(path) or path.endswith((".jsonl", ".ndjson")) else corpora.read_corpus_map(spark, path)


def _datagen(spark: SparkSession, a: argparse.Namespace) -> None:
    files = _corpus(spark, a.ast)
    splits = split.split_files(files, a.seed)
    made = samples.fim_samples(files, a.seed).join(splits.withColumnRenamed("path", "file_path"), "file_path")
    corpora.write_samples(made, a.output_prefix)
    split.split_counts(files, made.drop("split"), splits).show()


def _text(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = corpora.read_samples(spark, a.data)
    if a.max_samples:
        key = F.md5(F.to_json(F.struct(*rows.columns)))
        rows = split.take_random(rows.withColumn("k", key), "k", a.max_samples, split.TRAIN_SEED).drop("k")
    samples.training_text(rows).write.json(a.output)


def _numbered(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of files numbered from 0: by file, then by block of it, then by place in the block."""
    block = ["_file", "_block"]
    own = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    counts = own.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))  # a row for each block of the files
    before = counts.select(*block, (F.sum("_n").over(Window.orderBy(*block)) - F.col("_n")).alias("_before"))
    placed = own.join(F.broadcast(before), block).withColumn("_k", F.row_number().over(Window.partitionBy(*block).orderBy("_place")))
    return placed.select((F.col("_before") + F.col("_k") - 1).alias("sample_id"), *rows.columns)


def _tests(spark: SparkSession, path: str, most: int | None, file_path: str = "unknown") -> DataFrame:
    """Samples numbered from 0 in the order of the file, and a seeded draw of them."""
    numbered = samples.with_defaults(_numbered(spark, corpora.read_samples(spark, path)), file_path)
    return split.take_random(numbered, "sample_id", most)


def _factory(name: str):
    """``module:function`` names what makes a generator; workers call it, so the module must be there too."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _completions(spark: SparkSession, a: argparse.Namespace, tests: DataFrame) -> DataFrame:
    """Stored completions, or those of two generators."""
    if a.completions:
        schema = "sample_id long, model string, text string, k_samples array<string>, time_ms double, tokens int"
        return spark.read.schema(schema).json(corpora.require(a.completions))
    prompts = generate.prompts(tests)
    made = [generate.complete(prompts, _factory(name), model, a.k) for name, model in ((a.tuned, "tuned"), (a.baseline, "baseline"))]
    return made[0].unionByName(made[1])


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    tests = _tests(spark, a.test_data, a.max_samples)
    scores = evaluate.score(_completions(spark, a, tests), tests)
    evaluate.result_document(scores, time.strftime("%Y-%m-%d %H:%M:%S")).write.text(f"{a.output}/results")
    corpora.write_report(evaluate.report_lines(scores), f"{a.output}/report")
    corpora.write_manifest(evaluate.manifest_rows(tests), f"{a.output}/manifest")
    evaluate.compact_results(scores).write.json(f"{a.output}/compact")
    evaluate.delta_lines(scores).show(20, truncate=False)
    evaluate.pass_by_node_type(scores).show(50, truncate=False)


def _infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """The second evaluation: its rows as one JSON list, in a file named by the time unless told, and its summary."""
    tests = _tests(spark, a.test_data, a.max_samples, "unknown.rs")
    rows = evaluate.compact_results(evaluate.score(_completions(spark, a, tests), tests)).orderBy("id").persist()
    path = a.output or f"results_{int(time.time())}.json"
    with open(path, "w", encoding="utf-8") as f:
        for k, line in enumerate(rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator()):  # one partition at a time
            f.write(("[\n" if not k else ",\n") + line[0])
        f.write("]" if rows.count() else "[]")
    for line in evaluate.compact_lines(rows).collect():
        print(line.line)
    print(f"Saved: {path}")
    rows.unpersist()


def _summary(spark: SparkSession, a: argparse.Namespace) -> None:
    line = evaluate.closing_line(a.results, spark).first().line
    print("no results" if line is None else line)


def _check_tokenizer(spark: SparkSession, a: argparse.Namespace) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpora.require(a.tokenizer))
    generate.check_round_trip(lambda t: tokenizer.encode(t, add_special_tokens=False).ids, lambda ids: tokenizer.decode(ids, skip_special_tokens=False))
    print(f"OK: {a.tokenizer} preserves code whitespace")


def _quick(spark: SparkSession, a: argparse.Namespace) -> None:
    results = quick.run(spark, _factory(a.generator)).cache()
    results.show(20, truncate=60)
    evaluate.keyword_summary(results).show()


def _modelfile(spark: SparkSession, a: argparse.Namespace) -> None:
    text = corpora.model_file(a.run_dir, a.temperature, a.num_predict, a.num_ctx, not a.final)
    with open(a.output or f"{a.run_dir.rstrip('/')}.modelfile", "w", encoding="utf-8") as f:
        f.write(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomfill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, help: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help)
        p.set_defaults(run=run)
        return p

    def evaluated(p: argparse.ArgumentParser) -> None:
        p.add_argument("--test_data", required=True)
        p.add_argument("--completions", help="stored completions, in place of generators")
        p.add_argument("--tuned", default=os.environ.get("LOOMFILL_TUNED", STUB), help="module:function that makes a generator")
        p.add_argument("--baseline", default=os.environ.get("LOOMFILL_BASELINE", STUB))
        p.add_argument("--max_samples", type=int)
        p.add_argument("--k", type=int, default=5)

    p = command("extract", _extract, "syntax nodes of a source tree")
    p.add_argument("source")
    p.add_argument("output")
    p.add_argument("--language", choices=sorted(LANGUAGES), default="python")
    p = command("datagen", _datagen, "train and test samples of a corpus")
    p.add_argument("--ast", required=True)
    p.add_argument("--output_prefix", default="ast")
    p.add_argument("--seed", type=int, default=split.SEED)
    p = command("text", _text, "training text of samples")
    p.add_argument("--data", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--max_samples", type=int)
    p = command("benchmark", _benchmark, "score stored completions, or those of two generators")
    evaluated(p)
    p.add_argument("--output", required=True)
    p = command("infer", _infer, "the second evaluation, as one JSON list")
    evaluated(p)
    p.add_argument("--output")
    p = command("summary", _summary, "closing line of a result document; the last by name of a folder or pattern")
    p.add_argument("results")
    p = command("check-tokenizer", _check_tokenizer, "whether a tokenizer file gives white space back unchanged")
    p.add_argument("tokenizer")
    p = command("quick", _quick, "the quick test")
    p.add_argument("--generator", default=STUB)
    p = command("modelfile", _modelfile, "deployment file of a training run")
    p.add_argument("run_dir")
    p.add_argument("--output")
    p.add_argument("--temperature", type=float, default=0.2)
    p.add_argument("--num_predict", type=int, default=128)
    p.add_argument("--num_ctx", type=int, default=4096)
    p.add_argument("--final", action="store_true", help="never the merged model")
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName(f"loomfill {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
