"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.functions import metrics as M
from loomfill.functions import text as X
from loomfill.functions.spans import line_starts, line_to_char, parse_span
from loomfill.operators import blocks as B
from loomfill.operators import evaluate as E
from loomfill.operators import extract, generate
from loomfill.operators import samples as S
from loomfill.operators import split as P
from loomfill.plans import surrogate as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _md5(name: str):
    return F.md5(F.col(name).cast("binary"))


# Files, spans and blocks.


@query
def node_type_counts(spark, sf_dir):
    return B.node_type_counts(D.nodes(spark, sf_dir))


@query
def line_offsets(spark, sf_dir):
    return B.line_offsets(D.files(spark, sf_dir))


@query
def line_lookups(spark, sf_dir):
    """Offsets of each file's line before the first, first, second and past the end."""
    rows = D.files(spark, sf_dir).select("path", F.col("code"), line_starts(F.col("code")).alias("starts"))
    at = lambda n: line_to_char(F.col("starts"), F.lit(n)).cast("long")
    return rows.select("path", at(0).alias("before"), at(1).alias("first"), at(2).alias("second"), at(1_000_000).alias("past"))


@query
def parsed_spans(spark, sf_dir):
    """Spans of nodes, and broken forms of them by turns."""
    start = F.split_part("span", F.lit(":"), F.lit(1))
    broken = F.when(F.col("node_type") == "Use", F.col("span")).when(F.col("node_type") == "Function", start)
    broken = broken.when(F.col("node_type") == "Struct", F.concat(F.lit("a:"), start)).otherwise(F.concat("span", F.lit(":1")))
    rows = D.nodes(spark, sf_dir).select("path", "node_type", "span", parse_span(broken).alias("p"))
    line = lambda c: F.coalesce(c, F.lit(-1)).alias(c.rpartition(".")[2])
    return rows.select("path", "node_type", "span", line("p.start_line"), line("p.end_line"))


@query
def extract_blocks(spark, sf_dir):
    return B.extract_blocks(D.files(spark, sf_dir))


@query
def function_body_blocks(spark, sf_dir):
    return B.extract_blocks(D.files(spark, sf_dir)).where("node_type = 'FunctionBody'")


@query
def fim_samples(spark, sf_dir):
    part = lambda c: [F.length(c).cast("long").alias(f"{c}_chars"), _md5(c).alias(f"{c}_md5")]
    return D.samples(spark, sf_dir).select("file_path", F.col("ord").cast("long").alias("ord"), "node_type", *part("prefix"), *part("middle"), *part("suffix"))


@query
def long_samples(spark, sf_dir):
    rows = S.long_samples(D.samples(spark, sf_dir), max_tokens=2048)
    return rows.select("file_path", F.col("ord").cast("long").alias("ord"), F.col("n_chars").cast("long").alias("n_chars"))


# Splits and samples.


@query
def split_assignment(spark, sf_dir):
    return P.split_files(D.files(spark, sf_dir))


@query
def split_by_hash(spark, sf_dir):
    return P.split_by_hash(D.files(spark, sf_dir))


@query
def split_counts(spark, sf_dir):
    files = D.files(spark, sf_dir)
    return P.split_counts(files, S.fim_samples(files), P.split_files(files))


@query
def train_semi_join(spark, sf_dir):
    files = D.files(spark, sf_dir)
    return P.train_rows(files.select("path", F.length("code").cast("long").alias("n_chars")), P.split_files(files))


@query
def test_anti_join(spark, sf_dir):
    files = D.files(spark, sf_dir)
    return P.test_rows(files.select("path", F.length("code").cast("long").alias("n_chars")), P.split_files(files))


@query
def sample_sorted(spark, sf_dir):
    return P.take_random(D.tests(spark, sf_dir).select("sample_id", "node_type"), "sample_id", 200)


@query
def sample_drawn(spark, sf_dir):
    """The same draw, with its position in drawing order."""
    rows = P.take_random(D.tests(spark, sf_dir).select("sample_id", "node_type"), "sample_id", 200, in_order=False)
    return rows.coalesce(1).withColumn("id", F.monotonically_increasing_id())


@query
def train_subsample(spark, sf_dir):
    return P.take_random(D.tests(spark, sf_dir).select("sample_id"), "sample_id", 100, seed=P.TRAIN_SEED)


@query
def latest_run(spark, sf_dir):
    """The user with the latest event."""
    return P.latest(D.table(spark, sf_dir, "events"), "event_id", "ts")


# Prompts and texts.


@query
def format_training_text(spark, sf_dir):
    return S.training_text(D.samples(spark, sf_dir)).select(_md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query
def prompt_roundtrip(spark, sf_dir):
    """Prompts of turns, parsed again: by markers, without a hole, and without markers."""
    c = D.table(spark, sf_dir, "conversations")
    prompt = F.when(F.col("turn") % 3 == 0, X.format_prompt(F.col("role"), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(X.BEGIN), "text")).otherwise(F.col("text"))
    prefix, suffix = X.parse_prompt(F.col("prompt"), F.when(F.col("turn") % 2 == 0, F.col("role")))
    rows = c.select("conv_id", "turn", "role", prompt.alias("prompt"))
    return rows.select("conv_id", "turn", F.md5(prefix.cast("binary")).alias("prefix_md5"), F.md5(suffix.cast("binary")).alias("suffix_md5"))


@query
def template_prompts(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations")
    prompt = X.template_prompt(F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role")))
    return c.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query
def conversation_prompts(spark, sf_dir):
    """Each user's turn with the next turn as what is expected."""
    c = D.table(spark, sf_dir, "conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"), F.col("role").alias("by"))
    pairs = c.where("role = 'user'").join(following, ["conv_id", "turn"]).where("by = 'assistant'")
    prompt = X.format_prompt(F.col("text"), F.lit(""))
    return pairs.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt_md5"), _md5("expected").alias("expected_md5"))


STOPS = ["the", ". ", "er"]


@query
def stop_truncate(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", X.truncate_at_stops(F.col("text"), STOPS).alias("text"))


@query
def blank_line_cut(spark, sf_dir):
    doubled = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return D.table(spark, sf_dir, "documents").select("doc_id", X.truncate_at_blank_line(doubled).alias("text"))


@query
def keyword_any(spark, sf_dir):
    keywords = F.array(F.lit("Tion"), F.lit("QU"), F.col("lang"))
    langs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    rows = D.tests(spark, sf_dir).withColumn("doc", F.expr(f"sample_id div {D.LINE_IDS}"))
    return rows.join(langs, "doc").select("sample_id", X.contains_any(F.col("middle"), keywords).alias("passed"))


@query
def clip_text(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.clip(F.col("text")).alias("long"), X.clip(F.col("text"), 120).alias("short"))


@query
def format_duration(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", X.format_duration(F.abs("value") * 40).alias("duration"))


@query
def model_tags(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", X.model_tag(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("tag"))


@query
def mask_tokens(spark, sf_dir):
    """Line numbers of each order as tokens, those of returned lines masked."""
    rows = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("m")))).alias("t")
    )
    ids = X.mask_tokens(F.transform("t", lambda x: x["l_linenumber"]), F.transform("t", lambda x: x["m"]), -100)
    return rows.select("l_orderkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query
def default_fields(spark, sf_dir):
    rows = D.tests(spark, sf_dir).select(
        "sample_id",
        F.when(F.col("sample_id") % 3 > 0, F.col("file_path")).alias("file_path"),
        F.when(F.col("sample_id") % 5 > 0, F.col("node_type")).alias("node_type"),
    )
    return S.with_defaults(rows)


@query
def request_checks(spark, sf_dir):
    """Turns as completion requests whose limits break a rule by turns."""
    c = D.table(spark, sf_dir, "conversations")
    requests = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(F.col("turn") % 4 < 3, F.col("text")).alias("prefix"),
        F.col("role").alias("suffix"),
        (F.col("conv_id") % 700).cast("int").alias("max_tokens"),
        (F.col("turn") / 2.0).cast("double").alias("temperature"),
        F.array(F.lit("x"), F.when(F.col("conv_id") % 11 > 0, F.lit("y")).otherwise("")).alias("stop_sequences"),
    )
    return generate.validate_requests(requests).select("request_id", F.array_join("errors", ",").alias("errors"))


# Metrics of completions.


def _scores(spark, sf_dir, *metrics) -> DataFrame:
    return E.score(D.completions(spark, sf_dir), D.tests(spark, sf_dir), list(metrics) or None)


#: Ranges of running sums: of so many documents.
SPAN = E.RANGE * D.LINE_IDS
#: Metrics that summaries need.
SUMMED = ["pass_at_1", "pass_at_3", "pass_at_5", "edit_similarity", "token_overlap", "bleu_score"]


@query
def edit_similarity_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "edit_similarity").select("sample_id", "model", F.round("edit_similarity", 6).alias("edit_similarity"))


@query
def token_overlap_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "token_overlap").select("sample_id", "model", F.round("token_overlap", 6).alias("token_overlap"))


@query
def word_overlap_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "word_overlap").select("sample_id", "model", F.round("word_overlap", 6).alias("word_overlap"))


@query
def bleu_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "bleu_score").select("sample_id", "model", F.round("bleu_score", 6).alias("bleu_score"))


@query
def pass_at_k(spark, sf_dir):
    return _scores(spark, sf_dir, "exact_match", "pass_at_1", "pass_at_3", "pass_at_5", "any_pass").select("sample_id", "model", "exact_match", "pass_at_1", "pass_at_3", "pass_at_5", "any_pass")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def benchmark_summary(spark, sf_dir):
    return _rounded(E.summary(_scores(spark, sf_dir, *SUMMED)))


@query
def summary_by_node_type(spark, sf_dir):
    return _rounded(E.summary(_scores(spark, sf_dir, *SUMMED), "node_type"))


@query
def pass1_by_node_type(spark, sf_dir):
    return _rounded(E.pass_by_node_type(_scores(spark, sf_dir, "pass_at_1")))


@query
def model_delta_long(spark, sf_dir):
    return _rounded(E.model_deltas(_scores(spark, sf_dir, *SUMMED)))


@query
def delta_lines(spark, sf_dir):
    return E.delta_lines(_scores(spark, sf_dir, *SUMMED))


@query
def running_pass1(spark, sf_dir):
    return E.running_pass(_scores(spark, sf_dir, "pass_at_1"), span=SPAN)


@query
def progress_rows(spark, sf_dir):
    """Every 500th row of the running count."""
    return E.running_pass(_scores(spark, sf_dir, "pass_at_1"), every=500, span=SPAN)


@query
def side_by_side(spark, sf_dir):
    wide = E.side_by_side(_scores(spark, sf_dir))
    return wide.select("sample_id", "node_type", F.col("tuned.exact_match").alias("tuned_exact"), F.col("baseline.exact_match").alias("baseline_exact"))


@query
def compact_results(spark, sf_dir):
    rows = E.compact_results(_scores(spark, sf_dir), SPAN)
    return rows.select(
        F.col("id").cast("long").alias("id"), "path", F.col("tuned.exact").alias("tuned_exact"), F.col("tuned.`pass@5`").alias("tuned_pass_5"), F.col("baseline.tokens").cast("long").alias("baseline_tokens")
    )


@query
def latency_percentiles(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    return _rounded(E.value_at(events, "value", {"p50": 0.5, "p99": 0.99}, "event_type"))


@query
def keyword_summary(spark, sf_dir):
    rows = D.completions(spark, sf_dir).where("model = 'tuned'")
    cases = rows.select(F.col("sample_id").cast("string").alias("name"), F.col("text").alias("generated"), "time_ms", F.array(F.lit("tion"), F.lit("que")).alias("expected_contains"))
    return _rounded(E.keyword_summary(E.keyword_results(cases)))


@query
def manifest_rows(spark, sf_dir):
    return E.manifest_rows(P.take_random(D.tests(spark, sf_dir), "sample_id", 200))


@query
def results_json(spark, sf_dir):
    """The result rows of an evaluation of every line, and a row of its metadata and summary."""
    return E.result_rows(_scores(spark, sf_dir), "2026-01-01 00:00:00")


@query
def report_lines(spark, sf_dir):
    return E.report_lines(_scores(spark, sf_dir))


# At the Python boundary.


@query
def rust_items(spark, sf_dir):
    """Items that the scanner finds in the stand-in files; a use has its tokens for a name, which are left out."""
    parsed = extract.extract_nodes(D.files(spark, sf_dir), "rust")
    name = F.when(F.col("node_type") != "Use", F.col("name")).alias("name")
    return extract.explode_nodes(parsed).select("path", F.col("ord").cast("long").alias("ord"), "node_type", name, "span")


@query
def python_ast_nodes(spark, sf_dir):
    """Nodes of Python files made of the documents: each line, whole, as a list literal in a function, class, loop or assignment by turns."""
    docs = D.table(spark, sf_dir, "documents")

    def make(line, i):
        literal, number = F.to_json(F.array(line)), i.cast("string")
        forms = [("def f_", "():\n    return "), ("class C_", ":\n    text = "), ("for x_", " in range(2):\n    y = "), ("z_", " = ")]
        made = [F.concat(F.lit(head), number, F.lit(tail), literal, F.lit("\n")) for head, tail in forms]
        return F.when(i % 4 == 0, made[0]).when(i % 4 == 1, made[1]).when(i % 4 == 2, made[2]).otherwise(made[3])

    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.array_join(F.transform(F.split("text", "\n"), make), "").alias("code"))
    parsed = extract.extract_nodes(files, "python")
    return extract.explode_nodes(parsed).select("path", F.col("ord").cast("long").alias("ord"), "node_type", "span")


@query
def generate_stub(spark, sf_dir):
    """Completions of every line of every document by the stand-in generator, without their times."""
    rows = D.tests(spark, sf_dir).select("sample_id", X.format_prompt(F.col("middle"), F.lit("")).alias("prompt"))
    done = generate.complete(rows, generate.StubGenerator, "stub")
    return done.select("sample_id", "model", "text", F.array_join("k_samples", "|").alias("draws"), "tokens")
