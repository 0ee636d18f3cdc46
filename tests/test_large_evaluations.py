"""Evaluations of many samples: what nobody reads is not scored, and both models' rows still meet."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomfill.functions import metrics as M
from loomfill.functions.text import clip, quoted, words
from loomfill.operators import evaluate as E
from loomfill.plans import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["compact_results", "side_by_side"])
def test_metrics_that_nobody_reads_are_left_out(spark, name):
    text = plan(Q.QUERIES[name](spark, DATA))
    assert "levenshtein" not in text and "array_intersect" not in text


def test_side_by_side_needs_both_models(spark):
    made = [(1, "tuned", "a", ["b"], 1.0, 3), (1, "baseline", None, None, 2.0, 4), (2, "tuned", "a", [], 1.0, 3), (3, "baseline", "a", [], 1.0, 3), (4, "tuned", "x", ["a"], 1.0, 5), (4, "baseline", "a", ["a"], 1.0, 6)]
    samples = [(i, f"p{i}", None, None if i == 1 else "a") for i in range(1, 5)]
    completions = spark.createDataFrame(made, "sample_id long, model string, text string, k_samples array<string>, time_ms double, tokens int")
    scores = E.score(completions, spark.createDataFrame(samples, "sample_id long, file_path string, node_type string, middle string"))
    one, four = E.side_by_side(scores).orderBy("sample_id").collect()
    assert (one.sample_id, one.expected, one.tuned.text, one.baseline.text, one.tuned.exact_match) == (1, None, "a", None, False)
    assert (four.sample_id, four.file_path, four.tuned.any_pass, four.tuned.exact_match, four.baseline.exact_match, four.baseline.generated_tokens) == (4, "p4", True, False, True, 6)
    assert [(r.id, r.path, r.expected, r.tuned["pass@5"], r.baseline.tokens) for r in E.compact_results(scores).orderBy("id").collect()] == [(0, "p1", None, False, 4), (1, "p4", "a", True, 6)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_report_scores_for_its_table_and_for_its_samples_only(spark):
    text = plan(Q.QUERIES["report_lines"](spark, DATA))
    assert "sort_array" not in text  # n-grams are not sorted
    assert text.count("Relation [") <= 7  # once for the table (both models, samples), once for the samples (those twice)


def test_workers_part_words_as_columns_do(spark):
    odd = "".join(c for c in map(chr, range(0x110000)) if c.isspace()) + "\u200b\ufeff\u180e\x00\x08\x7f"
    rows = [(f"a{c}b",) for c in odd]
    got = spark.createDataFrame(rows, "t string").select("t", words(F.col("t")).alias("w"), M.bleu(F.col("t"), F.lit("a b")).alias("bleu")).collect()
    assert [r.w for r in got] == [r.t.split() for r in got]
    assert all(r.bleu == (1.0 if r.w == ["a", "b"] else 0.0) for r in got)


def test_bleu_of_repeated_and_missing_texts(spark):
    rows = [("a b a b c", "b a b a b x"), (None, "a"), ("a", None), (None, None), ("b c", "ab cd"), ("x y z", "w x y z")]
    got = [r.b for r in spark.createDataFrame(rows, "g string, e string").select(M.bleu(F.col("g"), F.col("e")).alias("b")).collect()]
    assert got[0] == pytest.approx((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25) and got[1:] == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_long_lines_cost_their_length(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices([f"w{i}" for i in range(2_000)], k=40_000))
    rows = spark.createDataFrame([(text[len(text) // 4 : len(text) // 2], text)], "g string, e string")
    start = time.perf_counter()
    r = rows.select(M.edit_distance(F.col("g"), F.col("e")).alias("d"), M.bleu(F.col("g"), F.col("e")).alias("b")).first()
    assert r.d == len(text) - (len(text) // 2 - len(text) // 4) and 0.9 < r.b < 1
    assert time.perf_counter() - start < 10  # the product of the lengths would take minutes


def test_clipped_and_quoted_texts_are_as_python_shows_them(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("ab\n\n\t\r\\'\"\x00\x07\x7f\x85\xa0\xadé🙂 ", k=rng.randint(0, 16))),) for _ in range(500)] + [("x" * 9 + "\n",), ("x" * 10,), ("x" * 11,)]
    got = spark.createDataFrame(rows, "t string").select("t", clip(F.col("t"), 10).alias("c"), quoted(F.col("t")).alias("q")).collect()
    for r in got:
        line = r.t.replace("\n", "\\n")
        assert r.c == (line if len(line) <= 10 else line[:10] + " …[truncated]") and r.q == repr(r.t)
