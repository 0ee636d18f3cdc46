"""Hand-computed values of Column functions."""

import random

import pytest
from pyspark.sql import functions as F

from loomfill.functions import metrics as M
from loomfill.functions import spans as S
from loomfill.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)


@pytest.mark.parametrize(
    ("span", "want"), [("3:7", (3, 7)), ("3", None), ("1:2:3", None), ("a:1", None), ("1:b", None), ("", None)]
)
def test_parse_span(spark, span, want):
    got = one(spark, S.parse_span(F.lit(span)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("code", "lines", "want"),
    [("ab\ncd", [-1, 0, 1, 2, 3, 99], [0, 0, 0, 3, 6, 6]), ("ab\n", [1, 2, 3], [0, 3, 4]), ("", [1, 2], [0, 1])],
)
def test_line_to_char(spark, code, lines, want):
    starts = S.line_starts(F.lit(code))
    assert [one(spark, S.line_to_char(starts, F.lit(n))) for n in lines] == want


def test_line_starts_over_chunks(spark):
    code = "\n".join("x" * (i % 7) for i in range(1000))
    want = [0]
    for line in code.split("\n"):
        want.append(want[-1] + len(line) + 1)
    assert one(spark, S.line_starts(F.lit(code))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"), [("", "", 1.0), ("", "x", 0.0), ("x", "", 0.0), ("kitten", "sitting", 0.571429), ("é🙂", "e🙂", 0.5)]
)
def test_edit_similarity(spark, a, b, want):
    assert round(one(spark, M.edit_similarity(F.lit(a), F.lit(b))), 6) == want


def test_edit_distance_without_shared_ends(spark):
    rng = random.Random(1)
    rows = [tuple("".join(rng.choices("abé🙂", k=rng.randint(0, 9))) for _ in "ab") for _ in range(300)] + [("x" * 40_000, "x" * 20_000 + "y"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(M.edit_distance(F.col("a"), F.col("b")).eqNullSafe(F.levenshtein("a", "b")).alias("same"))
    assert all(r.same for r in got.limit(300).collect())
    assert df.limit(301).select(M.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()[-1].d == 20_000


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (M.token_overlap, "a b b c", "b c d", 0.5),
        (M.word_overlap, "a b b c", "b c d", 0.666667),
        (M.token_overlap, " ", " ", 0.0),
        (M.word_overlap, "", "a", 0.0),
        (M.token_overlap, "a b", "a b", 1.0),
        (M.bleu, "a b c d e", "a b c d x", 0.668740),
        (M.bleu, "a b", "a b c", 1.0),
        (M.bleu, "a a a", "a", 0.0),
        (M.bleu, "", "", 0.0),
        (M.bleu, " ", "a", 0.0),
    ],
)
def test_overlaps(spark, f, a, b, want):
    assert round(one(spark, f(F.lit(a), F.lit(b))), 6) == want


def test_any_match(spark):
    draws, x = lit(["a", "b", "c", "x", "d"]), F.lit("x")
    assert not one(spark, M.any_match(draws, x, 3))
    assert one(spark, M.any_match(draws, x, 5)) and one(spark, M.any_match(draws, x))
    assert one(spark, M.any_match(F.array(F.lit(None).cast("string")), x)) is False


@pytest.mark.parametrize(("stops", "want"), [(["bc", "abx"], "za"), (["cab", "bc"], "zab"), ([], "zabcabx")])
def test_stops_fold_in_order(spark, stops, want):
    assert one(spark, X.truncate_at_stops(F.lit("zabcabx"), stops)) == want
    if stops:
        assert one(spark, X.truncate_at_stops(F.lit("zabcabx"), lit(stops))) == want


def test_empty_stop_is_refused():
    with pytest.raises(ValueError):
        X.truncate_at_stops(F.lit("x"), [""])


def test_small_text_functions(spark):
    assert one(spark, X.truncate_at_blank_line(F.lit("a\n\nb\n\nc"))) == "a"
    assert [one(spark, X.format_duration(F.lit(s))) for s in (59.9, 61.0, 3661.0)] == ["59s", "1m1s", "1h1m"]
    assert one(spark, X.clip(F.lit("a\nb"), 300)) == "a\\nb"
    assert one(spark, X.clip(F.lit("abcdef"), 3)) == "abc …[truncated]"
    assert one(spark, X.clip(F.lit(None).cast("string"))) == ""
    assert one(spark, X.contains_any(F.lit("So Sum"), lit(["iter", "sum"])))
    assert not one(spark, X.contains_any(F.lit("x"), lit(["iter", "sum"])))
    assert one(spark, X.model_tag(F.lit("My_Model"))) == "my-model"


def test_prompts(spark):
    made = X.format_prompt(F.lit("P"), F.lit("S"))
    prefix, suffix = X.parse_prompt(made, F.lit("other"))
    assert (one(spark, prefix), one(spark, suffix)) == ("P", "S")
    prefix, suffix = X.parse_prompt(F.lit(X.BEGIN + "P"), F.lit(None).cast("string"))
    assert (one(spark, prefix), one(spark, suffix)) == ("P", "")
    prefix, suffix = X.parse_prompt(F.lit("P"), F.lit(None).cast("string"))
    assert (one(spark, prefix), one(spark, suffix)) == ("P", "")
    assert one(spark, X.template_prompt(F.lit("P"), F.lit(""))) == "P"
    assert one(spark, X.format_training(F.lit("p"), F.lit("m"), F.lit("s"))) == f"{X.BEGIN}p{X.HOLE}s{X.END}m{X.EOS}"
    with pytest.raises(ValueError):
        X.format_prompt(F.lit("P"), F.lit("S"), "other")


def test_mask_tokens(spark):
    ids, mask = lit([1, 2, 3]), lit([True, False, True])
    assert one(spark, X.mask_tokens(ids, mask, -100)) == [-100, 2, -100]
    assert one(spark, X.mask_tokens_2d(F.array(ids), F.array(mask), 0)) == [[0, 2, 0]]
    assert one(spark, X.mask_tokens(F.array().cast("array<int>"), F.array().cast("array<boolean>"), 5)) == []
    with pytest.raises(Exception, match="differ in length"):
        one(spark, X.mask_tokens(ids, lit([True, False]), -100))
    with pytest.raises(ValueError):
        X.check_mask_id(300, "uint8")
    with pytest.raises(TypeError):
        X.check_mask_id(3, "float32")
    assert X.check_mask_id(255, "uint8") == 255
