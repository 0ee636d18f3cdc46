"""The evaluation of whole texts against plain Python, on the smallest tables."""

import json
import math
import os
from collections import Counter, defaultdict

import pytest

from loomfill.plans import queries as Q
from loomfill.plans import surrogate as D

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in D.table(spark, DATA, "documents").collect()}


@pytest.fixture(scope="module")
def expected(texts):
    return {i * D.LINE_IDS + k: line for i, r in texts.items() for k, line in enumerate(r.text.split("\n") if r.text is not None else [None])}


@pytest.fixture(scope="module")
def made(spark):
    return {(r.sample_id, r.model): r for r in D.completions(spark, DATA).collect()}


def plain(text, middle):
    a, b = text.split(), middle.split()
    x, y = set(a), set(b)
    token = len(x & y) / len(x | y) if x and y else 0.0
    word = len(x & y) / max(len(x), len(y)) if x and y else 0.0
    edit = 1.0 if not middle and not text else 0.0 if not middle or not text else 1 - (len(middle) - len(text)) / len(middle)
    shares = []
    for n in range(1, 5):
        own, other = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        if own:
            shares.append(sum((own & other).values()) / sum(own.values()))
    bleu = math.exp(sum(map(math.log, shares)) / len(shares)) if shares and min(shares) > 0 else 0.0
    return {"edit_similarity": edit, "token_overlap": token, "word_overlap": word, "bleu_score": bleu}


def test_lines_hold_the_whole_texts(spark, texts, expected):
    got = defaultdict(dict)
    for r in D.tests(spark, DATA).collect():
        got[r.sample_id // D.LINE_IDS][r.sample_id % D.LINE_IDS] = r.middle
    assert {i: "\n".join(v[k] for k in sorted(v)) for i, v in got.items() if texts[i].text is not None} == {i: r.text for i, r in texts.items() if r.text is not None}
    assert sum(map(len, got.values())) == len(expected)


def test_scores(spark, expected, made):
    frames = {"edit_similarity": "edit_similarity_scores", "token_overlap": "token_overlap_scores", "word_overlap": "word_overlap_scores", "bleu_score": "bleu_scores"}
    want = {k: plain(r.text or "", expected[k[0]] or "") for k, r in made.items() if expected[k[0]] is not None}
    assert any(0 < w["bleu_score"] < 1 for w in want.values())
    for c, name in frames.items():
        got = {(r.sample_id, r.model): r[c] for r in Q.QUERIES[name](spark, DATA).collect()}
        assert len(got) == len(made)
        assert all(math.isclose(got[k], w[c], abs_tol=2e-6) for k, w in want.items()), c


def test_counts(spark, texts, expected, made):
    done = {"tuned": 0, "baseline": 0}
    rows = {(r.model, r.sample_id): (r.passed, r.done) for r in Q.QUERIES["running_pass1"](spark, DATA).collect()}
    for k, (i, model) in enumerate(sorted(made)):
        done[model] += made[i, model].text == expected[i]
        assert rows[model, i] == (done[model], k // 2 + 1)
    for r in Q.QUERIES["benchmark_summary"](spark, DATA).collect():
        assert (r.n, r.pass_at_1) == (len(expected), done[r.model])
    ids = {r.id for r in Q.QUERIES["compact_results"](spark, DATA).collect()}
    assert ids == set(range(len(expected)))
    has = {r.sample_id: r.passed for r in Q.QUERIES["keyword_any"](spark, DATA).collect()}
    for i, line in expected.items():
        if line is not None:
            words = ["tion", "qu", texts[i // D.LINE_IDS].lang]
            assert bool(has[i]) == any(w and w.lower() in line.lower() for w in words)


def test_generator_gets_every_line(spark, expected):
    assert {r.sample_id for r in Q.QUERIES["generate_stub"](spark, DATA).select("sample_id").collect()} == set(expected)


def test_reports_hold_every_sample(spark, expected, made):
    rows = {r.sample_id: json.loads(r.json) for r in Q.QUERIES["results_json"](spark, DATA).collect()}
    head = rows.pop(None)
    scored = set(expected)
    assert set(rows) == scored and head["metadata"]["total_samples"] == len(scored) > 200
    exact = {m: sum(made[i, m].text == expected[i] for i in expected) for m in D.MODELS}
    assert {m: head["summary"][m]["pass_at_1"] for m in D.MODELS} == exact
    for i, row in rows.items():
        assert row["sample_id"] == i and row.get("expected") == expected[i] and row.get("tuned_output") == made[i, "tuned"].text
    sections = {r.section for r in Q.QUERIES["report_lines"](spark, DATA).select("section").distinct().collect()}
    assert sections == scored | {-1}
