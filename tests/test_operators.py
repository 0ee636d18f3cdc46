"""Blocks, samples, splits and evaluation on small inputs, against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomfill.operators import blocks as B
from loomfill.operators import evaluate as E
from loomfill.operators import generate as G
from loomfill.operators import samples as S
from loomfill.operators import split as P

NODES = "path string, code string, nodes array<struct<node_type:string,span:string,body:string>>"


def plain_blocks(code, nodes):
    starts = [0]
    for line in code.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    at = lambda n: 0 if n <= 0 else starts[min(n, len(starts)) - 1]
    most, out = max(len(code) // 10, 30), []
    for kind, span, body in nodes:
        try:
            s, e = map(int, span.split(":"))
        except ValueError:
            continue
        if not s or not e:
            continue
        if 10 <= at(e + 1) - at(s) <= most:
            out.append((kind, at(s), at(e + 1)))
        if kind == "Function" and body is not None:
            low, high = at(s), min(at(e + 1), len(code))
            brace = code.find("{", low, high)
            if brace >= 0:
                end = brace + max(1, len(code[brace:high].rstrip(" \t\n")))
                if 10 <= end - brace <= most:
                    out.append(("FunctionBody", brace, end))
    return out


def make_file(rng, k):
    lines = [rng.choice(["fn f() { let x = 1; }  ", "fn g(a: T<{ 1 }>) {\r", "", "use a::b;", "struct S { x: u8 } // é🙂", "}\t"]) for _ in range(rng.randint(1, 60))]
    code = "\n".join(lines) + rng.choice(["", "\n"])
    nodes = []
    for _ in range(12):
        a = rng.randint(0, len(lines) + 1)
        span = rng.choice([f"{a}:{a + rng.randint(0, 2)}", "x:1", "3", "1:2:3"])
        kind = rng.choice(["Function", "Function", "Use", "Struct"])
        nodes.append((kind, span, rng.choice([None, "{ }"]) if kind == "Function" else None))
    return f"f{k}", code, nodes


def test_blocks_and_samples(spark):
    rng = random.Random(4)
    files = [make_file(rng, k) for k in range(40)] + [("none", None, []), ("empty", "", [("Use", "1:1", None)])]
    df = spark.createDataFrame(files, NODES)
    got = sorted(tuple(r) for r in B.extract_blocks(df).collect())
    want = sorted((p, i, *b) for p, code, nodes in files if code is not None for i, b in enumerate(plain_blocks(code, nodes)))
    assert got == want
    assert len(got) > 50
    codes = {p: code for p, code, _ in files}
    spots = {(p, i): (a, b) for p, i, _, a, b in want}
    for r in S.fim_samples(df).collect():
        code, (a, b) = codes[r.file_path], spots[r.file_path, r.ord]
        odd = int(hashlib.md5(f"42|{r.file_path}|{r.ord}".encode()).hexdigest()[-1], 16) % 2
        most = 16000 if odd else 8000
        before = (most - (b - a)) // 2
        assert (r.prefix, r.middle, r.suffix) == (code[max(0, a - before) : a], code[a:b], code[b : b + most - (b - a) - before])
        assert r.prefix + r.middle + r.suffix in code


def test_window_sizes(spark):
    code = "x" * 99 + "\n" + "y" * 49 + "\n" + "z" * 9850
    nodes = [("Use", "2:2", None)]
    r = S.fim_samples(spark.createDataFrame([("a", code, nodes)], NODES)).first()
    most = 16000 if int(hashlib.md5(b"42|a|0").hexdigest()[-1], 16) % 2 else 8000
    assert (len(r.prefix), len(r.suffix)) == ((100, 3975) if most == 8000 else (100, 7975))


@pytest.mark.parametrize(("n", "train"), [(1, 0), (2, 1), (49, 48), (50, 49), (100, 98), (1234, 1209)])
def test_split_is_exact(spark, n, train):
    files = spark.createDataFrame([(f"p{i}",) for i in range(n)], "path string")
    got = {r.path: r.split for r in P.split_files(files).collect()}
    order = sorted(got, key=lambda p: (hashlib.md5(f"42|{p}".encode()).hexdigest(), p))
    assert [got[p] for p in order] == ["train"] * train + ["test"] * (n - train)


def test_samples_and_membership(spark):
    rows = spark.range(50).withColumnRenamed("id", "sample_id")
    drawn = [r.sample_id for r in P.take_random(rows, "sample_id", 10, in_order=False).collect()]
    again = [r.sample_id for r in P.take_random(rows, "sample_id", 10).collect()]
    assert sorted(drawn) == again and drawn != again
    assert P.take_random(rows, "sample_id", None).count() == 50
    files = spark.createDataFrame([(f"p{i}",) for i in range(60)], "path string")
    splits = P.split_files(files)
    assert P.train_rows(files, splits).count() + P.test_rows(files, splits).count() == 60
    assert P.latest(spark.createDataFrame([("a", 2), ("b", 3)], "name string, t int"), "name", "t").first().name == "b"


def plain_bleu(a, b):
    scores = []
    for n in range(1, 5):
        x, y = ([t[i : i + n] for i in range(len(t) - n + 1)] for t in (a.split(), b.split()))
        if x:
            scores.append(sum(min(x.count(g), y.count(g)) for g in map(list, {tuple(g) for g in x})) / len(x))
    if not a or not b or not scores or min(scores) == 0:
        return 0.0
    return math.exp(sum(map(math.log, scores)) / len(scores))


def completions(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, model string, text string, k_samples array<string>, time_ms double, tokens int")


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices("ab", k=rng.randint(0, 8)))
    samples = [(i, f"p{i}", rng.choice(["A", "B"]), text()) for i in range(30)]
    rows = [(i, m, text(), [text() for _ in range(6)], float(rng.randint(1, 9)), 3) for i in range(30) for m in ("tuned", "baseline")]
    df = E.score(completions(spark, rows), spark.createDataFrame(samples, "sample_id long, file_path string, node_type string, middle string"))
    return samples, rows, df.cache()


def test_scores(scored):
    samples, rows, df = scored
    expected = {s[0]: s[3] for s in samples}
    got = {(r.sample_id, r.model): r for r in df.collect()}
    assert len(got) == len(rows)
    for i, m, text, draws, _, _ in rows:
        r, want = got[i, m], expected[i]
        assert r.exact_match == (text == want) == r.pass_at_1
        assert (r.pass_at_3, r.pass_at_5, r.any_pass) == (want in draws[:3], want in draws[:5], want in draws)
        assert r.pass_at_5 or not r.pass_at_3
        assert math.isclose(r.bleu_score, plain_bleu(text, want), abs_tol=1e-9)
        assert 0 <= r.token_overlap <= r.word_overlap <= 1 and 0 <= r.edit_similarity <= 1


def test_summaries(spark, scored):
    samples, rows, df = scored
    n = {m: sum(t == samples[i][3] for i, mm, t, *_ in rows if mm == m) for m in ("tuned", "baseline")}
    got = {r.model: r for r in E.summary(df).collect()}
    assert {m: got[m].pass_at_1 for m in n} == n and got["tuned"].n == 30
    delta = {r.metric: r.delta for r in E.model_deltas(df).collect()}
    assert delta["pass_at_1"] == n["tuned"] - n["baseline"]
    groups = E.pass_by_node_type(df).collect()
    assert [g.n for g in groups] == sorted((g.n for g in groups), reverse=True)
    last = max(r.passed for r in E.running_pass(df).where("model = 'tuned'").collect())
    assert last == n["tuned"]
    assert E.running_pass(df, every=10).count() == 6
    assert E.side_by_side(df).count() == 30
    assert [r.id for r in E.compact_results(df).orderBy("id").collect()] == list(range(30))
    document = E.result_document(df, "now").first().json
    assert '"total_samples":30' in document
    lines = [r.line for r in E.report_lines(df).orderBy("section", "ord").collect()]
    assert lines[0] == "# FIM Benchmark Report" and f"| pass@1 | {n['tuned']}/30 | {n['baseline']}/30 | {n['tuned'] - n['baseline']:+d} |" in lines
    assert E.summary(df.where("false")).count() == 0
    assert E.model_deltas(df.where("false")).where("metric = 'bleu_score'").first().tuned is None


def test_value_at(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    r = E.value_at(df, "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (r.p50, r.p99, r.n, r.avg) == (6.0, 10.0, 10, 5.5)


def test_generation(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id long, prompt string")
    got = G.complete(prompts, G.StubGenerator, "m", k=3).collect()
    assert len(got) == 2 and all(len(r.k_samples) == 3 and r.text not in r.k_samples for r in got)
    fields = "request_id string, prefix string, suffix string, max_tokens int, temperature double, stop_sequences array<string>"
    requests = spark.createDataFrame(
        [("a", "p", "s", None, None, None), ("b", None, "s", 0, 3.0, [""]), ("c", "p", "s", 2, 0.0, ["0", "1"])], fields
    )
    got = {r.request_id: r for r in G.serve(requests, G.StubGenerator, "m").collect()}
    assert got["a"].status == 200 and got["b"].status == 422
    assert got["b"].errors == ["prefix", "max_tokens", "temperature", "stop_sequences"]
    assert "0" not in got["c"].completion and "1" not in got["c"].completion
    r = G.prompt_response(G.serve(requests.limit(1), G.StubGenerator, "m"), 7).first()
    assert r.id == "cmpl-7" and r.usage.total_tokens == r.usage.completion_tokens and r.choices[0].finish_reason == "stop"
    G.check_round_trip(lambda t: list(t.encode()), lambda ids: bytes(ids).decode())
    with pytest.raises(ValueError):
        G.check_round_trip(lambda t: t.split(), lambda ids: " ".join(ids))


def test_keywords(spark):
    cases = spark.createDataFrame([Row(name="a", generated="x.Await", time_ms=2.0, expected_contains=[".await", "send"]), Row(name="b", generated="", time_ms=4.0, expected_contains=["q"])])
    results = E.keyword_results(cases)
    assert [r.passed for r in results.orderBy("name").collect()] == [True, False]
    s = E.keyword_summary(results).first()
    assert (s.passed, s.total, s.percent, s.avg_time_ms) == (1, 2, 50.0, 3.0)
    assert E.keyword_summary(results.where(F.lit(False))).first().percent is None
