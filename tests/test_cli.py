"""From a source tree to a report, by the command line's functions."""

import json
import os

import pytest

from loomfill.__main__ import _numbered, main
from loomfill.operators import generate, quick
from loomfill.sources import corpora


def lines(folder):
    return [line for n in sorted(os.listdir(folder)) if n.startswith("part") for line in (folder / n).read_text().splitlines()]


def test_source_tree_to_report(spark, tmp_path, capsys):
    src = tmp_path / "src"
    (src / "m").mkdir(parents=True)
    for i in range(4):
        body = "".join(f"fn f{k}(x: u8) -> u8 {{\n    x + {k}\n}}\n" for k in range(40))
        (src / "m" / f"{i}.rs").write_text(body)
    (src / "bad.rs").write_text("fn f( {")
    main(["extract", str(src), str(tmp_path / "ast"), "--language", "rust"])
    assert {json.loads(x)["path"] for x in lines(tmp_path / "ast")} == {f"m/{i}.rs" for i in range(4)}
    main(["datagen", "--ast", str(tmp_path / "ast"), "--output_prefix", str(tmp_path / "out")])
    train, test = (lines(tmp_path / f"out_{s}.jsonl") for s in ("train", "test"))
    assert len(train) == 3 * 80 and len(test) == 80  # a block and a body block each
    main(["text", "--data", str(tmp_path / "out_train.jsonl"), "--output", str(tmp_path / "text"), "--max_samples", "7"])
    assert len(lines(tmp_path / "text")) == 7
    main(["benchmark", "--test_data", str(tmp_path / "out_test.jsonl"), "--max_samples", "9", "--output", str(tmp_path / "b"), "--k", "2"])
    document = json.loads(lines(tmp_path / "b" / "results")[0])
    assert document["metadata"]["total_samples"] == 9 == len(document["results"])
    assert len(lines(tmp_path / "b" / "manifest")) == 10 and len(lines(tmp_path / "b" / "compact")) == 9
    ids = [json.loads(x)["sample_id"] if "sample_id" in x else None for x in lines(tmp_path / "b" / "compact")]
    assert len(ids) == 9
    capsys.readouterr()
    main(["summary", str(tmp_path / "b" / "results")])
    results = document["results"]
    passed = {m: sum(r[f"{m}_metrics"]["pass_at_1"] for r in results) for m in ("tuned", "baseline")}
    mean = {m: sum(r[f"{m}_metrics"]["edit_similarity"] for r in results) / 9 for m in passed}
    want = f"pass@1 tuned {passed['tuned']}/9 ({passed['tuned'] / 9 * 100:.1f}%) vs base {passed['baseline']}/9 ({passed['baseline'] / 9 * 100:.1f}%) | edit-sim {mean['tuned']:.3f} vs {mean['baseline']:.3f}"
    assert capsys.readouterr().out.strip().splitlines()[-1] == want
    main(["infer", "--test_data", str(tmp_path / "out_test.jsonl"), "--max_samples", "5", "--output", str(tmp_path / "infer.json"), "--k", "2"])
    rows = json.loads((tmp_path / "infer.json").read_text())
    assert [r["id"] for r in rows] == list(range(5)) and {"pass@1", "pass@5", "edit_sim", "time"} <= set(rows[0]["tuned"])
    out = capsys.readouterr().out
    assert "RESULTS (5 samples)" in out and "TUNED: pass@1=0/5 (0.0%)" in out and "infer.json" in out
    main(["extract", str(src), "-", "--language", "rust"])
    printed = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert sorted(map(str, printed)) == sorted(map(str, map(json.loads, lines(tmp_path / "ast"))))
    with pytest.raises(FileNotFoundError):
        main(["datagen", "--ast", str(tmp_path / "missing")])


def test_quick_cases(spark):
    class Echo:
        def complete(self, prompt, draw, max_tokens, temperature, top_p):
            return "SELF.amount\n\niter", 3

    got = {r.name: r for r in quick.run(spark, Echo).collect()}
    assert len(got) == 8 and got["Rust: Struct field access"].passed and not got["Rust: Simple function body"].passed
    assert got["Rust: Match arm"].generated == "SELF.amount"
    assert quick.run(spark, generate.StubGenerator).count() == 8


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"filePath": f"{name}{i}", "prefix": "", "middle": "m", "suffix": "", "nodeType": "Use"}) + "\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r.sample_id: r.file_path for r in _numbered(spark, corpora.read_samples(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: f"{'ab'[k // 300]}{k % 300}" for k in range(600)}


def test_tokenizer_check(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    main(["check-tokenizer", tokenizers.path("byte_bpe_50k.json")])
    with pytest.raises(ValueError):
        main(["check-tokenizer", tokenizers.path("word_bpe_49k.json")])
