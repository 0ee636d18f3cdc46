"""Scans, readers, writers and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomfill.sources import corpora as C
from loomfill.sources import repo_files as R
from loomfill.streaming import ingest


def put(root, **files):
    for name, data in files.items():
        path = root / name.replace("__DOT__", ".").replace("__SL__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def repo(tmp_path):
    files = {
        "a.py": "x = 1\r\ny = 2\r\n", "pkg/__init__.py": "", "_private/b.py": "b", ".hidden/c.py": "c", "bad.py": b"\xff\xfe",
        "build/d.py": "d", "keep/build.py": "k", "note.txt": "t", ".gitignore": "build/\n*.log.py\n!keep.log.py\n# note\n",
        "x.log.py": "l", "keep.log.py": "l",
    }
    for name, data in files.items():
        put(tmp_path, **{name: data})
    return tmp_path


def test_plain_scan(spark, repo):
    R.register(spark)
    rows = spark.read.format("repo_files").option("path", str(repo)).load().collect()
    got = {r.path: r.code for r in rows}
    assert set(got) == {"a.py", "pkg/__init__.py", "_private/b.py", ".hidden/c.py", "build/d.py", "keep/build.py", "x.log.py", "keep.log.py"}
    assert got["a.py"] == "x = 1\ny = 2\n"


def test_ignoring_scan(spark, repo):
    R.register(spark)
    read = spark.read.format("repo_files").option("path", str(repo)).option("rules", "ignore").option("newlines", "keep").option("filesPerPartition", 2)
    got = {r.path: r.code for r in read.load().collect()}
    assert set(got) == {"a.py", "pkg/__init__.py", "_private/b.py", "keep/build.py", "keep.log.py"}
    assert got["a.py"] == "x = 1\r\ny = 2\r\n"


def test_extensions_and_links(tmp_path):
    put(tmp_path, **{"r/a.rs": "", "r/b.py": "", "other/c.rs": ""})
    os.symlink(tmp_path / "other", tmp_path / "r/link")
    os.symlink(tmp_path / "r", tmp_path / "r/loop")
    root = str(tmp_path / "r")
    assert [os.path.relpath(p, root) for p in R.list_files(root, [".rs"], "ignore")] == ["a.rs", "link/c.rs"]
    assert len(R.list_files(root, [".rs", "s"], "all")) == 2  # listed once for each extension


@pytest.mark.parametrize(
    ("line", "path", "want"),
    [("*.o", "a/b.o", True), ("/x", "a/x", False), ("/x", "x", True), ("a/**/b", "a/q/r/b", True), ("a/**/b", "a/b", True), ("d?[!x]", "dab", True), ("d?[!x]", "dax", False), ("doc/**", "doc/a/b", True)],
)
def test_ignore_patterns(line, path, want):
    assert bool(R.ignore_pattern(line)[0].fullmatch(path)) == want


CORPUS = {
    "a.rs": {"code": "fn f() {}\n", "ast": [{"Function": {"name": "f", "span": "1:1", "body": "{ }", "params": [["x", "u8"]], "return_type": "()"}}]},
    "b.rs": {"code": "é", "ast": [{"Use": {"name": "u", "span": "1:1"}}]},
    "c.rs": {"code": "c"},
    "d.rs": {"ast": []},
}


def test_both_corpus_forms(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps(CORPUS))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"path": p, **d}) for p, d in CORPUS.items()) + '\n{"path": "\\u{7f}"}\n')
    one = C.read_corpus_map(spark, str(tmp_path / "map.json"))
    two = C.read_corpus_lines(spark, str(tmp_path / "lines.json"))
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, two.collect())) and len(rows) == 4
    node = one.where("path = 'a.rs'").first().nodes[0]
    assert node.node_type == "Function" and node.params[0].asDict() == {"name": "x", "type": "u8"}
    assert one.where("path = 'c.rs'").first().nodes == [] and one.where("path = 'd.rs'").first().code is None
    assert C.read_corpus_lines(spark, str(tmp_path / "lines.json"), keep_bad=True).where("bad IS NOT NULL").count() == 1
    C.write_corpus(one, str(tmp_path / "out"))
    assert sorted(map(str, C.read_corpus_lines(spark, str(tmp_path / "out")).collect())) == rows
    document = json.loads(C.corpus_document(one.where("path = 'a.rs'")).first().json)
    assert document["a.rs"]["ast"][0]["Function"]["params"] == [["x", "u8"]]
    with pytest.raises(FileNotFoundError):
        C.read_corpus_map(spark, str(tmp_path / "missing"))


def test_sample_files(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a\n", "b", "", "Use", "train"), ("q", "é", "m", "s", "Const", "test")], "file_path string, prefix string, middle string, suffix string, node_type string, split string")
    C.write_samples(rows, str(tmp_path / "ast"))
    back = C.read_splits(spark, str(tmp_path / "ast_train.jsonl"), str(tmp_path / "ast_test.jsonl"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def text_of(folder):
    return "".join((folder / n).read_text() for n in sorted(os.listdir(folder)) if n.startswith("part"))


def test_manifest_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(7, "Use", "p"), (3, "Fn", "q")], "original_index long, node_type string, file_path string")
    C.write_manifest(rows, str(tmp_path / "m"))
    assert text_of(tmp_path / "m") == "# original_index\tnode_type\tfile_path\n3\tFn\tq\n7\tUse\tp\n"
    C.write_report(spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "section long, ord int, line string"), str(tmp_path / "r"))
    assert text_of(tmp_path / "r") == "a\nb\n"


def test_config_and_model_file(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("model: {size: 7B}\ntraining: {epochs: 1, lr: 0.1}\n")
    config = C.merged_config(C.read_config(str(tmp_path / "c.yaml")), {"training.epochs": 3, "training.lr": None, "new.key": 1})
    assert config == {"model": {"size": "7B"}, "training": {"epochs": 3, "lr": 0.1}, "new": {"key": 1}}
    C.write_config(config, str(tmp_path / "d.yaml"))
    assert C.read_config(str(tmp_path / "d.yaml")) == config
    with pytest.raises(FileNotFoundError):
        C.model_file(str(tmp_path))
    (tmp_path / "final_model").mkdir()
    (tmp_path / "final_model" / "w").write_text("12345")
    made = C.model_file(str(tmp_path))
    assert made.startswith(f"FROM {tmp_path}/final_model\n") and made.count("PARAMETER stop") == 4 and '"""{{ .Prompt }}"""' in made
    assert C.folder_size(str(tmp_path / "final_model")) == 5


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"filePath": "p", "prefix": f"a{i}", "middle": "m", "suffix": "s", "nodeType": "Use"}) + "\n")
    samples = ingest.sample_stream(spark, str(folder))
    q = ingest.write_batches(samples, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).count() == 3
    timed = samples.withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert ingest.arrival_counts(timed, "ts").isStreaming
