"""Queries with SQL against it, sharding against a plain table, and edge cases that operators share."""

import hashlib
import os
import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfill.llm import bpe, common, quality, sharding, token_counts
from loomfill.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want))


def plain_table(shards, slots):
    """Shards claim by turns the next free slot of their own order of all slots."""
    orders = []
    for name in shards:
        d = hashlib.sha256(name.encode()).hexdigest()
        offset, step = int(d[:16], 16) % slots, int(d[16:32], 16) % (slots - 1) + 1
        orders.append(iter([(offset + k * step) % slots for k in range(slots)]))
    owner = {}
    while True:
        for i, order in enumerate(orders):
            owner[next(slot for slot in order if slot not in owner)] = shards[i]
            if len(owner) == slots:
                return owner


@needs_tables
def test_sharding_query(spark):
    owner = plain_table([f"shard-{i:04d}" for i in range(64)], 65_537)
    got = QUERIES["op3_sharding"](spark, DATA).collect()
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in got) == ids
    for r in got:
        slot = int.from_bytes(hashlib.md5(str(r.doc_id).encode()).digest()[:4], "big") % 65_537
        assert (r.slot, r.shard) == (slot, owner[slot])


def odd_documents(spark):
    long = " ".join(random.Random(2).choices(["river", "stone", "light", "morning"], k=60_000))
    rows = [(1, "the river and the light", "en", "a", 1), (1, "the river and the light", "en", "a", 1), (1, "another text under this id", None, None, None), (None, "no id here at all", "en", "b", 2)]
    rows += [(None, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "b", len(long)), (4, long + " end", "en", "b", 0), (5, "THE RIVER and the light", "en", "a", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    bad = spark.range(1).select(F.lit(9).cast("long").alias("doc_id"), F.unhex(F.lit("fffe61206220")).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("b").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    return frame.unionByName(bad)


@needs_tables
def test_stages_take_odd_documents(spark, tmp_path):
    clashes = {"mix_key": F.lit("k"), "copy_key": F.lit(1), "near_key": F.lit(2), "fit_id": F.lit(3), "node": F.lit("n"), "n": F.lit(4), "draws": F.lit(5), "size": F.lit(6), "held_out": F.lit(True), "n_tokens": F.lit(7)}
    docs = odd_documents(spark).withColumns(clashes)
    rows = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / f"{k}"))
        done = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert done.columns == docs.columns, name
        rows.append(done.count())
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.count() == 0 and (k == 4 or empty.columns == docs.columns)
        if k != 0:  # the classifier may reject any; the others work on all of these
            docs = done
    assert rows[1] == 7 and rows[2] == 6  # of ten: one text three times, null and empty; then the long ones
    assert rows[4] == rows[3]


def test_quality_takes_any_bytes(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    scores = quality.score_documents(docs.withColumn("score", F.lit(1)), labels).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
    assert quality.keep_good(docs, labels).count() == sum(r.predicted for r in scores)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality", 100, 1_000)
    assert sum(len(r.fit_text) for r in rows) <= 1_000 and len({r.fit_id for r in rows}) == len(rows)
    # Words end at ASCII white space only.
    model = quality.fit([b"a b", b"c d"] * 5, [0, 1] * 5)
    assert model.scorer()("x\u00a0y".encode()) != model.scorer()(b"x y")


def test_counts_and_tokens_of_odd_documents(spark):
    pytest.importorskip("public_tokenizers")
    path, pattern = bpe.vocabulary()
    docs = odd_documents(spark).withColumns({"ids": F.lit(1), "n_tokens": F.lit("x")})
    tokens = bpe.round_trip(docs, path, pattern).collect()
    counts = token_counts.count_with_edits(docs, token_counts.redactions(), path, pattern).collect()
    assert sorted(r.n_tokens for r in tokens) == sorted(r.n_tokens for r in counts) and len(tokens) == 10
    assert token_counts.count_with_edits(docs.limit(0), token_counts.redactions(), path, pattern).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_with_edits(docs, token_counts.redactions(), path, r"\w+")


def test_shared_folder_is_named_or_local(monkeypatch):
    monkeypatch.setattr(common, "atexit", SimpleNamespace(register=lambda *a: None))

    def folder(master, conf, checkpoint=None):
        monkeypatch.setattr(common, "_folders", {})
        given = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
        context = SimpleNamespace(applicationId="app", master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: given)))
        return common.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf)))

    assert folder("spark://x:7077", "hdfs://a/b/") == "hdfs://a/b/loomfill-app"
    assert folder("yarn", None, "s3a://c/d") == "s3a://c/d/loomfill-app"
    assert folder("local[8]", None).startswith("file://")
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            folder(master, None)


def test_key_chunks():
    import pyarrow as pa

    rng = random.Random(4)
    keys = sorted(rng.choices(range(40), k=1000))
    table = pa.table({"k": keys, "v": list(range(1000))})
    for step in (1, 7, 300):
        chunks = list(common.key_chunks(iter(table.to_batches(max_chunksize=step)), 0, 100))
        assert pa.concat_tables(chunks).to_pydict() == table.to_pydict()
        seen = [set(c["k"].to_pylist()) for c in chunks]
        assert sum(map(len, seen)) == len(set().union(*seen)) and len(chunks) > 3
        assert max(map(len, chunks)) < 100 + 300 + 60
    assert list(common.key_chunks(iter([]))) == []


@pytest.mark.parametrize("bound", [0, 1 << 25])
def test_look_up(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    found = common.written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most")), "found")
    got = {(r.id, r.most) for r in common.look_up(rows, found, ["k"], "n").collect()}
    most = {}
    for i in range(1000):
        most[0 if i % 3 == 0 else i % 50] = i
    assert got == {(i, most[0 if i % 3 == 0 else i % 50]) for i in range(1000)}
    assert common.look_up(rows, found, ["k"], "n", F.xxhash64("id")).count() == 1000
