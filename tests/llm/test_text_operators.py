"""Exact dedup, URL filter, sharding, quality, BPE and token counts on edge cases and against plain versions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomfill.llm import bpe, quality, sharding, token_counts, url_filter
from loomfill.llm.exact_dedup import drop_copies, exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)


EDGE = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "a b"), (9, "a b"), (None, "A B"), (None, "lone")]


def test_exact_dedup(spark):
    got = exact_dedup(docs(spark, EDGE).withColumns({"norm": F.lit(1), "digest": F.lit(2), "salt": F.lit(3)})).collect()
    by = {}
    for i, t in EDGE:
        by.setdefault((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), []).append(i)
    want = []
    for norm, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup(docs(spark, [])).count() == 0
    unique = [(i, t) for i, t in EDGE if i is not None][:9]
    assert sorted(r.doc_id for r in drop_copies(docs(spark, unique)).collect()) == [4, 5, 6, 8, 9]


def test_drop_copies_of_odd_ids(spark):
    rows = [*EDGE, (9, "lone too"), (5, "a B"), (None, "x" * 200_000), (None, None)]
    for given in (rows, [(None, t) for _, t in rows]):
        by = {}
        for i, t in given:
            norm = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            by[norm] = max(by.get(norm, -1), -1 if i is None else i)
        kept = drop_copies(docs(spark, given).withColumn("keep_id", F.lit("own")))
        assert kept.columns == [*docs(spark, []).columns, "keep_id"]
        got = sorted(((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), -1 if r.doc_id is None else r.doc_id) for r in kept.collect())
        assert got == sorted(by.items())


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), action == "block", rule, action))
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_filter(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.www.Example.COM", "net", "x.net", "xnet", "com", "", "a..com", "example.com:80", "é.net"]
    urls = [None, "", "no scheme", "http:/x", "a://b://c.com/en/", "http://example.com", "http://example.com?x=/en/", "http://example.com#/en/", "http://net/es/" + "x" * 50_000]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/', '/en/a?b#c', '?q', '#f'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    for rules in (url_filter.RULES, [("block", "com/e"), ("allow", "com/en"), ("block", "b.example.com/"), ("allow", "example.com/")], []):
        for bound in (100, 0):
            table = spark.createDataFrame(rules, "action string, rule string")
            got = url_filter.judge_urls(pages, table, broadcast_rules=bound).collect()
            want = [(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)]
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    full = sharding.lookup_table(names, 1009)
    counts = [int((full == i).sum()) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert ((full != fewer) & (full != 6)).mean() < 0.1  # few others move
    weighted = sharding.lookup_table(names[:2], 1009, [2, 1])
    assert abs(int((weighted == 0).sum()) - 2 * 1009 / 3) < 3
    for bad in ([["a"], 10], [["a", "a"], 11], [[], 11]):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    shards = [f"s{i}" for i in range(5)]
    df = spark.createDataFrame([(i, i) for i in range(300)] + [(None, 1), (7, 2)], "k long, slot int")
    got = sharding.place(df, "k", shards, 101).collect()
    table = sharding.lookup_table(shards, 101)
    assert len(got) == 302
    for r in got:
        slot = int(hashlib.md5(b"" if r.k is None else str(r.k).encode()).hexdigest()[:8], 16) % 101
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.place(df.limit(0), "k", shards, 101).count() == 0


def labelled(n, rng):
    good = "the of and river water light house garden morning".split()
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(good) + "x" * rng.randint(0, 2) for _ in range(rng.randint(5, 60))]
        kind = rng.randint(0, 1)
        if bad:
            words = [w + "###" for w in words] if kind else [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(900, random.Random(3))
    extra = [(10_000, None), (10_001, ""), (10_002, "w " * 50_000), (None, "the river"), (5, rows[5][1])]
    frame = docs(spark, rows + extra)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_documents(frame, marks).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    same = {r.score for r in got if r.doc_id in (10_000, 10_001)}
    assert len(same) == 1
    kept = quality.keep_good(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in got)
    none = marks.where("false")
    assert {r.score for r in quality.score_documents(frame, none).collect()} == {0.5}
    # Labels of held-out rows never count.
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_documents(frame, flipped).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    pytest.importorskip("public_tokenizers")
    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(path)
    return path, pattern, bpe.Encoder(bpe.Tables(ranks, pattern)), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, n):
    return "".join(rng.choices(list("aeionstr THE  \n\t01,.'é漢한م🙂") + ["'re", "tion", "   "], k=rng.randint(0, n)))


def test_encoder(tokenizer):
    _, _, own, reference = tokenizer
    rng = random.Random(8)
    tokens = list(own.ranks)
    texts = [random_text(rng, 80) for _ in range(500)] + ["a" * 5000, "abc" * 3000, " " * 1000 + "x", "\u0000", "<|endoftext|>"]
    texts += [b"".join(rng.choices(tokens, k=8)).decode("utf-8", "replace") for _ in range(500)]
    for t in texts:
        ids = own.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_byte_tables():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    tables = bpe.Tables(ranks, r"\S+|\s+")
    own = bpe.Encoder(tables)
    for text in ("abc", "aabc", "abcabc", "aaaa", "aaa", "bcab", "aaabcbcc"):
        assert own.encode(text) == ([ranks[text.encode()]] if text.encode() in ranks else bpe.merge_pairs(text.encode(), ranks))
    with pytest.raises(ValueError):
        bpe.Tables({b"a": 0}, ".")


def test_bpe_in_workers(spark, tokenizer):
    path, pattern, own, reference = tokenizer
    rows = [(1, "Hello the world"), (2, None), (3, ""), (None, "x"), (1, "Hello the world"), (4, "wörd " * 20_000)]
    got = bpe.round_trip(docs(spark, rows), path, pattern).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    encoded = bpe.encode_documents(docs(spark, rows), path, pattern)
    assert sorted(bytes(r.bytes).decode() for r in bpe.decode_documents(encoded, path, pattern).collect()) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(docs(spark, []), path, pattern).count() == 0


def test_counts_follow_edits(tokenizer):
    _, _, own, reference = tokenizer
    rng = random.Random(4)
    for _ in range(600):
        text = random_text(rng, 60)
        tree = token_counts.CountTree(text, own)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 6))
            new = random_text(rng, 6)
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.n_tokens == len(reference.encode_ordinary(text)) and tree.n_chars == len(text)
    with pytest.raises(ValueError):
        tree.edit(0, len(text) + 1, "")
    with pytest.raises(ValueError):
        token_counts.CountTree("abcdef", own).apply([(0, 3, ""), (2, 4, "")])
    long = token_counts.CountTree("word " * 20_000, own)
    long.edit(50_000, 50_001, "x")
    assert long.recounted < 100


def test_counts_in_workers(spark, tokenizer):
    path, pattern, own, reference = tokenizer
    rows = [(1, "mail a.b@c.org now"), (2, None), (3, ""), (4, "call +1 555 123 4567!"), (None, "none"), (1, "mail a.b@c.org now")]
    got = {(r.doc_id, r.n_chars): r for r in token_counts.count_with_edits(docs(spark, rows), token_counts.redactions(), path, pattern).collect()}
    for i, t in rows:
        r, t = got[i, len(t or "")], t or ""
        after = t
        for a, b, m in reversed(token_counts.redactions()(t)):
            after = after[:a] + m + after[b:]
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (len(reference.encode_ordinary(t)), len(reference.encode_ordinary(after)), len(after))
    assert got[4, 21].n_edits == 1
