"""Mixing, Jaccard join, nearest neighbours, repeated strings and the pipeline against plain versions."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomfill.llm import ann, bpe, exact_dedup, jaccard, mixing, quality, repeats
from loomfill.llm.common import written
from loomfill.llm.components import components
from loomfill.llm.suffix_array import permuted_common_prefixes, suffix_array

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def noisy(rng, words, share):
    return [rng.choice(["q", "r", "z"]) + str(rng.random()) if rng.random() < share else w for w in words]


def corpus(seed, families=6, copies=12, singles=30):
    """Near copies around bases, a passage that many texts share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = [word() for _ in range(40)]
    texts = ["", None, " \n", "a", "a b", "A  B", "a b c", "a b c", "x" * 50_000, "w " * 3000]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([12, 40, 150, 400]))]
        texts += [" ".join(noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04]))) for _ in range(copies)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 60))]) for _ in range(singles)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, rng.choice(["s0", "s0", "s1", "s2", None])) for i, t in enumerate(texts)]


def plain_components(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 512), (5, 80, 512), (2, 70, 512), (3, 90, 4), (3, 90, 5)])
def test_jaccard(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    if block < 9:
        monkeypatch.setattr(jaccard, "GROUP", 2)
        monkeypatch.setattr(jaccard, "ASKING", 3)
    if block == 5:  # as with tables beyond the bound of broadcasts
        monkeypatch.setattr("loomfill.llm.common.BROADCAST_BYTES", 0)
        monkeypatch.setattr("loomfill.llm.common.HOT_KEYS", 20)
    rows = corpus(percent + block)
    got = jaccard.jaccard_components(docs(spark, rows).withColumns({"node": F.lit(1), "n": F.lit(2)}), width=width, percent=percent).collect()
    want = plain_components(rows, width, percent)
    assert sorted(map(tuple, got)) == want
    assert sum(c != i for i, _, c in want) > 10


def test_jaccard_edges(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (None, "a b c d e f g", "s"), (None, "lone words only here now ok", "s"), (4, None, None)]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == Counter({(1, 3, 1): 2, (None, 3, 1): 1, (None, 2, None): 1, (4, 0, 4): 1})
    kept = jaccard.keep_first(docs(spark, [(3, "a b c d e f", "s"), (2, "A b c d e f", "s"), (5, "", "s"), (6, None, "s")]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]
    with pytest.raises(ValueError):
        jaccard.Router(50)


def test_keep_first_of_odd_ids(spark):
    near = "a b c d e f"
    rows = [(7, near, "s"), (7, near, "s"), (7, "A b c d e f", "s"), (3, "k l m n o p", "s"), (7, "k l m n o p", "s"), (None, near, "s")]
    rows += [(None, "only one of its kind here", "s"), (None, "and one more of its own", "s"), (7, "lone words under this id", "s"), (8, "", "s"), (8, "", "s"), (None, None, "s"), (None, None, "s")]
    kept = jaccard.keep_first(docs(spark, rows))
    got = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    want = [(7, near), (3, "k l m n o p"), (None, "only one of its kind here"), (None, "and one more of its own"), (7, "lone words under this id"), (8, ""), (None, "")]
    assert got == Counter(want) and kept.columns == docs(spark, []).columns


def test_links_come_from_opened_groups(spark, monkeypatch):
    rows = corpus(93)
    frame = docs(spark, rows)
    names = written(jaccard._map_sets(frame.select("doc_id", "text"), 3, whole=False), "names")
    assert jaccard.node_links(frame.select("doc_id", "text"), names, 3, 90).count() > 10
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    near = [np.unique(np.concatenate([base[: 200 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(1, 6)]
    far = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(3)]
    got = jaccard.cell_links([base, *far], [*near, *far, base], [-1] * 5 + [1, 2, 3, 0], 90)
    assert got == [(k, 0) for k in range(5)]
    opened = []
    monkeypatch.setattr(jaccard.Group, "overlaps", lambda self, tokens, needed: opened.append(1))
    assert jaccard.cell_links([base], near, [-1] * 5, 90) == [] and len(opened) == 5  # nothing opens, nothing links


def test_router_never_misses():
    rng = np.random.default_rng(1)
    for percent in (70, 80, 90, 95):
        route, seen = jaccard.Router(percent), 0
        for _ in range(400):
            n = int(rng.integers(1, 400))
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            d = route.apart(n, n) // 2
            other = np.unique(np.concatenate([base[rng.permutation(len(base))[: len(base) - int(rng.integers(0, d + 1))]], rng.integers(0, 1 << 63, int(rng.integers(0, d + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if len(base) == len(other) == shared or not jaccard.linked(shared, len(base), len(other), percent):
                continue
            seen += 1
            assert len(np.intersect1d(route.hashes(base), route.hashes(other)))
        assert seen > 50


def test_components(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(110)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [(None, "x")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def plain_targets(sizes, weights):
    total, targets = 1.5 * sum(sizes), None
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        targets = [2 * s for s in sizes]
        for i in free:
            targets[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if targets[i] > 2 * sizes[i]]
        if not over:
            return targets
        capped |= set(over)


def test_targets():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 5000]) for _ in range(rng.randint(1, 9))]
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
        got, want = mixing.water_fill(sizes, weights, 1.5 * sum(sizes)), plain_targets(sizes, weights)
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want))


def dense(dealt, n):
    out = np.zeros((len(dealt), n), np.int64)
    for row, (some, quota) in zip(out, dealt):
        row[some] = quota
    return out


def test_split_quotas():
    quotas = np.array([100, 3, 0, 57])
    got = dense(mixing.split_quotas(quotas, 7, 1), 4)
    assert (got.sum(axis=0) == quotas).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 3
    assert (got == dense(mixing.split_quotas(quotas, 7, 1), 4)).all() and not (got == dense(mixing.split_quotas(quotas, 7, 2), 4)).all()
    # A draw of the marginals: over many seeds a shard's share of a source follows the source's share.
    mean = np.mean([dense(mixing.split_quotas(quotas, 4, seed), 4) for seed in range(200)], axis=0)
    assert np.abs(mean - quotas / 4).max() < 1.5


def test_the_tree_deals_the_mix(spark, monkeypatch, tmp_path):
    rng = random.Random(17)
    rows = [(i, " ".join(["w"] * rng.randint(5, 40)), rng.choice("ab")) for i in range(600)]
    rows.append((999, "w " * 5_000, "b"))  # a long one
    frame = docs(spark, rows).withColumns({"mix_shard": F.lit("own"), "drawn": F.lit(1)})
    options = {"block_words": 200, "shards": 8}
    sizes = {r.doc_id: r for r in mixing.mixed_sizes(frame, **options).collect()}
    shards = Counter(d.shard for r in sizes.values() for d in r.draws)
    assert len(shards) == 8
    mixed = mixing.mix(frame, **options)
    assert mixed.columns.count("mix_shard") == 1
    mixing.write_mix(mixed, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert Counter((r.doc_id, r.mix_shard, r.mix_position) for r in back) == Counter((i, d.shard, d.position) for i, r in sizes.items() for d in r.draws)
    # Blocks of a shard are disjoint: it draws no document twice in one epoch, and each shard is one sorted file.
    for name in os.listdir(tmp_path / "mix"):
        if name.startswith("mix_shard="):
            positions = [r.mix_position for r in spark.read.parquet(str(tmp_path / "mix" / name)).coalesce(1).collect()]
            assert positions == sorted(positions) and len([f for f in os.listdir(tmp_path / "mix" / name) if f.endswith(".parquet")]) == 1
    # Without the tree's draws there is another mix.
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: [(np.arange(len(quotas)), np.asarray(quotas))])
    assert {d.shard for r in mixing.mixed_sizes(frame, **options).collect() for d in r.draws} == {0}
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: [])
    assert sum(r.taken for r in mixing.mixed_sizes(frame, **options).collect()) == 0
    with pytest.raises(ValueError):
        mixing.mixed_sizes(frame, max_sources=1)


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "B", "é", None])) for i in range(1200)]
    rows += [(5000, None, "a"), (5001, "", "B"), (None, "x y", "a"), (7, "u v w", "B"), (7, "u v w", "B")]
    frame = docs(spark, rows).withColumns({"size": F.lit("x"), "target": F.lit(1)})
    got = mixing.mixed_sizes(frame, block_words=400).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(frame, block_words=400).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert order == ["B", "a", "é", None]
    targets = dict(zip(order, plain_targets([sizes[s] for s in order], [3.0, 1.0, 2.0, 3.0])))
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[round(r.target, 6)] += r.taken
    for s in order:
        assert abs(taken[round(targets[s], 6)] - targets[s]) <= 40
    mixed = mixing.mix(frame, block_words=400)
    assert mixed.columns == [*frame.columns, "mix_shard", "mix_position"]
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mixed_sizes(frame.limit(0)).count() == 0
    empty = docs(spark, [(1, None, None), (2, "", "a")])
    assert [r.taken for r in mixing.mixed_sizes(empty).collect()] == [0, 0]


def test_mixing_fills_past_a_long_document(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(20, 60)), "a") for i in range(500)]
    rows.append((9000, "w " * (sum(len(t.split()) for _, t, _ in rows) // 2), "a"))  # a third of all words
    rows += [(None, "w " * n, "a") for n in (31, 32, 32, 33)]
    frame = docs(spark, rows)
    seen = 0
    for seed in range(8):
        got = mixing.mixed_sizes(frame, block_words=600, seed=seed).collect()
        gap = got[0].target - sum(r.taken for r in got)
        copies = max(r.copies for r in got)
        least = min(r.size for r in got if r.copies < copies)
        assert -1 < gap < least + 1, (seed, gap)
        assert copies <= 2
        seen += next(r.copies for r in got if r.doc_id == 9000) == 1
        drawn = Counter((r.doc_id, len(r.text.split())) for r in mixing.mix(frame, block_words=600, seed=seed).select("doc_id", "text").collect())
        assert drawn == Counter((r.doc_id, r.size) for r in got for _ in range(r.copies))
    assert seen  # the long document crosses the target


def plain_search(ids, vectors, queries, k):
    out = []
    for q in queries:
        s = (vectors * vectors[ids.index(q)]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out += [(q, r + 1, ids[i], float(s[i])) for r, i in enumerate(order)]
    return out


def test_search_edges(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8)).astype(np.float32)
    v[40:90] = v[40]  # one vector many times: ties go to the smaller id
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)]
    odd = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [1.0] * 3), (505, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (40, rows[40][1]), (506, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=20, goal=1.0, max_parts=1).collect()
    want = plain_search(list(range(120)), v.astype(np.float64), range(0, 120, 20), 20)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    assert all(abs(a.score - b[3]) < 1e-12 for a, b in zip(sorted(got, key=lambda r: (r.query_id, r["rank"])), sorted(want)))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, few, k=20).count() == 6
    assert ann.search(few.limit(0), few).count() == 0


def recall(found, ids, v, queries, k=20):
    got, want = defaultdict(set), defaultdict(set)
    for q, i in found:
        got[q].add(i)
    for q, _, i, _ in plain_search(ids, v, queries, k):
        want[q].add(i)
    assert all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len(got[q] & want[q]) / len(want[q]) for q in want])


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_search_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "BLOCK", 700)
    rng = np.random.default_rng(3)
    n = 3000
    v = rng.normal(size=(n, 16))
    if kind != "noise":
        centres = rng.normal(size=(30, 16))
        v = centres[rng.integers(0, 30, n)] + 0.2 * v
    if kind == "copies":
        v[: n // 3] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "vec_id long, embedding array<double>")
    found = ann.search(frame, frame.where("vec_id % 50 = 0"), k=20, part_rows=200)
    assert recall([(r.query_id, r.vec_id) for r in found.collect()], list(range(n)), v, range(0, n, 50)) >= 0.9
    index = ann.fit_index(v, 15)
    assert index.parts == 15 or kind == "copies"
    if kind == "clusters":  # sure of its parts: visits are few
        assert index.visits(v).mean() < 0.4


def test_short_queries_visit_every_part(spark, monkeypatch):
    monkeypatch.setattr(ann.Index, "visits", lambda self, v, sizes=None, least=0: np.eye(self.parts, dtype=bool)[self.part(v)] | (least > 100))
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 4))
    frame = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(frame, frame.where("vec_id < 9"), k=85, part_rows=30).collect())
    assert got == Counter({i: 85 for i in range(9)})


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_search_recall_on_tables(spark, sf):
    got = [(r.query_id, r.vec_id) for r in ann.op5_nearest_neighbours(spark, f"/root/testdata/sf{sf}").collect()]
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect() if r.embedding and None not in r.embedding}
    ids = sorted(i for i, x in rows.items() if np.isfinite(x).all() and any(x))
    v = np.array([rows[i] for i in ids], np.float64)
    assert recall(got, ids, v, [i for i in ids if i % 20 == 0]) >= 0.9


def test_balanced_parts():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(500, 6))
    label = ann.balanced_parts(v, ann.neighbour_graph(v, 5), 8, rng)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1.1 * 500 / 8) + 1
    assert ann.pack_parts({0: 5, 1: 6, 2: 30, 3: 1}, 10) == ({0: 0, 1: 1, 2: 2, 3: 1}, {0: 1, 1: 1, 2: 3})


@pytest.mark.parametrize("thin", [1, 64])
def test_suffix_array(monkeypatch, thin):
    monkeypatch.setattr("loomfill.llm.suffix_array.THIN", thin)
    rng = random.Random(9)
    texts = [b"", b"a", b"a" * 300, b"ab" * 200, b"abc" * 90 + b"x" + b"abc" * 80]
    texts += [bytes(rng.choices(range(97, 97 + rng.choice([1, 2, 4, 26])), k=rng.randint(1, 500))) for _ in range(60)]
    for b in texts:
        t = np.frombuffer(b, np.uint8)
        array = suffix_array(t, 256 if thin == 64 else 123)
        assert array.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = permuted_common_prefixes(t, array)
        for x, y in zip(array, array[1:]):
            assert shared[y] == len(os.path.commonprefix([b[x:], b[y:]]))


def plain_repeats(rows, span):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - span + 1):
            s = b[p : p + span]
            if s in seen:
                covered[p : p + span] = b"\1" * span
            seen.add(s)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((i, len(b), sum(covered), spans, kept))
    return sorted(out)


def repeated_corpus(rng):
    piece = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [piece(rng.choice([60, 99, 100, 140, 400])) for _ in range(6)]
    texts = ["", None, "x", "a" * 900, "ab" * 300, "word " * 200, "line of text\n" * 40, passages[3], passages[3]]
    for _ in range(60):
        texts.append("".join(rng.choice([piece(rng.randint(1, 80)), rng.choice(passages)]) for _ in range(rng.randint(1, 7))))
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats(spark, monkeypatch, hot):
    if hot == 3:
        monkeypatch.setattr(repeats, "PIECE", 30)
    rows = repeated_corpus(random.Random(hot))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"order": F.lit("x"), "spans": F.lit(1)}).repartition(3)
    got = repeats.remove_repeats(frame, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_repeats(rows, 100)


def test_runs_of_long_texts_are_bounded():
    for text in (b"a" * 300_000, b"abcab" * 40_000):
        key, mark, start, size = repeats.find_runs(text)
        assert np.abs(size).max() < repeats.PIECE + 100 and len(set(zip(mark.tolist(), size.tolist()))) < 20
        assert (np.diff(start) > 0).all() and start[-1] + abs(size[-1]) == len(text)


def test_repeats_of_one_byte(spark):
    rows = [(1, "a" * 300_000), (2, "a" * 99), (3, "ab" * 5000)]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 299_999, 2: 0, 3: 9_998}  # all but the first string's start


def test_repeats_edges(spark):
    text = "some text that is long enough to be found again because it has more than a hundred bytes in it, surely so"
    rows = [(5, text), (5, text), (None, text), (3, text + " and more"), (9, "short")]
    got = Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, len(text)): 2, (None, len(text)): 1, (3, 0): 1, (9, 0): 1})
    for hot in (1, 20_000):
        rows = [(1, text), (1, text), (2, text + "x" * 200), (2, text + "x" * 200)] + [(i, f"{i} " * 40 + text) for i in range(3, 9)]
        got = Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect())
        plain = plain_repeats(sorted(set(rows)), 100)
        assert got == Counter({(i, gone): 2 if i < 3 else 1 for i, _, gone, *_ in plain})
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_tables_outlive_their_source(spark):
    df = written(spark.range(10).where("id > 100"), "none")
    assert df.count() == 0 and df.columns == ["id"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    all_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs_now, tables = all_docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs_now, SMALL).write.parquet(str(tmp_path / str(k)))
        tables[k] = docs_now = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs_now.columns == all_docs.columns
    # Classifier: the rows that score well, and none of the others.
    good = {r.doc_id for r in quality.score_documents(all_docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in tables[0].collect()} == good
    # Copies: the largest id of equal texts.
    by = defaultdict(list)
    for r in tables[0].collect():
        by[r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))].append(r.doc_id)
    assert {r.doc_id for r in tables[1].collect()} == {max(v) for v in by.values()}
    # Near copies: the smallest id of each component.
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    assert {r.doc_id for r in tables[2].collect()} == {c for _, _, c in plain_components(rows, 5, 80)}
    # Mix: as often as the sizes say.
    copies = Counter(r.doc_id for r in tables[3].collect())
    want = {r.doc_id: r.copies for r in mixing.mixed_sizes(tables[2]).collect() if r.copies}
    assert dict(copies) == want
    # Tokens of every drawn row.
    path, pattern = bpe.vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in tables[3].collect()}
    assert Counter(r.doc_id for r in tables[4].collect()) == copies
    for r in tables[4].collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, tables[4].collect()))
    assert exact_dedup.exact_dedup(tables[1]).where("NOT kept").isEmpty()
