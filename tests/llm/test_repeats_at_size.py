"""What operator 6 sends and leaves on disk where common passages and large tables would make it much."""

import random
import time

import numpy as np
import pytest

from loomfill.llm import common, repeats


def shuffle_blocks(spark):
    names = spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(",").split(",")
    return {n for n in names if n.startswith("shuffle_")}


def test_files_of_a_finished_shuffle_go_at_once(spark):
    old = shuffle_blocks(spark)
    kept = common.written(spark.range(10_000).repartition(4, "id"), "moved")
    assert shuffle_blocks(spark) - old
    common.free_shuffles(spark)
    for _ in range(20):
        if not (left := shuffle_blocks(spark) - old):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 10_000


def test_copies_of_a_hot_passage_come_as_stretches(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(100))
    # Different ends of few bytes make different runs of the passage's keys, so that they turn hot.
    rows = [(i, " ".join((word(), passage[: 650 - rng.randrange(60)], word()))) for i in range(60)]
    seen = []

    def look(fetched, span, resolve=repeats._resolve):
        seen.extend(r.kind for r in fetched.select("kind").collect())
        return resolve(fetched, span)

    monkeypatch.setattr(repeats, "_resolve", look)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame, hot=1).collect()}
    known, want = set(), {}
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            if text[k : k + 100] in known:
                gone[k : k + 100] = True
            known.add(text[k : k + 100])
        want[i] = (int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()))
    assert got == want
    covered = seen.count(repeats.COVERED)
    assert seen.count(repeats.SINGLY) and 0 < covered <= 20 * len(rows)  # and not one for each of some hundred strings of a row


@pytest.mark.parametrize(("starts", "want"), [([], []), ([5], [(5, 10)]), ([0, 1, 11, 22], [(0, 21), (22, 10)])])
def test_stretches(starts, want):
    n = len(starts)
    order, twin, start, size = repeats._stretches(np.zeros(n, np.int64), np.zeros(n, np.int64), np.array(starts, np.int64), 10)
    assert list(zip(start.tolist(), size.tolist())) == want


def test_stretches_stay_in_their_document():
    got = repeats._stretches(*(np.array(x, np.int64) for x in ([2, 1, 1, 1], [0, 0, 7, 0], [4, 3, 4, 2])), 10)
    assert [x.tolist() for x in got] == [[1, 1, 2], [0, 7, 0], [2, 4, 4], [11, 10, 10]]


def test_texts_are_not_joined_by_broadcast_of_what_grows_with_them(spark):
    texts = spark.createDataFrame([(1, 2, "x")], "order long, twin long, text string")
    places = spark.range(1).selectExpr("id AS order", "id AS twin", "id AS places")
    assert "broadcast" not in repeats._with_places(texts, places, "left")._jdf.queryExecution().analyzed().toString().lower()


def test_runs_travel_packed_by_ranges_of_whole_keys(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=60_000)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = repeats._map_runs(repeats._keyed(frame, "doc_id", "text"), 100, 32, repeats.HOT).collect()
    runs = sum(len(repeats.find_runs(t.encode())[0]) for t in texts)
    keys = [set(np.frombuffer(r.runs, repeats._RUN)["key"].tolist()) for r in rows]
    assert sum(len(r.runs) // repeats._RUN.itemsize for r in rows) == runs
    assert len(rows) * 10 < runs
    assert sum(map(len, keys)) == len(set().union(*keys))
