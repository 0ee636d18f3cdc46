"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample of distinct vectors: build the exact neighbour
graph of the sample, partition the graph into balanced parts by label
propagation under a capacity, and train a small softmax classifier from a
vector to the parts of its neighbours. A query visits its most probable parts
until their chances add up to ``reach``: few where the classifier is sure, many
where it is not. ``reach`` is the least that finds ``goal`` of the ``k`` nearest
of sample vectors that were held out from the graph and the classifier.

Every row is indexed under its most probable part. Queries are ranked by exact
inner products in double precision with all rows of the parts that they visit.
Parts are packed into bins of up to ``BLOCK`` rows, and a query
visits a bin once for all of its parts there, so that a bin returns one list
per query. A part with more rows is a bin of its own, cut into blocks, as are
the queries, so a part that holds a third of all rows is many tasks. Queries
that have found fewer than ``k`` rows visit every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfill.llm.common import table, tidy, written

#: Distinct vectors that the index is fitted on: so many for each part, at least and at most so many, and bytes at most. Every row is indexed.
SAMPLE_PER_PART, LEAST_SAMPLE, SAMPLE, SAMPLE_BYTES = 64, 4_096, 65_536, 64 << 20
NEIGHBOURS = 10
#: Share of the sample that is held out to tune the visits on.
HELD_OUT = 0.1
#: Rows per part aimed at, and the number of parts at least and at most.
PART_ROWS, LEAST_PARTS, MAX_PARTS = 500, 2, 512
GOAL = 0.96
BLOCK = 16_384
CHUNK = 256


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of each vector's k nearest others by inner product."""
    n = len(vectors)
    out = np.empty((n, k), np.int64)
    for low in range(0, n, CHUNK):
        scores = vectors[low : low + CHUNK] @ vectors.T
        scores[np.arange(len(scores)), np.arange(low, low + len(scores))] = -np.inf
        out[low : low + CHUNK] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Part of each node: halves by random directions to start with, then moves that keep more
    neighbours together, the best first, while the new part has room."""
    n = len(vectors)
    label = np.zeros(n, np.int64)

    def split(members: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            label[members] = low
            return
        a, b = rng.choice(len(members), 2, replace=len(members) < 2)
        order = np.argsort(vectors[members] @ (vectors[members[a]] - vectors[members[b]]), kind="stable")
        mid = (low + high) // 2
        cut = len(members) * (mid - low) // (high - low)
        split(members[order[:cut]], low, mid)
        split(members[order[cut:]], mid, high)

    split(np.arange(n), 0, parts)
    capacity = int(np.ceil(1.1 * n / parts))
    ends = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    others = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(ends * parts + label[others], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moves = np.flatnonzero(gain > 0)
        if not len(moves):
            break
        size = np.bincount(label, minlength=parts)
        for i in moves[np.argsort(-gain[moves], kind="stable")].tolist():
            if size[best[i]] < capacity:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
    return label


@dataclass
class Index:
    """The classifier, and how much of the chances a query's visits cover."""

    weights: np.ndarray
    bias: np.ndarray
    reach: float

    @property
    def parts(self) -> int:
        return len(self.bias)

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        return _softmax(_unit(vectors) @ self.weights + self.bias)

    def part(self, vectors: np.ndarray) -> np.ndarray:
        return self.chances(vectors).argmax(axis=1)

    def visits(self, vectors: np.ndarray, sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """Whether each vector goes to each part: the most probable ones until ``reach``, and until they hold ``least`` rows."""
        chances = self.chances(vectors)
        order = np.argsort(-chances, axis=1, kind="stable")
        go = _before(np.take_along_axis(chances, order, axis=1)) < self.reach
        go[:, 0] = True
        if sizes is not None:
            go |= _before(sizes[order]) < least
        out = np.zeros_like(go)
        np.put_along_axis(out, order, go, axis=1)
        return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _before(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, axis=1) - values


def fit_index(sample: np.ndarray, parts: int, goal: float = GOAL, k: int = 20, seed: int = 3) -> Index:
    """Fit on distinct vectors. Fewer than 64 have one part only."""
    sample = np.unique(np.asarray(sample, np.float64), axis=0)
    dim = sample.shape[1] if len(sample) else 1
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))]
    held = int(len(sample) * HELD_OUT)
    asking, sample = sample[:held], sample[held:]
    parts = max(1, min(parts, len(sample) // 28))
    if parts == 1:
        return Index(np.zeros((dim, 1)), np.zeros(1), 1.0)
    graph = neighbour_graph(sample, min(NEIGHBOURS, len(sample) - 1))
    label = balanced_parts(sample, graph, parts, rng)
    target = np.zeros((len(sample), parts))  # half for the own part, half for the neighbours' parts
    np.add.at(target, (np.arange(len(sample))[:, None], label[graph]), 0.5 / graph.shape[1])
    target[np.arange(len(sample)), label] += 0.5
    unit = _unit(sample)
    weights, bias = np.zeros((dim, parts)), np.zeros(parts)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    epochs = 30
    for epoch in range(epochs):
        order, rate = rng.permutation(len(sample)), 4.0 * (1 - epoch / epochs)
        for low in range(0, len(sample), 128):
            rows = order[low : low + 128]
            error = (_softmax(unit[rows] @ weights + bias) - target[rows]) / len(rows)
            speed_w = 0.9 * speed_w - rate * (unit[rows].T @ error)
            speed_b = 0.9 * speed_b - rate * error.sum(axis=0)
            weights, bias = weights + speed_w, bias + speed_b
    index = Index(weights, bias, 1.0)
    # What has to be covered before the part of each of the held-out vectors' nearest is reached.
    placed, needed = index.part(sample), []
    for low in range(0, len(asking), CHUNK):
        some = asking[low : low + CHUNK]
        scores, top = some @ sample.T, min(k, len(sample))
        near = np.argpartition(-scores, top - 1, axis=1)[:, :top]
        chances = index.chances(some)
        order = np.argsort(-chances, axis=1, kind="stable")
        before = np.empty_like(chances)
        np.put_along_axis(before, order, _before(np.take_along_axis(chances, order, axis=1)), axis=1)
        needed.append(np.take_along_axis(before, placed[near], axis=1).ravel())
    if needed:
        index.reach = float(np.quantile(np.concatenate(needed), goal)) + 1e-9
    return index


def nearest_in_block(
    ids: np.ndarray, vectors: np.ndarray, part: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, visits: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k nearest others in the parts that it visits, ties to smaller ids.

    ``visits`` tells for each query and part whether it goes there. Of equal vectors, those
    beyond the k + 1 smallest ids can't be in a result and are left out first.
    """
    _, same = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, same))
    again = np.concatenate(([False], (same[order][1:] == same[order][:-1]) & (ids[order][1:] == ids[order][:-1])))
    order = order[~again]  # repeated rows count once
    same = same[order]
    first = np.concatenate(([True], same[1:] != same[:-1]))
    position = np.arange(len(same)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    order = order[position <= k]
    ids, vectors, part = ids[order], vectors[order], part[order]
    found = []
    for low in range(0, len(queries), CHUNK):
        q, qid = queries[low : low + CHUNK], query_ids[low : low + CHUNK]
        scores = q @ vectors.T
        scores[(qid[:, None] == ids[None, :]) | ~visits[low : low + CHUNK][:, part]] = -np.inf
        top = min(k, scores.shape[1])
        floor = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        near = 1e-12 * np.abs(q).sum(axis=1) * max(1e-300, np.abs(vectors).max())
        i, j = np.nonzero((scores >= (floor - near)[:, None]) & (scores > -np.inf))
        exact = (q[i] * vectors[j]).sum(axis=1)  # the same for equal vectors, wherever they stand
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        begin = np.searchsorted(i, i)
        keep = np.arange(len(i)) - begin < k
        found.append((qid[i[keep]], ids[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def pack_parts(held: dict[int, int], size: int = BLOCK) -> tuple[dict[int, int], dict[int, int]]:
    """The bin of each part, and the number of blocks of each bin."""
    bin_of, blocks, room = {}, {}, 0
    for part, n in sorted(held.items()):
        if n > size:
            bin_of[part], blocks[part] = part, -(-n // size)
            continue
        if n > room:
            current, room = part, size
            blocks[current] = 1
        bin_of[part] = current
        room -= n
    return bin_of, blocks


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of rows with an id and a vector that is not null, not zero, and finite throughout."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0))))
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")
    )


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    part_rows: int = PART_ROWS,
    max_parts: int = MAX_PARTS,
    goal: float = GOAL,
) -> DataFrame:
    """Each query's ``k`` nearest rows by inner product: ``query_id, rank, vec_id, score``.

    A query is never its own result: rows with its id are left out. Unusable
    vectors (see :func:`usable_vectors`) and those of another dimension than
    most take no part, as they have no inner product with the others. Repeated
    rows of one id and vector count once. A query gets ``k`` rows, or all
    candidates where there are fewer: one that finds fewer in its parts is ranked
    with every row. Empty tables give an empty result; columns other than id and
    vector are not read.
    """
    spark = rows.sparkSession
    usable = usable_vectors(rows, id_col, vector_col)
    dims = usable.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("v") == dims.dim)
    parts = min(max_parts, max(LEAST_PARTS, dims.n // part_rows))
    rows_to_fit = min(sample, max(LEAST_SAMPLE, SAMPLE_PER_PART * parts), max(64, SAMPLE_BYTES // (8 * dims.dim)))
    chosen = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows_to_fit).select("v").toArrow()  # bounded in rows and bytes
    index = fit_index(_matrix(chosen["v"]), parts, goal, k)
    del chosen
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = sent.value.part(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["vec_id", "v", "part"])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        q, i, s = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if left.num_rows and right.num_rows:
            go = np.zeros((right.num_rows, sent.value.parts), bool)
            for row, parts in zip(go, right["visits"].to_pylist()):
                row[parts] = True
            q, i, s = nearest_in_block(
                left["vec_id"].to_numpy(), _matrix(left["v"]), left["part"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"]), go, k
            )
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    asked = usable_vectors(queries, id_col, vector_col).where(F.size("v") == dims.dim)
    placed = written(usable.mapInArrow(tidy(place), "vec_id long, v array<double>, part int"), "placed")
    held = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more rows than parts
    bin_of, blocks = pack_parts(held)
    sizes, bins = (np.array([of.get(p, none) for p in range(index.parts)]) for of, none in ((held, 0), (bin_of, -1)))

    def nearest(asked: DataFrame, least: int) -> DataFrame:
        """The best of the visited parts, which hold ``least`` rows at least."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    go = sent.value.visits(_matrix(batch.column(1)), sizes, least) & (bins >= 0)
                    rows = [(i, b, p[bins[p] == b].tolist()) for i, p in enumerate(map(np.flatnonzero, go)) for b in np.unique(bins[p]).tolist()]
                    if rows:
                        spots, own, parts = zip(*rows)
                        columns = [*(c.take(pa.array(spots)) for c in batch.columns), pa.array(own, pa.int32()), pa.array(parts, pa.list_(pa.int32()))]
                        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "bin", "visits"])

        routed = written(asked.mapInArrow(tidy(route), "vec_id long, v array<double>, bin int, visits array<int>"), "routed")
        asks = {r.bin: r.n for r in routed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more rows than parts
        grid = [(p, b, blocks[b], -(-asks[b] // BLOCK)) for p, b in bin_of.items() if b in asks]
        if not grid:
            return spark.createDataFrame([], schema)
        by_part = F.broadcast(spark.createDataFrame(grid, "part int, bin int, nv int, nq int"))
        by_bin = F.broadcast(spark.createDataFrame(sorted({g[1:] for g in grid}), "bin int, nv int, nq int"))
        own = F.xxhash64("vec_id")
        v = placed.join(by_part, "part").select(
            "vec_id", "v", "part", "bin", F.pmod(own, "nv").cast("int").alias("bv"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq")
        )
        q = routed.join(by_bin, "bin").select(
            "vec_id", "v", "visits", "bin", F.pmod(own, "nq").cast("int").alias("bq"), F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv")
        )
        cell = ["bin", "bv", "bq"]
        near = v.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(rank, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (
            near.distinct()
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    done = written(nearest(asked, k + 1), "nearest")
    full = done.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if index.parts == 1 or short.isEmpty():
        return done
    return done.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(nearest(short, dims.n + 1))


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
