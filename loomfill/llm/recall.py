"""Recall of ``op5_nearest_neighbours`` against brute force: ``python -m loomfill.llm.recall TABLES``.

For tables that fit in memory: every query's exact nearest are found in numpy.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import SparkSession

from loomfill.llm.ann import op5_nearest_neighbours, usable_vectors
from loomfill.llm.common import table


def recall(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[float, float]:
    """Mean and least share of the ``k`` nearest that each query has found; equal scores count as found."""
    rows = {r.vec_id: r.v for r in usable_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").collect()}
    ids = np.array(sorted(rows))
    vectors = np.array([rows[i] for i in ids.tolist()])
    got: dict[int, list[float]] = {}
    for r in op5_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.score)
    shares = []
    for q in ids[ids % 20 == 0].tolist():
        scores = vectors @ np.array(rows[q])
        best = np.sort(scores[ids != q])[::-1][:k]
        shares.append(sum(s >= best[-1] - 1e-9 for s in got.get(q, [])) / len(best))
    return float(np.mean(shares)), float(np.min(shares))


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    for folder in sys.argv[1:]:
        print(folder, *(f"{x:.4f}" for x in recall(session, folder)))
