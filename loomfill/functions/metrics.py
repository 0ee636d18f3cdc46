"""Completion metrics as Columns. Texts are compared as they stand, without trimming."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomfill.functions.text import words


def exact_match(generated: Column, expected: Column) -> Column:
    return F.coalesce(generated == expected, F.lit(False))


def any_match(draws: Column, expected: Column, first: int | None = None) -> Column:
    """Whether any of the first draws (all by default) equals the expected text."""
    some = F.slice(draws, 1, first) if first else draws
    return F.coalesce(F.exists(some, lambda x: F.coalesce(x == expected, F.lit(False))), F.lit(False))


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts start with in common, by doubling steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    room = F.least(F.length(a), F.length(b))
    fits = lambda n: (n <= room) & (F.left(a, n.cast("int")) == F.left(b, n.cast("int")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points.

    Of a text that stands in the other one, it is what they differ by in length.
    Elsewhere, what the texts share at either end never changes it and is cut off first,
    as the rest costs the product of the lengths. Each transform binds what the next one needs.
    """
    def with_prefix(x: Column) -> Column:
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), (common_prefix(x["a"], x["b"]) + 1).cast("int").alias("k"))

    def cut(x: Column) -> Column:
        return F.struct(*[F.reverse(F.substring(x[c], x["k"], F.length(x[c]))).alias(c) for c in "ab"])

    pair = F.array(F.struct(a.alias("a"), b.alias("b")))
    for _ in range(2):  # the start, then, turned round, the end
        pair = F.transform(F.transform(pair, with_prefix), cut)
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(inside, F.abs(F.length(a) - F.length(b))).otherwise(F.get(F.transform(pair, lambda x: F.levenshtein(x["a"], x["b"])), F.lit(0)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 for two empty texts, 0 if one is empty, else 1 less the distance's share of the longer one."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - edit_distance(a, b) / longer)


def _of_words(a: Column, b: Column, share) -> Column:
    """``share`` of both texts' words, which are bound once; 0 if either text has none."""
    pair = F.array(F.struct(words(a).alias("x"), words(b).alias("y")))
    some = lambda p: (F.size(p["x"]) > 0) & (F.size(p["y"]) > 0)
    return F.get(F.transform(pair, lambda p: F.when(some(p), share(p["x"], p["y"])).otherwise(0.0)), F.lit(0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words as a share of all distinct words; 0 if either text has none."""
    return _of_words(a, b, lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words as a share of the larger word set; 0 if either text has none."""
    return _of_words(a, b, lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens in order, joined by blanks, which words never hold; empty if there are fewer."""
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def _walk_shared(own: Column, other: Column) -> Column:
    """:func:`shared_count` by one sort of both arrays and one walk over them."""
    tagged = lambda grams, o: F.transform(grams, lambda g: F.struct(g.alias("g"), F.lit(o).alias("o")))
    state = lambda g, own, other, hits: F.struct(g.alias("g"), own.alias("own"), other.alias("other"), hits.alias("hits"))
    zero = F.lit(0)

    def walk(s: Column, x: Column) -> Column:
        same = state(s["g"], s["own"] + x["o"], s["other"] + 1 - x["o"], s["hits"])
        fresh = state(x["g"], x["o"], 1 - x["o"], s["hits"] + F.least(s["own"], s["other"]))
        return F.when(s["g"].eqNullSafe(x["g"]), same).otherwise(fresh)

    start = state(F.lit(None).cast("string"), zero, zero, zero)
    return F.aggregate(F.sort_array(F.concat(tagged(own, 1), tagged(other, 0))), start, walk, lambda s: s["hits"] + F.least(s["own"], s["other"]))


def shared_count(own: Column, other: Column) -> Column:
    """How many entries two arrays of strings share, each as often as both have it.

    One of each that both have, by hashing, and what their repetitions share:
    of a sorted array, the entries that equal the one before.
    """
    again = lambda s: F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))
    pair = F.array(F.struct(F.sort_array(own).alias("a"), F.sort_array(other).alias("b")))
    both = F.transform(pair, lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("n"), again(p["a"]).alias("a"), again(p["b"]).alias("b")))
    more = lambda p: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), _walk_shared(p["a"], p["b"])).otherwise(0)
    return F.get(F.transform(both, lambda p: p["n"] + more(p)), F.lit(0))


def _precision(own_words: Column, other_words: Column, n: int) -> Column:
    own, other = (ngrams(w, n) if n > 1 else w for w in (own_words, other_words))
    return F.when(F.size(own_words) >= n, shared_count(own, other) / (F.size(own_words) - n + 1))


def ngram_precision(generated: Column, expected: Column, n: int) -> Column:
    """Clipped precision of the generated words' n-grams; null if there are none."""
    return _precision(words(generated), words(expected), n)


def _bleu(generated: str, expected: str, most: int) -> float:
    a, b = generated.split(), expected.split()
    if not a or not b:
        return 0.0
    if f" {' '.join(a)} " in f" {' '.join(b)} ":  # a run of the expected words: any precision is 1
        return 1.0
    logs = []
    for n in range(1, min(most, len(a)) + 1):
        own, other = (Counter(t if n == 1 else zip(*[t[i:] for i in range(n)])) for t in (a, b))
        hits, there = 0, other.get
        for gram, c in own.items():
            hits += min(c, there(gram, 0))
        if not hits:
            return 0.0
        logs.append(math.log(hits / (len(a) - n + 1)))
    return math.exp(sum(logs) / len(logs))


def bleu(generated: Column, expected: Column, most: int = 4) -> Column:
    """Geometric mean of the n-gram precisions for n from 1 to ``most``; null texts count as empty.

    Orders without n-grams are skipped, any precision of 0 gives 0, and there
    is no brevity penalty. Counted row by row in a Python worker, whose
    ``str.split`` parts words as :func:`words` does; texts of any length cost the number of their words.
    """

    def run(generated: pa.Array, expected: pa.Array) -> pa.Array:
        return pa.array([_bleu(a or "", b or "", most) for a, b in zip(generated.to_pylist(), expected.to_pylist())], pa.float64())

    return F.arrow_udf(run, DoubleType())(generated, expected)
