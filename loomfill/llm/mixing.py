"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. One pass counts every document's words; sums per source give the targets.
2. Each source is cut into blocks of about equal words by a hash of the id.
   A source's stream of blocks is a seeded permutation of its blocks for each
   epoch; its quota is how many of them reach the target. The first block that
   does not fit whole, and those after it in the same epoch, are drawn in part:
   document by document, each that still fits, until none does.
3. The vector of all quotas is split over the output shards by a binary tree:
   each node gives its left half a multivariate-hypergeometric draw of its
   quotas, so shards get exact quotas and random composition. A shard's draws of
   a source are the next blocks of the source's permutation, as many as its
   quota says, so shards hold disjoint blocks. What the tree deals out *is* the
   mix: a document is taken once for each draw of its block by some shard.
4. Rows are brought together by shard and shuffled inside it by a hash.

The driver handles sources and blocks only. Their number is bounded: at most
``max_sources`` sources (more are refused), and blocks of at least
``block_words`` words, of which there are ``max_blocks``, or
``BLOCKS_PER_SHARD`` for each shard, at most, besides one for each source.
Shards grow in number with the mix. All randomness comes from the seed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfill.llm.common import WORD, table, written

#: Fixed values of the contract: weights by turns, share of all words, most repeats.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0

BLOCK_WORDS = 50_000
MAX_BLOCKS = 16_384
#: At least so many shards, each of so many words at most (some 3 GB of text) and of so many blocks.
SHARDS, SHARD_WORDS, BLOCKS_PER_SHARD = 64, 500_000_000, 4
MAX_SOURCES = 100_000
#: Block tables up to this many rows (some 30 MB) are broadcast; larger ones are shuffled.
BROADCAST_BLOCKS = 200_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Share ``total`` by weight; targets stop at ``most`` times the size, and the
    excess is shared by weight among the others until none is above."""
    targets = [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    left = total
    while free:
        weight = math.fsum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
        free = [i for i in free if i not in set(over)] if len(over) < 50 else sorted(set(free) - set(over))
        left = total - math.fsum(targets)
    return targets


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard the sources that it draws from, and how many blocks of each.

    The shards' quotas add up to ``quotas``, and their sums differ by one per
    level at most. Only what is not zero is held.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def split(low: int, high: int, source: np.ndarray, have: np.ndarray) -> None:
        if high - low == 1:
            out.append((source, have))
            return
        mid, total = (low + high) // 2, int(have.sum())
        rng = np.random.default_rng((seed, low, high))
        take = round(total * (mid - low) / (high - low))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        split(low, mid, source[left > 0], left[left > 0])
        split(mid, high, source[have > left], (have - left)[have > left])

    quotas = np.asarray(quotas, np.int64)
    split(0, shards, np.flatnonzero(quotas), quotas[quotas > 0])
    return out


@dataclass
class Draw:
    block: int
    epoch: int
    shard: int
    fills: tuple[Fill, ...] | None = None  # what of the block is drawn; None for all of it


#: Documents of a block of at most so many words, whose order is above ``after`` (None: from the first on) and ``upto`` at most.
Fill = tuple[int, int | None, int]
LAST = (1 << 63) - 1


def source_stream(blocks: dict[int, int], target: float, key: str, seed: int) -> tuple[list[tuple[int, int]], list[int], int, int]:
    """(block, epoch) of whole blocks in drawing order while they fit in ``target`` words;
    then the blocks of the last epoch that are not drawn, in order, that epoch, and the words left for them."""
    order = sorted(blocks)
    whole = sum(blocks.values())
    out: list[tuple[int, int]] = []
    left, epoch = target, 0
    while whole and left > 0:
        rng = np.random.default_rng([seed, epoch, *key.encode()])
        walk = [b for k in rng.permutation(len(order)) if blocks[b := order[int(k)]]]
        for i, block in enumerate(walk):
            if blocks[block] > left:
                return out, walk[i:], epoch, round(left)
            out.append((block, epoch))
            left -= blocks[block]
        epoch += 1
    return out, [], epoch, 0


def fill_rest(sized: DataFrame, sources: list[tuple[str, int, float, int]], rests: dict[str, tuple[list[int], int]]) -> dict[tuple[str, int], list[Fill]]:
    """Draw documents of ``rests``, a source's undrawn blocks in order and the words left for it, each in turn that still fits.

    A round takes what fits up to the first document that does not; the next
    goes on behind it with what is left, which is less than that document has.
    So rounds are few, and in the end no document passed over would fit.
    Rows with equal ids and texts are taken, or not, together.
    """
    spark = sized.sparkSession
    state = [(key, open_, -1, None) for key, (walk, open_) in rests.items() if walk and open_ > 0]
    fills: dict[tuple[str, int], list[Fill]] = {}
    if not state:
        return fills
    rows = [(key, block, spot) for key, *_ in state for spot, block in enumerate(rests[key][0])]
    spots = spark.createDataFrame(rows, "mix_key string, mix_block int, spot int")
    spots = F.broadcast(spots) if len(rows) <= BROADCAST_BLOCKS else spots
    left = _with_block(sized, sources).join(spots, ["mix_key", "mix_block"]).select("mix_key", "spot", "mix_order", "size")
    left = written(left.where("size > 0"), "mix-left", share=16)
    upto = Window.partitionBy("mix_key").orderBy("mix_order")  # equal rows at once
    while state:
        now = spark.createDataFrame(state, "mix_key string, open long, at int, after long")
        now = F.broadcast(now) if len(state) <= BROADCAST_BLOCKS else now
        fit = left.join(now, "mix_key").where("size <= open AND (spot > at OR (spot = at AND mix_order > after))")
        sums: dict[str, dict[int, int]] = {}
        for r in fit.groupBy("mix_key", "spot").agg(F.sum("size").alias("size")).collect():  # blocks at most
            sums.setdefault(r.mix_key, {})[r.spot] = int(r.size)
        crossing = []
        rules: dict[str, tuple[int, int, int | None]] = {key: (open_, at, after) for key, open_, at, after in state}
        for key, found in sums.items():
            open_, at, after = rules[key]
            room = open_
            for spot in sorted(found):
                if found[spot] > room:
                    crossing.append((key, spot, room))
                    break
                fills.setdefault((key, rests[key][0][spot]), []).append((open_, after if spot == at else None, LAST))
                room -= found[spot]
        state = []
        if not crossing:
            break
        cross = spark.createDataFrame(crossing, "mix_key string, spot int, room long")
        cross = F.broadcast(cross) if len(crossing) <= BROADCAST_BLOCKS else cross
        part = fit.join(cross, ["mix_key", "spot"]).withColumn("sum", F.sum("size").over(upto))  # one block of each source
        taken = F.col("sum") <= F.col("room")
        ends = part.groupBy("mix_key", "spot", "room").agg(
            F.max(F.when(taken, F.col("mix_order"))).alias("upto"),
            F.coalesce(F.sum(F.when(taken, F.col("size"))), F.lit(0)).alias("taken"),
            F.min(F.when(~taken, F.col("mix_order"))).alias("over"),
        )
        for r in ends.collect():
            open_, at, after = rules[r.mix_key]
            if r.upto is not None:
                fills.setdefault((r.mix_key, rests[r.mix_key][0][r.spot]), []).append((open_, after if r.spot == at else None, r.upto))
            if r.room > r.taken:
                state.append((r.mix_key, int(r.room - r.taken), r.spot, r.over))
    return fills


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Adds mix_key (the source, null apart from any string) and two hashes of the id and text: many rows may have a null id."""
    row = [F.col(id_col).cast("string"), F.xxhash64(F.col(text_col))]
    return docs.withColumns(
        {
            "mix_key": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")),
            "mix_order": F.xxhash64(F.lit("order"), *row),
            "mix_hash": F.xxhash64(F.lit("block"), *row),
        }
    )


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Plan:
    """What the driver decides: per source (key, size, target, n_blocks), and the draws of each block."""

    sources: list[tuple[str, int, float, int]]
    draws: dict[tuple[str, int], list[Draw]]


def plan_mix(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    shards: int | None = None,
    block_words: int = BLOCK_WORDS,
    max_blocks: int = MAX_BLOCKS,
    max_sources: int = MAX_SOURCES,
    seed: int = 11,
) -> Plan:
    """Plan from rows of ``mix_key, mix_hash, mix_order, size``."""
    sums = sized.groupBy("mix_key").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"a mix of more than {max_sources} sources")
    found = {r.mix_key: int(r.size) for r in sums}
    keys = sorted(found, key=lambda k: (k == "n", k))
    sizes = [found[k] for k in keys]
    total = sum(sizes)
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(keys))], share * total, most)
    shards = shards or max(SHARDS, math.ceil(math.fsum(targets) / SHARD_WORDS))
    block_words = max(block_words, math.ceil(total / max(max_blocks, BLOCKS_PER_SHARD * shards)))
    sources = [(k, s, t, max(1, math.ceil(s / block_words))) for k, s, t in zip(keys, sizes, targets)]
    per_block = (
        _with_block(sized, sources)
        .groupBy("mix_key", "mix_block")
        .agg(F.sum("size").alias("size"))
        .collect()  # the bounded number of blocks
    )
    blocks: dict[str, dict[int, int]] = {k: {} for k in keys}
    for r in per_block:
        blocks[r.mix_key][r.mix_block] = int(r.size)
    found = {k: source_stream(blocks[k], t, k, seed) for k, _, t, _ in sources}
    fills = fill_rest(sized, sources, {k: (rest, left) for k, (_, rest, _, left) in found.items()})
    streams = [
        [(b, e, None) for b, e in whole] + [(b, epoch, tuple(fills[k, b])) for b in rest if (k, b) in fills]
        for k, (whole, rest, epoch, _) in found.items()
    ]
    draws: dict[tuple[str, int], list[Draw]] = {(k, b): [] for k in keys for b in blocks[k]}
    at = [0] * len(keys)
    for shard, (some, quota) in enumerate(split_quotas(np.array([len(x) for x in streams], np.int64), shards, seed)):
        for i, n in zip(some.tolist(), quota.tolist()):
            for block, epoch, part in streams[i][at[i] : at[i] + n]:
                draws[keys[i], block].append(Draw(block, epoch, shard, part))
            at[i] += n
    return Plan(sources, draws)


def _with_block(sized: DataFrame, sources: list[tuple[str, int, float, int]]) -> DataFrame:
    spark = sized.sparkSession
    info = spark.createDataFrame(sources, "mix_key string, source_size long, target double, n_blocks int")
    info = F.broadcast(info) if len(sources) <= BROADCAST_BLOCKS else info
    return sized.join(info, "mix_key").withColumn("mix_block", F.pmod("mix_hash", "n_blocks").cast("int"))


def _with_draws(sized: DataFrame, plan: Plan) -> DataFrame:
    """Adds each row's block, and ``drawn array<struct<epoch, shard>>``: the draws that hold it.

    Where a block is drawn in part, that is by its :func:`fill_rest` rules.
    """
    rows = [
        (key, block, [(d.epoch, d.shard) for d in found if d.fills is None], *next(((list(d.fills), (d.epoch, d.shard)) for d in found if d.fills is not None), (None, None)))
        for (key, block), found in plan.draws.items()
    ]
    pair = "struct<epoch:int,shard:int>"
    info = sized.sparkSession.createDataFrame(
        rows, f"mix_key string, mix_block int, full array<{pair}>, fills array<struct<most:long,after:long,upto:long>>, rest {pair}"
    )
    info = F.broadcast(info) if len(rows) <= BROADCAST_BLOCKS else info
    with_info = _with_block(sized, plan.sources).join(info, ["mix_key", "mix_block"])
    if "size" not in sized.columns:  # counted for blocks in part only
        with_info = with_info.withColumn("size", F.when(F.col("fills").isNotNull(), word_count("text")))
    size, order = F.col("size"), F.col("mix_order")
    fits = F.exists("fills", lambda f: (size > 0) & (size <= f["most"]) & (f["after"].isNull() | (order > f["after"])) & (order <= f["upto"]))
    return with_info.withColumn("drawn", F.when(fits, F.concat("full", F.array("rest"))).otherwise(F.col("full")))


def _position(drawn: Column, order: Column) -> Column:
    """Where a draw of a row stands in its shard's shuffled order."""
    return F.xxhash64(drawn["epoch"], drawn["shard"], order)


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """How many words of each document a mix takes, and where to: ``doc_id, size, source_size, target, taken, copies, draws``.

    ``draws`` holds the shard and the position in its shuffled order of each draw.
    Null texts have no words; null sources form the last source. Rows with
    equal ids and texts fall in one block and are drawn equally often. A source's
    taken words stay below its target by less than its smallest document that
    could still be drawn (or than such equal rows together). Empty input gives an
    empty result. No document is taken more than ``most`` times, rounded up.
    Words of whole texts count, however long; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    keyed = _keyed(rows, "doc_id", "source", "text").withColumn("size", word_count("text"))
    sized = written(keyed.drop("source", "text"), "mix-sizes", share=16)
    drawn = _with_draws(sized, plan_mix(sized, **options))
    draws = F.transform("drawn", lambda d: F.struct(d["shard"].alias("shard"), _position(d, F.col("mix_order")).alias("position")))
    return drawn.withColumn("draws", draws).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size("draws").alias("copies"), "draws"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every column of ``docs``, a row for each draw, with ``mix_shard`` and ``mix_position``.

    Columns so named are replaced; any other names are free. :func:`in_order`
    brings rows in their shuffled order. Rows of a shard come from disjoint
    blocks. Nulls, long texts, equal rows and empty tables as in :func:`mixed_sizes`.
    """
    columns = [c for c in docs.columns if c not in ("mix_shard", "mix_position")]
    whole = _keyed(docs.select(F.struct(*columns).alias("mix_row"), F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), F.col(text_col).alias("text")), "mix_id", "mix_source", "text")
    sized = whole.select("mix_key", "mix_hash", "mix_order", word_count("text").alias("size"))
    plan = plan_mix(written(sized, "mix-sizes", share=16), **options)
    drawn = _with_draws(whole, plan).select("mix_row", "mix_order", F.explode("drawn").alias("mix_draw"))
    return drawn.select(
        *[F.col("mix_row").getField(c).alias(c) for c in columns],
        F.col("mix_draw.shard").alias("mix_shard"),
        _position(F.col("mix_draw"), F.col("mix_order")).alias("mix_position"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of a mix by shard, each shard's in its shuffled order; a shard's rows are in one partition."""
    return mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_position")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write a mix, one folder for each shard, each in its shuffled order; an empty mix leaves an empty folder."""
    in_order(mixed).write.partitionBy("mix_shard").parquet(path)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))
