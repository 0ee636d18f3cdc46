"""Shard placement by a permutation-filled lookup table.

Each shard walks its own permutation of a prime number of slots (an offset and
a step taken from its name's digest). Shards take turns and claim the next free
slot of their walk until the table is full, so shards differ by at most one
slot per unit of weight, and adding or removing a shard moves few other slots.
The table is a constant ``slots`` rows, whatever the data, and is broadcast:
a row is placed by one hash and one look-up, without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
N_SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """``slots`` shard numbers. In each round shard i claims ``weights[i]`` slots (1 each by default)."""
    if not _is_prime(slots) or slots < 3:
        raise ValueError("the number of slots must be a prime above 2")
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= slots:
        raise ValueError("shard names must be distinct, at least one, and no more than slots")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    walks = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        walks.append((offset + step * np.arange(slots, dtype=np.int64)) % slots)
    table, at, free = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while free:
        for i, walk in enumerate(walks):
            for _ in range(min(weights[i], free)):
                while table[walk[at[i]]] >= 0:
                    at[i] += 1
                table[walk[at[i]]] = i
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of its MD5, modulo ``slots``; null keys share the empty string's slot."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(
    df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None
) -> DataFrame:
    """Add ``slot`` and ``shard`` (a name) to every row of ``df``, replacing columns so named.

    Equal keys share a shard. A key that holds a large part of all rows stays
    on one shard by definition; hash a finer key to spread it. Null keys go where
    the empty string goes, keys may be of any length, repeated rows are placed
    alike, and an empty table gives an empty one.
    """
    numbers = lookup_table(shards, slots, weights)
    rows = [(i, shards[k]) for i, k in enumerate(numbers.tolist())]
    table = df.sparkSession.createDataFrame(rows, "slot int, shard string")  # constant size: slots rows
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    keyed = df.select(*kept, slot_of(F.col(key), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write placed rows in one folder per shard; each task writes its own files, so no shuffle is needed.

    Nulls are written as they are; an empty table leaves an empty folder.
    """
    placed.select(*(columns or [c for c in placed.columns if c not in ("slot", "shard")]), "shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard among 64, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", [f"shard-{i:04d}" for i in range(N_SHARDS)])


def op3_sql() -> str:
    """The query's placement; the filled table, which SQL can't fill, is a list in it."""
    owners = ", ".join(map(str, lookup_table([f"shard-{i:04d}" for i in range(N_SHARDS)]).tolist()))
    return f"""
WITH owners AS (SELECT unnest(range({SLOTS}))::INTEGER AS slot, unnest([{owners}]) AS k
), d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(k::VARCHAR, 4, '0') AS shard FROM d JOIN owners USING (slot)
"""
