"""Infilling samples: a block as the middle, with the text around it up to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfill.functions.text import EOS, format_training
from loomfill.operators.blocks import with_blocks

#: A sample's characters at most, one of the two by chance.
BUDGETS = (8000, 16000)


def budget(path: Column, ordinal: Column, seed: int = 42) -> Column:
    """One of the two budgets, by the parity of a digest's last hex digit."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), path, ordinal.cast("string")).cast("binary"))
    odd = F.conv(F.substring(digest, 32, 1), 16, 10).cast("int") % 2 == 1
    return F.when(odd, BUDGETS[1]).otherwise(BUDGETS[0])


def fim_samples(files: DataFrame, seed: int = 42) -> DataFrame:
    """``file_path, ord, prefix, middle, suffix, node_type`` from ``files(path, code, nodes)``.

    Half of what the middle leaves of the budget goes before it, the rest
    after it; what the file can't fill is not given to the other side. Texts
    are cut inside the file's row, so only samples are exploded; they are cut out
    of four bytes a character, so no cut walks the file from its start.
    """
    found = with_blocks(files.where("code IS NOT NULL")).withColumn("wide", F.encode("code", "UTF-32"))
    n_chars = F.col("n_chars")

    def cut(start: Column, n: Column) -> Column:
        return F.decode(F.substring("wide", 4 * start + 1, 4 * n), "UTF-32")

    def sample(block: Column, i: Column) -> Column:
        start, end = block["start"], block["end"]
        most = budget(F.col("path"), i, seed)
        middle = end - start
        before = F.floor((most - middle) / 2).cast("int")
        first = F.greatest(F.lit(0), start - before)
        last = F.least(n_chars, end + (most - middle - before))
        made = F.struct(
            i.alias("ord"),
            cut(first, start - first).alias("prefix"),
            cut(start, middle).alias("middle"),
            F.when(last > end, cut(end, last - end)).otherwise("").alias("suffix"),
            block["node_type"].alias("node_type"),
        )
        return F.when((middle > 0) & (middle <= most), made)

    samples = F.array_compact(F.transform("blocks", sample))
    rows = found.select(F.col("path").alias("file_path"), F.explode_outer(samples).alias("s"))  # outer: no filter is inferred
    return rows.where("s IS NOT NULL").select("file_path", "s.*")


def training_text(samples: DataFrame, style: str = "psm", eos: str = EOS) -> DataFrame:
    """One column ``text``; all others are pruned."""
    return samples.select(format_training(F.col("prefix"), F.col("middle"), F.col("suffix"), style, eos).alias("text"))


def with_defaults(samples: DataFrame, path: str = "unknown", node_type: str = "unknown") -> DataFrame:
    """Fill a missing path or node type; the prompt-style evaluation names the path ``unknown.rs``."""
    return samples.withColumns({"file_path": F.coalesce("file_path", F.lit(path)), "node_type": F.coalesce("node_type", F.lit(node_type))})


def long_samples(samples: DataFrame, max_tokens: int = 4096, chars_per_token: float = 3.0) -> DataFrame:
    """Audit: samples whose text is likely cut off by a trainer's token limit, the target first."""
    size = F.length("prefix") + F.length("middle") + F.length("suffix")
    return samples.where(size > max_tokens * chars_per_token).select("file_path", "ord", size.alias("n_chars"))
