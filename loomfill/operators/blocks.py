"""Blocks of source files, from syntax nodes with line spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfill.functions.spans import line_starts, line_to_char, parse_span

#: Least block length, and the share of a file and the length that bound it above.
MIN_SPAN, MAX_SHARE, MAX_SHORT = 10, 10, 30

_BLOCK = "struct<node_type:string,start:int,end:int>"


def length_bound(code: Column) -> Column:
    """Longest block of a file."""
    return F.greatest(F.floor(F.length(code) / MAX_SHARE).cast("int"), F.lit(MAX_SHORT))


def line_offsets(files: DataFrame) -> DataFrame:
    """``path, line, start, end``: each line's place, by a running sum per file in a shuffle."""
    lines = files.where("code IS NOT NULL").select("path", F.posexplode(F.split("code", "\n")).alias("pos", "text"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("path", (F.col("pos") + 1).alias("line"), start.alias("start"), (start + F.length("text") + 1).alias("end"))


def with_blocks(files: DataFrame) -> DataFrame:
    """Add ``blocks array<struct<node_type, start, end>>`` to ``files(path, code, nodes)``.

    ``nodes`` holds structs of ``node_type, span, body``. Each node gives a
    block of its lines if the length fits; a function with a body also gives
    one from its first brace on, trailing blanks, tabs and line ends cut off.
    Files stay whole rows and no code is copied per node. Each transform below
    binds what the next one needs, as a lambda would compute it anew per use.
    """
    located = files.withColumns(
        {"starts": line_starts(F.col("code")), "n_chars": F.length("code"), "bound": length_bound(F.col("code")), "wide": F.encode("code", "UTF-32")}
    )
    starts, n_chars, bound = F.col("starts"), F.col("n_chars"), F.col("bound")

    def spanned(node: Column) -> Column:
        has_body = (node["node_type"] == "Function") & node["body"].isNotNull()
        return F.struct(node["node_type"].alias("node_type"), has_body.alias("has_body"), parse_span(node["span"]).alias("span"))

    def placed(node: Column) -> Column:
        s, e = node["span"]["start_line"], node["span"]["end_line"]
        at = F.struct(
            node["node_type"].alias("node_type"), node["has_body"].alias("has_body"), line_to_char(starts, s).alias("start"), line_to_char(starts, e + 1).alias("end")
        )
        return F.when((s != 0) & (e != 0), at)

    def with_text(at: Column) -> Column:
        # Four bytes a character: no cut walks the file from its start.
        text = F.when(at["has_body"], F.decode(F.substring("wide", 4 * at["start"] + 1, 4 * (F.least(at["end"], n_chars) - at["start"])), "UTF-32"))
        return F.struct(at.alias("at"), text.alias("text"), F.instr(text, F.lit("{")).alias("brace"))

    def trimmed(x: Column) -> Column:
        kept = F.length(F.rtrim(F.substring(x["text"], x["brace"], F.length(x["text"])), F.lit(" \t\n")))
        begin = x["at"]["start"] + x["brace"] - 1
        body = F.struct(F.lit("FunctionBody").alias("node_type"), begin.alias("start"), (begin + kept).alias("end"))
        own = F.struct(x["at"]["node_type"].alias("node_type"), x["at"]["start"].alias("start"), x["at"]["end"].alias("end"))
        return F.array(own, F.when(x["brace"] > 0, body)).cast(f"array<{_BLOCK}>")

    nodes = F.array_compact(F.transform(F.transform("nodes", spanned), placed))
    found = F.array_compact(F.flatten(F.transform(F.transform(nodes, with_text), trimmed)))
    blocks = F.filter(found, lambda b: (b["end"] - b["start"]).between(F.lit(MIN_SPAN), bound))
    return located.withColumn("blocks", F.coalesce(blocks, F.array().cast(f"array<{_BLOCK}>"))).drop("starts", "bound", "wide")


def extract_blocks(files: DataFrame) -> DataFrame:
    """``path, ord, node_type, start, end`` of every block; ``ord`` counts from 0 within the file.

    The outer form keeps Spark from inferring a filter on the number of
    blocks, which would compute all of them twice.
    """
    return (
        with_blocks(files.where("code IS NOT NULL"))
        .select("path", F.posexplode_outer("blocks").alias("ord", "block"))
        .where("block IS NOT NULL")
        .select("path", "ord", F.col("block.node_type").alias("node_type"), F.col("block.start").alias("start"), F.col("block.end").alias("end"))
    )


def node_type_counts(nodes: DataFrame) -> DataFrame:
    """``node_type, n``, most frequent first."""
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_type")
