"""Line spans and character offsets as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def parse_span(span: Column) -> Column:
    """``struct<start_line, end_line>`` of ``"start:end"``; null unless both are whole numbers and nothing else stands there."""
    parts = F.split(span, ":")
    start, end = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1))
    whole = (F.size(parts) == 2) & start.isNotNull() & end.isNotNull()
    return F.when(whole, F.struct(start.alias("start_line"), end.alias("end_line")))


def line_starts(code: Column) -> Column:
    """Offset of each line's first character, and one offset past the last line and its line end.

    Sums run within chunks of lines and then over the chunks, so long files
    don't cost a copy of the whole array per line.
    """
    lines = F.split(code, "\n")
    running = lambda items, step: F.aggregate(
        items, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + step(x))
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / _CHUNK)), lambda k: F.slice(lines, (k * _CHUNK + 1).cast("int"), _CHUNK))
    within = F.transform(chunks, lambda c: running(c, lambda line: F.length(line) + 1))
    bases = running(within, lambda offsets: F.element_at(offsets, -1))
    moved = F.zip_with(within, F.slice(bases, 1, F.size(within)), lambda o, base: F.transform(F.slice(o, 1, F.size(o) - 1), lambda x: x + base))
    return F.array_append(F.flatten(moved), F.element_at(bases, -1))


def line_to_char(starts: Column, line: Column) -> Column:
    """Offset of a 1-based line in ``starts``: 0 before the first, the last entry past the end."""
    return F.when(line <= 0, F.lit(0)).otherwise(F.element_at(starts, F.least(line, F.size(starts))))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; unchanged where it doesn't start with it."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)
