"""Text and prompt functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers of a fill-in-the-middle prompt and the end-of-text marker.
BEGIN, HOLE, END = "<｜fim▁begin｜>", "<｜fim▁hole｜>", "<｜fim▁end｜>"
EOS = "<｜end▁of▁sentence｜>"
#: Prompt styles: both names mean prefix, suffix, then middle.
STYLES = ("psm", "deepseek")


def check_style(style: str) -> str:
    if style not in STYLES:
        raise ValueError(f"Unsupported FIM style: {style}")
    return style


def stop_markers(style: str = "psm", eos: str = EOS) -> list[str]:
    """Markers that end a completion, in order."""
    check_style(style)
    return [BEGIN, HOLE, END, eos]


def words(text: Column) -> Column:
    """Tokens between runs of Unicode white space, none of them empty."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def format_prompt(prefix: Column, suffix: Column, style: str = "psm") -> Column:
    check_style(style)
    return F.concat(F.lit(BEGIN), prefix, F.lit(HOLE), suffix, F.lit(END))


def format_training(prefix: Column, middle: Column, suffix: Column, style: str = "psm", eos: str = EOS) -> Column:
    """Prompt, target and end marker."""
    return F.concat(format_prompt(prefix, suffix, style), middle, F.lit(eos))


def template_prompt(prompt: Column, suffix: Column) -> Column:
    """The deployed template: markers only where there is a suffix."""
    return F.when(F.coalesce(suffix, F.lit("")) != "", format_prompt(prompt, suffix)).otherwise(prompt)


def parse_prompt(prompt: Column, suffix: Column) -> tuple[Column, Column]:
    """(prefix, suffix) of a prompt. With a begin marker the text between the
    markers counts and ``suffix`` does not; without, prompt and suffix stand as they are."""
    inner = F.split_part(prompt, F.lit(BEGIN), F.lit(2))
    marked = F.contains(prompt, F.lit(BEGIN))
    after = F.split_part(F.split_part(inner, F.lit(HOLE), F.lit(2)), F.lit(END), F.lit(1))
    return (
        F.when(marked, F.split_part(inner, F.lit(HOLE), F.lit(1))).otherwise(prompt),
        F.when(marked, after).otherwise(F.coalesce(suffix, F.lit(""))),
    )


def truncate_at_stops(text: Column, stops: list[str] | Column) -> Column:
    """Cut at the first occurrence of each stop sequence, one after another in order."""
    if isinstance(stops, Column):
        return F.aggregate(stops, text, lambda a, s: F.split_part(a, s, F.lit(1)))
    if any(not s for s in stops):
        raise ValueError("stop sequences must not be empty")
    return reduce(lambda a, s: F.split_part(a, F.lit(s), F.lit(1)), stops, text)


def truncate_at_blank_line(text: Column) -> Column:
    return F.substring_index(text, "\n\n", 1)


def contains_any(text: Column, keywords: Column) -> Column:
    """Whether any keyword stands in the text, whatever the case."""
    return F.coalesce(F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k))), F.lit(False))


def clip(text: Column, limit: int = 300) -> Column:
    """One line of at most ``limit`` characters, with a marker where something was cut off."""
    # Replacing only adds characters, so one more than the limit decides.
    line = F.replace(F.left(F.coalesce(text, F.lit("")), F.lit(limit + 1)), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit), F.lit(" …[truncated]")))


def quoted(text: Column) -> Column:
    """A text as Python shows it in a list: in single quotes, or double ones if it holds only single ones, with escapes.

    Control characters up to U+00A0 are escaped; other characters stand as they are.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    codes = [*range(0, 9), 11, 12, *range(14, 32), *range(127, 161), 173]
    escaped = lambda o: reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"\\x{k:02x}")), codes, o)
    # One pass where there is one of them at all; each transform binds what the next step reads more than once.
    odd = lambda o: o.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\xa0\\xad]")
    out = F.get(F.transform(F.array(out), lambda o: F.when(odd(o), escaped(o)).otherwise(o)), F.lit(0))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    plain = F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(plain)


def format_duration(seconds: Column) -> Column:
    """``1h1m``, ``1m1s`` or ``59s``; fractions are cut off."""
    s = F.floor(seconds)
    text = lambda c: c.cast("string")
    hours = F.concat(text(F.floor(s / 3600)), F.lit("h"), text(F.floor(s % 3600 / 60)), F.lit("m"))
    minutes = F.concat(text(F.floor(s / 60)), F.lit("m"), text(s % 60), F.lit("s"))
    return F.when(s >= 3600, hours).when(s >= 60, minutes).otherwise(F.concat(text(s), F.lit("s")))


def model_tag(name: Column) -> Column:
    """A model's name as deployments spell it."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("-")))


def mask_tokens(ids: Column, mask: Column, mask_id: Column | int) -> Column:
    """``mask_id`` where the mask is true, the token elsewhere. Unequal lengths raise an error."""
    value = F.lit(mask_id) if isinstance(mask_id, int) else mask_id
    same = F.zip_with(ids, mask, lambda x, m: F.when(m, value.cast("long")).otherwise(x.cast("long")))
    return F.when(F.size(ids) == F.size(mask), same).otherwise(F.raise_error(F.lit("token ids and mask differ in length")))


def mask_tokens_2d(ids: Column, mask: Column, mask_id: int) -> Column:
    """The same for arrays of arrays."""
    rows = F.zip_with(ids, mask, lambda r, m: mask_tokens(r, m, mask_id))
    return F.when(F.size(ids) == F.size(mask), rows).otherwise(F.raise_error(F.lit("token ids and mask differ in length")))


#: Ranges of token types: (DDL type that holds them, least, greatest).
TOKEN_TYPES = {
    "int8": ("tinyint", -(1 << 7), (1 << 7) - 1),
    "uint8": ("smallint", 0, (1 << 8) - 1),
    "int16": ("smallint", -(1 << 15), (1 << 15) - 1),
    "int32": ("int", -(1 << 31), (1 << 31) - 1),
    "int64": ("bigint", -(1 << 63), (1 << 63) - 1),
}


def check_mask_id(mask_id: int, token_type: str) -> int:
    """Raise unless the token type is known and can hold the id."""
    if token_type not in TOKEN_TYPES:
        raise TypeError(f"unsupported token type: {token_type}")
    _, least, greatest = TOKEN_TYPES[token_type]
    if isinstance(mask_id, bool) or not isinstance(mask_id, int):
        raise TypeError("the mask id must be a whole number")
    if not least <= mask_id <= greatest:
        raise ValueError(f"mask id {mask_id} does not fit {token_type}")
    return mask_id
