"""Token counts that follow edits.

A text is cut into pre-tokens, and a segment tree over them holds, for each
subtree, its number of characters and of tokens. An edit finds its place by
descending the tree, cuts and encodes anew only from the last pre-token it
could affect until the cuts agree with the old ones again, and updates the
sums above the leaves that it touched.

The pattern looks at most ``CONTEXT`` characters past the end of a pre-token
and never back, so pre-tokens that end so far before an edit stay as they are,
and from any common cut on, old and new pre-tokens are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfill.llm.bpe import Encoder, Shared, _encoders, encoder_of, vocabulary
from loomfill.llm.common import small_batches, table, tidy

CONTEXT = 3
#: What the query's edits redact, and what they put in its place.
ADDRESS, NUMBER = r"[\w.+-]+@[\w-]+\.[\w.-]*\w", r"\+?\d[\d ()-]{6,}\d"
MARK = "[redacted]"

Edit = tuple[int, int, str]  # start, end, replacement


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        self.memo = encoder.memo
        self.leaves: list[str] = encoder.split(text)
        self.recounted = 0
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        # Characters and tokens of each subtree: node k has the children 2k and 2k + 1, the root is 1.
        self.sums = sums = np.zeros((2, 2 * size), np.int64)
        n = len(self.leaves)
        sums[0, size : size + n] = np.fromiter(map(len, self.leaves), np.int64, n)
        sums[1, size : size + n] = np.fromiter(map(len, map(self.memo.__getitem__, self.leaves)), np.int64, n)
        level = size
        while level > 1:
            sums[:, level // 2 : level] = sums[:, level : 2 * level : 2] + sums[:, level + 1 : 2 * level : 2]
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[0, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts."""
        node, start, chars = 1, 0, self.sums[0]
        while node < self.size:
            node *= 2
            if place >= start + chars[node]:
                start += int(chars[node])
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, piece: str, tokens: int) -> None:
        self.leaves[leaf] = piece
        node = leaf + self.size
        change = np.array([len(piece), tokens]) - self.sums[:, node]
        if change.any():
            while node:
                self.sums[:, node] += change
                node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to before ``end``."""
        total = self.n_chars
        if not 0 <= start <= end <= total:
            raise ValueError(f"edit {start}:{end} lies outside the text of {total} characters")
        if not self.leaves:
            self.leaves.append("")
        first, begin = (0, 0) if not total else self._leaf_at(min(max(0, start - CONTEXT), total - 1))
        last, at = (0, 0) if not total else self._leaf_at(min(end, total - 1))
        old = "".join(self.leaves[first : last + 1])
        upto = at + len(self.leaves[last])  # old place after the leaves taken so far
        shift = len(replacement) - (end - start)
        new = old[: start - begin] + replacement + old[end - begin :]
        safe = start + len(replacement) - begin  # cuts from here on may agree
        n, taken = len(self.leaves), 4
        cuts = {}  # place in `new` of an old leaf's start: the leaf
        while True:
            while last + 1 < n and taken:
                last += 1
                if piece := self.leaves[last]:
                    cuts[upto + shift - begin] = last
                    new += piece
                    upto += len(piece)
                    taken -= 1
            pieces, place, stop = self.encoder.split(new), 0, None
            for k, piece in enumerate(pieces):
                if place >= safe and place in cuts and place + CONTEXT <= len(new):
                    stop = k, cuts[place]
                    break
                place += len(piece)
            if stop or last + 1 >= n:
                break
            taken = 2 * len(cuts) + 4
        if stop:
            pieces, rest = pieces[: stop[0]], stop[1]
        else:
            rest = last + 1
        self.recounted += sum(map(len, pieces))
        # New pre-tokens fill the freed leaves; what is left over shares the last of them.
        room = rest - first
        for k in range(room):
            own = pieces[k : k + 1] if k < room - 1 else pieces[k:]
            self._set(first + k, "".join(own), sum(len(self.memo[p]) for p in own))

    def apply(self, edits: list[Edit]) -> None:
        """Edits of the text as it is now; they must not overlap."""
        done = self.n_chars + 1
        for start, end, replacement in sorted(edits, reverse=True):
            if end > done:
                raise ValueError("edits overlap")
            self.edit(start, end, replacement)
            done = start


def patterns() -> set[str]:
    """Patterns that look at most ``CONTEXT`` characters past the end of a pre-token, and never back."""
    return {vocabulary()[1]}


def redactions(mark: str = MARK):
    """A function from text to the edits that put ``mark`` in place of addresses and long numbers."""
    number, either = regex.compile(NUMBER).finditer, regex.compile(f"{ADDRESS}|{NUMBER}").finditer

    def edits_of(text: str) -> list[Edit]:
        found = either if "@" in text else number  # no address is without it
        return [(m.start(), m.end(), mark) for m in found(text)]

    return edits_of


def count_with_edits(
    docs: DataFrame, edits_of, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Count tokens before and after ``edits_of(text)``, a list of (start, end, replacement).

    Returns one row per row: ``doc_id, n_chars, n_tokens, n_edits,
    n_chars_after, n_tokens_after, n_recounted`` (characters encoded anew).
    Null and empty texts have no tokens. Every text has its tree, edited or
    not. Texts of any length are counted whole. Repeated rows give
    repeated rows, an empty table an empty result; columns other than id and
    text are not read. Only the :func:`patterns` are taken, as ``CONTEXT``
    has been made out for these.
    """
    if pattern not in patterns():
        raise ValueError("how far this pattern looks past a pre-token is not known")
    tables = Shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tables)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                edits = edits_of(text)
                tree = CountTree(text, encoder)
                before = tree.n_tokens
                tree.apply(edits)
                rows.append((len(text), before, len(edits), tree.n_chars, tree.n_tokens, tree.recounted))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_COUNTS])

    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = small_batches(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    return rows.mapInArrow(tidy(run, _encoders.clear), f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in _COUNTS))


_COUNTS = ["n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_recounted"]


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after addresses and long numbers are redacted."""
    path, pattern = vocabulary()
    edits = redactions()
    return count_with_edits(table(spark, sf_dir, "documents"), edits, path, pattern)
