"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A token sequence is the BPE encoding of a piece exactly when every two adjacent
tokens are compatible, that is, when BPE keeps them apart as they stand. So the
encoder walks the piece once: it tries the longest token that starts here, then
that token's shorter prefixes, until one is compatible with the token before;
if none is, it drops that token and never ends a token at this place again.
Each place is given up at most once, so the work is linear in the piece.

Bytes are mapped to Latin-1 characters, one for one, so that a pyahocorasick
automaton over strings finds all tokens of a piece in one pass. Compatibility
is memoised, and so are the encodings of short pieces. Both memos hold a bounded
number of entries of bounded size (some 50 MB together) and are dropped with the
rest of the encoder when a task ends, so idle workers hold nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.llm.common import small_batches, table, tidy

MEMO = 150_000
MEMO_PIECE = 48
FITS = 250_000
NONE: dict[int, bool] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: merge the adjacent pair of the lowest rank, leftmost first. For short pieces only."""
    get, none = ranks.get, 1 << 60
    starts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (lowest := min(pairs)) < none:
        i = pairs.index(lowest)
        del starts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[starts[i] : starts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[starts[i - 1] : starts[i + 1]], none)
    return [ranks[piece[i:j]] for i, j in zip(starts, starts[1:])]


class Tables:
    """What the encoder needs of a vocabulary; made once on the driver and broadcast (a few MB)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks, self.pattern = ranks, pattern
        # Tokens that BPE itself never makes of their bytes stand for whole pieces only.
        self.made = {token: rank for token, rank in ranks.items() if merge_pairs(token, ranks) == [rank]}
        self.shorter: dict[int, int] = {}
        for token, rank in self.made.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in self.made:
                    self.shorter[rank] = self.made[token[:n]]
                    break


class Memo(dict):
    """Piece to its ids. Holds at most two generations of ``MEMO`` short
    pieces; pieces in use survive a change."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (found := self.old.get(piece)) is None:
            found = tuple(self.encode(piece.encode()))
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    def __init__(self, tables: Tables):
        self.ranks, self.shorter = tables.ranks, tables.shorter
        self.split = regex.compile(tables.pattern).findall
        self.bytes_of = {rank: token for token, rank in tables.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in tables.made.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.digits = {rank: str(rank) for rank in self.bytes_of}
        self.size = {rank: len(token) for rank, token in self.bytes_of.items()}
        self.fits: dict[int, dict[int, bool]] = {}  # left token, right token
        self.n_fits = 0
        self.memo = Memo(self.encode_piece)

    def compatible(self, left: int, right: int) -> bool:
        if self.n_fits >= FITS:
            self.fits.clear()
            self.n_fits = 0
        self.n_fits += 1
        known = merge_pairs(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        self.fits.setdefault(left, {})[right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [0] * n
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = rank  # ends grow, so the longest one stays
        closed = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else None
        while at < n:
            last = out[-1] if out else None
            after = fits.get(last, NONE)
            while token is not None:
                end = at + size[token]
                if not closed[end]:
                    if last is None:
                        break
                    if (fit := after.get(token)) is None:
                        fit = self.compatible(last, token)
                        after = fits.get(last, NONE)
                    if fit:
                        break
                token = shorter.get(token)
            if token is None:  # nothing may follow here: this place ends no token
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter.get(token)
                continue
            out.append(token)
            at = end
            token = longest[at] if at < n else None
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def join(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[object, Encoder] = {}


def encoder_of(tables) -> Encoder:
    """This worker's encoder for broadcast tables."""
    if (known := _encoders.get(tables.id)) is None:
        _encoders.clear()
        known = _encoders[tables.id] = Encoder(tables.value)
    return known


@cache
def _tables(path: str, pattern: str) -> Tables:
    return Tables(read_ranks(path), pattern)


class Shared:
    """Broadcast tables with a key that workers can cache by."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.id = (path, pattern)
        self._sent = spark.sparkContext.broadcast(_tables(path, pattern))

    @property
    def value(self) -> Tables:
        return self._sent.value


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every whole text, without special tokens.

    Null texts are empty and have no ids; invalid UTF-8 is replaced by U+FFFD
    first. Texts of any length are encoded whole, in linear time. Repeated rows
    give repeated rows, an empty table gives an empty result, and columns other
    than id and text are not read.
    """
    tables = Shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tables)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(tidy(run, _encoders.clear), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes binary`` of rows from :func:`encode_documents`; null ids decode to nothing."""
    tables = Shared(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tables)
        for batch in batches:
            out = [encoder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    rows = small_batches(encoded.select("doc_id", "ids"))
    return rows.mapInArrow(tidy(run, _encoders.clear), f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Encoding and decoding share a pass, so ids never leave the worker.
    Same rules for null, repeated and invalid texts as :func:`encode_documents`.
    """
    tables = Shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = encoder_of(tables), hashlib.sha256
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(sha(encoder.join(ids).encode()).hexdigest())
                decoded_sha.append(sha(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(tidy(run, _encoders.clear), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return small_batches(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public vocabulary file on the driver, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary())
