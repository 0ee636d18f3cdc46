"""Removal of long repeated byte strings by sharded suffix arrays.

A byte goes when a string of ``span`` bytes covers it that also starts earlier
in the corpus. Comparing all of those strings everywhere would need one suffix
array over the corpus; instead, equal strings are brought to the same shard:

1. A string's key is the least hash of its ``seed``-byte substrings. Neighbouring
   strings mostly share their key, so a document becomes *runs* of strings of
   one key, about one for each ``(span - seed) / 2`` bytes. Equal strings have
   equal keys, so runs are dealt out to shards by key.
2. In a shard, runs whose key occurs once are settled, and of runs that are
   equal as a whole, all but the first are covered whole. Runs whose key has
   several different runs are fetched as bytes.
3. A shard joins its fetched runs in corpus order, builds the suffix array by
   induced sorting and the permuted common prefixes. Suffixes that share
   ``span`` bytes form a class, of which every start but the first is covered.
4. Covered stretches are merged by document and cut out.

Common strings don't gather in a shard. Tasks combine runs before they send
them: of equal ones the first is sent on, and the others are covered on the
spot. A key with more than ``HOT`` different runs or ``HOT_BYTES`` of them (texts
around one common passage), or with a share of that in one task, is *hot*: its
strings are dealt out singly by their own hash, again combined in each task first.

Long stretches of one key, as in a text of one repeated byte, are cut into runs
of ``PIECE`` strings. Shards come sorted by key, or packed by range of keys, and are
worked on a few keys or ranges at a time, so a worker's memory depends neither on a text's length nor on a shard's.

Where contents stand for themselves by digests: equal runs have equal keys,
lengths and 64-bit hashes; single strings of hot keys equal 128-bit hashes.
Everything else is compared as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.llm.common import free_shuffles, key_chunks, small_batches, table, tidy, written
from loomfill.llm.shingles import _BYTE, U, _power_tables, mix64
from loomfill.llm.suffix_array import permuted_common_prefixes, suffix_array

SPAN, SEED = 100, 32
HOT, HOT_BYTES = 20_000, 8 << 20
#: Strings in a run at most.
PIECE = 4_096
#: Bytes of runs in one suffix array (some 100 bytes of memory each), unless one key has more; a shard with more works key range by key range.
ARRAY_BYTES = 2_000_000
#: No byte of valid UTF-8.
GAP = 0xFF
#: Runs or strings that a task combines at a time.
CHUNK = 400_000
#: Kinds of rows: covered whole, to be fetched, to be fetched string by string, mark of a hot key.
COVERED, WHOLE, SINGLY, HOT_KEY = range(4)
#: A run, as it travels: packed with others of its range of keys, so that the JVM moves and sorts few rows.
_RUN = np.dtype([(c, "<i8") for c in ("order", "twin", "key", "mark")] + [(c, "<i4") for c in ("start", "size", "kind")])
_PACKED = "range int, runs binary"


def find_runs(text: bytes, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, content hash, start and byte length of each run of strings of one key.

    The length is negative where the key's seed stands in the run more than
    once, so that strings may repeat within it.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if n < span:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    seeds = least = mix64((total[seed:] - total[:-seed]) * down[: n - seed + 1])
    width, have = span - seed + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: have - width], least[width - have :])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    if (long := np.diff(np.append(start, len(least)))).max() > PIECE:
        pieces = -(-long // PIECE)
        ends = np.cumsum(pieces)
        start = np.repeat(start, pieces) + PIECE * (np.arange(ends[-1]) - np.repeat(ends - pieces, pieces))
    size = np.diff(np.append(start, len(least))) + span - 1
    mark = mix64((total[start + size] - total[start]) * down[start] + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    seeds, each = seeds.astype(np.uint32), size - seed + 1
    ends = np.cumsum(each)
    same = seeds[np.arange(ends[-1]) + np.repeat(start - ends + each, each)] == np.repeat(least[start].astype(np.uint32), each)
    twice = np.add.reduceat(same, ends - each, dtype=np.int32) > 1
    return least[start], mark, start, np.where(twice, -size, size)


def merge_stretches(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of [start, end) per owner; owners are numbers."""
    if not len(start):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + owner * wide)  # owners don't mix: each adds its own offset
    fresh = np.concatenate(([True], start[1:] + owner[1:] * wide > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return owner[first], start[first], reach[last] - owner[first] * wide


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _spread(order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys for rows that no longer need one."""
    return mix64(order.view(np.uint64) * U(31) + start.astype(np.uint64)).view(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _stretches(order: np.ndarray, twin: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, twin, start and size of what strings of ``span`` bytes cover."""
    at = np.lexsort((start, twin, order))
    order, twin, start = order[at], twin[at], start[at].astype(np.int64)
    fresh = _changes(order, twin)
    fresh[1:] |= np.diff(start) > span
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(start))[: len(begin)] - 1
    return order[begin], twin[begin], start[begin], start[last] - start[begin] + span


def _is_hot(number: np.ndarray, fresh: np.ndarray, size: np.ndarray, hot: int, share: int = 1) -> np.ndarray:
    """For each run whether its key, as numbered, has too many different ones, or too many bytes of them."""
    return (np.bincount(number, weights=fresh)[number] > hot) | (np.bincount(number, weights=fresh * np.abs(size))[number] > HOT_BYTES // share)


def _range_bits(spark: SparkSession) -> int:
    """Keys are dealt out by ranges of their hashes, 4,096 or eight for each shuffle partition; workers hold few at a time."""
    return min(20, max(12, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _combine(order, twin, key, mark, start, size, hot: int, bits: int) -> pa.RecordBatch:
    """A task's runs: of equal ones the first, the others covered; keys with over ``hot`` different runs marked hot. Packed by range."""
    at = np.lexsort((start, twin, order, mark, key))
    order, twin, key, mark, start, size = (x[at] for x in (order, twin, key, mark, start, size))
    new_key, new_mark = _changes(key), _changes(key, mark)
    again = ~_changes(key, mark, order, twin, start)  # a document that is in the table more than once
    number = np.cumsum(new_key) - 1
    is_hot = _is_hot(number, new_mark, size, hot, 64)
    kind = np.where(~new_mark, COVERED, np.where(is_hot, SINGLY, WHOLE))
    size = np.where(kind == WHOLE, size, np.abs(size))
    marked = key[new_key & is_hot]
    key = np.where(kind == WHOLE, key, _spread(order, start))
    keep = ~again
    zeros = np.zeros(len(marked), np.int64)
    runs = np.empty(int(keep.sum()) + len(marked), _RUN)
    for name, x, m in zip(_RUN.names, (order, twin, key, mark, start, size, kind), (zeros, zeros, marked, zeros, zeros, zeros, zeros + HOT_KEY)):
        runs[name] = np.concatenate((x[keep], m))
    # By a hash of the key, as a key is the least of many hashes and so is small.
    place = (mix64(runs["key"].view(np.uint64)) >> U(64 - bits)).astype(np.int32)
    at = np.argsort(place, kind="stable")
    runs, place = runs[at], place[at]
    first = np.flatnonzero(_changes(place))
    packed = [runs[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(runs)])]
    return pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(packed, pa.binary())], ["range", "runs"])


def _map_runs(keyed: DataFrame, span: int, seed: int, hot: int) -> DataFrame:
    # The more tasks there are, the fewer of a key's runs may come from each, so that what meets stays bounded.
    local = max(1, min(hot // 64, 2 * hot // int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bits = _range_bits(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            order, twin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [find_runs(t.as_py().encode(), span, seed) for t in batch.column(2)]
            counts = [len(p[0]) for p in parts]
            if not sum(counts):
                continue
            key, mark, start, size = (np.concatenate(c) for c in zip(*parts))
            held.append((np.repeat(order, counts), np.repeat(twin, counts), key.view(np.int64), mark.view(np.int64), start, size))
            n += len(key)
            if n >= CHUNK:
                yield _combine(*map(np.concatenate, zip(*held)), local, bits)
                held, n = [], 0
        if held:
            yield _combine(*map(np.concatenate, zip(*held)), local, bits)

    return small_batches(keyed.select("order", "twin", "text")).mapInArrow(tidy(run), _PACKED)


def _settle_runs(runs: DataFrame, hot: int) -> DataFrame:
    """``order, twin, key, start, size, kind`` of runs that are covered or to be fetched.

    Runs whose strings may repeat within themselves are fetched in any case.
    """

    def settle(got: pa.Table) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(b"".join(got.column(1).to_pylist()), _RUN)
        order, twin, key, mark, start, size, kind = (np.ascontiguousarray(packed[c]) for c in _RUN.names)
        done = np.flatnonzero((kind == COVERED) | (kind == SINGLY))
        out = [[x[done] for x in (order, twin, key, start, size, kind)]]
        marked = np.isin(key, key[kind == HOT_KEY])
        at = np.flatnonzero(kind == WHOLE)
        at = at[np.argsort(key[at], kind="stable")]
        _, count = np.unique(key[at], return_counts=True)
        at = at[(np.repeat(count, count) > 1) | (size[at] < 0) | marked[at]]  # the others are settled: their keys occur once
        if len(at):
            at = at[np.lexsort((start[at], twin[at], order[at], mark[at], key[at]))]
            order, twin, key, mark, start, size, marked = (x[at] for x in (order, twin, key, mark, start, size, marked))
            within, size = size < 0, np.abs(size)
            new_mark = _changes(key, mark, size)
            again = ~_changes(key, mark, order, twin, start)
            number = np.cumsum(_changes(key)) - 1
            different = np.bincount(number, weights=new_mark)[number]
            kind = np.where(~new_mark, COVERED, np.where(marked | _is_hot(number, new_mark, size, hot), SINGLY, WHOLE))
            keep = ~again & ((kind != WHOLE) | (different > 1) | within)
            out.append([x[keep] for x in (order, twin, key, start, size, kind)])
        for columns in out:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k > 2 else c) for k, c in enumerate(columns)], ["order", "twin", "key", "start", "size", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_chunks(batches, size=100_000 * _RUN.itemsize):
            yield from settle(part)

    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(tidy(run), "order long, twin long, key long, start int, size int, kind int")


def _fetch(keyed: DataFrame, places: DataFrame, span: int) -> DataFrame:
    """``order, twin, key, start, kind, bytes`` of the places. Single strings come under
    their own hash with another hash for bytes; of equal ones in a task the first. The others
    are covered, and come as stretches, with a stretch's size for bytes: a row for each string
    would be as many rows as the copies of a long common passage have bytes."""
    names = ["order", "twin", "key", "start", "kind", "bytes"]

    def singles(held: list[tuple]) -> pa.RecordBatch:
        order, twin, key, other, start = (np.concatenate(c) for c in zip(*held))
        at = np.lexsort((start, twin, order, other, key))
        order, twin, key, other, start = (x[at] for x in (order, twin, key, other, start))
        fresh, first = _changes(key, other, order, twin, start), _changes(key, other)
        covered = _stretches(*(x[fresh & ~first] for x in (order, twin, start)), span)
        first &= fresh
        parts = [(order[first], twin[first], key[first], start[first], other[first]), (*covered[:2], _spread(covered[0], covered[2]), *covered[2:])]
        n, m = (len(p[0]) for p in parts)
        order, twin, key, start, content = (np.concatenate(c) for c in zip(*parts))
        columns = [pa.array(x) for x in (order, twin, key, start.astype(np.int32), np.repeat([SINGLY, COVERED], [n, m]).astype(np.int32))]
        digests = pa.Array.from_buffers(pa.binary(8), n + m, [None, pa.py_buffer(content.astype(np.int64, copy=False).tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([*columns, digests], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            out = [[], [], [], [], []]
            for order, twin, text, places in zip(*(batch.column(i) for i in range(4))):
                order, twin, data = order.as_py(), twin.as_py(), text.as_py().encode()
                for p in places.as_py():
                    piece = data[p["start"] : p["start"] + p["size"]]
                    if p["kind"] == WHOLE:
                        for column, value in zip(out, (order, twin, p["key"], p["start"], piece)):
                            column.append(value)
                    else:
                        hashes, other = _string_hashes(piece, span)
                        held.append((np.full(len(hashes), order), np.full(len(hashes), twin), hashes, other, p["start"] + np.arange(len(hashes))))
                        n += len(hashes)
            if out[0]:
                columns = [pa.array(c, t) for c, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([WHOLE] * len(out[0]), pa.int32()), pa.array(out[4], pa.binary())], names)
            if n >= CHUNK:
                yield singles(held)
                held, n = [], 0
        if held:
            yield singles(held)

    rows = _with_places(keyed, places, "inner").select("order", "twin", "text", "places")
    return small_batches(rows).mapInArrow(tidy(run), "order long, twin long, key long, start int, kind int, bytes binary")


_OTHER = np.random.default_rng(20_240_602).integers(1, 1 << 63, 256, dtype=np.uint64) << U(1) | U(1)


def _string_hashes(text: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each ``span`` bytes of ``text``."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    up, down = _power_tables(n + 1)
    out = []
    for table in (_BYTE, _OTHER):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        out.append(mix64((total[span:] - total[:-span]) * down[: n - span + 1]).view(np.int64))
    return out[0], out[1]


def _with_places(keyed: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Join texts with the written table ``places`` (one row per document). It grows with the
    texts, so they are shuffled to it whatever its size, unless Spark itself finds it small."""
    return keyed.join(places, ["order", "twin"], how)


def covered_starts(strings: list[bytes], span: int = SPAN) -> np.ndarray:
    """Of strings joined with a gap byte after each, the places whose ``span`` bytes also start at an earlier place."""
    text = np.frombuffer(b"".join(x for s in strings for x in (s, b"\xff")), np.uint8)
    array = suffix_array(text, 256)
    shared = permuted_common_prefixes(text, array)[array] >= span
    shared[:1] = False
    # Suffixes that share span bytes are neighbours; a gap byte never is part of what equal strings share,
    # as no string of span bytes that starts in one run goes on in the next one.
    fits = np.zeros(len(text) + 1, bool)
    sizes = np.array([len(s) for s in strings])
    begin = np.cumsum(sizes + 1) - sizes - 1
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(len(text))
    fits = room >= span
    number = np.cumsum(~shared) - 1
    valid = fits[array]
    first = np.full(number[-1] + 1 if len(number) else 0, len(text), np.int64)
    np.minimum.at(first, number[valid], array[valid])
    hit = valid & (array != first[number])
    return np.sort(array[hit])


def _resolve(fetched: DataFrame, span: int) -> DataFrame:
    """Step 3: ``order, twin, start, size`` of covered stretches."""

    def resolve(got: pa.Table) -> Iterator[pa.RecordBatch]:
        order, twin, key, start, kind = (got.column(i).to_numpy() for i in range(5))
        content = got.column(5).combine_chunks()
        sizes = np.asarray(pc.binary_length(content))
        # Stretches that a task has found covered, and of single ones all but the first of a pair of hashes.
        done, s = np.flatnonzero(kind == COVERED), np.flatnonzero(kind == SINGLY)
        length, other = (np.frombuffer(b"".join(content.take(pa.array(x)).to_pylist()), np.int64) for x in (done, s))
        at = np.lexsort((start[s], twin[s], order[s], other, key[s]))
        s, other = s[at], other[at]
        s = s[~_changes(key[s], other) & _changes(key[s], other, order[s], twin[s], start[s])]
        first = start.astype(np.int64)
        out = [(order[done], twin[done], first[done], first[done] + length), (order[s], twin[s], first[s], first[s] + span)]
        # Runs: key ranges of bounded size, each in corpus order.
        r = np.flatnonzero(kind == WHOLE)
        r = r[np.argsort(key[r], kind="stable")]
        upto = np.cumsum(sizes[r] + 1)
        low = 0
        while low < len(r):
            high = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + ARRAY_BYTES, "right"))
            high = max(high, low + 1)
            high = int(np.searchsorted(key[r], key[r[high - 1]], "right"))  # whole keys
            part = r[low:high]
            low = high
            part = part[np.lexsort((start[part], twin[part], order[part]))]
            part = part[_changes(order[part], twin[part], start[part])]  # a repeated row is one document
            strings = [content[int(i)].as_py() for i in part]
            hits = covered_starts(strings, span)
            if len(hits):
                begin = np.cumsum(sizes[part] + 1) - sizes[part] - 1
                which = np.searchsorted(begin, hits, "right") - 1
                o, s0, e0 = merge_stretches(which, hits - begin[which], hits - begin[which] + span)
                i = part[o]
                out.append((order[i], twin[i], start[i] + s0, start[i] + e0))
        for o, t, a, b in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(o), pa.array(t), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32))], ["order", "twin", "start", "size"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_chunks(batches, 2, 100_000, 2 * ARRAY_BYTES):
            yield from resolve(part)

    return fetched.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "order long, twin long, start int, size int")


def _merge(stretches: DataFrame) -> DataFrame:
    """``order, twin, spans``: a document's covered stretches, packed as int32 starts and ends."""

    def merge(got: pa.Table) -> pa.RecordBatch:
        order, twin, start, size = (got.column(i).to_numpy() for i in range(4))
        at = np.lexsort((twin, order))
        fresh = np.concatenate(([True], (order[at][1:] != order[at][:-1]) | (twin[at][1:] != twin[at][:-1])))
        owner, a, b = merge_stretches(np.cumsum(fresh) - 1, start[at].astype(np.int64), start[at].astype(np.int64) + size[at])
        pairs = np.stack([a, b], axis=1).astype("<i4")
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        docs = at[np.flatnonzero(fresh)]
        packed = [p.tobytes() for p in np.split(pairs, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(order[docs]), pa.array(twin[docs]), pa.array(packed, pa.binary())], ["order", "twin", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_chunks(batches, 1, 100_000):
            yield merge(part)

    # By the twin, a hash of the text: a null or repeated id may stand for many texts.
    return stretches.repartition("order", "twin").sortWithinPartitions("twin", "order").mapInArrow(tidy(run), "order long, twin long, spans binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds the place in corpus order (a null id comes last) and a hash that tells texts of one id apart."""
    text: Column = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), F.xxhash64("text").alias("twin"), "text")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """``order, twin, spans`` of the documents with covered bytes."""
    keyed = _keyed(docs, id_col, text_col)
    settled = written(_settle_runs(_map_runs(keyed, span, seed, hot), hot), "runs")
    free_shuffles(docs.sparkSession)
    places = settled.where("kind > 0").groupBy("order", "twin").agg(F.collect_list(F.struct("key", "start", "size", "kind")).alias("places"))
    fetched = _fetch(keyed, written(places, "places"), span)
    found = written(_resolve(fetched, span), "covered")
    free_shuffles(docs.sparkSession)
    whole = settled.where("kind = 0").select("order", "twin", "start", "size")
    return written(_merge(whole.unionByName(found)), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Cut repeated strings of ``span`` bytes out of every text.

    Texts are UTF-8 bytes (null: empty; invalid bytes count as U+FFFD), and
    matches never cross documents. A byte goes if a ``span``-byte string that
    covers it also starts earlier: in a document of a smaller id, or earlier in
    the same one. Strings are judged on the input. Returns one row per input
    row: ``doc_id, n_bytes, n_removed, n_spans, kept binary``.

    Ids are whole numbers; a null id comes after all others. Different texts of
    one id are ordered by a hash; rows that repeat id and text are one document
    and are all returned alike. Texts of any length up to 2 GB are searched whole,
    an empty table gives an empty result, and other columns are not read.
    """
    spans = find_repeats(docs, id_col, text_col, span, seed, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = [], []
            for text, packed in zip(batch.column(1), batch.column(2)):
                data, at, parts, gone = text.as_py().encode(), 0, [], 0
                pairs = np.frombuffer(packed.as_py() or b"", "<i4").reshape(-1, 2).tolist()
                for a, b in pairs:
                    parts.append(data[at:a])
                    gone += b - a
                    at = b
                parts.append(data[at:])
                counts.append((len(data), gone, len(pairs)))
                kept.append(b"".join(parts))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = _with_places(_keyed(docs, id_col, text_col), spans, "left").select("doc_id", "text", "spans")
    return small_batches(rows).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeated_strings(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS string FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM b)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY string ORDER BY doc_id, i) AS k FROM p) WHERE k > 1
), marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh FROM again
), numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM marked
), spans AS (SELECT doc_id, span, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, span
), around AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans
), cut AS (
  SELECT a.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept
  FROM around AS a JOIN b ON b.doc_id = a.doc_id GROUP BY a.doc_id
)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN cut ON cut.doc_id = b.doc_id
"""
