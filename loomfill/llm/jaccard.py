"""N-gram Jaccard join of documents by a token-group matrix.

Exact for the threshold asked for, whatever the texts:

1. Texts become sets of shingle hashes; equal sets are one node from here on.
2. Tokens of one node. A first matrix tells tokens that one node has from
   those that more have. A node with too many of its own can't reach the
   threshold with any other, and is closed out. Tokens travel packed, sorted
   and cut to 48 bits or more; tokens that fall together only keep nodes in.
3. Routing. Two sets that link differ in at most ``d`` tokens, so of ``d + 1``
   parts of the token space, cut for their size class, one holds the same
   tokens in both. Each open node has the hashes of its parts; nodes that share
   one are listed together, and a node that shares none links with nothing.
4. Groups. Open nodes are partitioned by the least part hash that they share, so
   similar nodes fall together, into groups of about ``GROUP`` nodes. A group has
   its token union and, for each token, the members that hold it: its rows of
   the token-group matrix. A node asks its own group and the first group of each
   of its lists. Its overlap with the union bounds its overlap with every
   member; only groups that qualify are opened, and opening one counts the exact
   intersections. So groups of near copies cost linear work, and every link
   comes from an opened group.
5. Lists that still span components form families. A family's token-group
   matrix, with components as groups, says which components have a token; a node
   whose tokens outside its own component cannot reach the threshold is closed out.
6. What remains of a family is grouped again, and its nodes ask all groups of
   other components.

A group that many nodes ask is copied to as many cells as they need. Families
above ``BLOCK`` nodes are dealt out in pairs of blocks, so no task holds more
than two blocks. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfill.llm.common import free_shuffles, key_chunks, keyed_rows, look_up, odd_ids, one_of_each, only_keys, small_batches, table, tidy, written
from loomfill.llm.components import components
from loomfill.llm.shingles import U, mix64, set_digest, shingle_set

#: Nodes in a block of a family, and in a group; tokens of a group, unless one node has more.
BLOCK, GROUP, GROUP_TOKENS = 512, 32, 131_072
#: Nodes that ask a group in one cell, and their tokens.
ASKING, ASKING_TOKENS = 512, 500_000
#: Nodes whose counts a task combines at a time.
COUNTS = 500_000
#: Families with more tokens than this are pruned by the distributed matrix before they are dealt out.
FAMILY_TOKENS = 1_000_000


class Router:
    """Part hashes of token sets for a threshold of ``percent`` (51 to 99)."""

    def __init__(self, percent: int):
        if not 67 <= percent <= 99:
            raise ValueError("thresholds from 67 to 99 percent are supported")
        self.percent = percent
        first = 1
        while not self.apart(first, first):
            first += 1
        self.ends = [first]  # class k holds sizes below ends[k]; in class 0, unequal sets never link
        while self.ends[-1] < 1 << 40:
            self.ends.append(self.ends[-1] * 3 // 2 + 1)

    def apart(self, n: int, k: int) -> int:
        """Most tokens in which linked sets of n and k tokens differ: 100 * i >= percent * u."""
        return (n + k) * (100 - self.percent) // (100 + self.percent)

    @cache
    def parts(self, size_class: int) -> tuple[int, int, np.ndarray]:
        """Number of parts, of parts that may be empty without notice, and the cuts of the token space."""
        low, high = self.ends[size_class - 1] * self.percent // 100, self.ends[size_class] - 1
        d = self.apart(high, high)
        spare = 3
        for _ in range(20):
            m = d + 1 + spare
            empty = m * exp(-low / m)
            spare = max(spare, ceil(empty + 4 * sqrt(empty) + 2))
        m = d + 1 + spare
        return m, spare, np.array([(i << 64) // m for i in range(1, m)], np.uint64)

    def hashes(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not n:
            return tokens
        own = next(k for k, end in enumerate(self.ends) if n < end)
        classes = [own] if own else []
        if 100 * n >= self.percent * self.ends[own]:
            classes.append(own + 1)
        mixed, out = mix64(tokens + U(77)), []
        for k in classes:
            m, spare, cuts = self.parts(k)
            at = np.concatenate(([0], np.searchsorted(tokens, cuts), [n]))
            held = np.flatnonzero(at[1:] > at[:-1])
            salt = U(k * 1_000_003)
            sums = np.add.reduceat(mixed, at[:-1][held])
            out.append(mix64(sums + salt + held.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
            if m - len(held) > spare:  # so many empty parts that agreement on them could be all
                none = np.setdiff1d(np.arange(m), held).astype(np.uint64)
                out.append(mix64(salt + none * U(0x9E3779B97F4A7C15) + U(1)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


@cache
def router(percent: int) -> Router:
    return Router(percent)


def linked(shared: int, n: int, k: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + k - shared)


class Group:
    """Similar nodes with their token union and, for each of its tokens, the members that hold it."""

    def __init__(self, members: np.ndarray, sets: list[np.ndarray]):
        self.members = members
        self.sizes = np.array([len(sets[i]) for i in members])
        tokens = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        self.union = tokens[first]
        self.at = np.append(first, len(tokens))

    def overlaps(self, tokens: np.ndarray, needed: float) -> np.ndarray | None:
        """Exact intersection sizes with all members, or None if the union bounds them all below ``needed``."""
        k = np.searchsorted(self.union, tokens)
        k[k == len(self.union)] = 0
        k = k[self.union[k] == tokens]
        if len(k) < needed:
            return None
        low, counts = self.at[k], self.at[k + 1] - self.at[k]
        ends = np.cumsum(counts)
        spots = np.arange(ends[-1]) + np.repeat(low - ends + counts, counts)
        return np.bincount(self.owner[spots], minlength=len(self.members))


def group_links(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, percent: int, cross: bool) -> list[tuple[int, int]]:
    """Links between nodes of different roots; only between sides if ``cross``."""
    sizes = np.array([len(s) for s in sets])
    least = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
    out: list[tuple[int, int]] = []
    halves = (0, 1) if cross else (0,)
    of_side = [np.flatnonzero(side == h) for h in halves]
    indexed, asking = of_side[0], of_side[-1]
    indexed = indexed[np.lexsort((sizes[indexed], least[indexed]))]  # equal least hashes: likely similar
    groups = [Group(indexed[i : i + GROUP], sets) for i in range(0, len(indexed), GROUP)]
    for q in asking.tolist():
        n = int(sizes[q])
        for g in groups:
            fits = (100 * g.sizes >= percent * n) & (100 * n >= percent * g.sizes) & (roots[g.members] != roots[q])
            if not fits.any():
                continue
            needed = percent * (n + int(g.sizes[fits].min())) / (100 + percent)
            shared = g.overlaps(sets[q], needed)
            if shared is None:
                continue
            hit = fits & (100 * shared >= percent * (n + g.sizes - shared))
            out += [(q, int(k)) for k in g.members[hit] if cross or q < k]
    return out


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return small_batches(docs.select("doc_id", text.alias("text")))


def _map_sets(docs: DataFrame, width: int, whole: bool) -> DataFrame:
    """``doc_id, n, node, mark``, and by ``whole`` the set itself as ``data``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(1)]
            nodes = [set_digest(s) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(map(_mark, nodes), pa.int64())]
            columns += [pa.array([s.tobytes() for s in sets], pa.binary())] * whole
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "mark", "data"][: 4 + whole])

    rows = _texts(docs)
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n long, node binary, mark long" + ", data binary" * whole)


def _mark(node: bytes) -> int:
    """A number for a node; should two nodes share it, their tokens only look shared."""
    return int.from_bytes(node[:8], "little", signed=True)


def _range_bits(spark: SparkSession) -> int:
    """Tokens are dealt out by their first bits, at least four ranges for each shuffle partition; workers hold one at a time."""
    return min(24, max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _own_tokens(docs: DataFrame, width: int) -> DataFrame:
    """``mark, own``: how many tokens of a node no other node has; nodes without any are left out.

    Tokens are compared by the 40 bits after those of their range.
    """
    bits = _range_bits(docs.sparkSession)
    ranges = 1 << bits
    mark_bits = bits - 2  # of marks there are as many ranges as partitions

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, marks = [], []
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), width)
                if len(tokens):
                    sets.append(tokens)
                    marks.append(_mark(set_digest(tokens)))
            if not sets:
                continue
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            cuts = np.searchsorted(tokens, np.arange(1, ranges, dtype=np.uint64) << U(64 - bits))
            rest = (tokens << U(bits)) >> U(24)
            low, high = rest.astype("<u4"), (rest >> U(32)).astype(np.uint8)
            out = [[], [], [], [], []]
            bounds = np.concatenate(([0], cuts, [len(tokens)]))
            for k in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                part = slice(bounds[k], bounds[k + 1])
                held, index = np.unique(owner[part], return_inverse=True)
                for column, value in zip(out, (k, low[part].tobytes(), high[part].tobytes(), index.astype("<u2").tobytes(), np.array(marks, "<i8")[held].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["range", "low", "high", "owner", "marks"])

    def dealt(marks: list[np.ndarray], own: list[np.ndarray]) -> pa.RecordBatch:
        mark, index = np.unique(np.concatenate(marks), return_inverse=True)
        own = np.bincount(index, weights=np.concatenate(own)).astype("<u4")
        group = np.searchsorted(mark, np.arange(-(1 << mark_bits - 1), 1 << mark_bits - 1, dtype=np.int64) << (64 - mark_bits))
        group = np.append(group, len(mark))
        some = np.flatnonzero(group[1:] > group[:-1]).tolist()
        columns = [pa.array([x[group[i] : group[i + 1]].tobytes() for i in some], pa.binary()) for x in (mark, own)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], ["range", "marks", "own"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_marks, found_own, n = [], [], 0
        for part in key_chunks(batches, size=4 << 20):
            held: dict[int, list[tuple]] = {}
            for k, *row in zip(*(c.to_pylist() for c in part.columns)):
                held.setdefault(k, []).append(row)
            for rows in held.values():
                tokens, owners = [], []
                for low, high, owner, marks in rows:
                    tokens.append(np.frombuffer(high, np.uint8).astype(np.uint64) << U(32) | np.frombuffer(low, "<u4"))
                    owners.append(np.frombuffer(marks, "<i8")[np.frombuffer(owner, "<u2")])
                tokens, owners = np.concatenate(tokens), np.concatenate(owners)
                order = np.argsort(tokens)
                tokens, owners = tokens[order], owners[order]
                first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                single = np.minimum.reduceat(owners, first) == np.maximum.reduceat(owners, first)
                # A token of one node may come from several copies of it, and counts once.
                mark, own = np.unique(owners[first[single]], return_counts=True)
                found_marks.append(mark)
                found_own.append(own)
                n += len(mark)
            if n >= COUNTS:
                yield dealt(found_marks, found_own)
                found_marks, found_own, n = [], [], 0
        if n:
            yield dealt(found_marks, found_own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_chunks(batches, size=4 << 20):
            marks = np.frombuffer(b"".join(part["marks"].to_pylist()), "<i8")
            mark, index = np.unique(marks, return_inverse=True)
            own = np.bincount(index, weights=np.frombuffer(b"".join(part["own"].to_pylist()), "<u4")).astype(np.int64)
            for i in range(0, len(mark), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(mark[i : i + 100_000]), pa.array(own[i : i + 100_000])], ["mark", "own"])

    packed = _texts(docs).select("text").mapInArrow(tidy(pack), "range int, low binary, high binary, owner binary, marks binary")
    counted = packed.repartition("range").sortWithinPartitions("range").mapInArrow(tidy(count), "range int, marks binary, own binary")
    return counted.repartition("range").sortWithinPartitions("range").mapInArrow(tidy(add), "mark long, own long")


def _hashes(sets: DataFrame, percent: int) -> DataFrame:
    """``hash, node`` rows of the part hashes of ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = router(percent)
        for batch in batches:
            found = [route.hashes(_tokens(d.as_py())) for d in batch.column(1)]
            if found:
                spots = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(pa.array(spots))], ["hash", "node"])

    return small_batches(sets.select("node", "data")).mapInArrow(tidy(run), "hash long, node binary")


def cell_links(members: list[np.ndarray], asking: list[np.ndarray], same: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (asking, member) that join what was apart in this cell; ``same`` tells which member an asking node is, or -1.

    The members are one group: a node whose overlap with the group's union is
    too small opens nothing.
    """
    group = Group(np.arange(len(members)), members)
    root = list(range(len(members) + len(asking)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for q, (tokens, own) in enumerate(zip(asking, same)):
        n = len(tokens)
        fits = (100 * group.sizes >= percent * n) & (100 * n >= percent * group.sizes)
        if own >= 0:
            fits[own] = False
            root[len(members) + q] = find(own)
        if not fits.any():
            continue
        shared = group.overlaps(tokens, percent * (n + int(group.sizes[fits].min())) / (100 + percent))
        if shared is None:
            continue
        for k in np.flatnonzero(fits & (100 * shared >= percent * (n + group.sizes - shared))).tolist():
            a, b = find(len(members) + q), find(k)
            if a != b:
                root[a] = b
                out.append((q, k))
    return out


def _partition(listed: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, n, group``: each listed node's group."""
    least = listed.groupBy("node").agg(F.min("hash").alias("key"))
    keyed = least.join(sets.select("node", "n"), "node")
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), pieces.alias("pieces")), "group-sizes", share=16)
    placed = look_up(keyed, sizes, ["key"], "k", F.xxhash64("node"))
    return placed.select("node", "n", F.xxhash64("key", F.pmod(F.xxhash64("node"), "pieces")).alias("group"))


def _ask_groups(visits: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` from the groups that ``visits`` (``node, group``) ask and open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_chunks(batches):
            cell = part["cell"].to_numpy()
            cuts = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell)).tolist()
            a, b = [], []
            for low, high in zip(cuts, cuts[1:]):
                one = part.slice(low, high - low)
                nodes, data, asks = one["node"].to_pylist(), [_tokens(d) for d in one["data"].to_pylist()], one["asks"].to_pylist()
                members, asking = [i for i, x in enumerate(asks) if not x], [i for i, x in enumerate(asks) if x]
                if not members or not asking:
                    continue
                at = {nodes[i]: k for k, i in enumerate(members)}
                for q, k in cell_links([data[i] for i in members], [data[i] for i in asking], [at.get(nodes[i], -1) for i in asking], percent):
                    a.append(nodes[asking[q]])
                    b.append(nodes[members[k]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    sized = visits.join(groups.select("node", "n"), "node")
    cells = F.greatest(F.ceil(F.count(F.lit(1)) / ASKING), F.ceil(F.sum("n") / ASKING_TOKENS)).cast("int")
    needs = written(sized.groupBy("group").agg(F.count(F.lit(1)).alias("k"), cells.alias("cells")), "cells", share=16)
    number = F.xxhash64("node")
    asking = look_up(sized, needs, ["group"], "k", number).select("node", F.xxhash64("group", F.pmod(number, "cells").cast("int")).alias("cell"), F.lit(True).alias("asks"))
    copies = groups.join(needs, "group").select("node", "group", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("copy"))
    members = copies.select("node", F.xxhash64("group", "copy").alias("cell"), F.lit(False).alias("asks"))
    rows = asking.unionByName(members).join(sets.select("node", "data"), "node").select("cell", "node", "asks", "data")
    return small_batches(rows.repartition("cell").sortWithinPartitions("cell")).mapInArrow(tidy(run), "a binary, b binary")


def _close_out(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 5 for large families: ``family, node, root`` of the members that the matrix leaves open.

    A node may differ from a partner in ``slack`` tokens at most, summed over
    the two; tokens that no other component of the family has use it up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(3).to_pylist()
            spots = pa.array(np.repeat(np.arange(len(data)), [len(d) // 8 for d in data]))
            tokens = pa.array(np.frombuffer(b"".join(data), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(spots) for i in range(3)), tokens], ["family", "node", "root", "token"])

    # Families and nodes by number keep the exploded rows narrow.
    kept = members.join(sets.select("node", "n", "data"), "node")
    narrow = kept.select(F.xxhash64("family").alias("family"), F.xxhash64("node").alias("node"), F.xxhash64("root").alias("root"), "data")
    rows = small_batches(narrow).mapInArrow(tidy(run), "family long, node long, root long, token long")
    matrix = rows.groupBy("family", "token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    alone = matrix.where("low = high").select("family", "token")
    unmatched = rows.join(alone, ["family", "token"]).groupBy("family", "node").agg(F.count(F.lit(1)).alias("unmatched"))
    slack = (
        members.join(sets.select("node", "n"), "node")
        .withColumns({"f": F.xxhash64("family"), "v": F.xxhash64("node")})
        .join(unmatched.select(F.col("family").alias("f"), F.col("node").alias("v"), "unmatched"), ["f", "v"], "left")
        .select("family", "node", "root", (F.col("n") * (100 - percent) - F.coalesce("unmatched", F.lit(0)) * (100 + percent)).alias("slack"))
    )
    slack = written(slack, "slack", share=16)
    most = slack.groupBy("family").agg(F.max("slack").alias("most"))
    return slack.join(most, "family").where("slack + most >= 0").select("family", "node", "root")


def _open_groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 6: links ``a, b`` between members of a family under different roots."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        found = group_links(
            [_tokens(d) for d in frame["data"]],
            pd.factorize(frame["root"])[0],
            (frame["block"] != low).to_numpy().astype(int),
            percent,
            cross=low != high,
        )
        nodes = frame["node"].to_numpy()
        return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[k] for _, k in found]}, columns=["a", "b"])

    counts = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cells = (
        members.join(counts, "family")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", "node", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(sets.select("node", "data"), "node")
    )
    return cells.groupBy("family", "low", "high").applyInPandas(run, "a binary, b binary")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Link documents whose shingle sets' Jaccard similarity is ``percent`` or more.

    Returns one row per row of ``docs``: ``doc_id, n_shingles, component_id``,
    the smallest id that links reach. Null and blank texts have no shingles
    and link with nothing. A null id counts only where a whole component has
    no other. Repeated rows share their component. Texts of any length count
    whole, an empty table gives an empty result, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = written(_map_sets(rows, width, whole=False), "names")
    root = components(node_links(rows, names, width, percent))
    nodes = names.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k"))
    linked = written(root.join(nodes, "node").select("node", "root", "least"), "linked", share=16)
    reached = written(linked.groupBy("root").agg(F.min("least").alias("reached"), F.count(F.lit(1)).alias("k")), "reached", share=16)
    by_node = look_up(linked, reached, ["root"], "k", F.xxhash64("node")).select("node", "reached")
    found = nodes.join(by_node, "node", "left").select("node", F.coalesce("reached", "least").alias("component_id"), "k")
    alike = look_up(names.where("n > 0"), written(found, "found"), ["node"], "k")
    empty = names.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return alike.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def node_links(rows: DataFrame, names: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between unequal sets, as digests, whose components are those of all links."""
    # Step 2: open nodes, and their sets from one document of each.
    own = _own_tokens(rows, width)
    marked = names.where("n > 0").join(own, "mark", "left")
    possible = marked.where(F.coalesce("own", F.lit(0)) * 100 <= F.col("n") * (100 - percent))
    chosen = written(possible.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "chosen", share=16)
    free_shuffles(rows.sparkSession)
    some = only_keys(rows, chosen.where("doc_id IS NOT NULL").distinct(), "doc_id")
    if not chosen.where("doc_id IS NULL").isEmpty():
        some = some.unionByName(rows.where("doc_id IS NULL"))
    sets = written(_map_sets(some, width, whole=True).select("node", "n", "data").where("n > 0").dropDuplicates(["node"]), "sets", share=4)
    # Step 3: lists of nodes that share a part hash.
    hashes = _hashes(sets, percent)
    mark = F.xxhash64("node")
    common = (
        hashes.select("hash", mark.alias("mark")).groupBy("hash").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high")
    )
    common = written(common.select("hash"), "common", share=16)
    listed = written(only_keys(hashes, common, "hash").distinct(), "listed", share=4)
    # Step 4: groups, and first components from those that open.
    groups = written(_partition(listed, sets), "groups", share=4)
    first = listed.join(groups.select("node", "group"), "node").groupBy("hash").agg(F.min(F.struct("node", "group")).alias("first"), F.count(F.lit(1)).alias("k"))
    listed = written(look_up(listed, written(first, "first", share=4), ["hash"], "k", mark).select("hash", "node", F.col("first.node").alias("leader"), F.col("first.group").alias("group")), "lists", share=4)
    free_shuffles(rows.sparkSession)
    visits = listed.select("node", "group").unionByName(groups.select("node", "group")).distinct()
    links = written(_ask_groups(visits, groups, sets, percent), "links", share=16)
    root = components(links)
    # Step 5: families of lists that span components.
    spread = listed.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = spread.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hash")
    members = written(
        spread.join(open_lists, "hash").select(F.col("leader").alias("family"), "node", "root").distinct(), "members", share=4
    )
    sizes = members.join(sets.select("node", "n"), "node").groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"))
    sized = written(sizes.select("family", (F.col("k") > BLOCK) | (F.col("tokens") > FAMILY_TOKENS)).toDF("family", "large"), "families", share=16)
    large = members.join(sized.where("large"), "family").drop("large")
    small = members.join(sized.where("NOT large"), "family").drop("large")
    left = small
    if not sized.where("large").isEmpty():
        left = small.unionByName(_close_out(large, sets, percent))
    # Step 6.
    more = written(_open_groups(left, sets, percent), "more", share=16)
    return links.unionByName(more)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with exactly one row of each component: one with the smallest id.

    A null id ranks behind every other. Where an id is null or repeated, rows go by
    id and text digest in place of the id; of repeated rows any one stays, blank ones too.
    Empty input gives an empty result; columns of any name are returned as they are.
    """
    if odd_ids(docs, id_col):
        keyed = keyed_rows(docs, F.col(id_col).isNull(), id_col, text_col)
        kept = jaccard_components(keyed, "key", "text", width, percent).where("doc_id = component_id")
        return one_of_each(keyed, written(kept.select(F.col("doc_id").alias("key")).distinct(), "kept", share=16))
    kept = jaccard_components(docs, id_col, text_col, width, percent).where("doc_id = component_id")
    kept = written(kept.select(F.col("doc_id").alias(id_col)), "kept", share=16)
    return only_keys(docs, kept, id_col).select(*docs.columns)


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS shingles
  FROM w
), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.doc_id, e.b FROM reached AS r JOIN ends AS e ON e.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, len(s.shingles) AS n_shingles, l.component_id FROM s JOIN least AS l ON l.doc_id = s.doc_id
"""
