"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than the next one; the
leftmost-smaller ones are sorted by their substrings, recursively where some are
equal, and induce the order of all others, linearly.

Where buckets hold many suffixes, induction runs over a whole bucket at once:
all entries that other buckets have pushed, and with them their runs of one
symbol, in a closed form. So it costs four steps a bucket, whatever the runs.
Where buckets are thin (reduced strings, short texts) it goes entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Buckets must hold so many suffixes on average for induction by buckets to pay.
THIN = 64


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (numbers from 0 to sigma - 1) in order; a prefix comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # Types: True for a suffix smaller than the next one. Ties take the type of the next differing place.
    place = np.arange(n)
    differ = np.append(text[:-1] != text[1:], True)
    nearest = np.minimum.accumulate(np.where(differ, place, n - 1)[::-1])[::-1]
    smaller = np.append(text[:-1] < text[1:], False)[nearest]
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    if sigma * THIN > n:
        plain = text.tolist(), smaller.tolist(), ends.tolist()
        induce = lambda ordered: np.array(_induce_singly(*plain, ordered.tolist()), np.int64)
    else:
        run = np.maximum.accumulate(np.where(np.append(True, differ[:-1]), place, 0))
        small = text.astype(np.uint16) if sigma <= 1 << 16 else text.astype(np.int64)
        induce = lambda ordered: _induce_buckets(small, run, ends, ordered)
    array = induce(leftmost)
    if len(leftmost) < 2:
        return array
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = array[is_leftmost[array]]
    # Leftmost-smaller substrings, each up to the next one's start; equal neighbours share a name.
    stop = np.full(n, n, np.int64)
    stop[leftmost[:-1]] = leftmost[1:] + 1
    names = np.cumsum(np.append(False, ~_same(text, ordered, stop[ordered], n)))
    if names[-1] + 1 < len(leftmost):
        by_place = np.zeros(n, np.int64)
        by_place[ordered] = names
        ordered = leftmost[suffix_array(by_place[leftmost], int(names[-1]) + 1)]
    return induce(ordered)


def _same(text: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Whether each substring equals the one before; one that ends with the text equals none."""
    length = stop - start
    out = (length[1:] == length[:-1]) & (stop[1:] < n) & (stop[:-1] < n)
    pairs = np.flatnonzero(out)
    if len(pairs):
        size = length[pairs]
        ends = np.cumsum(size)
        step = np.arange(ends[-1]) - np.repeat(ends - size, size)
        equal = text[np.repeat(start[pairs], size) + step] == text[np.repeat(start[pairs + 1], size) + step]
        out[pairs] = np.logical_and.reduceat(equal, ends - size)
    return out


def _induce_singly(text: list[int], smaller: list[bool], ends: list[int], leftmost: list[int]) -> list[int]:
    """Induce all suffixes from leftmost-smaller ones, given in order within each bucket."""
    n = len(text)
    array = [-1] * n
    tail = ends.copy()
    for i in reversed(leftmost):
        c = text[i]
        tail[c] -= 1
        array[tail[c]] = i
    head = [0, *ends[:-1]]
    c = text[n - 1]  # smaller than nothing: the first larger suffix of its bucket
    array[head[c]] = n - 1
    head[c] += 1
    for i in array:  # grows ahead of the scan
        if i > 0 and not smaller[i - 1]:
            c = text[i - 1]
            array[head[c]] = i - 1
            head[c] += 1
    tail = ends.copy()
    for k in range(n - 1, -1, -1):
        i = array[k]
        if i > 0 and smaller[i - 1]:
            c = text[i - 1]
            tail[c] -= 1
            array[tail[c]] = i - 1
    return array


def _induce_buckets(text: np.ndarray, run: np.ndarray, ends: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The same, a bucket at a time; ``run`` tells where the run of one symbol around each place starts."""
    n, sigma = len(text), len(ends)
    starts = np.concatenate(([0], ends[:-1]))
    array = np.full(n, -1, np.int64)
    symbol = text[leftmost]
    seeds = leftmost[np.argsort(symbol, kind="stable")]
    seed_at = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=sigma))))
    head, tail = starts.copy(), ends.copy()

    def with_runs(first: np.ndarray) -> np.ndarray:
        """Entries from other buckets end their runs; all second to last places follow all last ones, and so on."""
        count = first - run[first] + 1
        total = int(count.sum())
        if total == len(first):
            return first
        back = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return (np.repeat(first, count) - back)[np.argsort(back, kind="stable")]

    def push(entries: np.ndarray, c: int, up: bool) -> None:
        """The predecessors in other buckets: those above go to heads, those below to tails."""
        before = entries[entries > 0] - 1
        symbol = text[before]
        keep = symbol > c if up else symbol < c
        before, symbol = before[keep], symbol[keep]
        if not len(before):
            return
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order].astype(np.int64)
        counts = np.bincount(symbol, minlength=sigma)
        rank = np.arange(len(before)) - (np.cumsum(counts) - counts)[symbol]
        if up:
            array[head[symbol] + rank] = before
            np.add(head, counts, out=head)
        else:
            array[tail[symbol] - 1 - rank] = before
            np.subtract(tail, counts, out=tail)

    last = int(text[n - 1])
    array[head[last]] = n - 1
    head[last] += 1
    used = np.flatnonzero(ends > starts).tolist()
    for c in used:
        low = starts[c]
        if head[c] > low:
            entries = with_runs(array[low : head[c]])
            array[low : low + len(entries)] = entries
            head[c] = low + len(entries)
            push(entries, c, True)
        push(seeds[seed_at[c] : seed_at[c + 1]], c, True)
    for c in reversed(used):
        high = ends[c]
        if tail[c] < high:
            entries = with_runs(array[tail[c] : high][::-1])
            tail[c] = high - len(entries)
            array[tail[c] : high] = entries[::-1]
            push(entries, c, False)
        push(array[starts[c] : head[c]][::-1], c, False)
    return array


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, most: int = 1 << 62) -> np.ndarray:
    """For each place of ``text`` (bytes): how much its suffix shares with the one before it in order.

    Places whose symbol to the left differs from their partner's are compared
    directly; all others have one less than the place to their left.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    partner = np.full(n, -1, np.int64)
    partner[array[1:]] = array[:-1]
    place = np.arange(n)
    direct = (place == 0) | (partner <= 0) | (text[place - 1] != text[np.maximum(partner - 1, 0)])
    start, other = place[direct], partner[direct]
    shared = np.zeros(len(start), np.int64)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = text
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    open_ = np.flatnonzero(other >= 0)
    while len(open_):
        a, b = start[open_] + shared[open_], other[open_] + shared[open_]
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        same = words[a] == words[b]
        got = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        room = n - np.maximum(a, b)
        got = np.minimum(got, room)
        shared[open_] += got
        open_ = open_[(got == 8) & (shared[open_] < most)]
    spots = np.maximum.accumulate(np.where(direct, place, 0))
    value = np.zeros(n, np.int64)
    value[start] = shared
    return np.maximum(value[spots] - (place - spots), 0)
