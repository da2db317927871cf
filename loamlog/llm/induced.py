"""External suffix sorting by recursive induction, with queues, texts and orders on disk and common-prefix lengths carried."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from math import isqrt

import numpy as np

CHUNK = 1 << 16
MEMORY = 1 << 20  # tuples that a queue keeps off the disk, and names that are ordered without another level
DEPTH = 1 << 8
DIGIT = 1 << 12  # most names that a level below the first has as characters of their own, if two digits do
LCP_BITS = 20  # of a tuple; the rest is the position


def mapped(n: int, dtype, file=None) -> np.ndarray:
    """An array on disk of ``n`` zeros, or of what ``file`` holds. Its file has no name and goes with it, as a spill of the task."""
    file = file or tempfile.TemporaryFile()
    file.flush()
    size = max(1, n) * np.dtype(dtype).itemsize
    file.truncate(size)
    return np.frombuffer(mmap.mmap(file.fileno(), size), dtype)


def cool(*arrays: np.ndarray) -> None:
    """Unmap the pages of arrays on disk that were touched; the machine keeps or writes them as it likes."""
    for a in arrays:
        while isinstance(a, np.ndarray):
            a = a.base
        if isinstance(a, mmap.mmap):
            a.madvise(mmap.MADV_DONTNEED)


def packed(at: np.ndarray, lcp: np.ndarray | int = 0) -> np.ndarray:
    """Tuples of a suffix's position and its common prefix with the suffix before it."""
    return at << LCP_BITS | lcp


def unpacked(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuples >> LCP_BITS, tuples & (1 << LCP_BITS) - 1


class TupleQueue:
    """Priority queue of tuples with small integers as priorities; all but about ``memory`` tuples wait in one nameless file.

    A suffix that is induced comes from one processed before, so tuples of a priority arrive in the order of their suffixes and come out
    as they went in. Those that came out can be read again in reverse.
    """

    def __init__(self, priorities: int, memory: int):
        self.memory, self.chunk = memory, max(1, min(CHUNK, memory))
        self.blocks: list[list] = [[] for _ in range(priorities)]  # arrays, or place and number of tuples on disk
        self.taken = [0] * priorities  # blocks that came out
        self.loose: dict[int, int] = {}  # priorities with arrays in memory, and the first of these
        self.held, self.file, self.end = 0, None, 0

    def push(self, priority: int, tuples: np.ndarray) -> None:
        own = self.blocks[priority]
        self.loose.setdefault(priority, len(own))
        own.append(tuples)
        self.held += len(tuples) + 8  # an array has an overhead
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        for priority, first in self.loose.items():
            own, split = self.blocks[priority], max(first, self.taken[priority])
            done, wait = self._written(own[first:split]), self._written(own[split:])
            own[first:] = done + wait
            if split > first:
                self.taken[priority] = first + len(done)
        self.loose, self.held = {}, 0

    def _written(self, arrays: list[np.ndarray]) -> list[tuple[int, int]]:
        if not arrays:
            return []
        size = sum(map(len, arrays))
        start = self.end
        for t in arrays:
            self.file.write(t.tobytes())
        self.end += 8 * size
        return [(start + 8 * k, min(self.chunk, size - k)) for k in range(0, size, self.chunk)]

    def _read(self, block) -> np.ndarray:
        if isinstance(block, np.ndarray):
            return block
        self.file.seek(block[0])
        return np.frombuffer(self.file.read(8 * block[1]), np.int64)

    def pop(self, priority: int) -> np.ndarray:
        """The next tuples of a priority, none at the end."""
        own, at = self.blocks[priority], self.taken[priority]
        if at == len(own):
            return np.empty(0, np.int64)
        if isinstance(own[at], np.ndarray) and len(own) > at + 1:
            own[at:] = [np.concatenate(own[at:])]
        self.taken[priority] += 1
        return self._read(own[at])

    def reverse(self, priority: int) -> Iterator[np.ndarray]:
        """All tuples of a priority from the last to the first."""
        for block in reversed(self.blocks[priority]):
            yield self._read(block)[::-1]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int | np.ndarray) -> np.ndarray:
    """Common-prefix lengths of suffixes of ``text`` (padded by the limit), at most ``limit``."""
    limit = np.broadcast_to(limit, len(a))
    out = limit.astype(np.int64)
    left = np.flatnonzero((a != b) & (out > 0))
    k = 0
    while len(left):
        x, y = (text[p[left][:, None] + np.arange(k, k + 8)] for p in (a, b))
        differ = x != y
        found = differ.argmax(axis=1)
        done = differ[np.arange(len(left)), found]
        own = left[done]
        out[own] = np.minimum(k + found[done], limit[own])
        k += 8
        left = left[~done]
        left = left[limit[left] > k]
    return out


class _Pushes:
    """Deals batches of inducing suffixes to the buckets before them, with the least common prefix since each bucket's last."""

    def __init__(self, alphabet: int, memory: int, carry: bool, depth: int):
        self.carry, self.depth = carry, depth
        self.queue = TupleQueue(alphabet, memory)
        self.least = np.zeros(alphabet, np.int64)

    def new_bucket(self) -> None:
        self.least[:] = 0

    def deal(self, at: np.ndarray, lcp: np.ndarray, to: np.ndarray, chosen: np.ndarray) -> None:
        """``to``: the bucket of the suffix before each; only ``chosen`` ones are pushed."""
        own = np.flatnonzero(chosen)
        if len(own):
            order = own[np.argsort(to[own], kind="stable")]
            bucket = to[order]
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            out = packed(at[order] - 1)
            if self.carry:
                before = np.where(first, -1, np.concatenate([[0], order[:-1]]))
                reach = _range_min(lcp, before + 1, order)
                out |= np.minimum(np.where(first, np.minimum(reach, self.least[bucket]), reach) + 1, self.depth)
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(order))
            for b, s, e in zip(bucket[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
                self.queue.push(b, out[s:e])
            last, names = order[ends - 1], bucket[starts]
        if not self.carry or not len(at):
            return
        np.minimum(self.least, lcp.min(), out=self.least)
        if len(own):
            after = np.minimum.accumulate(lcp[::-1])[::-1]
            self.least[names] = np.where(last + 1 < len(lcp), after[np.minimum(last + 1, len(lcp) - 1)], self.depth)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low..high]``, both ends included."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    table, width = values.astype(np.int64), 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    return out


def star_positions(text: np.ndarray, n: int, chunk: int = CHUNK) -> np.ndarray:
    """Leftmost S suffixes of ``text[:n]``, ascending: each is less than the one after it, the one before it isn't."""
    out = mapped(n // 2 + 1, np.int64)
    to, end = len(out), n
    after_s = True  # the last character is the least of all
    while end > 1:
        start = max(1, end - chunk)
        part = text[start - 1 : end + 1].astype(np.int64) if end < n else np.append(text[start - 1 : n].astype(np.int64), -1)
        step = np.sign(part[1:] - part[:-1])  # of start - 1 to end - 1
        if end == n:
            step[-1] = 1
        elif step[-1] == 0:
            step[-1] = 1 if after_s else -1
        filled = np.flatnonzero(step)
        kind = step[filled[np.searchsorted(filled, np.arange(len(step)))]] > 0
        found = np.flatnonzero(kind[1:] & ~kind[:-1]) + start
        out[to - len(found) : to] = found
        to -= len(found)
        after_s, end = bool(kind[1]), start
    return out[to:]


def induce(text: np.ndarray, n: int, alphabet: int, seeds: TupleQueue, memory: int, depth: int, carry: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes from the last to the first in order, from the leftmost S suffixes, which ``seeds`` has in order and with their common prefixes.

    Yields chunks of positions, for each the common prefix with the one yielded before it, and which are leftmost S suffixes themselves. Two passes over the
    buckets of first characters: L suffixes upwards, then S suffixes downwards; each tuple induces the suffix before it. Without ``carry`` the common prefixes mean nothing.
    """
    low = _Pushes(alphabet, memory, carry, depth)
    last_l = np.full(alphabet, -1)
    for c in range(alphabet):
        low.new_bucket()
        first = True
        while len(chunk := low.queue.pop(c)):
            at, l = unpacked(chunk)
            if first:
                l[0], first = 0, False
            last_l[c] = at[-1]
            before = np.where(at > 0, text[at - 1], 0).astype(np.int64)
            low.deal(at, l, before, (at > 0) & (before >= c))
        first = True
        while len(chunk := seeds.pop(c)):
            at, l = unpacked(chunk)
            if first:
                l[0], first = common_prefix(text, last_l[c : c + 1], at[:1], depth)[0] if last_l[c] >= 0 else 0, False
            low.deal(at, l, np.where(at > 0, text[at - 1], 0).astype(np.int64), at > 0)
    high = _Pushes(alphabet, memory, carry, depth)
    for c in range(alphabet - 1, -1, -1):
        high.new_bucket()
        last = -1
        while len(chunk := high.queue.pop(c)):
            at, l = unpacked(chunk)
            if last < 0:
                l[0] = 0
            last = at[-1]
            before = np.where(at > 0, text[at - 1], alphabet).astype(np.int64)
            high.deal(at, l, before, (at > 0) & (before <= c))
            yield at, l, (at > 0) & (before > c)
        high.queue.blocks[c] = []  # read for the last time
        if c == 0:  # the last suffix is the least one, and nothing induces it
            at = np.array([n - 1])
            yield at, np.zeros(1, np.int64), at > 0
        carried = 0
        for k, chunk in enumerate(low.queue.reverse(c)):
            at, own = unpacked(chunk)
            l = np.empty(len(at), np.int64)
            l[1:] = own[:-1]
            l[0] = carried if k else (common_prefix(text, np.array([last]), at[:1], depth)[0] if last >= 0 else 0)
            carried = int(own[-1])
            before = np.where(at > 0, text[at - 1], alphabet).astype(np.int64)
            high.deal(at, l, before, (at > 0) & (before < c))
            yield at, l, np.zeros(len(at), bool)


def order_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names in order to ``depth`` names, by doubling, in memory: the base of the recursion."""
    order = np.argsort(names, kind="stable")
    total, width = len(names), 1
    rank = np.empty(total, np.int64)  # of a suffix: where those that are equal to it so far start in the order
    first = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(total), 0))
    while width < depth:
        slots = np.flatnonzero(~first | ~np.append(first[1:], True))  # only groups of several go on
        if not len(slots):
            break
        open_ = order[slots]
        then = np.where(open_ + width < total, rank[np.minimum(open_ + width, total - 1)] + 1, 0)
        pair = rank[open_] * (total + 1) + then
        within = np.argsort(pair)
        order[slots], pair = open_[within], pair[within]
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        first[slots] = fresh
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        width *= 2
    return order


def _spans(n: int, chunk: int) -> Iterator[tuple[int, int]]:
    return ((k, min(n, k + chunk)) for k in range(0, n, chunk))


def _named(text: np.ndarray, n: int, alphabet: int, stars: np.ndarray, memory: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the pieces between leftmost S suffixes, the name of each by that order, and the number of names.

    Pieces are induced from leftmost S suffixes in any order. Equal pieces have one name; so have pieces that agree to ``depth``.
    """
    count, chunk = len(stars), max(1, min(CHUNK, memory))
    seeds = TupleQueue(alphabet, memory)
    for a, e in _spans(count, chunk):
        at = np.array(stars[a:e])
        char = text[at]
        within = np.argsort(char, kind="stable")
        edges = np.flatnonzero(np.diff(char[within], prepend=-1))
        tuples = packed(at[within])
        for s, t in zip(edges.tolist(), np.append(edges[1:], len(at)).tolist(), strict=True):
            seeds.push(int(char[within[s]]), tuples[s:t])
    order, names = mapped(count, np.int64), mapped(count, np.int64)
    to, name, after = count, 0, None
    for at, _, is_star in induce(text, n, alphabet, seeds, memory, depth, carry=False):
        at = at[is_star]
        if not len(at):
            continue
        nth = np.searchsorted(stars, at)
        size = np.where(nth + 1 < count, stars[np.minimum(nth + 1, count - 1)], n - 1) - at
        if after is not None:
            at, nth, size = (np.concatenate([[x], y]) for x, y in zip(after, (at, nth, size), strict=True))
        same = size[1:] == size[:-1]
        own = np.flatnonzero(same)
        reach = np.minimum(size[own] + 1, depth)
        same[own] = common_prefix(text, at[own], at[own + 1], reach) >= reach
        own = np.concatenate([[name], name + np.cumsum(~same)])
        skip = after is not None
        names[nth[skip:]] = own[skip:]
        order[to - len(nth) + skip : to] = nth[skip:][::-1]
        to -= len(nth) - skip
        name, after = int(own[-1]), (at[-1], nth[-1], size[-1])
    for a, e in _spans(count, chunk):  # they were counted from the last one down
        names[a:e] = name - names[a:e]
    return order, names, name + 1


def _ordered(names: np.ndarray, distinct: int, memory: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a string of names from the last to the first in order, with common prefixes in names: another level of induction.

    A name is written as two digits of a number where that makes the string of the next level shorter, so that buckets stay few; suffixes that start within a name are left out again.
    """
    count, chunk = len(names), max(1, min(CHUNK, memory))
    # one digit or two: more would make the string longer than it was
    for width in (1,) if distinct <= min(DIGIT, max(4, count // 64)) else (2, 1):
        base, deep = distinct if width == 1 else isqrt(distinct - 1) + 1, (depth + 1) * width
        text = mapped(count * width + 1 + deep + 8, np.uint16 if base < 1 << 16 else np.uint32)
        for a, e in _spans(count, chunk):
            left = names[a:e].copy()
            for k in range(width - 1, -1, -1):
                text[a * width + k : e * width : width] = left % base + 1
                left //= base
        if width == 1 or len(star_positions(text, count * width + 1, chunk)) < 0.8 * count:  # with one digit it is half as many at most
            break
    carried = np.iinfo(np.int64).max
    for at, lcp in sorted_suffixes(text, base + 1, memory, deep, count * width + 1):
        own = np.flatnonzero((at % width == 0) & (at < count * width))
        if not len(own):
            carried = min(carried, int(lcp.min()))
            continue
        least = np.minimum.reduceat(lcp, np.concatenate([[0], own[:-1] + 1]))
        least[0] = min(least[0], carried)
        carried = int(lcp[own[-1] + 1 :].min()) if own[-1] + 1 < len(lcp) else np.iinfo(np.int64).max
        yield at[own] // width, least // width


def sorted_suffixes(text: np.ndarray, alphabet: int, memory: int = MEMORY, depth: int = DEPTH, n: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text[:n]`` from the last to the first in order, in chunks of positions and common prefixes with the one before.

    ``text`` holds characters below ``alphabet`` and ``text[n - 1]`` is 0, which stands nowhere before; beyond it are ``depth + 8`` more zeros, which are added if ``n`` isn't given. It
    may be an array on disk. Order and common prefixes are exact to ``depth``; suffixes that agree so far stand together.

    Leftmost S suffixes are sorted by the string of their pieces' names: in memory if these are at most ``memory``, else by this function again. Their order and common
    prefixes induce those of all suffixes. Queues keep at most about ``memory`` tuples; all that grows with the text is on disk.
    """
    if n is None:
        n = len(text)
        text = np.concatenate([text, np.zeros(depth + 8, text.dtype)])
    if depth >= 1 << LCP_BITS:
        raise ValueError(f"common prefixes of {depth} don't fit a tuple")
    chunk = max(1, min(CHUNK, memory))
    stars = star_positions(text, n, chunk)
    count = len(stars)
    seeds = TupleQueue(alphabet, memory)
    if not count:
        yield from ((at, l) for at, l, _ in induce(text, n, alphabet, seeds, memory, depth))
        return
    order, names, distinct = _named(text, n, alphabet, stars, memory, depth)
    common = None  # names that a suffix shares with the one before it; unknown where they were sorted in memory
    if distinct < count <= memory:
        order[:] = order_of_names(np.array(names), depth // 2 + 1)
    elif distinct < count:
        common, to = mapped(count, np.int32), count
        for nth, shared in _ordered(names, distinct, memory, depth // 2 + 1):
            order[to - len(nth) : to] = nth[::-1]
            common[to - len(nth) + 1 : to + 1] = shared[int(to == count) :][::-1]  # the last one has none after it
            to -= len(nth)
    # common prefixes in characters: what whole names stand for, and the characters of the next piece
    behind = -1
    for a, e in _spans(count, chunk):
        nth = np.array(order[a:e])
        at = stars[nth]
        prior = np.concatenate([[behind], at[:-1]])
        known = np.zeros(len(at), np.int64)
        if common is not None:
            known = np.minimum(stars[np.minimum(nth + common[a:e], count - 1)] - at, depth)
        lcp = np.where(prior >= 0, known + common_prefix(text, np.maximum(prior, 0) + known, at + known, depth - known), 0)
        behind = at[-1]
        tuples = packed(at, lcp)
        char = text[at].astype(np.int64)
        edges = np.flatnonzero(np.diff(char, prepend=-1))
        for s, t in zip(edges.tolist(), np.append(edges[1:], len(at)).tolist(), strict=True):
            seeds.push(int(char[s]), tuples[s:t])
    cool(stars, order, names)
    yield from ((at, l) for at, l, _ in induce(text, n, alphabet, seeds, memory, depth))
