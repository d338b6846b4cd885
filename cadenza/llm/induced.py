"""External suffix sorting by induction, with common-prefix lengths.

``suffix_order`` gives the suffixes of an integer string in order, each with the
length of the prefix it shares with its predecessor.  Per level: the substrings
between leftmost-S positions are sorted by an external merge sort and named; where
names repeat, the shorter string of names is sorted by recursion; then L-type
suffixes are induced from the sorted leftmost-S suffixes in ascending order, and
S-type suffixes from those in descending order.  Induction goes through priority
queues of (character, arrival, position, common prefix) tuples, which keep at most
``memory`` tuples and hold the rest as sorted runs on disk; arrays that grow with
the string are files as well.  Common prefixes are carried along: two suffixes
induced into one bucket share one character more than the least value passed
between their sources, which a monotone stack answers.

What stays in memory: the queues' tuples, one block of each open run, and a stack no
deeper than the longest common prefix.

Edge cases: an empty string has no suffixes; one of a single character has one.
"""

from __future__ import annotations

import heapq
import itertools
import tempfile
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np

MEMORY = 1 << 18
BLOCK = 1 << 12
#: Rows read from a spilled run at once; runs that are open at once.
READ, FAN = 256, 64
_serial = itertools.count()


class DiskQueue:
    """A priority queue of integer tuples, smallest first; beyond ``memory`` tuples it spills sorted runs, and ``FAN`` runs become one."""

    def __init__(self, folder: Path, width: int, memory: int = MEMORY):
        self.folder, self.width, self.memory = folder, width, max(memory, 2)
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (tuple, run number)
        self.runs: list[Iterator[tuple]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self.heap.sort()
            part, self.heap = self.heap, []
            self._add(iter(part))
            if len(self.runs) >= FAN:
                before = [itertools.chain((head,), self.runs[r]) for head, r in self.heads]
                self.runs, self.heads = [], []
                self._add(heapq.merge(*before))

    def _add(self, rows: Iterator[tuple]) -> None:
        path = self.folder / f"run-{next(_serial)}"
        with open(path, "wb") as f:
            while part := list(itertools.islice(rows, BLOCK)):
                np.array(part, np.int64).tofile(f)
        run = read_rows(path, self.width)
        self.runs.append(run)
        if (first := next(run, None)) is not None:
            heapq.heappush(self.heads, (first, len(self.runs) - 1))

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, r = self.heads[0]
            after = next(self.runs[r], None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, r))
            return item
        return heapq.heappop(self.heap)


def read_rows(path: Path, width: int) -> Iterator[tuple]:
    """Rows of a file, a few at a time; the file goes when it is read."""
    with open(path, "rb") as f:
        while len(rows := np.fromfile(f, np.int64, READ * width)):
            yield from map(tuple, rows.reshape(-1, width).tolist())
    path.unlink()


class Column:
    """An append-only file of integers, read back as a memory map."""

    def __init__(self, folder: Path):
        self.path = folder / f"column-{next(_serial)}"
        self.file, self.part = open(self.path, "wb"), []

    def append(self, value: int) -> None:
        self.part.append(value)
        if len(self.part) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        np.array(self.part, np.int64).tofile(self.file)
        self.part = []

    def done(self) -> np.ndarray:
        self.flush()
        self.file.close()
        return np.memmap(self.path, np.int64, "r").view(np.ndarray) if self.path.stat().st_size else np.zeros(0, np.int64)


class LeastSince:
    """The least of the values passed after a given step, by a stack whose values rise."""

    def __init__(self):
        self.steps: list[int] = []
        self.values: list[int] = []

    def add(self, step: int, value: int) -> None:
        steps, values = self.steps, self.values
        while values and values[-1] >= value:
            values.pop()
            steps.pop()
        steps.append(step)
        values.append(value)

    def after(self, step: int) -> int:
        return self.values[bisect_right(self.steps, step)]


def on_disk(folder: Path, kind: type, size: int) -> np.ndarray:
    """An array of zeros in a file."""
    return np.memmap(folder / f"array-{next(_serial)}", kind, "w+", shape=max(size, 1)).view(np.ndarray)[:size]


def _types(text: np.ndarray, folder: Path) -> np.ndarray:
    """True for S-type positions, in a file; the last suffix is S-type, being the sentinel's."""
    n = len(text)
    out = on_disk(folder, np.bool_, n)
    out[n - 1] = after = True
    for lo in reversed(range(0, n - 1, BLOCK)):
        hi = min(lo + BLOCK, n - 1)
        part = np.asarray(text[lo : hi + 1])
        differs = np.flatnonzero(part[1:] != part[:-1])
        rising = np.append(part[differs] < part[differs + 1], after)
        out[lo:hi] = rising[np.searchsorted(differs, np.arange(hi - lo))]
        after = bool(out[lo])
    return out


def _stars(kinds: np.ndarray, folder: Path) -> np.ndarray:
    """Leftmost-S positions in text order, in a file."""
    out = Column(folder)
    for lo in range(0, len(kinds) - 1, BLOCK):
        part = np.asarray(kinds[lo : lo + BLOCK + 1])
        for i in (np.flatnonzero(part[1:] & ~part[:-1]) + lo + 1).tolist():
            out.append(i)
    return out.done()


def _common(text: np.ndarray, a: int, b: int) -> int:
    """Shared prefix of two suffixes by comparison, used where buckets and substrings meet; few characters one by one, then more at once."""
    char, got = memoryview(text), 0
    left = len(text) - max(a, b)
    few = min(8, left)
    while got < few and char[a + got] == char[b + got]:
        got += 1
    if got < few or got == left:
        return got
    step = 16
    while True:
        m = min(step, left - got)
        if m <= 0:
            return got
        differs = np.flatnonzero(text[a + got : a + got + m] != text[b + got : b + got + m])
        if len(differs):
            return got + int(differs[0])
        got += m
        step *= 2


def _sorted_pieces(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, folder: Path, memory: int) -> Iterator[tuple[bytes, int]]:
    """(key, number) of the leftmost-S substrings in order, by an external merge sort; of equal characters L-type ones come first."""
    runs, part, size = [], [], 0

    def spill():
        part.sort()
        path = folder / f"pieces-{next(_serial)}"
        with open(path, "wb") as f:
            for key, i in part:
                f.write(len(key).to_bytes(4, "big") + i.to_bytes(8, "big") + key)
        runs.append(path)

    def read(path):
        with open(path, "rb") as f:
            while head := f.read(12):
                i = int.from_bytes(head[4:], "big")
                yield f.read(int.from_bytes(head[:4], "big")), i
        path.unlink()

    for lo in range(0, len(stars), BLOCK):
        hi = min(lo + BLOCK, len(stars))
        begin = np.asarray(stars[lo:hi])
        ends = np.append(begin[1:], stars[hi] if hi < len(stars) else len(text) - 1)
        a, b = int(begin[0]), int(ends[-1]) + 1
        raw = (text[a:b].astype(np.int64) * 2 + kinds[a:b]).astype(">u8" if text.dtype.itemsize > 4 else ">u4")
        base, w = a, raw.dtype.itemsize
        data = raw.tobytes()
        part += [(data[(a - base) * w : (b + 1 - base) * w], i) for i, a, b in zip(range(lo, hi), begin.tolist(), ends.tolist(), strict=True)]
        size += len(data)
        if len(part) > memory or size > 64 * memory:
            spill()
            part, size = [], 0
    if not runs:
        part.sort()
        yield from part
        return
    spill()
    yield from heapq.merge(*map(read, runs))


def _star_order(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, folder: Path, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost-S suffixes in order, and the prefix each shares with the one before."""
    names, at = on_disk(folder, np.int64, len(stars) + 1), stars
    stars, mark = memoryview(stars), memoryview(names)
    order, lcps, before, name = Column(folder), Column(folder), None, 0
    for key, i in _sorted_pieces(text, kinds, at, folder, memory):
        name += before is None or key != before[0]
        lcps.append(0 if before is None else _common(text, stars[i], stars[before[1]]) if key != before[0] else -1)
        mark[i] = name
        order.append(stars[i])
        before = (key, i)
    order, lcps = order.done(), lcps.done()
    if name == len(stars):
        return order, lcps
    order, lcps, last = Column(folder), Column(folder), -1
    for i, l in suffix_order(names, folder, memory):
        if i < len(stars):
            # l names agree, which cover the text from one position to the other; the rest is compared
            got = 0 if last < 0 else stars[i + l] - stars[i] + _common(text, stars[i + l], stars[last + l])
            order.append(stars[i])
            lcps.append(got)
            last = i
    return order.done(), lcps.done()


def suffix_order(text: np.ndarray, folder: Path | None = None, memory: int = MEMORY) -> Iterator[tuple[int, int]]:
    """(position, shared prefix with the suffix before) in suffix order; the string must end with its only least value."""
    if folder is None:
        with tempfile.TemporaryDirectory() as d:
            yield from suffix_order(text, Path(d), memory)
        return
    n = len(text)
    if n <= 1:
        yield from ((i, 0) for i in range(n))
        return
    with tempfile.TemporaryDirectory(dir=folder) as d:
        own = Path(d)
        kinds = _types(text, own)
        stars = _stars(kinds, own)
        star_at, star_lcp = _star_order(text, kinds, stars, own, memory)
        yield from _induce(text, kinds, star_at, star_lcp, own, memory)


def _chars(text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(position, its character, the one before it or -1) in blocks."""
    for lo in range(0, len(at), BLOCK):
        p = np.asarray(at[lo : lo + BLOCK])
        before = np.where(p > 0, text[np.maximum(p - 1, 0)].astype(np.int64), -1)
        yield from zip(p.tolist(), text[p].tolist(), before.tolist(), strict=True)


def _induce(text: np.ndarray, kinds: np.ndarray, star_at: np.ndarray, star_lcp: np.ndarray, folder: Path, memory: int) -> Iterator[tuple[int, int]]:
    char, is_s = memoryview(text), memoryview(kinds)  # single elements come faster from these
    # ascending: L-type suffixes from leftmost-S ones and from each other
    queue = DiskQueue(folder, 4, memory)
    low_at, low_lcp, low_char = Column(folder), Column(folder), Column(folder)
    letters = 1 + max(int(text[lo : lo + BLOCK].max()) for lo in range(0, len(text), BLOCK))
    least, last_in = LeastSince(), memoryview(on_disk(folder, np.int64, letters))  # the last step that put a suffix into a bucket; 0: none
    seeds = zip(_chars(text, star_at), star_lcp, strict=True)
    seed = next(seeds, None)
    step, previous, last_seed = 0, None, False
    while seed is not None or queue.heap or queue.heads:
        head = queue.peek()
        if head is not None and (seed is None or head[0] <= seed[0][1]):
            c, _, p, shared = queue.pop()
            low_at.append(p)
            low_lcp.append(shared)
            low_char.append(c)
            before = char[p - 1] if p else -1
            if last_seed:  # an S-type suffix came between: the bucket is new
                shared = 0
            last_seed = False
        else:
            (p, c, before), shared = seed
            shared = int(shared)
            if not last_seed:
                shared = _common(text, p, previous[0]) if previous is not None and previous[1] == c else 0
            last_seed = True
            seed = next(seeds, None)
        step += 1
        least.add(step, shared)
        previous = (p, c)
        if before >= c and p and not is_s[p - 1]:
            since = last_in[before]
            queue.push((before, step, p - 1, 1 + least.after(since) if since else 0))
            last_in[before] = step
    low_at, low_lcp, low_char = low_at.done(), low_lcp.done(), low_char.done()

    # descending: S-type suffixes from L-type ones and from each other
    queue = DiskQueue(folder, 4, memory)
    out_at, out_next = Column(folder), Column(folder)  # S-type suffixes downwards, each with the prefix shared with the one above
    least, last_in = LeastSince(), memoryview(on_disk(folder, np.int64, letters))
    i, step, above = len(low_at) - 1, 1, None  # step 1 is the sentinel's
    block: list = []
    base = len(low_at)
    queue.push((-int(text[-1]), 1, len(text) - 1, 0))
    last_in[int(text[-1])] = 1
    above_low = -1  # the prefix that the L-type suffix above shares with the one below it
    while i >= 0 or queue.heap or queue.heads:
        head = queue.peek()
        if i >= 0 and i < base:
            base = max(0, i + 1 - BLOCK)
            block = list(zip(low_at[base : i + 1].tolist(), low_lcp[base : i + 1].tolist(), low_char[base : i + 1].tolist(), strict=True))
        if head is not None and (i < 0 or -head[0] >= block[i - base][2]):
            c, _, p, shared = queue.pop()
            c = -c
            out_at.append(p)
            out_next.append(shared)
            gap = shared if above is not None and above_low < 0 and above[1] == c else 0
            above_low = -1
        else:
            p, below, c = block[i - base]
            i -= 1
            if above is None or above[1] != c:
                gap = 0
            elif above_low >= 0:
                gap = above_low
            else:
                gap = _common(text, p, above[0])
            above_low = below
        step += 1
        least.add(step, gap)
        above = (p, c)
        if p and is_s[p - 1]:
            before = char[p - 1]
            since = last_in[before]
            queue.push((-before, step, p - 1, 1 + least.after(since) if since else 0))
            last_in[before] = step
    out_at, out_next = out_at.done(), out_next.done()

    # merge: in each bucket L-type suffixes come first
    low_at, low_lcp, low_char, out_at, out_next = map(memoryview, (low_at, low_lcp, low_char, out_at, out_next))
    k, before, below = len(out_at) - 1, None, 0
    j = 0
    while j < len(low_at) or k >= 0:
        if j < len(low_at) and (k < 0 or low_char[j] <= char[out_at[k]]):
            p, c = low_at[j], low_char[j]
            shared, low = low_lcp[j] if before is not None and before[2] else 0, True
            j += 1
        else:
            p = out_at[k]
            c = char[p]
            if before is not None and before[1] == c:
                shared = _common(text, p, before[0]) if before[2] else below
            else:
                shared = 0
            below, low = out_next[k], False
            k -= 1
        yield p, shared if before is not None and before[1] == c else 0
        before = (p, c, low)
