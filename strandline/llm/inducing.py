"""Suffix array and common prefixes by induced sorting in external memory.

The text is a memory-mapped file of symbols. A suffix is L if it is greater than the next one, else S; S* is an S after an
L. S* substrings are sorted and named; unless all names differ, the text of names is sorted by the same procedure. From the
sorted S* suffixes, one ascending pass induces the L suffixes and one descending pass the S suffixes. Both passes draw from
a queue on disk that holds (symbol, time, position, common prefix): sorted runs are spilled, and merged as they are read.

The common prefix of two neighbours that a pass gives to one symbol is one more than the least common prefix between those
that induced them. A stack of falling minima over the output answers that when an entry is made, so that it is carried in
the tuple. Common prefixes are cut off at ``cap``.

Whatever grows with the text is a file: symbols, types, S* places, names, their order, prefixes, last times of symbols, queues
and output. Files are written in blocks, and those that are read at random are mapped. Memory holds ``held`` rows of a queue
or of a run that is sorted, a block of each of at most FAN runs a level, and the stack, whose values are different and at
most ``cap``: it grows with ``held`` and ``cap``, not with the text.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np

#: Rows kept in memory before they are spilled as a sorted run; rows written at once; runs that are merged at once.
HELD, READ, FAN = 400_000, 8_192, 16


def scratch_dir() -> str | None:
    """Where Spark itself spills on this executor; a task's files there end with it, and are made anew if it is run again."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)), None)


def _mapped(folder: str, name: str, n: int, kind=np.int64) -> np.ndarray:
    return np.memmap(os.path.join(folder, name), kind, "w+", shape=(max(n, 1),))[:n]


def _block(held: int) -> int:
    return max(min(held, READ), 64)


def _piece(held: int) -> int:
    return max(min(held // (4 * FAN), READ), 64)


class Run:
    """Sorted rows in a file, read in pieces; the file has no name any more, so it ends with the last reader."""

    def __init__(self, path: str, width: int, piece: int):
        self.file, self.width, self.piece = open(path, "rb"), width, piece  # noqa: SIM115
        os.unlink(path)

    def read(self) -> np.ndarray:
        if self.file.closed:
            return np.zeros((0, self.width), np.int64)
        rows = np.fromfile(self.file, np.int64, self.width * self.piece).reshape(-1, self.width)
        if not len(rows):
            self.file.close()
        return rows


def _in_order(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1])


def merged_rows(runs: list[Run], begun: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """The rows of all runs in order. Of the pieces at hand, those rows go out that no run's unread rest can precede."""
    heads = [h if len(h) else r.read() for h, r in zip(begun, runs, strict=True)] if begun else [r.read() for r in runs]
    live = [i for i, h in enumerate(heads) if len(h)]
    while live:
        limit = min(tuple(heads[i][-1]) for i in live)
        both = np.concatenate([heads[i] for i in live])
        of = np.repeat(np.arange(len(live)), [len(heads[i]) for i in live])
        order = _in_order(both)
        both, of = both[order], of[order]
        low, high = 0, len(both)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if tuple(both[middle]) <= limit else (low, middle)
        yield both[:low]
        gone = np.bincount(of[:low], minlength=len(live))
        for k, i in enumerate(live):
            heads[i] = heads[i][gone[k] :]
            if not len(heads[i]):
                heads[i] = runs[i].read()
        live = [i for i in live if len(heads[i])]


class Runs:
    """Sorted runs in levels: FAN runs of a level become one of the next."""

    def __init__(self, folder: str, width: int, held: int):
        self.folder, self.width, self.piece = folder, width, _piece(held)
        self.levels: list[list[Run]] = []
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.folder, f"run{id(self)}-{self.made}")

    def written(self, blocks: Iterable[np.ndarray]) -> Run:
        path = self.path()
        with open(path, "wb") as sink:
            for rows in blocks:
                sink.write(np.ascontiguousarray(rows).tobytes())
        return Run(path, self.width, self.piece)

    def add(self, rows: np.ndarray) -> None:
        run, level = self.written([rows]), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN:
                return
            run, self.levels[level], level = self.written(merged_rows(self.levels[level])), [], level + 1


def sorted_rows(blocks: Iterable[np.ndarray], width: int, folder: str, held: int) -> Iterator[np.ndarray]:
    """Rows of ``width`` whole numbers in order. What fits into ``held`` rows never leaves memory."""
    runs, waiting, size = Runs(folder, width, held), [], 0

    def batch() -> np.ndarray:
        rows = np.concatenate(waiting) if waiting else np.zeros((0, width), np.int64)
        return rows[_in_order(rows)]

    for rows in blocks:
        waiting.append(rows)
        size += len(rows)
        if size >= held:
            runs.add(batch())
            waiting, size = [], 0
    if not runs.levels:
        yield batch()
        return
    if size:
        runs.add(batch())
    waiting = []
    yield from merged_rows([r for level in runs.levels for r in level])


class DiskQueue:
    """The least of many (key, time, position, prefix) entries, most of them in sorted runs on disk."""

    def __init__(self, folder: str, held: int = HELD):
        self.held = held
        self.heap: list[tuple[int, int, int, int]] = []
        self.heads: list[tuple[tuple[int, int, int, int], int]] = []
        self.runs = Runs(folder, 4, held)
        #: by number: the run, its level, its rows at hand and the place of the head among them
        self.open: dict[int, list] = {}
        self.named = 0

    def push(self, entry: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) >= self.held:
            rows = np.array(self.heap, np.int64)
            self.heap = []
            self._begin(self.runs.written([rows[_in_order(rows)]]), 0)

    def _begin(self, run: Run, level: int) -> None:
        rows = list(map(tuple, run.read().tolist()))
        if rows:
            self.open[self.named] = [run, level, rows, 0]
            heapq.heappush(self.heads, (rows[0], self.named))
            self.named += 1
        mine = [n for n, r in self.open.items() if r[1] == level]
        if len(mine) >= FAN:
            parts = [self.open.pop(n) for n in mine]
            gone = set(mine)
            self.heads = [h for h in self.heads if h[1] not in gone]
            heapq.heapify(self.heads)
            begun = [np.array(rows[at:], np.int64).reshape(-1, 4) for _, _, rows, at in parts]
            self._begin(self.runs.written(merged_rows([p[0] for p in parts], begun)), level + 1)

    def peek(self) -> int | None:
        """The least key."""
        a = self.heap[0] if self.heap else None
        b = self.heads[0][0] if self.heads else None
        return None if a is None and b is None else (a if b is None or (a is not None and a < b) else b)[0]

    def pop(self) -> tuple[int, int, int, int]:
        if not self.heads or (self.heap and self.heap[0] < self.heads[0][0]):
            return heapq.heappop(self.heap)
        entry, name = self.heads[0]
        state = self.open[name]
        state[3] += 1
        if state[3] == len(state[2]):
            state[2], state[3] = list(map(tuple, state[0].read().tolist())), 0
        if state[2]:
            heapq.heapreplace(self.heads, (state[2][state[3]], name))
        else:
            heapq.heappop(self.heads)
            del self.open[name]
        return entry


class Minima:
    """Least of the values since some time, by a stack whose values rise towards the present."""

    def __init__(self):
        self.times: list[int] = []
        self.values: list[int] = []

    def add(self, time: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.times.pop()
        self.times.append(time)
        self.values.append(value)

    def since(self, time: int) -> int:
        """Least of the values after ``time``."""
        return self.values[bisect_left(self.times, time + 1)]


class Output:
    """Positions and common prefixes, written in blocks."""

    def __init__(self, folder: str, name: str, n: int, held: int):
        self.data = np.memmap(os.path.join(folder, name), np.int32 if n < 1 << 31 else np.int64, "w+", shape=(max(n, 1), 2))
        self.at, self.block, self.most = 0, [], _block(held)

    def add(self, position: int, prefix: int) -> None:
        self.block.append((position, prefix))
        if len(self.block) == self.most:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.block:
            self.data[self.at : self.at + len(self.block)] = self.block
            self.at += len(self.block)
            self.block = []
        return self.data[: self.at]


def types(text: np.ndarray, folder: str, name: str, held: int) -> np.ndarray:
    """True for S suffixes. The last symbol is the least and only one of its kind, and S."""
    n, size = len(text), _block(held)
    out = _mapped(folder, name, n, bool)
    out[n - 1] = True
    for high in range(n - 1, 0, -size):
        low = max(0, high - size)
        part = np.asarray(text[low : high + 1])
        differ = np.flatnonzero(part[:-1] != part[1:])
        # the type of a place is that of the next place where the symbol changes, or of the block behind
        rises = np.append(part[differ] < part[differ + 1], out[high])
        out[low:high] = rises[np.searchsorted(differ, np.arange(high - low))]
    return out


def _stars(small: np.ndarray, folder: str, name: str, held: int) -> np.ndarray:
    path, size = os.path.join(folder, name), _block(held)
    with open(path, "wb") as sink:
        for low in range(1, len(small), size):
            part = np.asarray(small[low - 1 : low + size])
            sink.write((np.flatnonzero(part[1:] & ~part[:-1]) + low).astype(np.int64).tobytes())
    n = os.path.getsize(path) // 8
    return np.memmap(path, np.int64, "r+", shape=(n,)) if n else np.zeros(0, np.int64)


def _names(text: np.ndarray, small: np.ndarray, star: np.ndarray, folder: str, name: str, held: int) -> tuple[np.ndarray, bool]:
    """(the number of lesser S* substrings for each, whether all are different). Symbols carry their type, which ends a
    comparison of prefixes. Round by round, rows that are still alike are sorted by further symbols."""
    m, n, size = len(star), len(text), _block(held)
    most = max(int(np.max(text[low : low + size])) for low in range(0, n, size))
    bits = (2 * most + 2).bit_length()
    per = max(62 // bits, 1)
    rank, alike = _mapped(folder, name, m), _mapped(folder, f"{name}-alike", m, bool)
    alike[:] = True

    def lengths(low: int, high: int) -> np.ndarray:
        own = np.asarray(star[low : min(high + 1, m)])
        out = np.diff(np.append(own, n - 1) if high >= m else own) + 1
        if high >= m:
            out[-1] = 1
        return out

    def rows(at: int) -> Iterator[np.ndarray]:
        for low in range(0, m, size):
            who = np.flatnonzero(alike[low : low + size])
            if not len(who):
                continue
            length, begin = lengths(low, min(low + size, m))[who], np.asarray(star[low : low + size])[who]
            word = np.zeros(len(who), np.int64)
            for k in range(per):
                place = np.minimum(begin + at + k, n - 1)
                coded = text[place].astype(np.int64) * 2 + small[place] + 1
                word = (word << bits) | np.where(length > at + k, coded, 0)
            yield np.stack([np.asarray(rank[low : low + size])[who], word, who + low], 1)

    at, different = 0, False
    longest = max(int(lengths(low, min(low + size, m)).max()) for low in range(0, m, size))
    while at < longest and not different:
        different, before, count, first, waiting = True, None, 0, 0, None
        for part in sorted_rows(rows(at), 3, folder, held):
            if not len(part):
                continue
            old, word, who = part.T
            new = np.ones(len(part), bool)
            new[1:] = (old[1:] != old[:-1]) | (word[1:] != word[:-1])
            fresh = np.ones(len(part), bool)  # the first of the rows that were alike before
            fresh[1:] = old[1:] != old[:-1]
            if before is not None:
                new[0], fresh[0] = (old[0], word[0]) != before, old[0] != before[0]
            index = np.arange(count, count + len(part))
            base = np.maximum.accumulate(np.where(fresh, index, first))
            head = np.maximum.accumulate(np.where(new, index, waiting[1] if waiting is not None else 0))
            rank[who] = old + head - base
            single = new & np.append(new[1:], True)
            if waiting is not None:  # the row before this block: alone, unless this block goes on with it
                if waiting[2] and new[0]:
                    alike[waiting[0]] = False
                else:
                    different = False
            alike[who[:-1]] = ~single[:-1]
            different &= bool(single[:-1].all())
            before, first, count = (old[-1], word[-1]), base[-1], count + len(part)
            waiting = (who[-1], head[-1], bool(new[-1]))
        if waiting is not None:
            if waiting[2]:
                alike[waiting[0]] = False
            else:
                different = False
        at += per
    return rank, different


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, of which ``known`` symbols are equal, up to ``cap``."""
    out, live = np.minimum(known, cap), np.flatnonzero(known < cap)
    n = len(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def _seam(text: np.ndarray, low: int, high: int, cap: int) -> int:
    """Common prefix of an L and an S suffix with one first symbol: the shorter run of it."""
    least = cap
    for at in (low, high):
        part = np.asarray(text[at : at + least])
        other = np.flatnonzero(part != part[0])
        least = int(other[0]) if len(other) else len(part)
    return least


def _sorted_stars(text: np.ndarray, small: np.ndarray, star: np.ndarray, cap: int, folder: str, held: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S* places in suffix order, and the common prefix of each with the one before."""
    m, size = len(star), _block(held)
    seeds, prefix = _mapped(folder, f"seeds{depth}", m), _mapped(folder, f"prefix{depth}", m)
    if m <= 1:
        seeds[:] = star
        return seeds, prefix
    names, different = _names(text, small, star, folder, f"names{depth}", held)
    if different:
        for low in range(0, m, size):
            seeds[names[low : low + size]] = star[low : low + size]
        below = None
    else:
        below = induced(names, cap, folder, held, depth + 1)
    before = None
    for low in range(0, m, size):
        shared = np.zeros(min(size, m - low), np.int64)
        if below is not None:
            order, equal = np.array(below[low : low + size]).astype(np.int64).T
            reach = np.minimum(order + equal, m - 1)
            shared = star[reach] - star[order]  # names that are equal stand for at least these symbols
            seeds[low : low + size] = star[order]
        own = np.array(seeds[low : low + size])
        former = np.concatenate([[own[0] if before is None else before], own[:-1]])
        prefix[low : low + size] = _extend(text, former, own, shared, cap)
        before = own[-1]
    prefix[0] = 0
    return seeds, prefix


def induced(text: np.ndarray, cap: int, folder: str, held: int = HELD, depth: int = 0) -> np.ndarray:
    """(position, common prefix with the one before) of all suffixes of ``text`` in order, mapped from disk.

    The last symbol must be the least and occur once.
    """
    n, size = len(text), _block(held)
    if n == 1:
        out = Output(folder, f"out{depth}", 1, held)
        out.add(0, 0)
        return out.flush()
    small = types(text, folder, f"types{depth}", held)
    star = _stars(small, folder, f"star{depth}", held)
    seeds, prefix = _sorted_stars(text, small, star, cap, folder, held, depth)
    symbols = max(int(np.max(text[low : low + size])) for low in range(0, n, size)) + 1

    def times(name: str) -> np.ndarray:
        """The time of the last entry of each symbol, plus one; 0 if there is none."""
        return np.zeros(symbols, np.int64) if symbols <= held else _mapped(folder, f"{name}{depth}", symbols)

    # ascending: L suffixes, between the S* ones that start with the same or a lesser symbol
    queue, minima, last = DiskQueue(folder, held), Minima(), times("rising")
    large = Output(folder, f"large{depth}", n, held)
    time, s, before, symbol_before, was_seed = 0, 0, -1, -1, False
    base, part = 0, ([], [], [])
    while True:
        key = queue.peek()
        if s < len(seeds) and s - base >= len(part[0]):
            own = np.array(seeds[s : s + size])
            base, part = s, (own.tolist(), text[own].tolist(), np.array(prefix[s : s + size]).tolist())
        if s < len(seeds) and (key is None or part[1][s - base] < key):
            at, symbol, is_seed = part[0][s - base], part[1][s - base], True
            if symbol != symbol_before:
                common = 0
            elif was_seed:
                common = part[2][s - base]
            else:
                common = _seam(text, before, at, cap)
            s += 1
        elif key is not None:
            symbol, _, at, common = queue.pop()
            is_seed = False
            if symbol != symbol_before:
                common = 0
        else:
            break
        minima.add(time, common)
        if not is_seed:
            large.add(at, common)
        if at and not small[at - 1]:
            c = int(text[at - 1])
            then = int(last[c])
            queue.push((c, time, at - 1, min(minima.since(then - 1) + 1, cap) if then else 0))
            last[c] = time + 1
        before, symbol_before, was_seed = at, symbol, is_seed
        time += 1
    large_rows = large.flush()

    # descending: S suffixes, above the L ones of the same symbol; a prefix here is shared with the next greater suffix
    queue, minima, last = DiskQueue(folder, held), Minima(), times("falling")
    out = Output(folder, f"out{depth}", n, held)
    time, at_large, own, position, joint = 0, len(large_rows) - 1, -1, -1, 0
    rows, base, loaded = ([], []), len(large_rows), len(large_rows)
    queue.push((-int(text[n - 1]), -1, n - 1, 0))
    above, symbol_above, above_large, pending = -1, -1, False, 0
    while True:
        key = queue.peek()
        if at_large >= 0 and loaded != at_large:
            if at_large < base:
                base = max(0, at_large + 1 - size)
                part = np.array(large_rows[base : at_large + 1])
                rows = (part.tolist(), text[part[:, 0]].tolist())
            (position, joint), own, loaded = rows[0][at_large - base], rows[1][at_large - base], at_large
        if key is not None and (at_large < 0 or -key >= own):
            minus, _, at, common = queue.pop()
            symbol, is_large = -minus, False
            if symbol != symbol_above:
                common = 0
        elif at_large >= 0:
            at, symbol, is_large = position, own, True
            if symbol != symbol_above:
                common = 0
            elif above_large:
                common = pending
            else:
                common = _seam(text, at, above, cap)
            pending = joint
            at_large -= 1
        else:
            break
        if above >= 0:
            out.add(above, common)  # the prefix between this suffix and the greater one before it
        minima.add(time, common)
        if at and small[at - 1]:
            c = int(text[at - 1])
            then = int(last[c])
            queue.push((-c, time, at - 1, min(minima.since(then - 1) + 1, cap) if then else 0))
            last[c] = time + 1
        above, symbol_above, above_large = at, symbol, is_large
        time += 1
    out.add(above, 0)
    return out.flush()[::-1]


class Shard:
    """Segments of symbols (from 0 on), each at a start of an owner, on disk; and the windows that occur more than once.

    A window at place p of a segment stands at (owner, start + p). Each segment has a tag that it is given back with.
    """

    def __init__(self, folder: str, held: int = HELD):
        self.folder, self.held, self.count = folder, held, 0
        self.text, self.table, self.offsets = (open(os.path.join(folder, name), "wb") for name in ("text", "segments", "offsets"))  # noqa: SIM115
        self.size = 0

    def add(self, owner: int, start: int, symbols: np.ndarray, tag: int = 0) -> None:
        self.text.write((symbols.astype(np.int32) + 2).tobytes() + b"\1\0\0\0")
        self.table.write(np.array([len(symbols), owner, start, tag], np.int64).tobytes())
        self.offsets.write(self.size.to_bytes(8, "little"))
        self.size += len(symbols) + 1
        self.count += 1

    def repeated(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segment, place) of the windows of ``width`` symbols that also start earlier: all that stand elsewhere than the
        least (owner, start + place) among equal ones."""
        self.text.write(bytes(4))
        for file in (self.text, self.table, self.offsets):
            file.close()
        if not self.count:
            return
        text = np.memmap(os.path.join(self.folder, "text"), np.int32, "r")
        self.rows = np.memmap(os.path.join(self.folder, "segments"), np.int64, "r").reshape(-1, 4)
        first = np.memmap(os.path.join(self.folder, "offsets"), np.int64, "r")
        sa = induced(text, width, self.folder, self.held)
        block = max(_block(self.held), 1 << 10)

        def placed(position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Which of the positions begin a window, its segment, owner and place in the owner."""
            segment = np.searchsorted(first, position, "right") - 1
            rows = self.rows[segment]
            place = position - first[segment]
            ok = np.flatnonzero(place + width <= rows[:, 0])
            return ok, segment[ok], rows[ok, 1], rows[ok, 2] + place[ok]

        def late(position: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok, segment, owner, where = placed(position)
            order = np.lexsort((where, owner, group[ok]))
            segment, o, w, k = segment[order], owner[order], where[order], group[ok][order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
            later = (o != o[head]) | (w != w[head])
            return segment[later], (w - self.rows[segment, 2])[later]

        def of_one(low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """One class of equal windows, of any size: the least place is found first, then the others go out."""
            least = None
            for at in range(low, high, block):
                _, _, owner, where = placed(np.array(sa[at : min(at + block, high), 0]))
                if len(owner):
                    k = np.lexsort((where, owner))[0]
                    least = min(x for x in (least, (owner[k], where[k])) if x is not None)
            for at in range(low, high, block):
                _, segment, owner, where = placed(np.array(sa[at : min(at + block, high), 0]))
                later = (owner != least[0]) | (where != least[1]) if least else np.zeros(0, bool)
                yield segment[later], (where - self.rows[segment, 2])[later]

        # classes of equal windows are runs of common prefixes of the full width; one may go on over many blocks
        begun = 0
        for at in range(0, len(sa), block):
            part = np.array(sa[at : at + block])
            cuts = np.flatnonzero(part[:, 1] < width)
            if not len(cuts):
                continue
            if at + cuts[0] - begun > 1:
                yield from of_one(begun, at + int(cuts[0]))
            body = part[cuts[0] : cuts[-1]]
            if len(body):
                yield late(body[:, 0], np.cumsum(body[:, 1] < width))
            begun = at + int(cuts[-1])
        if len(sa) - begun > 1:
            yield from of_one(begun, len(sa))


def repeated_windows(segments: Iterator[tuple[int, int, np.ndarray]], width: int, folder: str | None = None, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``Shard.repeated`` of (owner, start, symbols) segments, in a folder of its own."""
    with tempfile.TemporaryDirectory(dir=folder or scratch_dir()) as work:
        shard = Shard(work, held)
        for owner, start, symbols in segments:
            shard.add(owner, start, symbols)
        yield from shard.repeated(width)
