"""External suffix sorting by recursive induction that carries common prefixes.

``sorted_suffixes`` returns the suffixes of a text in order, each with the length
of the prefix it shares with its predecessor.  The leftmost-S substrings are put
in order by a first induction and named; unless all names differ, the string of
names is sorted by the same procedure, recursively; a second induction then
sorts all suffixes.

An induction is a monotone priority queue of tuples (character, position, common
prefix).  It is emptied from the least character on; each suffix that leaves it
pushes the suffix one to its left, if that is of the type being sorted.  The
common prefix pushed along is one more than the least value that went by since
the last push to the same character.  Between recursion levels these values are
translated from names to characters, so none is found by comparing suffixes;
characters are only compared while leftmost-S substrings are named.

The queue is cut by ranges of characters.  A frequent character is a range of
its own and is read first in, first out, in portions.  Rare ones share a range:
what is pushed within the range itself is ranked by doubling over the pushes.

Memory.  Texts, types, orders and prefixes over a share of the budget lie in
unlinked files in Spark's own scratch folder and are worked through in blocks;
the queue spills there as well.  Like Spark's spills, these files belong to one
task and end with it.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterable

import numpy as np

#: Character of the end of the text, and of the end of a context; bytes follow.
END, BREAK, BYTES_FROM = 0, 1, 2
SIGMA = BYTES_FROM + 256
MEMORY_BYTES = 64 << 20
BLOCK = 1 << 14
#: A character with a longer run gets a range of its own.
LONG_RUN = 100
_BIG = np.int32(1 << 30)


class Scratch:
    """Arrays within a memory budget: larger ones lie in unlinked files."""

    def __init__(self, budget: int = MEMORY_BYTES):
        self.budget, self.spilled = budget, 0

    def file(self):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        return tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.budget // 16:
            return np.empty(n, dtype)
        self.spilled += size
        with self.file() as f:  # the mapping outlives the file
            return np.memmap(f, dtype, "w+", shape=(n,))


def _blocks(n: int, block: int = BLOCK) -> Iterable[slice]:
    return (slice(at, min(at + block, n)) for at in range(0, n, block))


class LeastOf:
    """Least value of any stretch of an array."""

    def __init__(self, values: np.ndarray, scratch: Scratch):
        n = len(values)
        steps = max(1, n.bit_length())
        self._flat = n <= 4 * BLOCK
        if self._flat:
            self._levels = np.empty((steps, n), values.dtype)
            self._levels[0] = values
        else:
            self._levels = [values, *(scratch.array(n - (1 << k) + 1, values.dtype) for k in range(1, steps))]
        for k in range(1, steps):
            half, size = 1 << (k - 1), n - (1 << k) + 1
            for s in _blocks(size, 1 << 20):
                np.minimum(self._levels[k - 1][s], self._levels[k - 1][s.start + half : s.stop + half], out=self._levels[k][s])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        last = last + 1 - (1 << level)
        if self._flat:
            return np.minimum(self._levels[level, first], self._levels[level, last])
        out = np.empty(len(first), dtype=self._levels[0].dtype)
        for k in np.flatnonzero(np.bincount(level)) if len(level) else ():
            at, values = level == k, self._levels[k]
            out[at] = np.minimum(values[first[at]], values[last[at]])
        return out


# ------------------------------------------------------------------- queue


class RangeQueue:
    """Tuples (character, position, common prefix) by range of characters, in order of arrival in each."""

    def __init__(self, bounds: np.ndarray, scratch: Scratch):
        self._bounds, self._scratch, self._file = bounds, scratch, None
        self._parts: dict[int, deque] = {}
        self._held: dict[int, int] = {}
        self._in_memory = 0

    def push(self, chars: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """``chars`` ascending; equal ones in order of arrival."""
        if not len(chars):
            return
        cuts = np.append(np.searchsorted(chars, self._bounds), len(chars))
        for r in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, z = cuts[r], cuts[r + 1]
            part = chars[a:z], positions[a:z], prefixes[a:z]
            self._parts.setdefault(r, deque()).append(part)
            size = sum(x.nbytes for x in part)
            self._held[r] = self._held.get(r, 0) + size
            self._in_memory += size
        if self._in_memory > self._scratch.budget // 4:
            self._spill()

    def _spill(self) -> None:
        self._file = self._file or self._scratch.file()
        while self._in_memory > self._scratch.budget // 8:
            r = max(self._held, key=self._held.get)
            parts, kept = self._parts[r], deque()
            held = [p for p in parts if isinstance(p[0], np.ndarray)]
            kept.extend(p for p in parts if not isinstance(p[0], np.ndarray))
            whole = [np.ascontiguousarray(np.concatenate(x)) for x in zip(*held, strict=True)]
            places = []
            for x in whole:
                self._file.seek(0, os.SEEK_END)
                places.append((self._file.tell(), x.dtype))
                self._file.write(x.tobytes())
                self._scratch.spilled += x.nbytes
            kept.append((len(whole[0]), places))
            self._parts[r] = kept
            self._in_memory -= self._held.pop(r)

    def take(self, r: int, most: int) -> list[np.ndarray] | None:
        """The next tuples of a range: about ``most``, or less."""
        parts, got, n = self._parts.get(r), [], 0
        while parts and n < most:
            part = parts.popleft()
            if isinstance(part[0], np.ndarray):
                size = sum(x.nbytes for x in part)
                self._held[r] -= size
                self._in_memory -= size
            else:
                part = self._read(parts, part, most - n)
            got.append(part)
            n += len(part[0])
        if not got:
            return None
        return list(got[0]) if len(got) == 1 else [np.concatenate(x) for x in zip(*got, strict=True)]

    def _read(self, parts: deque, part: tuple, most: int) -> list[np.ndarray]:
        count, places = part
        n, out = min(count, most), []
        for at, dtype in places:
            self._file.seek(at)
            out.append(np.frombuffer(self._file.read(n * dtype.itemsize), dtype=dtype))
        if n < count:
            parts.appendleft((count - n, [(at + n * dtype.itemsize, dtype) for at, dtype in places]))
        return out


# ------------------------------------------------------------------- types


def suffix_types(text: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(whether a suffix is smaller than the next one (S), how often its first character is repeated at once)."""
    n = len(text)
    small, run = scratch.array(n, bool), scratch.array(n, np.int32)
    small[n - 1], run[n - 1] = True, 1
    change, rises = n - 1, True  # the next place where the character changes, and how
    for stop in range(n - 1, 0, -BLOCK):
        start = max(0, stop - BLOCK)
        here, following = text[start:stop], text[start + 1 : stop + 1]
        at = np.where(here != following, np.arange(start, stop), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        inside = at < n
        small[start:stop] = np.where(inside, (here < following)[np.minimum(at - start, stop - start - 1)], rises)
        at[~inside] = change
        run[start:stop] = at - np.arange(start, stop) + 1
        change, rises = int(at[0]), bool(small[start])
    return small, run


# --------------------------------------------------------------- induction


class Induction:
    """Sorts the members (suffixes of one type) from the seeds (what they are pushed by first, in order).

    ``flip`` turns the alphabet round, for the type that is sorted downwards.
    Within a character all members come before the seeds.
    """

    def __init__(self, text, member, run, sigma: int, flip: bool, carry: bool, scratch: Scratch):
        self._text, self._member, self._run, self._sigma = text, member, run, sigma
        self._flip, self._carry, self._scratch = flip, carry, scratch

    def _key(self, positions) -> np.ndarray:
        got = self._text[positions]
        return (self._text.dtype.type(self._sigma - 1) - got) if self._flip else got

    def _plan(self, seeds: np.ndarray) -> None:
        """Count characters and cut the alphabet into ranges."""
        n, sigma = len(self._text), self._sigma
        members, of_seeds, lone = np.zeros(sigma, np.int64), np.zeros(sigma, np.int64), np.zeros(sigma, bool)
        for s in _blocks(n, 1 << 20):
            key = self._key(s)
            members += np.bincount(key[self._member[s]], minlength=sigma)
            lone[key[self._run[s] > LONG_RUN]] = True
        for s in _blocks(len(seeds), 1 << 20):
            of_seeds += np.bincount(self._key(seeds[s]), minlength=sigma)
        both = members + of_seeds
        lone |= both > BLOCK
        group = np.cumsum(both) // BLOCK
        cuts = np.r_[True, (group[1:] != group[:-1]) | lone[1:] | lone[:-1]]
        self.bounds = np.flatnonzero(cuts)
        self.members, self.total = members, int(members.sum())
        self._seed_ends = np.cumsum(of_seeds)
        self._busy = np.add.reduceat(both, self.bounds) > 0

    def run(self, seeds: np.ndarray, seed_prefixes: np.ndarray | None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(members in order, common prefix of each with the one before it in its character)."""
        self._plan(seeds)
        self._queue = RangeQueue(self.bounds, self._scratch)
        self._since = np.full(self._sigma if self._carry else 0, -1, np.int32)
        self.order = self._scratch.array(self.total, _places(len(self._text)))
        self.prefixes = self._scratch.array(self.total if self._carry else 0, np.int32)
        self._out = 0
        if first is not None:
            self._queue.push(self._key(first), first, np.zeros(len(first), np.int32))
        ends = np.r_[self.bounds[1:], self._sigma]
        for r in np.flatnonzero(self._busy).tolist():
            low, high = int(self.bounds[r]), int(ends[r])
            begin = int(self._seed_ends[low - 1]) if low else 0
            here = slice(begin, int(self._seed_ends[high - 1]))
            if high - low == 1:
                self._one_character(r, seeds, seed_prefixes, here)
            else:
                self._several(r, high, seeds[here], seed_prefixes[here] if self._carry else None)
        return self.order, self.prefixes

    def _emit(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        end = self._out + len(positions)
        self.order[self._out : end] = positions
        if self._carry:
            self.prefixes[self._out : end] = prefixes
        self._out = end

    def _one_character(self, r: int, seeds, seed_prefixes, here: slice) -> None:
        last = -1
        while (part := self._queue.take(r, BLOCK)) is not None:
            _, positions, prefixes = part
            self._emit(positions, prefixes)
            self._pass_on(positions, prefixes, 0)
            last = int(positions[-1])
        for at in range(here.start, here.stop, BLOCK):
            positions = np.asarray(seeds[at : min(at + BLOCK, here.stop)])
            prefixes = None
            if self._carry:
                prefixes = np.array(seed_prefixes[at : min(at + BLOCK, here.stop)])
                if at == here.start:
                    prefixes[0] = min(self._run[last], self._run[positions[0]]) if last >= 0 else 0
            self._pass_on(positions, prefixes, 0)

    def _several(self, r: int, high: int, seeds, seed_prefixes) -> None:
        got = self._queue.take(r, 1 << 62)
        none = np.zeros(0, np.int64)
        _, known, known_prefixes = got if got else (none, none, np.zeros(0, np.int32))
        seeds = np.asarray(seeds)
        # Nodes: what was pushed from below the range, the seeds, then what those push within the range.
        places, links = [known, seeds], [np.arange(len(known) + len(seeds))]
        at, node, n = np.concatenate(places), links[0], len(links[0])
        while len(at):
            left = at - 1
            inside = (at > 0) & self._member[left]
            left, node = left[inside], node[inside]
            inside = self._key(left) < high
            at = left[inside]
            places.append(at)
            links.append(node[inside])
            node = np.arange(n, n + len(at))
            n += len(at)
        place, link = np.concatenate(places), np.concatenate(links)
        if not n:
            return
        key = self._key(place).astype(np.int64)
        kind, among = np.full(n, 1, np.int64), np.zeros(n, np.int64)
        kind[: len(known)], among[: len(known)] = 0, np.arange(len(known))
        fixed = len(known) + len(seeds)
        kind[len(known) : fixed], among[len(known) : fixed] = 2, np.arange(len(seeds))
        weight = (key * 3 + kind) * n + among
        while True:
            order = np.argsort(weight, kind="stable")
            ranked = weight[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
            if rank[order[-1]] == n - 1:
                break
            weight = rank * n + rank[link]
            link = link[link]
        stream, key, is_seed = place[order], key[order], kind[order] == 2
        prefixes = None
        if self._carry:
            values = np.full(n, _BIG, np.int32)
            values[: len(known)], values[len(known) : fixed] = known_prefixes, seed_prefixes
            prefixes = values[order]
            same = np.r_[False, key[1:] == key[:-1]]
            seam = np.flatnonzero(same & is_seed & ~np.r_[False, is_seed[:-1]])
            prefixes[seam] = np.minimum(self._run[stream[seam - 1]], self._run[stream[seam]])
            prefixes[~same] = 0
            inner = np.flatnonzero(same & (kind[order] == 1))
            if len(inner):
                self._fill(prefixes, inner, key, order, rank, np.concatenate(links), kind)
        self._emit(stream[~is_seed], prefixes[~is_seed] if self._carry else None)
        self._pass_on(stream, prefixes, high)

    def _fill(self, prefixes, inner, key, order, rank, link, kind) -> None:
        """Common prefixes of what was pushed within the range; each depends on values before it."""
        upto = rank[link[order[inner]]]
        before = order[inner - 1]
        open_ = kind[before] == 0  # the one before was pushed from below the range
        begin = np.where(open_, 0, rank[link[before]] + 1)
        floor = np.where(open_, self._since[key[inner]], _BIG)
        while True:
            new = np.minimum(LeastOf(prefixes, self._scratch)(begin, upto), floor) + 1
            if (prefixes[inner] == new).all():
                return
            prefixes[inner] = new

    def _pass_on(self, positions: np.ndarray, prefixes: np.ndarray | None, least: int) -> None:
        left = positions - 1
        at = np.flatnonzero((positions > 0) & self._member[left])
        key = self._key(left[at])
        if least:
            above = key >= least
            at, key = at[above], key[above]
        if not len(at):
            if self._carry:
                np.minimum(self._since, prefixes.min(), out=self._since)
            return
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        if not self._carry:
            self._queue.push(key, left[at], np.zeros(len(at), np.int32))
            return
        head = np.empty(len(key), bool)
        head[0], head[1:] = True, key[1:] != key[:-1]
        value = np.empty(len(at), np.int32)
        upto = np.minimum.accumulate(prefixes)
        value[head] = np.minimum(self._since[key[head]], upto[at[head]])
        rest = np.flatnonzero(~head)
        value[rest] = LeastOf(prefixes, self._scratch)(at[rest - 1] + 1, at[rest])
        np.minimum(self._since, upto[-1], out=self._since)
        tail = np.append(head[1:], True)
        after = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], _BIG)
        self._since[key[tail]] = after[at[tail] + 1]
        self._queue.push(key, left[at], value + np.int32(1))


# -------------------------------------------------------------- recursion


def _reversed(values: np.ndarray, scratch: Scratch, shift: bool) -> np.ndarray:
    """Backwards; ``shift`` turns prefixes shared with the one before into those shared with the one after."""
    n = len(values)
    out = scratch.array(n, values.dtype)
    for s in _blocks(n, 1 << 20):
        out[n - s.stop : n - s.start] = values[s][::-1]
    if shift and n:
        for a in range(n - 1, 0, -(1 << 20)):  # from the end, so that nothing is overwritten before it is read
            z = max(0, a - (1 << 20))
            out[z + 1 : a + 1] = np.array(out[z:a])
        out[0] = 0
    return out


def _places(n: int):
    """The type of positions in a text."""
    return np.int32 if n < 1 << 31 else np.int64


def _named(text, stars, ends, in_order, scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """(name of each leftmost-S substring in text order, common prefix of each name with the one before, names).

    The last character of a substring doesn't count as common: it is the next one's.
    """
    m = len(stars)
    names, common = scratch.array(m, np.int32), scratch.array(m, np.int32)

    index = scratch.array(len(text), np.int32)
    for s in _blocks(m, 1 << 20):
        index[stars[s]] = np.arange(s.start, s.stop)
    name = 0
    names[index[in_order[0]]], common[0] = 0, 0
    for s in _blocks(m - 1):
        a, b = np.asarray(in_order[s.start : s.stop]), np.asarray(in_order[s.start + 1 : s.stop + 1])
        i, j = index[a], index[b]
        of_a, of_b = ends[i] - a + 1, ends[j] - b + 1
        least = np.minimum(of_a, of_b)
        alike, open_, k = least.copy(), np.arange(len(a)), 0
        while len(open_):
            same = text[a[open_] + k] == text[b[open_] + k]
            alike[open_[~same]] = k
            k += 1
            open_ = open_[same]
            open_ = open_[least[open_] > k]
        ended = (alike == least) & (of_a != of_b)  # alike to the end of one, where only the types differ
        alike[ended] -= 1
        differ = (alike < least)
        own = name + np.cumsum(differ)
        common[own[differ]] = alike[differ]
        names[j] = own
        name = int(own[-1])
    return names, common, name + 1


def sorted_suffixes(text: np.ndarray, sigma: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before); ``text`` ends with a single 0, its least character."""
    n = len(text)
    small, run = suffix_types(text, scratch)
    counts = sum(int(np.count_nonzero(small[s][1:] & ~small[s][:-1])) for s in (slice(b.start, min(b.stop + 1, n)) for b in _blocks(n, 1 << 20)))
    kind = _places(n)
    stars, at = scratch.array(counts, kind), 0
    for b in _blocks(n, 1 << 20):
        part = small[b.start : min(b.stop + 1, n)]
        found = np.flatnonzero(part[1:] & ~part[:-1]) + 1 + b.start
        stars[at : at + len(found)] = found
        at += len(found)
    large = _Not(small)
    end = np.array([n - 1], kind)
    if not counts:  # one character: nothing but the end
        return end, np.zeros(1, np.int32)

    ends = scratch.array(counts, kind)  # the next one's begin
    ends[:-1], ends[-1] = stars[1:], n - 1

    # Leftmost-S substrings in order.
    first = np.asarray(text[stars])
    rough = scratch.array(counts, kind)
    rough[:] = stars[np.argsort(first, kind="stable")]
    down, _ = Induction(text, large, run, sigma, False, False, scratch).run(rough, None)
    up, _ = Induction(text, small, run, sigma, True, False, scratch).run(_reversed(down, scratch, False), None, end)
    in_order, at = scratch.array(counts, kind), counts
    for s in _blocks(len(up), 1 << 20):
        part = np.asarray(up[s])
        part = part[(part > 0) & large[np.maximum(part - 1, 0)]]
        in_order[at - len(part) : at] = part[::-1]
        at -= len(part)
    names, common, different = _named(text, stars, ends, in_order, scratch)
    del down, up, in_order, rough

    # Their suffixes in order, by recursion unless all names differ.
    star_prefixes = scratch.array(counts, np.int32)
    if different == counts:
        order = scratch.array(counts, kind)
        order[names] = np.arange(counts)
        shared = np.zeros(1, np.int32)
    else:
        order, shared = sorted_suffixes(names, different, scratch)
    least = LeastOf(common, scratch)
    seeds = scratch.array(counts, kind)
    seeds[0], star_prefixes[0] = stars[order[0]], 0
    for s in _blocks(counts - 1):
        i, j = order[s.start : s.stop], order[s.start + 1 : s.stop + 1]
        same = shared[s.start + 1 : s.stop + 1] if len(shared) == counts else 0
        seeds[s.start + 1 : s.stop + 1] = stars[j]
        i, j, along = i + same, j + same, stars[j + same] - stars[j]
        # The names that differ share `more` characters; to the end of the shorter one, and its last character's run, if only the types differ there.
        more = least(names[i] + 1, names[j]).astype(np.int64)
        last = np.minimum(ends[i] - stars[i], ends[j] - stars[j])
        x, y = stars[i] + last, stars[j] + last
        typed = np.flatnonzero((more == last) & (text[x] == text[y]))
        more[typed] += np.minimum(run[x[typed]], run[y[typed]])
        star_prefixes[s.start + 1 : s.stop + 1] = along + more
    del names, common, least, order, shared

    # Everything else.
    down, down_prefixes = (of_large := Induction(text, large, run, sigma, False, True, scratch)).run(seeds, star_prefixes)
    of_small = Induction(text, small, run, sigma, True, True, scratch)
    up, up_prefixes = of_small.run(_reversed(down, scratch, False), _reversed(down_prefixes, scratch, True), end)
    up, up_prefixes = _reversed(up, scratch, False), _reversed(up_prefixes, scratch, True)
    n_small = of_small.members[::-1]
    before_large, before_small = np.cumsum(n_small) - n_small, np.cumsum(of_large.members)
    out, prefixes = scratch.array(n, kind), scratch.array(n, np.int32)
    heads = np.cumsum(of_large.members) - of_large.members
    for s in _blocks(len(down)):
        to = np.arange(s.start, s.stop) + before_large[text[down[s]]]
        out[to], prefixes[to] = down[s], down_prefixes[s]
    for s in _blocks(len(up)):
        to = np.arange(s.start, s.stop) + before_small[text[up[s]]]
        out[to], prefixes[to] = up[s], up_prefixes[s]
    starts = np.cumsum(n_small + of_large.members) - (n_small + of_large.members)
    prefixes[starts[(n_small + of_large.members) > 0]] = 0
    both = np.flatnonzero((n_small > 0) & (of_large.members > 0))
    seam = starts[both] + of_large.members[both]
    prefixes[seam] = np.minimum(run[out[seam - 1]], run[out[seam]])
    return out, prefixes


class _Not:
    """The other type, without an array of its own."""

    def __init__(self, small: np.ndarray):
        self._small = small

    def __getitem__(self, at):
        return ~np.asarray(self._small[at])


# ------------------------------------------------------------------ shards


class Shard:
    """Contexts that are sorted together; beyond the budget their text lies in a file."""

    def __init__(self, budget: int = MEMORY_BYTES):
        self.scratch, self._parts, self._file, self.sizes, self.bytes = Scratch(budget), [], None, [], 0

    def add(self, context: bytes) -> None:
        self._parts.append(context)
        self.sizes.append(len(context))
        self.bytes += len(context)
        if sum_over(self._parts, self.scratch.budget // 16):
            self._file = self._file or self.scratch.file()
            self._file.write(b"".join(self._parts))
            self._parts = []

    def _text(self) -> tuple[np.ndarray, np.ndarray]:
        """(the contexts one after the other, where each begins)."""
        sizes = np.array(self.sizes, dtype=np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        text = self.scratch.array(self.bytes + len(sizes) + 1, np.int16)
        rest = b"".join(self._parts)
        if self._file:
            self._file.write(rest)
            self._file.seek(0)
        for at in range(0, len(sizes), 1024):
            some = sizes[at : at + 1024]
            begin, n = int(starts[at]), int(some.sum())
            if self._file:
                raw = np.frombuffer(self._file.read(n), np.uint8)
            else:
                raw = np.frombuffer(rest, np.uint8, n, begin - at)
            put = np.arange(n) + np.repeat(np.arange(len(some)), some)
            piece = np.full(n + len(some), BREAK, np.int16)
            piece[put] = raw.astype(np.int16) + BYTES_FROM
            text[begin : begin + len(piece)] = piece
        text[-1] = END
        return text, starts

    def repeated(self, depth: int) -> list[np.ndarray]:
        """For each context, the starts of its ``depth``-byte windows that also start elsewhere in the shard."""
        text, starts = self._text()
        order, prefixes = sorted_suffixes(text, SIGMA, self.scratch)
        hits = self.scratch.array(len(text), bool)
        hits[:] = False
        for s in _blocks(len(text), 1 << 20):
            alike = np.flatnonzero(prefixes[s] >= depth) + s.start
            hits[order[alike]] = True
            hits[order[alike - 1]] = True
        # A prefix may run over the end of a context; such a window isn't one.
        out = []
        for a, n in zip(starts.tolist(), self.sizes, strict=True):
            out.append(np.flatnonzero(hits[a : a + max(0, n - depth + 1)]))
        return out


def sum_over(parts: list[bytes], limit: int) -> bool:
    return len(parts) % 256 == 0 and sum(map(len, parts)) > limit


def repeated_windows(contexts: Iterable[bytes], depth: int, budget: int = MEMORY_BYTES) -> list[np.ndarray]:
    """For each context, the starts of its ``depth``-byte windows that also start elsewhere in the contexts."""
    shard = Shard(budget)
    for c in contexts:
        shard.add(c)
    return shard.repeated(depth) if shard.sizes else []
