"""Vertical (bit-sliced) comparison of 64-bit fingerprints with numpy.

Fingerprints are stored as bit planes: word w of plane b holds bit b of the
fingerprints 64w to 64w+63. One XOR compares a bit of 64 pairs, and carry-save
adders count the differing bits of all these pairs at once in three counter
planes and one overflow plane.
"""

from __future__ import annotations

import numpy as np

BITS, MAX_RADIUS = 64, 6
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: the bit planes of an array of uint64."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class Counters:
    """Counts of differing bits for many lanes; counts of 8 and more stay in ``over``."""

    def __init__(self, shape):
        self.c0, self.c1, self.c2, self.over = (np.zeros(shape, np.uint64) for _ in range(4))

    def add_two(self, a, b):
        """A full adder takes two planes and the lowest counter, its carry ripples on."""
        x = a ^ b
        carry = (a & b) | (self.c0 & x)
        self.c0 ^= x
        t = self.c1 & carry
        self.c1 ^= carry
        self.over |= self.c2 & t
        self.c2 ^= t

    def exceeds(self, radius: int):
        """The lanes whose count is over the radius."""
        above, equal = self.over.copy(), ~self.over
        for k, c in ((2, self.c2), (1, self.c1), (0, self.c0)):
            if radius >> k & 1:
                equal &= c
            else:
                above |= equal & c
                equal &= ~c
        return above

    def take(self, columns):
        for k in ("c0", "c1", "c2", "over"):
            setattr(self, k, np.ascontiguousarray(getattr(self, k)[:, columns]))


def near(queries: np.ndarray, against: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Boolean (queries, against.shape[1] * 64): which lanes are within the radius of each query.

    against: bit planes. Every ``step`` planes, the blocks of 64 lanes in which
    no query is within reach any more are abandoned.
    """
    masks = planes_of_queries(queries)
    words = against.shape[1]
    alive = np.arange(words)
    count = Counters((len(queries), words))
    for b in range(0, BITS, 2):
        count.add_two(against[b][None, alive] ^ masks[b][:, None], against[b + 1][None, alive] ^ masks[b + 1][:, None])
        if (b + 2) % step == 0:
            live = (count.exceeds(radius) != _ONES).any(axis=0)
            if not live.all():
                count.take(live)
                alive = alive[live]
                if not len(alive):
                    break
    hit = np.zeros((len(queries), words), np.uint64)
    if len(alive):
        hit[:, alive] = ~count.exceeds(radius)
    return np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little").astype(bool)


def planes_of_queries(queries: np.ndarray) -> np.ndarray:
    """(64, queries): all ones where the query has the bit, else zero."""
    bits = (queries[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.where(bits.astype(bool), _ONES, np.uint64(0))


def shifted(p: np.ndarray, k: int) -> np.ndarray:
    """The planes with lane i + k in lane i's place."""
    w, r = divmod(k, 64)
    out = np.zeros_like(p)
    if w < p.shape[1]:
        out[:, : p.shape[1] - w] = p[:, w:] >> np.uint64(r)
        if r and w + 1 < p.shape[1]:
            out[:, : p.shape[1] - w - 1] |= p[:, w + 1 :] << np.uint64(64 - r)
    return out


def neighbours(fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j < ends[i], within the radius, for rows in groups of a few rows each.

    All groups are compared at once: round k compares each lane with the k-th
    lane after it.
    """
    n, left, right = len(fps), [], []
    p = planes(fps)
    lane = np.arange(n)
    for k in range(1, int((ends - lane).max(initial=1))):
        inside = np.zeros(p.shape[1] * 64, bool)
        inside[:n] = lane + k < ends
        valid = np.packbits(inside, bitorder="little").view(np.uint64)
        alive = np.flatnonzero(valid)
        if not len(alive):
            break
        other = shifted(p, k)
        count = Counters((1, len(alive)))
        for b in range(0, BITS, 2):
            count.add_two((p[b, alive] ^ other[b, alive])[None], (p[b + 1, alive] ^ other[b + 1, alive])[None])
            if (b + 2) % 16 == 0:
                live = (count.exceeds(radius)[0] & valid[alive]) != valid[alive]
                if not live.all():
                    count.take(live)
                    alive = alive[live]
                    if not len(alive):
                        break
        hit = np.zeros(p.shape[1], np.uint64)
        if len(alive):
            hit[alive] = ~count.exceeds(radius)[0] & valid[alive]
        i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
        left.append(i)
        right.append(i + k)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, for links a-b among n rows."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            return label


def components_of_group(fps: np.ndarray, radius: int, block: int = 64) -> np.ndarray:
    """The least row of each row's component in one large group; memory is block * len(fps) flags."""
    n = len(fps)
    label, p = np.arange(n), planes(fps)
    for q in range(0, n, block):
        hits = near(fps[q : q + block], p, radius)[:, :n]
        for k in range(len(hits)):
            linked = np.unique(label[np.flatnonzero(hits[k])])
            if len(linked) > 1:
                label[np.isin(label, linked)] = linked[0]
    return label


def links(fps: np.ndarray, ends: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row of its component inside its group) for rows that aren't the least.

    Rows are ordered by group; ends[i] is the end of row i's group. Links that
    join no new rows are left out, so there are fewer links than rows.
    """
    n = len(fps)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
    sizes = ends[starts] - starts
    label = np.arange(n)
    few = np.repeat((sizes > 1) & (sizes <= small), sizes)
    if few.any():
        rows = np.flatnonzero(few)
        size = np.repeat(sizes, sizes)[rows]
        first = np.repeat(starts, sizes)[rows]
        begin = np.arange(len(rows)) - (rows - first)
        a, b = neighbours(fps[rows], begin + size, radius)
        label[rows] = rows[merged(len(rows), a, b)]
    for s, k in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        label[s : s + k] = s + components_of_group(fps[s : s + k], radius)
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


class CarrySave:
    """Counts of differing bits without a bound, sixteen planes at a time: carries of 1, 2, 4 and 8 are saved, only those of 16 ripple."""

    def __init__(self, lanes: int, bits: int):
        self.counts = np.zeros((4 + (bits // 16).bit_length(), lanes), np.uint64)

    def add(self, planes: np.ndarray):
        carries = planes
        for level in range(4):
            a, b = carries[::2], carries[1::2]
            x, out, c = a ^ b, a & b, self.counts[level]
            for k in range(len(x)):
                out[k] |= c & x[k]
                c ^= x[k]
            carries = out
        carry = carries[0]
        for c in self.counts[4:]:
            more = c & carry
            c ^= carry
            carry = more

    def exceeds(self, radius: int):
        """The lanes whose count is over the radius."""
        above, equal = np.zeros_like(self.counts[0]), np.full_like(self.counts[0], _ONES)
        for k in reversed(range(len(self.counts))):
            if radius >> k & 1:
                equal &= self.counts[k]
            else:
                above |= equal & self.counts[k]
                equal &= ~self.counts[k]
        return above


def _run(words: np.ndarray, shift: int):
    """Ascending numbers of words, shifted, as a slice if there are no gaps."""
    first, last = int(words[0]) + shift, int(words[-1]) + shift
    return slice(first, last + 1) if last - first + 1 == len(words) else words + shift


def wide_neighbours(fps: np.ndarray, ends: np.ndarray, radius: int):
    """Yield arrays (i, j) of pairs i < j < ends[i] within the radius, each pair once, for fingerprints of several words: (rows, words) uint64.

    Round k compares each lane with the k-th lane after it, for all groups at
    once. Blocks of 64 lanes that are all out of reach are abandoned.
    """
    n, bits = len(fps), 64 * fps.shape[1]
    words = -(-n // 64)
    padded = np.zeros((words * 64, fps.shape[1]), np.uint64)
    padded[:n] = fps
    flags = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    p = np.zeros((bits, words + 1), np.uint64)  # the last word is empty, for shifts
    p[:, :words] = np.packbits(np.ascontiguousarray(flags.T), axis=1, bitorder="little").view(np.uint64)
    lane, inside = np.arange(n), np.zeros(words * 64, bool)
    for k in range(1, int((ends - lane).max(initial=1))):
        inside[:n] = lane + k < ends
        valid = np.packbits(inside, bitorder="little").view(np.uint64)
        alive = np.flatnonzero(valid)
        if not len(alive):
            break
        w, r = divmod(k, 64)
        count = CarrySave(len(alive), bits)
        own, at, after = (_run(alive, shift) for shift in (0, w, w + 1))
        for b in range(0, bits, 16):
            rows = p[b : b + 16]
            differ = rows[:, own] ^ (rows[:, at] >> np.uint64(r))
            if r:
                differ ^= rows[:, after] << np.uint64(64 - r)
            count.add(differ)
            if b + 16 > 2 * radius and b % 32 and b + 16 < bits:  # before, hardly any block is out of reach
                live = (~count.exceeds(radius) & valid[alive]) != 0
                if not live.all():
                    alive, count.counts = alive[live], np.ascontiguousarray(count.counts[:, live])
                    if not len(alive):
                        break
                    own, at, after = (_run(alive, shift) for shift in (0, w, w + 1))
        if len(alive):
            hit = np.zeros(words, np.uint64)
            hit[alive] = ~count.exceeds(radius) & valid[alive]
            i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            if len(i):
                yield i, i + k
