"""Suffixes of a byte array sorted by mergesort; two suffixes are compared by hashes of their prefixes.

Prefix sums of a polynomial hash give the hash of any stretch in constant time. The common
extension of two suffixes is found by binary search over its length, so a comparison takes
logarithmic time however much they share. Runs are merged many at a time: each pair of
runs is cut into lanes along the merge path, and all lanes advance together. Neighbours that
hash as equal are compared byte by byte; a collision starts anew with another multiplier.
"""

from __future__ import annotations

import numpy as np

MULTIPLIERS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F]


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``size`` powers of the multiplier and of its inverse modulo 2^64, kept for the next call."""
    known = _tables.get(multiplier)
    if known is None or len(known[0]) < size:
        room = 1 << max(size - 1, 1).bit_length()
        made = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            table = np.full(room, base, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        known = _tables[multiplier] = made[0], made[1]
    return known[0][:size], known[1][:size]


class PrefixHashes:
    """Hashes modulo 2^64 of all stretches of ``data``."""

    def __init__(self, data: np.ndarray, multiplier: int = MULTIPLIERS[0]):
        size = len(data)
        power, self.inverse = powers(multiplier, size + 1)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * power[:size], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def grams(self, length: int) -> np.ndarray:
        """Hashes of all stretches of one length, in order."""
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes with all bits spread."""
    for _ in range(2):
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(MULTIPLIERS[1])
    return hashes ^ (hashes >> np.uint64(32))


class SuffixSort:
    """Order of suffixes ``start`` of ``data``, each cut at ``length`` bytes, and which neighbours are equal."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.head = np.zeros(len(start), np.uint64)
        for k in range(8):
            byte = np.where(length > k, padded[start + k], 0).astype(np.uint64)
            self.head = (self.head << np.uint64(8)) | byte
        for multiplier in MULTIPLIERS:
            self.hashes = PrefixHashes(data, multiplier)
            self.order = self.sorted()
            equal = self.hash_equal_neighbours()
            if self.verified(equal):
                break
        else:
            raise ArithmeticError("every multiplier met a hash collision")
        #: Class of equal suffixes, by position in ``start``.
        self.group = np.empty(len(start), np.int64)
        self.group[self.order] = np.cumsum(np.concatenate([[False], ~equal])[: len(start)])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``x`` and ``y``."""
        a, b = self.start[x], self.start[y]
        high = np.minimum(self.length[x], self.length[y])
        low = np.zeros(len(x), np.int64)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(a, middle) == self.hashes.of(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        return low

    def not_after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix ``x`` is smaller than or equal to suffix ``y``."""
        result = self.head[x] < self.head[y]
        tie = np.flatnonzero(self.head[x] == self.head[y])
        if len(tie):
            x, y = x[tie], y[tie]
            common = self.extension(x, y)
            more_x, more_y = self.length[x] > common, self.length[y] > common
            byte = lambda s: self.data[np.minimum(self.start[s] + common, len(self.data) - 1)]
            result[tie] = ~more_x | (more_y & (byte(x) < byte(y)))
        return result

    def sorted(self) -> np.ndarray:
        count = len(self.start)
        order, width = np.arange(count), 1
        while width < count:
            order = self.merged(order, width)
            width *= 2
        return order

    def merged(self, order: np.ndarray, width: int) -> np.ndarray:
        """Merge neighbouring sorted runs of ``width`` suffixes."""
        count = len(order)
        lane = int(min(64, max(4, count // 4096)))
        base = np.arange(0, count, 2 * width)
        middle, end = np.minimum(base + width, count), np.minimum(base + 2 * width, count)
        lanes = -(-(end - base) // lane)
        base, middle, end = (np.repeat(v, lanes) for v in (base, middle, end))
        done = lane * (np.arange(len(base)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        left, right = middle - base, end - middle
        # Merge path: how many of the lane's earlier outputs come from the left run.
        low, high = np.maximum(0, done - right), np.minimum(done, left)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            half = (low[open_] + high[open_]) >> 1
            goes = self.not_after(order[base[open_] + half], order[middle[open_] + done[open_] - 1 - half])
            low[open_] = np.where(goes, half + 1, low[open_])
            high[open_] = np.where(goes, high[open_], half)
            open_ = open_[low[open_] < high[open_]]
        i, j = base + low, middle + done - low
        out, place = np.empty_like(order), base + done
        stop = np.minimum(place + lane, end)
        for _ in range(lane):
            on = place < stop
            if not on.all():
                i, j, middle, end, place, stop = (v[on] for v in (i, j, middle, end, place, stop))
                if not len(i):
                    break
            take = j >= end
            both = np.flatnonzero((i < middle) & ~take)
            take[both] = self.not_after(order[i[both]], order[j[both]])
            out[place] = order[np.where(take, i, np.minimum(j, count - 1))]
            i, j, place = i + take, j + ~take, place + 1
        return out

    def hash_equal_neighbours(self) -> np.ndarray:
        x, y = self.order[:-1], self.order[1:]
        same = (self.length[x] == self.length[y]) & (self.head[x] == self.head[y])
        same[same] = self.extension(x[same], y[same]) == self.length[x[same]]
        return same

    def verified(self, equal: np.ndarray) -> bool:
        """Byte by byte: neighbours held equal are equal, and all others stand in the right order."""
        x, y = self.order[:-1], self.order[1:]
        open_ = np.arange(len(x))
        for k in range(int(self.length.max(initial=0))):
            x, y = self.order[:-1][open_], self.order[1:][open_]
            on = (self.length[x] > k) & (self.length[y] > k)
            if (equal[open_[~on]] & (self.length[x[~on]] != self.length[y[~on]])).any() or (~equal[open_[~on]] & (self.length[x[~on]] >= self.length[y[~on]])).any():
                return False
            open_, x, y = open_[on], x[on], y[on]
            a, b = self.data[self.start[x] + k], self.data[self.start[y] + k]
            if ((a > b) | ((a != b) & equal[open_])).any():
                return False
            open_ = open_[a == b]
            if not len(open_):
                return True
        return bool(equal[open_].all())


def equal_groups(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Class of equal stretches, numbered from 0; only stretches whose hash occurs twice are sorted."""
    hashes = mixed(PrefixHashes(data).of(start, length)) ^ length.astype(np.uint64)
    _, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[group] > 1)
    if len(twice):
        # The sort decides: stretches that only share a hash come apart again.
        found = SuffixSort(data, start[twice], length[twice]).group
        _, apart = np.unique(found, return_inverse=True)
        group[twice] = len(times) + apart
        _, group = np.unique(group, return_inverse=True)
    return group
