"""A compressed FM-index of word sequences: the BWT as a wavelet matrix of packed bit planes, searched backwards for many queries at once."""

from __future__ import annotations

import numpy as np


#: LOW[k] has the k lowest bits set.
LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """rank(c, i): how often c stands before place i, for arrays of c and i."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(values)
        self.bits, self.sums, self.zeros = [], [], []
        now = values.astype(np.int32)
        for level in range(self.levels):
            bit = ((now >> (self.levels - 1 - level)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int32)
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], ones[:-1]]).astype(np.int32))
            self.zeros.append(np.int32(self.n - int(ones[-1])))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = np.zeros(sigma, np.int32)
        self.first = self._walk(np.arange(sigma, dtype=np.int32), np.zeros(sigma, np.int32))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            word = i >> 6
            ones = self.sums[level].take(word)
            ones += np.bitwise_count(self.bits[level].take(word) & LOW.take(i & 63))
            one = (c & np.int32(1 << (self.levels - 1 - level))) != 0
            i = np.where(one, ones + self.zeros[level], i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c.astype(np.int32), i.astype(np.int32)) - self.first[c]


class FMIndex:
    """Over sequences of word numbers from 1 on; 0 parts the sequences. Patterns may have up to `depth` words.

    Suffixes are sorted by their first `depth` words only, which is all that searching such patterns needs.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        self.depth = depth
        sigma = int(text.max(initial=0)) + 1
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        h = 1
        while h < depth and n:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            h *= 2
            if rank[order[-1]] == n - 1:
                break
        self.bwt = WaveletMatrix(text[order - 1], sigma) if n else None
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def leftmost(self, text: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each query text[stop:end] read backwards from its end: the largest q with text[q:end] found once only, or stop - 1
        if even the whole of it is found more often. These are matching statistics cut at `stop`."""
        q = end - 1
        c = text[q]
        sp, ep = self.before[c], self.before[c + 1]
        out = np.where(ep - sp >= 2, stop - 1, q)
        live = np.flatnonzero((ep - sp >= 2) & (q > stop))
        q, sp, ep = q[live], sp[live], ep[live]
        while len(live):
            q = q - 1
            c = text[q]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([sp, ep])) + np.concatenate([self.before[c]] * 2)
            sp, ep = both[: len(c)], both[len(c) :]
            lone = ep - sp < 2
            out[live[lone]] = q[lone]
            go = ~lone & (q > stop[live])
            live, q, sp, ep = live[go], q[go], sp[go], ep[go]
        return out


def repeated_windows(index: FMIndex, text: np.ndarray, base: np.ndarray, n_windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, first, last) ranges of windows of `width` words, counted within their sequence, that stand more than once in the index.

    base: where each sequence starts in text. One search tells of a whole range of windows: those it fails within are
    unique, those it covers are repeated; what is left on either side is searched again.
    """
    if index.depth < width:
        raise ValueError(f"windows of {width} words need an index of that depth; this one has {index.depth}")
    seq = np.flatnonzero(n_windows > 0)
    lo, hi = np.zeros(len(seq), np.int64), n_windows[seq].astype(np.int64) - 1
    kind = np.zeros(len(seq), np.int8)  # 0: try the first window, 1: try all of them, 2: halve
    found = [(np.zeros(0, np.int64),) * 3]
    while len(seq):
        mid = np.where(kind == 0, lo, np.where(kind == 1, hi, (lo + hi) // 2))
        mid = np.minimum(mid, lo + index.depth - width)
        q = index.leftmost(text, base[seq] + mid + width, base[seq] + lo) - base[seq]
        rep = q < mid
        found.append((seq[rep], np.maximum(q + 1, lo)[rep], mid[rep]))
        left = (q >= lo) & (np.minimum(q, mid - 1) >= lo)
        right_from = np.where(q >= mid, q + 1, mid + 1)
        right = right_from <= hi
        all_good = q < lo
        seq, lo, hi, kind = (
            np.concatenate([seq[left], seq[right]]),
            np.concatenate([lo[left], right_from[right]]),
            np.concatenate([np.minimum(q, mid - 1)[left], hi[right]]),
            np.concatenate([np.full(left.sum(), 2, np.int8), np.where(all_good, 1, 0).astype(np.int8)[right]]),
        )
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))
