"""Ratcliff-Obershelp likeness of many pairs of strings at once, in numpy: what ``difflib.SequenceMatcher(None, a, b).ratio()`` gives, to the last bit."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

WIDTH = 192  # longest string in ASCII that is compared in numpy (difflib treats those from 200 on otherwise); others go to difflib
BITS = 64  # longest string whose places are bits of a number: one of two must be no longer
CHUNK = 1024  # windows compared at once: their characters stay in a core's cache


class Strings:
    """Strings as rows of characters, filled up with 0; ``fits`` tells those in ASCII of at most ``WIDTH``, ``narrow`` of at most ``BITS``."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        raw = [t.encode() if len(t) <= WIDTH and t.isascii() and "\0" not in t else None for t in texts]
        self.fits = np.array([r is not None for r in raw], dtype=bool)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.narrow = self.fits & (self.length <= BITS)
        self.chars = np.frombuffer(b"".join((r or b"").ljust(WIDTH, b"\0") for r in raw), dtype=np.uint8).reshape(-1, WIDTH)
        self._columns = self._places = None

    @property
    def columns(self) -> np.ndarray:
        """The characters by place."""
        if self._columns is None:
            self._columns = np.ascontiguousarray(self.chars.T)
        return self._columns

    @property
    def places(self) -> np.ndarray:
        """For each narrow string and character a bit for each place where it stands."""
        if self._places is None:
            self._places = np.zeros((len(self.texts), 128), dtype=np.uint64)
            for p in range(int(self.length[self.narrow].max(initial=0))):
                rows = np.flatnonzero(self.narrow & (self.length > p))
                self._places[rows, self.chars[rows, p]] |= np.uint64(1 << p)
        return self._places


def most_common(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a[i]``, narrow, and ``b[j]``: no fewer characters than likeness matches, as its blocks stand in the same order in both."""
    table, left = a.places.reshape(-1), i * 128
    v = np.full(len(i), 2**64 - 1, dtype=np.uint64)
    for column in b.columns[: int(b.length[j].max(initial=0))]:
        u = table.take(left + column.take(j)) & v
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _longest(a: Strings, b: Strings, i, j, alo, ahi, blo, bhi, b_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last places in ``a`` and ``b``, from the windows' starts, and lengths of the windows' longest common blocks: of several the first in ``a``, then in ``b``, or with ``b_first`` in ``b``, then in ``a``.

    A bit stands for a place in ``b``; blocks of 1, 2, 4 ... characters that end at a row's place in ``a`` are put together to the longest.
    """
    wa = ahi - alo
    r = np.arange(wa.max())[:, None]
    window = (np.uint64(2**64 - 1) >> (BITS - (bhi - blo)).astype(np.uint64)) << blo.astype(np.uint64)
    ends = b.places.reshape(-1).take(a.chars.reshape(-1).take(i * WIDTH + alo + r, mode="clip") + j * 128)
    ends &= window
    if wa.min() < len(r):
        ends[r >= wa] = 0

    def after(blocks: np.ndarray, n: int) -> np.ndarray:
        """Where blocks end that could go on with ``n`` more characters."""
        out = np.zeros_like(blocks)
        np.left_shift(blocks[:-n], np.uint64(n), out=out[n:])
        return out

    powers = [ends]
    while len(r) >= 2 ** len(powers) and (more := powers[-1] & after(powers[-1], 2 ** (len(powers) - 1))).any():
        powers.append(more)
    best, size = powers[-1], np.zeros(len(i), dtype=np.int64)
    for t in reversed(range(len(powers))):
        longer = powers[t] & (after(best, 2**t) | np.where(size, np.uint64(0), np.uint64(2**64 - 1)))
        some = np.bitwise_or.reduce(longer, axis=0) != 0
        best = np.where(some, longer, best)
        size += some.astype(np.int64) << t
    place = lambda bits: np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    if b_first:
        end_b = place(np.bitwise_or.reduce(best, axis=0))
        return (best >> np.minimum(end_b, BITS - 1).astype(np.uint64) & np.uint64(1)).argmax(axis=0), end_b - blo, size
    end_a = (best != 0).argmax(axis=0)
    return end_a, place(best[end_a, np.arange(len(i))]) - blo, size


def _matched(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray, need: np.ndarray, b_first: bool) -> np.ndarray:
    """Characters that likeness matches, ``b`` narrow; of a pair that can't come to ``need`` perhaps fewer."""
    total = np.zeros(len(i), dtype=np.int64)
    p, alo, ahi, blo, bhi = np.arange(len(i)), np.zeros(len(i), np.int64), a.length[i], np.zeros(len(i), np.int64), b.length[j]
    while True:
        room = np.minimum(ahi - alo, bhi - blo)
        able = total + np.bincount(p, room, len(i)) >= need
        left = np.flatnonzero((room > 0) & able[p])
        if not len(left):
            return total
        left = left[np.argsort((ahi - alo)[left] * (WIDTH + 1) + (bhi - blo)[left])]  # windows of a size together
        p, alo, ahi, blo, bhi = (x[left] for x in (p, alo, ahi, blo, bhi))
        found = [_longest(a, b, i[p[s]], j[p[s]], alo[s], ahi[s], blo[s], bhi[s], b_first) for s in (slice(k, k + CHUNK) for k in range(0, len(p), CHUNK))]
        end_a, end_b, size = (np.concatenate(x) for x in zip(*found))
        total += np.bincount(p, size, len(i)).astype(np.int64)
        some = np.flatnonzero(size)
        p, alo, ahi, blo, bhi, end_a, end_b, size = (x[some] for x in (p, alo, ahi, blo, bhi, end_a, end_b, size))
        p, alo, ahi, blo, bhi = np.tile(p, 2), np.concatenate([alo, alo + end_a + 1]), np.concatenate([alo + end_a + 1 - size, ahi]), np.concatenate([blo, blo + end_b + 1]), np.concatenate([blo + end_b + 1 - size, bhi])


def ratios(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``a[i]``, ``b[j]`` those whose likeness is at least ``least`` (their numbers, and the likeness), 0 where either is empty."""
    both = a.length[i] + b.length[j]
    reach = lambda common, at: 2.0 * common >= least[at] * both[at] * (1 - 1e-12)
    at = np.flatnonzero(reach(np.minimum(a.length[i], b.length[j]), slice(None)))
    swap = ~b.narrow[j[at]]
    score, kept = np.zeros(len(i)), []
    for x, y, p, q, few, b_first in ((a, b, i, j, at[a.fits[i[at]] & ~swap], False), (b, a, j, i, at[b.fits[j[at]] & a.narrow[i[at]] & swap], True)):  # y is narrow
        if (least[few] > 0).all():
            few = few[reach(most_common(y, x, q[few], p[few]), few)]
        need = np.ceil(least[few] * both[few] / 2 - 1e-6).astype(np.int64)
        score[few] = 2.0 * _matched(x, y, p[few], q[few], need, b_first) / np.maximum(both[few], 1)
        kept.append(few)
    for k in at[~np.where(swap, b.fits[j[at]] & a.narrow[i[at]], a.fits[i[at]])]:
        x, y = a.texts[i[k]], b.texts[j[k]]
        score[k] = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        kept.append([k])
    at = np.sort(np.concatenate(kept).astype(np.int64))
    at = at[score[at] >= least[at]]
    return at, score[at]
