"""Content-chosen anchors: which windows may repeat, without a row per window.

For windows of `window` symbols, every window is represented by the `gram` symbols
with the smallest hash in it. Equal windows choose the same place, so only windows
whose anchor repeats can repeat. Neighbouring windows mostly share their anchor: the
run of windows with one anchor is a segment, and equal segments consist of equal
windows.
"""

from __future__ import annotations

import numpy as np

PLACE_BITS = 24
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64, at least n of them."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        make = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b)]))
        _POWERS, _INVERSE = make(BASE).astype(np.uint64), make(inverse).astype(np.uint64)
    return _POWERS[:n], _INVERSE[:n]


class Rolling:
    """Hashes of any window of a sequence of whole numbers, from one pass over it."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.powers, self.inverse = _powers(n + 1)
        terms = (symbols.astype(np.uint64) + np.uint64(1)) * self.powers[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        """One hash per start of a window of `size` symbols."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end)."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in each window of `width`, the leftmost of equal ones."""
    smallest = values >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    smallest |= np.arange(len(values), dtype=np.uint64)
    wide = 1
    while 2 * wide <= width:
        smallest = np.minimum(smallest[:-wide], smallest[wide:])
        wide *= 2
    rest = width - wide
    smallest = np.minimum(smallest[: len(smallest) - rest], smallest[rest:])
    return (smallest & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def segments(
    symbols: np.ndarray, lengths: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, ...]:
    """(sequence, anchor hash, segment hash, first window, windows, lead) of all segments.

    `symbols` holds sequences of the given `lengths` one after the other. The anchor
    hash is that of the `gram` symbols `lead` after the first window's start, the segment hash that of all symbols of its windows and of the
    lead. Sequences shorter than `window` have none. Work goes in blocks; a segment
    that crosses a block ends there and goes on as another one.
    """
    if window - gram >= 512:
        raise ValueError("a segment may have 512 windows at most, see pack")
    ends = np.cumsum(lengths)
    parts = []
    for start in range(0, max(len(symbols) - window + 1, 0), BLOCK):
        piece = symbols[start : start + BLOCK + window - 1]
        rolling = Rolling(piece)
        grams = rolling.windows(gram)
        anchors = _sliding_argmin(grams, window - gram + 1)
        stop = start + len(anchors)
        some = np.arange(*np.searchsorted(ends, [start, stop - 1], "right") + [0, 1])
        own_starts = np.maximum(ends[some] - lengths[some], start)
        owner = np.repeat(some, np.minimum(ends[some], stop) - own_starts)
        inside = np.flatnonzero(np.arange(start + window, stop + window) <= ends[owner])
        if not len(inside):
            continue
        anchors, owner = anchors[inside], owner[inside]
        breaks = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(np.concatenate([[True], breaks]))
        count = np.diff(np.concatenate([head, [len(anchors)]]))
        first, place, owner = inside[head], anchors[head], owner[head]
        lead = place - first
        spans = rolling.spans(first, first + count + window - 1)
        whole = mixed(spans ^ mixed(lead.astype(np.uint64) + np.uint64(1)))
        begin = (ends - lengths)[owner]
        parts.append((owner, grams[place], whole, first + start - begin, count, lead))
    if not parts:
        none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, hashes, hashes, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack(first: np.ndarray, count: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """First window (32 bits), windows - 1 and lead (9 bits each)."""
    return first << 18 | (count - 1) << 9 | lead


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and windows - 1."""
    return packed >> 18, packed >> 9 & 511
