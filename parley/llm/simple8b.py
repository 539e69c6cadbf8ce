"""Simple-8b: varying counts of unsigned integers in 64-bit words.

The top 4 bits of a word are its selector; the other 60 hold as many values as the selector says, the first in the lowest
bits. Selector 15 is the escape: one value of up to 60 bits as it is. A block is an array of words; ``offsets`` gives the
number of values before each word, so that any word can be decoded without those before it, and all words of a selector
are decoded at once. A word at the end of a block may have room left: the block states its count of values.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) by selector; the last is the escape.
SHAPES = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)
)
ESCAPE = 15
COUNTS = np.array([n for n, _ in SHAPES] + [0, 1], np.int64)


def _all_in_window(good: np.ndarray, n: int) -> np.ndarray:
    """Whether each place and the n - 1 after it are good; what lies beyond the end is."""
    padded = np.concatenate((good, np.ones(n, bool)))
    width = 1
    while width < n:
        step = min(width, n - width)
        np.logical_and(padded[:-step], padded[step:], out=padded[:-step])
        width += step
    return padded[: len(good)]


def _reached(step: np.ndarray, doublings: int = 4) -> np.ndarray:
    """The places from 0 on by steps from place to place. One in 2^doublings is found in a loop, those between them all at once."""
    n = len(step)
    hops = [np.minimum(np.arange(n + 1) + np.append(step, 0), n)]
    for _ in range(doublings):
        hops.append(hops[-1][hops[-1]])
    far, found, at = hops[-1].item, [], 0
    while at < n:
        found.append(at)
        at = far(at)
    out = np.array(found, np.int64)
    for hop in reversed(hops[:-1]):
        out = np.stack((out, hop[out]), axis=1).ravel()
    return out[out < n]


def pack(values: np.ndarray) -> np.ndarray:
    """The words of a block. Greedy: each word takes the longest run that fits."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    if int(values.max()) >> 60:
        raise ValueError("a value needs more than 60 bits")
    choice = np.full(n, ESCAPE, np.uint8)
    # ids are short: half the bytes are read where all values allow it
    short = values.astype(np.uint32) if not int(values.max()) >> 32 else values
    for selector in range(len(SHAPES) - 2, -1, -1):
        count, bits = SHAPES[selector]
        fits = short <= short.dtype.type(min((1 << bits) - 1, np.iinfo(short.dtype).max))
        if fits.any():
            np.putmask(choice, _all_in_window(fits, count), selector)
    starts = _reached(COUNTS[choice])
    chosen = choice[starts]
    padded = np.concatenate((values, np.zeros(60, np.uint64)))
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        count, bits = SHAPES[selector] if selector != ESCAPE else (1, 60)
        first = starts[mine]
        held = padded[first]
        for k in range(1, count):
            held |= padded[first + k] << np.uint64(k * bits)
        words[mine] |= held
    return words


def offsets(words: np.ndarray) -> np.ndarray:
    """The number of values before each word."""
    counts = COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    return np.concatenate(([0], np.cumsum(counts)[:-1])) if len(words) else np.zeros(0, np.int64)


def unpack(words: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
    """The first n values of a block, all words of a selector at once."""
    before = offsets(words) if before is None else before
    out = np.zeros(n + 60, np.uint64)
    chosen = words >> np.uint64(60)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        count, bits = SHAPES[int(selector)] if selector != ESCAPE else (1, 60)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[before[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    return out[:n]
