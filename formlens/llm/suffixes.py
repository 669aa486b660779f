"""Suffix arrays in numpy: refinement by ranks, common prefixes, and fingerprints of windows."""

from __future__ import annotations

import functools

import numpy as np

#: No UTF-8 text holds this byte; it stands between the strings of a suffix array.
BORDER = 0xFF
#: Positions that one lane of the common-prefix pass goes over.
LANE = 512
GRAM = 64
#: Grams of words, where windows are of words.
WORD_GRAM = 8
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


#: Bytes that are hashed at once; the powers of a base are kept for as many.
BLOCK = 1 << 17


@functools.lru_cache(2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(BLOCK, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def window_hashes(data: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each width bytes of data, by differences of running sums over blocks."""
    n = len(data) - width + 1
    up, down = _powers(base)
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, BLOCK - width + 1):
        block = data[a : a + BLOCK]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block + np.uint64(1)) * up[: len(block)], out=sums[1:])
        out[a : a + len(block) - width + 1] = mixed((sums[width:] - sums[:-width]) * down[: len(block) - width + 1])
    return out


def _slid(values: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each width values in a row."""
    n = len(values) - width + 1
    rows = np.full(-(-len(values) // width) * width, fill, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the gram bytes, or other values, that hash least among those of some window; equal windows have equal anchors, and each has one."""
    if len(data) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes, width = window_hashes(data, gram), window - gram + 1
    least = _slid(hashes, width, np.minimum, 2**64 - 1)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_slid(padded, width, np.maximum, 0) == hashes)
    return at, hashes[at]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of data in the order of their first depth bytes at least.

    Sorted by 8 bytes first; groups of equal suffixes are then refined by the rank of
    the suffix that follows, over twice the length each time. Suffixes that stand alone
    in their group drop out.
    """
    n = len(data)
    padded = np.concatenate([data, np.full(8, BORDER, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= padded[j : j + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0))), n
    single = fresh & np.concatenate([fresh[1:], [True]])
    slots, length = np.flatnonzero(~single), 8
    while length < depth and len(slots):
        at = order[slots]
        key = rank[at].astype(np.int64) << 32 | rank[np.minimum(at + length, n)]
        within = np.argsort(key)
        at, key = at[within], key[within]
        order[slots] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)).astype(np.int32)
        single = fresh & np.concatenate([fresh[1:], [True]])
        slots, length = slots[~single], length * 2
    at = order[slots]  # equal over that depth: in text order, so that common_prefixes() seldom starts anew
    order[slots] = at[np.argsort(rank[at].astype(np.int64) << 32 | at)]
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in order (or -1), and their common prefix, most at most.

    Kasai's pass in text order: what follows a suffix shares one byte less at least.
    Suffixes that share most bytes may be out of order beyond them; there this holds
    only while both neighbours move on together, and else the count starts anew. The
    text is cut into lanes that are gone over side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int16)
    padded = np.concatenate([data, np.full(most + 1, BORDER, np.uint8)])
    at = np.arange(0, n, LANE)
    ends = np.minimum(at + LANE, n)
    held = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        longer = (other >= 0) & (held < most)
        longer &= padded[at + held] == padded[other + held]
        longer &= padded[at + held] != BORDER
        held[longer] += 1
        done = np.flatnonzero(~longer)
        here = at[done]
        common[here] = held[done]
        at[done] += 1
        together = before[np.minimum(here + 1, n - 1)] == before[here] + 1
        held[done] = np.where((held[done] < most) | together, np.maximum(held[done] - 1, 0), 0)
        if len(done):
            left = at < ends
            if not left.all():
                at, ends, held = at[left], ends[left], held[left]
    return before, common


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text."""
    starts, ends = runs(~SPACE[data])
    up = np.full(len(data), BASES[0], np.uint64)
    down = np.full(len(data), pow(BASES[0], -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * np.multiply.accumulate(up), out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * np.multiply.accumulate(down)[starts])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
