"""Rolling hashes over one text at a time, in whole-array steps: words, windows, and the anchors that stand for windows.

The anchor of a window is its part of fixed length with the smallest hash, leftmost on ties. Equal windows have equal anchors at
equal offsets, neighbouring windows mostly share one, and every window has one: counting anchors prunes windows without loss."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Low bits of an anchor's key that hold its place; longer texts are refused rather than searched wrongly.
_PLACE = 28
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i up to n at least, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``span`` takes the hash of any stretch of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch [start, stop)."""
    return mix((sums[stop] - sums[start]) * powers(_INVERSE, len(sums))[start] + (stop - start).astype(np.uint64))


def byte_sums(raw: bytes) -> np.ndarray:
    return prefix(_BYTES[np.frombuffer(raw, np.uint8)])


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of ``raw``."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = SPACES[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_sums(raw: bytes) -> tuple[np.ndarray, int]:
    """Running sums over the word hashes of ``raw``, and the number of words."""
    start, stop = word_bounds(raw)
    return prefix(span(byte_sums(raw), start, stop)), len(start)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values: running minima within blocks, forwards and backwards."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(sums: np.ndarray, n: int, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of ``window`` units among ``n``: places of the anchors (parts of ``part`` units), their hashes, and
    the first and last window start each stands for. The starts of all anchors together are 0 to n - window, each once."""
    if n < window:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    if n >> _PLACE:
        raise ValueError(f"a text of {n} units is longer than {1 << _PLACE}")
    at = np.arange(n - part + 1)
    hashes = span(sums, at, at + part)
    keys = hashes >> _U(_PLACE) << _U(_PLACE) | at.astype(np.uint64)
    place = (sliding_min(keys, window - part + 1) & _U((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return place[first], hashes[place[first]], first, last


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the closed ranges [first, last], in order."""
    sizes = last - first + 1
    return np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)
