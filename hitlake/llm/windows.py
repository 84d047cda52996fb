"""Content-chosen anchors: how the window operators (2 and 6) look at every window cheaply.

Each window of ``window`` tokens holds ``window - gram + 1`` grams; its anchor is the
gram with the smallest hash (leftmost on ties). Equal windows choose the same
anchor at the same place, wherever they stand, so windows need only be compared
under their anchor's hash. Neighbouring windows mostly share an anchor, so a run
of windows [lo, hi] with one anchor is one row. A run's hull is all tokens its
windows cover; runs with equal hulls hold equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C55)
_Q = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
#: Tokens looked at together; positions inside must fit _BITS bits.
BUFFER, _BITS = 1 << 20, 22
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit."""
    x = np.array(x, "u8", ndmin=1) if np.ndim(x) == 0 else x
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n + 1 of each."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, BUFFER + 1)
        up, down = np.full(size, _P), np.full(size, _Q)
        up[0] = down[0] = 1
        _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0]


class Prefix:
    """Hashes of any range of a token-hash array, in constant time each."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, "u8")
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype("u8"))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values: place of its smallest, leftmost on ties of the upper bits."""
    n = len(values)
    key = (values >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(n, dtype="u8")
    pad = np.full(-n % w + w, np.iinfo("u8").max, "u8")
    rows = np.concatenate([key, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64((1 << _BITS) - 1)).astype("i8")


@dataclass
class Runs:
    """Runs of one buffer; places are inside the buffer, ``base`` takes them to the document."""

    doc: np.ndarray
    base: np.ndarray
    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    hull: np.ndarray
    prefix: Prefix


def runs(tokens: np.ndarray, owner: np.ndarray, base: np.ndarray, ends: np.ndarray, window: int, gram: int) -> Runs | None:
    """Runs of a buffer of pieces: owner/base/ends are per piece, ends the piece's end in the buffer."""
    n = len(tokens)
    if n < window:
        return None
    prefix = Prefix(tokens)
    grams = prefix.grams(gram)
    at = sliding_argmin(grams, window - gram + 1)
    starts = np.arange(len(at))
    piece = np.searchsorted(ends, starts, side="right")
    valid = starts + window <= ends[piece]
    i = starts[valid]
    if not len(i):
        return None
    a, p = at[i], piece[i]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1) | (p[1:] != p[:-1])])
    lo = i[first]
    hi = i[np.concatenate([first[1:], [True]])]
    a, p = a[first], p[first]
    hull = mix(prefix.of(lo, hi + window) + (a - lo).astype("u8"))
    return Runs(owner[p], base[p], a, lo, hi, grams[a], hull, prefix)


def buffers(docs: list[np.ndarray], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pack documents' token hashes in buffers (tokens, owner, base, ends); long ones in overlapping pieces."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def out():
        return (
            np.concatenate([x[2] for x in held]), np.array([x[0] for x in held]), np.array([x[1] for x in held]) - np.cumsum([0, *[len(x[2]) for x in held]])[:-1],
            np.cumsum([len(x[2]) for x in held]),
        )

    for d, t in enumerate(docs):
        if len(t) < window:
            continue
        step = BUFFER - window + 1
        for at in range(0, max(1, len(t) - window + 1), step):
            piece = t[at : at + BUFFER]
            if size and size + len(piece) > BUFFER:
                yield out()
                held, size = [], 0
            held.append((d, at, piece))
            size += len(piece)
    if held:
        yield out()


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes: what bytes.split() gives."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype("i1"))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    b = np.frombuffer(raw, "u1")
    s, e = word_bounds(b)
    out, base = np.empty(len(s), "u8"), 0
    while base < len(s):  # pieces that end with a whole word
        stop = max(np.searchsorted(e, s[base] + BUFFER, side="right"), base + 1)
        lo, hi = s[base], e[stop - 1]
        out[base:stop] = Prefix(BYTE_HASH[b[lo:hi]]).of(s[base:stop] - lo, e[base:stop] - lo)
        base = int(stop)
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n tokens lie in a span [start, end)."""
    edge = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(end, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0
