"""Splitting texts into pretokens and keeping the ids of those seen, for byte-level BPE vocabularies.

The split is that of the public pattern of these vocabularies (contractions, letters, numbers, other
signs, each with an optional space before, and white space), done on arrays of code points for a whole
batch at once.  A batch's distinct pretokens are found by hash; only those not met before are encoded.  Two
different pretokens pass for one with a chance of about 1 in 10**19 a pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from vantage.llm.arrays import mix, powers

#: The pattern whose matches ``split`` finds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SIGN, SPACE = range(4)
_POINT = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, SIGN, np.uint8)
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "￾" for i in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, starts of their pretokens (and the end), and the first pretoken of each text (and the end)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text_at = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    if n == 0:
        return points, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_at] = True  # a text begins here (and at the end of all)
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= first
    start = change.copy()
    # White space before something else of the same text gives up its last character.
    space = kind == SPACE
    last = np.zeros(n + 1, bool)
    last[:n] = space & change[1:] & ~first[1:]
    plain = np.zeros(n + 1, bool)
    plain[:n] = points == 0x20
    joins = last & plain  # that character goes with what follows
    start |= last
    after = np.zeros(n + 1, bool)
    after[1:] = joins[:-1]
    start &= ~after
    # A single quote that stands alone and opens a pretoken takes its contraction along.
    quote = np.flatnonzero((points == 0x27) & start[:n] & start[1:])
    if len(quote):
        ends_at = np.searchsorted(text_at, quote, side="right")
        room = text_at[np.minimum(ends_at, len(text_at) - 1)] - quote - 1
        a = points[np.minimum(quote + 1, n - 1)]
        b = points[np.minimum(quote + 2, n - 1)]
        two = (room >= 2) & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        one = (room >= 1) & np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        for where, k in ((quote[one], 1), (quote[two], 2)):
            start[where + 1] = False
            start[where + 1 + k] = True
    starts = np.flatnonzero(start)
    return points, starts, np.searchsorted(starts, text_at)


def split_at_spaces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``split``, into runs of spaces with what follows up to the next space."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text_at = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    start = np.zeros(len(points) + 1, bool)
    space = points == 0x20
    start[1:-1] = space[1:] & ~space[:-1]
    start[text_at] = True
    starts = np.flatnonzero(start)
    return points, starts, np.searchsorted(starts, text_at)


def hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each pretoken."""
    if len(starts) < 2:
        return np.zeros(0, np.uint64)
    size = np.diff(starts)
    at = np.arange(len(points)) - np.repeat(starts[:-1], size)
    return mix(np.add.reduceat(_POINT[points] * powers(int(size.max()))[at], starts[:-1]) + size.astype(np.uint64))


class Ids:
    """Ids of the pretokens met so far, as flat arrays; ``encode`` gives the ids of a list of new pretokens, ``kind`` holds the largest, ``cut`` splits."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 3_000_000, kind: type = np.uint16, cut: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]] = split) -> None:
        self.encode, self.most, self.kind, self.cut = encode, most, kind, cut
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.kind)
        self.used = 0

    def _add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        count = np.array([len(f) for f in found], np.int32)
        flat = np.fromiter((i for f in found for i in f), self.kind, int(count.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used // 2, 1 << 16), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(count) - count
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = (np.insert(x, where, y) for x, y in ((self.keys, keys), (self.at, at), (self.count, count)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the first of each text (and the end)."""
        points, starts, text_first = self.cut(texts)
        keys = hashes(points, starts)
        distinct, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > self.most or self.used > 8 * self.most:
            self.clear()
        where = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            # Sliced out of one decoded string: a pretoken of code points a..b is characters a..b of it.
            whole = points.tobytes().decode("utf-32-le", "surrogatepass")
            words = [whole[a:b] for a, b in zip(starts[example[new]].tolist(), starts[example[new] + 1].tolist(), strict=True)]
            self._add(distinct[new], self.encode(words))
        where = np.searchsorted(self.keys, distinct)
        at, count = self.at[where][inverse], self.count[where][inverse].astype(np.int64)
        edge = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(at - edge[:-1], count) + np.arange(edge[-1])]
        return ids, edge[text_first]
