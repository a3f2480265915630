"""64-bit hashes of the words of many texts at once, and hashes of runs of words."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bytes that are hashed at once. A run of this many and more without a separator is hashed by XXH64.
CHUNK = 1 << 16

#: Separators: the blanks, and (for ASCII and what `plain` leaves) all but letters, digits and _.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MARKS = np.array([b < 0x80 and not (chr(b).isalnum() or b == 0x5F) for b in range(256)])


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte; in the second row capital letters have their small ones' numbers.
_BYTES = np.stack([multipliers(256, 500)] * 2)
_BYTES[1, 0x41:0x5B] = _BYTES[1, 0x61:0x7B]
#: A multiplier for each place in a word, independent of each other: powers of one base modulo 2**64 let words be built that collide.
_PLACES = multipliers(CHUNK, 501)
_powers: dict[int, np.ndarray] = {}


def ladder(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64, or more."""
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK), np.uint64(base))]), dtype=np.uint64)
    return _powers[base]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words(NamedTuple):
    """Hashes of all words of some texts, in order; the words of text k are first[k] to first[k + 1]."""

    hashes: np.ndarray
    first: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]


def hashed(texts: list[bytes], apart: np.ndarray = BLANKS, lower: bool = False) -> Words:
    """The words of texts, cut at the bytes that `apart` marks. lower: A-Z count as a-z.

    A word's hash is the sum of its bytes' numbers, each times the multiplier of its place in
    the word; sums from the chunk's start give it for all words of a chunk together.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    number = _BYTES[int(lower)]
    out, starts, at = [], [], 0
    while at < len(data):
        part = data[at : at + CHUNK]
        gap = apart[part]
        if len(part) == CHUNK:
            ends = np.nonzero(gap)[0]
            if not len(ends):  # one long word
                stop = at + CHUNK
                while stop < len(data) and not apart[data[stop : stop + CHUNK]].any():
                    stop = min(len(data), stop + CHUNK)
                if stop < len(data):
                    stop += int(apart[data[stop : stop + CHUNK]].argmax())
                import xxhash

                out.append(np.array([xxhash.xxh64_intdigest(data[at:stop].tobytes(), int(lower))], np.uint64))
                starts.append(np.array([at]))
                at = stop
                continue
            part, gap = part[: ends[-1] + 1], gap[: ends[-1] + 1]
        edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
        begin, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        nth = np.arange(len(part))
        nth -= np.maximum.accumulate(np.where(gap, nth + 1, 0))
        nth[gap] = 0
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(number[part] * _PLACES[nth], out=total[1:])
        out.append(mixed(total[end] - total[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + at)
        at += len(part)
    place = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)]) if texts else np.zeros(1, np.int64)
    return Words(np.concatenate(out) if out else np.zeros(0, np.uint64), np.searchsorted(place, bounds))


def run_hashes(h: np.ndarray, places: list[int], multiplier: np.ndarray, span: int) -> np.ndarray:
    """Of every run of `span` words, the hash of the words at `places`. The words' own hashes are spread already, so a sum will do."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for p in places:
        total += h[p : p + n] * multiplier[p]
    return mixed(total)


class WordHashes:
    """Hashes of words given one by one."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return hashed([b" ".join(words)]).hashes
