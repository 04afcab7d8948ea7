"""Array helpers for byte and character n-grams inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np


class KeyIndex:
    """Positions of 64-bit keys by open addressing; built once, then only looked up."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.zeros(1 << bits, np.uint64)  # key + 1
        self.where = np.full(1 << bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(left):
            at = (home[left] + step) & self.mask
            free = np.flatnonzero(self.slots[at] == 0)
            _, winner = np.unique(at[free], return_index=True)
            won = free[winner]
            self.slots[at[won]] = keys[left[won]] + np.uint64(1)
            self.where[at[won]] = left[won]
            left, step = np.delete(left, won), step + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the keys given at the start, or -1."""
        at, want = self._home(keys), keys + np.uint64(1)
        seen = self.slots[at]
        out = np.where(seen == want, self.where[at], -1)
        left = np.flatnonzero((seen != want) & (seen != 0))
        while len(left):
            nxt = (at[left] + 1) & self.mask
            at[left] = nxt
            seen = self.slots[nxt]
            hit = seen == want[left]
            out[left[hit]] = self.where[nxt[hit]]
            left = left[~hit & (seen != 0)]
        return out


def packed(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes up to and including every position from ``size - 1`` on, the newest in the lowest byte."""
    n = len(data) - size + 1
    out = data[size - 1:size - 1 + n].astype(np.uint64)
    for back in range(1, size):
        out |= data[size - 1 - back:size - 1 - back + n].astype(np.uint64) << np.uint64(8 * back)
    return out


def low_bytes(keys: np.ndarray, size: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * size)) - 1)


def portions(texts: Iterator[bytes], context: int, pad: bytes, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, positions, owners): texts laid one after another, each led by ``context`` bytes, in bounded pieces.

    ``positions`` are the places of real text bytes counted from ``context``; ``owners`` says whose they are. A long
    text is cut; its next part is led by the bytes before it.
    """
    parts, places, owners, size = [], [], [], 0
    for owner, text in enumerate(texts):
        at = 0
        while at < len(text):
            take = text[at:at + max(limit - size, 1)]
            lead = (pad + text[max(0, at - context):at])[-context:] if context else b""
            parts += [lead, take]
            places.append(np.arange(size, size + len(take)))
            owners.append(np.full(len(take), owner))
            size += len(take) + len(lead)
            at += len(take)
            if size >= limit:
                yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate(places), np.concatenate(owners)
                parts, places, owners, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate(places), np.concatenate(owners)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


def word_hashes(limit: int = 1 << 18) -> Callable[[list[bytes]], np.ndarray]:
    """A function from words to their 64-bit hashes that remembers up to about ``limit`` words."""
    known = _Words()

    def get(words: list[bytes]) -> np.ndarray:
        if len(known) > limit:
            known.clear()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return get


def mixed(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the hashes of the words; runs of different sizes differ too."""
    n = len(words) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for at in range(size if n > 0 else 0):
        out = (out ^ words[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)
