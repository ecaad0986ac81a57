"""Hashes of the words of many texts at once: of lines, of shingles and of seeds."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash

#: Words of a shingle and of a seed; consecutive seeds of which the least is taken.
SHINGLE, SEED, CHOICE = 5, 16, 20


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed) | 1 for k in range(n)], np.uint64)


PLACE, LEVEL = odd_numbers(1, SHINGLE), odd_numbers(4, 8)
GOLDEN, NEVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def counted(sizes: np.ndarray) -> np.ndarray:
    """0 ... n - 1 for each size n, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Words:
    """Texts one after another. hashes: of each word; texts, lines: words of each text and of each line with a word; of: the text of each line."""

    hashes: np.ndarray
    texts: np.ndarray
    lines: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, texts: list[bytes]) -> Words:
        """A-Z are lower-cased; white space is the six ASCII characters."""
        split = [[w for line in t.lower().split(b"\n") if (w := line.split())] for t in texts]
        flat = list(chain.from_iterable(split))
        lines = np.fromiter(map(len, flat), np.int64, len(flat))
        n = int(lines.sum())
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(flat)), np.uint64, n)
        of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        return cls(hashes, np.bincount(of, lines, len(texts)).astype(np.int64), lines, of)

    def line_ids(self) -> np.ndarray:
        """A signed 64-bit identity of each line, equal for equal words in equal order."""
        if not len(self.lines):
            return np.empty(0, np.int64)
        placed = mixed(self.hashes + counted(self.lines).astype(np.uint64) * GOLDEN)
        return mixed(np.add.reduceat(placed, np.cumsum(self.lines) - self.lines)).view(np.int64)

    def shingles(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of some lines, of SHINGLE words at least, and how many each has."""
        sizes = self.lines[lines] - SHINGLE + 1
        at = np.repeat((np.cumsum(self.lines) - self.lines)[lines], sizes) + counted(sizes)
        sums = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            sums += self.hashes[at + k] * PLACE[k]
        return mixed(sums), sizes

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text, the place (in words) and the hash of each seed that is taken.

        Of each CHOICE consecutive seeds of a text the least is taken, the first of
        equal ones (of a text with fewer, the least). So two texts that share
        SEED + CHOICE - 1 words in a row share a seed that is taken in both. Seeds that
        equal one of the next four (the same few words over and over) are never taken.
        Of equal seeds taken one after another those that overlap the last one are left out.
        """
        some = np.flatnonzero(self.texts >= SEED)
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        h = self.hashes
        for k, step in enumerate((1, 2, 4, 8)):  # hashes of 2, 4, 8 and 16 words
            h = mixed(h[:-step] * LEVEL[2 * k] + h[step:] * LEVEL[2 * k + 1])
        n = self.texts[some] - SEED + 1
        # Each text's seeds, then CHOICE - 1 places that are never the least.
        begins = np.cumsum(n + CHOICE - 1) - (n + CHOICE - 1)
        to = np.repeat(begins, n) + counted(n)
        own = np.zeros(int((n + CHOICE - 1).sum()), np.uint64)
        own[to] = h[np.repeat((np.cumsum(self.texts) - self.texts)[some], n) + counted(n)]
        low = np.full(len(own), NEVER)
        low[to] = (own[to] & np.uint64(0xFFFFFFFF00000000)) | to.astype(np.uint64)
        for step in range(1, 5):
            low[:-step][own[:-step] == own[step:]] = NEVER
        have = 1
        while have < CHOICE:
            step = min(have, CHOICE - have)
            low, have = np.minimum(low[:-step], low[step:]), have + step
        first = np.maximum(n - CHOICE + 1, 1)
        least = np.unique(low[np.repeat(begins, first) + counted(first)])
        taken = np.sort((least[least != NEVER] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        of = np.searchsorted(begins, taken, "right") - 1
        value = own[taken]
        stay, last = np.ones(len(taken), bool), -1
        for k in (np.flatnonzero((value[1:] == value[:-1]) & (of[1:] == of[:-1])) + 1).tolist():
            last = taken[k - 1] if stay[k - 1] else last
            stay[k] = taken[k] - last >= SEED
        return some[of[stay]], (taken - begins[of])[stay], value[stay].view(np.int64)
