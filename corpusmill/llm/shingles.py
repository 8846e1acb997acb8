"""Words and word shingles of texts as 64-bit numbers, for whole batches of texts at once."""

from __future__ import annotations

import re
import unicodedata
from math import ceil

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
MARKS = re.compile("[̀-ͯ҃-҉֑-ֽً-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
KEPT_WORDS = 1 << 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
        return WORD.findall(text.casefold())
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word to 64-bit number; forgets all when it holds too many."""

    def __missing__(self, w: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def token_batch(texts, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts one after another, offsets); null texts have no words."""
    out, n = [], [0]
    get = ids.__getitem__
    for t in texts:
        ws = words(t) if t else []
        out.append(np.fromiter(map(get, ws), np.uint64, len(ws)))
        n.append(len(ws))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(n)


def shingles_at(tokens: np.ndarray, k: int) -> np.ndarray:
    """The shingle that begins at each word but the last k - 1."""
    n = max(len(tokens) - k + 1, 0)
    with np.errstate(over="ignore"):
        h = np.full(n, M1, np.uint64)
        for j in range(k):
            h = mix(h * M1 + tokens[j : j + n])
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x in order."""
    s = np.sort(x)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def shingle_batch(tokens: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted set of k-word shingles of each text; a text of fewer words has one shingle, all of it, and a text without words none."""
    with np.errstate(over="ignore"):
        h = shingles_at(tokens, k)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(distinct(h[a : b - k + 1]))
            elif b > a:
                x = np.full(1, M2, np.uint64)
                for t in tokens[a:b]:
                    x = mix(x * M1 + t)
                out.append(x)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def least_overlap(na, nb, similarity: float):
    """The fewest shared shingles of sets of sizes na and nb with at least this Jaccard similarity."""
    return np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9)


def prefix_length(n: int, similarity: float) -> int:
    """How many of n shingles, first in an order that all texts share, must hold one that a similar text has too."""
    return n - ceil(similarity * n - 1e-9) + 1


def set_id(s: np.ndarray) -> int:
    """A 128-bit number of a shingle set."""
    return xxhash.xxh3_128_intdigest(s.tobytes())
