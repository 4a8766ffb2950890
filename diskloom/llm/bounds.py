"""Which pairs of names can reach a similarity: upper bounds of ``names.similarity`` over whole arrays.

No bound is under the similarity of a pair, so what they leave out can't be
linked. Names that no bound covers (over LONGEST letters) are always left in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from . import names

#: Letters that have a bin of their own; all other characters share OTHER, which only raises a bound. Bin PAD has no letter.
LETTERS, OTHER, PAD, BINS = 26, 26, 27, 28
#: Letters of a core that a machine word has bits for.
LONGEST = 64
#: A likeness of exactly 0.95 by common subsequence needs a token of this length on both sides.
NEARLY_EQUAL = 19
#: Pairs looked at together.
AT_ONCE = 1 << 17

_VOWEL_BINS = [ord(c) - 97 for c in "aeiou"]
_NICK_BITS: dict[str, tuple[int, int]] = {}
for _k, (_short, _full) in enumerate(sorted(names._NICK)):
    for _word, _bits in ((_short, (1 << _k % 64, 0)), (_full, (0, 1 << _k % 64))):
        _had = _NICK_BITS.get(_word, (0, 0))
        _NICK_BITS[_word] = (_had[0] | _bits[0], _had[1] | _bits[1])


def _bit(text: str) -> int:
    """One of 64 bits, the same in every process."""
    h = 0
    for c in text:
        h = h * 31 + ord(c) & 0xFFFFFFFF
    return 1 << (h ^ h >> 15) % 64


@lru_cache(maxsize=1 << 16)
def marks(core: str) -> tuple[int, ...]:
    """What ``core_ratio`` looks at besides the letters of a core (tokens parted by spaces).

    Letters without initials, consonants without initials, tokens, 1 if it has
    initials, 1 if it has no vowel; then bits of initials, first letters,
    tokens without vowels, consonants of tokens, short and full given names; 1 for a long token.
    """
    tokens = core.split()
    longer = [t for t in tokens if len(t) > 1] or tokens
    size, solid = sum(map(len, longer)), sum(len(names.consonants(t)) for t in longer)
    initials = first = bare = bones = short = full = 0
    for t in tokens:
        first |= 1 << (ord(t[0]) & 63)
        if len(t) == 1:
            initials |= 1 << (ord(t) & 63)
        c = names.consonants(t)
        bones |= _bit(c)
        if c == t and len(t) > 1:
            bare |= _bit(t)
        if t in _NICK_BITS:
            short |= _NICK_BITS[t][0]
            full |= _NICK_BITS[t][1]
    return size, solid, len(tokens), int(len(longer) < len(tokens)), int(solid == size), initials, first, bare, bones, short, full, int(any(len(t) >= NEARLY_EQUAL for t in tokens))


class Cores:
    """The cores of some names as arrays, a row each."""

    def __init__(self, cores: list[str]):
        self.core = cores
        n = len(cores)
        m = np.array([marks(c) for c in cores], dtype=np.uint64).reshape(n, 12)
        self.size, self.solid, self.tokens = (m[:, k].astype(np.int32) for k in range(3))
        self.initialled, self.bare, self.long_token = (m[:, k].astype(bool) for k in (3, 4, 11))
        self.bits = m[:, 5:11]
        plain = [c.replace(" ", "") for c in cores]
        self.length = np.fromiter(map(len, plain), np.int32, n)
        self.long = self.length > LONGEST
        self.codes = self._coded([p[:LONGEST] for p in plain])
        kept = np.repeat(np.arange(n), np.minimum(self.length, LONGEST))
        self.counts = np.bincount(kept * BINS + self.codes[self.codes != PAD], minlength=n * BINS).reshape(n, BINS).astype(np.uint8)
        self.solid_counts = self.counts.copy()
        self.solid_counts[:, _VOWEL_BINS] = 0
        self._where: dict[bool, np.ndarray] = {}
        self._swapped: np.ndarray | None = None

    @staticmethod
    def _coded(texts: list[str]) -> np.ndarray:
        """The bins of the characters of each text, padded."""
        out = np.full((len(texts), LONGEST), PAD, np.uint8)
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), sizes)
        out[row, np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where((letters >= 97) & (letters < 97 + LETTERS), letters - 97, OTHER)
        return out

    @property
    def swapped(self) -> np.ndarray:
        """Codes of the cores of two tokens in the other order."""
        if self._swapped is None:
            self._swapped = self._coded(["".join(reversed(c.split()))[:LONGEST] for c in self.core])
        return self._swapped

    def where(self, swapped: bool) -> np.ndarray:
        """The places of each bin in a core, as bits."""
        if swapped not in self._where:
            codes = self.swapped if swapped else self.codes
            out = np.zeros((len(codes), BINS), np.uint64)
            rows = np.arange(len(codes))
            for k in range(int(min(self.length.max(initial=0), LONGEST))):
                out[rows, codes[:, k]] |= np.uint64(1 << k)
            out[:, PAD] = 0
            self._where[swapped] = out
        return self._where[swapped]

    def lcs(self, a: np.ndarray, b: np.ndarray, swap_a: bool = False, swap_b: bool = False) -> np.ndarray:
        """Longest common subsequences of the cores of rows ``a`` and ``b``, bit-parallel over all pairs."""
        where, codes = self.where(swap_a).reshape(-1), self.swapped if swap_b else self.codes
        s = np.full(len(a), ~np.uint64(0))
        base = a.astype(np.int64) * BINS
        for k in range(int(self.length[b].max(initial=0))):
            u = s & where[base + codes[b, k]]
            s = s + u | s - u
        own = np.uint64(64) - np.maximum(self.length[a], 1).astype(np.uint64)
        return np.bitwise_count(~s << own).astype(np.int32)

    def may_reach(self, a: np.ndarray, b: np.ndarray, core: float) -> np.ndarray:
        """Which pairs of rows can have a ``core_ratio`` of ``core`` or more."""
        need = (self.size[a] + self.size[b]) * (core / 2) - 1e-6
        bits = self.bits
        # Tokens that stand for others (initials, without vowels, given names) are made equal first; what comes of that isn't bounded.
        free = self.long[a] | self.long[b] | self.long_token[a] & self.long_token[b]
        for x, y in ((0, 1), (2, 3), (4, 5)):
            free |= (bits[a, x] & bits[b, y] | bits[b, x] & bits[a, y]) != 0
        free &= (self.tokens[a] > 1) & (self.tokens[b] > 1) | self.long[a] | self.long[b]
        bare = self.bare[a] | self.bare[b]
        # Letters in common, in any order.
        near = np.flatnonzero(~free & (np.minimum(self.length[a], self.length[b]) >= need))
        near = near[np.minimum(self.counts[a[near]], self.counts[b[near]]).sum(axis=1, dtype=np.int32) >= need[near]]
        # Letters in common in their order; tokens move as wholes, so for one or two of them all orders are tried.
        i, j = a[near], b[near]
        sure = self.initialled[i] | self.initialled[j] | (np.minimum(self.tokens[i], self.tokens[j]) > 1) & (np.maximum(self.tokens[i], self.tokens[j]) > 2)
        open_ = near[~sure]
        reach = [near[sure]]
        for swap_a, swap_b in ((False, False), (True, False), (False, True)):
            if swap_a or swap_b:
                open_ = open_[(self.tokens[a[open_]] == 2) & (self.tokens[b[open_]] == 2)]
            good = self.lcs(a[open_], b[open_], swap_a, swap_b) >= need[open_]
            reach.append(open_[good])
            open_ = open_[~good]
        out = free
        out[np.concatenate(reach)] = True
        # Without vowels the consonants are compared instead.
        solid = np.flatnonzero(bare & ~out)
        out[solid] = np.minimum(self.solid_counts[a[solid]], self.solid_counts[b[solid]]).sum(axis=1, dtype=np.int32) >= (self.solid[a[solid]] + self.solid[b[solid]]) * (core / 2) - 1e-6
        return out


def pairs_of(starts: np.ndarray, mine: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block, the first of them marked in ``mine`` and before the second; ``starts`` marks where blocks start. Some ``at_once``, a row's own together."""
    n = len(starts)
    begins = np.flatnonzero(starts)
    ends = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    rows = np.arange(n)
    later = np.where(mine, ends - rows - 1, 0)
    total = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_once, "right")))
        few = later[at:to]
        if few.sum():
            a = np.repeat(rows[at:to], few)
            yield a, np.arange(len(a)) - np.repeat(np.cumsum(few) - few, few) + a + 1
        at = to
