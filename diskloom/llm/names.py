"""Names as people type them: folding, parsing into parts, comparison by longest common subsequence."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

# Spellings that sound alike, digits used as letters, series numbers, words that carry no name.
SOUNDS = (("sch", "sh"), ("ph", "f"), ("ks", "x"), ("oo", "u"), ("ck", "k"), ("y", "i"), ("ce", "se"), ("ci", "si"), ("c", "k"), ("z", "s"))
LEET = str.maketrans("0134578", "oieastb")
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ABBREVIATIONS = {"ltd": "limited", "bros": "brothers", "labs": "laboratories", "prods": "productions", "intl": "international", "crw": "crew"}
NICKNAMES = {
    "alex": "alexander", "al": "alexander", "sandy": "alexander", "tony": "anthony", "chuck": "charles", "charlie": "charles", "ed": "edward", "ted": "edward", "ned": "edward", "eddie": "edward",
    "beth": "elizabeth", "betty": "elizabeth", "jim": "james", "jack": "john", "kate": "katherine", "kathy": "katherine", "peggy": "margaret", "maggie": "margaret", "mike": "michael", "mick": "michael",
    "pat": "patricia", "patty": "patricia", "tricia": "patricia", "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "sue": "susan", "susie": "susan", "suzy": "susan",
    "tom": "thomas", "tommy": "thomas", "bill": "william", "will": "william", "billy": "william",
}
# Articles, conjunctions and torn-off marks of the genitive (o' and 's).
FILLERS = frozenset(("the", "of", "o", "and", "a", "an", "s"))

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?|&")
_CAMEL = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z])")


def base_letters(text: str) -> str:
    """Without diacritics and format characters."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))


@lru_cache(maxsize=1 << 16)
def fold(word: str) -> str:
    """A word by sound: alike spellings made equal, repeated letters once."""
    word = word.lower()
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(LEET)
    for a, b in SOUNDS:
        if a in word:
            word = word.replace(a, b)
    return "".join(c for k, c in enumerate(word) if k == 0 or c != word[k - 1])


@lru_cache(maxsize=1 << 17)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Longest-common-subsequence ratio, 1 for equal strings, 0 if one is empty."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


_VOWELS = str.maketrans("", "", "aeiou")


def consonants(word: str) -> str:
    return word.translate(_VOWELS)


@dataclass
class Name:
    """Parts of a typed name: series number, folded tokens with their abbreviation marks."""

    number: int
    tokens: list[str]
    short: list[bool] = field(default_factory=list)

    @property
    def joined(self) -> str:
        return "".join(self.tokens)


_GIVEN = frozenset(NICKNAMES.values())
_PARTS = re.compile(r"[:|()]| -|- ")


def _number(word: str, after: str, opens: bool, closes: bool) -> int | None:
    """The series number a word stands for; ``opens`` and ``closes``: a part of the name starts or ends with the word."""
    w = word.lower().rstrip(".")
    if w.isdigit():
        return int(w) if len(w) <= 2 and int(w) > 0 else None
    if word.endswith("."):
        return None
    r = w.replace("y", "i")
    if r in ROMAN and not (len(r) == 1 and after[:1].isdigit()):
        return ROMAN[r]
    n = NUMBER_WORDS.get(w)
    if n is None and closes and not opens:  # mistyped
        n = 2 if sorted(w) == ["o", "t", "w"] else next((k for x, k in NUMBER_WORDS.items() if min(len(x), len(w)) >= 4 and ratio(w, x) >= (0.8 if len(x) > 4 else 0.75)), None)
    counted = len(after) > 3 and after.lower().endswith("s") and after.lower() not in _GIVEN
    if n is not None and not closes and (opens or counted):
        return None  # a number word that starts a subtitle, or counts a plural, belongs to the name
    return n


def parse(text: str, series: bool) -> Name:
    """Folded tokens of a name without fillers; with ``series``, its number in a series (1 if it has none)."""
    text = base_letters(text)
    text = _CAMEL.sub(" ", text)
    found = list(_TOKEN.finditer(text))
    number, tokens, short = 1, [], []
    for k, m in enumerate(found):
        w = m.group()
        if series:
            after = found[k + 1] if k + 1 < len(found) else None
            opens = k == 0 or bool(_PARTS.search(text, found[k - 1].end(), m.start()))
            closes = after is None or bool(_PARTS.search(text, m.end(), after.start()))
            n = _number(w, after.group() if after else "", opens and k > 0, closes) if k or w.isdigit() or closes else None
            if n is not None:
                number = n
                continue
            if w.lower().rstrip(".") == "part":
                continue
        dotted = w.endswith(".")
        w = w.rstrip(".").replace("'", "").replace("’", "")
        low = w.lower()
        folded = fold(ABBREVIATIONS.get(low, low))
        if low in FILLERS or folded in FILLERS or low == "&" or not low:
            continue
        tokens.append(folded)
        short.append(dotted)
    if series and found and not tokens:  # a title that is a number
        return parse(text, False)
    return Name(number, tokens, short)


_NICK = {(fold(a), fold(b)) for a, b in NICKNAMES.items()}


_FULL_NAMES: dict[str, list[str]] = {}
for _short, _full in _NICK:
    _FULL_NAMES.setdefault(_short, []).append(_full)


def _letters(word: str) -> int:
    """The letters of a word as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


@lru_cache(maxsize=1 << 16)
def likeness(a: str, b: str, short_a: bool = False, short_b: bool = False) -> float:
    """How well two tokens match: equal, abbreviated, without vowels, or by common subsequence."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b, short_a, short_b = b, a, short_b, short_a
    if short_a and b.startswith(a):
        return 0.95
    if len(a) >= 2 and len(a) < len(b) and a == consonants(b) or (a, b) in _NICK:
        return 0.95
    return ratio(a, b)


#: A token is taken for a spelling of a common word from this likeness on.
COMMON_LIKE = 0.8
#: Weight of the distinctive part of a name; the common words have the rest.
CORE = 0.8


class Vocabulary:
    """Common words of a field; the rest of a name is its distinctive core."""

    def __init__(self, common: Iterable[str]):
        self.common = sorted(set(common))
        self.by_first: dict[str, list[str]] = {}
        for w in self.common:
            self.by_first.setdefault(w[:1], []).append(w)
        self.long = sorted((w for w in self.common if len(w) >= 5), key=len, reverse=True)
        self.letters = {w: _letters(w) for w in self.common}
        self.by_consonants = {consonants(w): w for w in self.common if len(consonants(w)) >= 2}
        self.known: dict[tuple[str, bool], str | None] = {}

    def word(self, token: str, short: bool) -> str | None:
        """The common word a token stands for, if any."""
        key = (token, short)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._word(token, short)
        return self.known[key]

    def _word(self, token: str, short: bool) -> str | None:
        if token in self.letters:
            return token
        if len(token) < 2:
            return None
        alike = self.by_consonants.get(token) or next((w for w in _FULL_NAMES.get(token, ()) if w in self.letters), None)
        if alike is None and (short or len(token) <= 4 and len(token) >= 3):
            alike = next((w for w in self.by_first.get(token[0], ()) if w.startswith(token)), None)
        if alike:
            return alike
        best, most, own, size = None, COMMON_LIKE, _letters(token), len(token)
        for w, theirs in self.letters.items():
            # A letter that only one of them has is lost to the common subsequence.
            if 2 * min(size - (own & ~theirs).bit_count(), len(w) - (theirs & ~own).bit_count()) < most * (size + len(w)) or len(w) <= 3 and token[0] != w[0]:
                continue
            s = ratio(token, w)
            if s > most or best is None and s == most:
                best, most = w, s
        return best

    def pieces(self, token: str) -> list[str]:
        """A token that runs words together, cut where a common word or filler starts or ends it."""
        if len(token) >= 8 and token not in self.by_first.get(token[:1], ()):
            for w in self.long:
                rest = token[len(w):] if token.startswith(w) else token[:-len(w)] if token.endswith(w) else ""
                if len(rest) >= 2:
                    return [w, *([] if rest in FILLERS else self.pieces(rest))]
            for w in ("the", "and", "of"):
                for rest in (token[len(w):] if token.startswith(w) else "", token[:-len(w)] if token.endswith(w) else ""):
                    if len(rest) >= 4 and self.word(rest, False):
                        return [rest]
        return [token]

    def stands_out(self, name: Name) -> list[str]:
        """The tokens to index a name by: its core, or all its tokens."""
        return [t for t in self.split(name)[0] if len(t) > 1] or name.tokens

    def split(self, name: Name) -> tuple[list[str], list[str]]:
        """(core tokens, common words) of a name; a name of common words only is all core."""
        core, common = [], []
        for t, s in zip(name.tokens, name.short, strict=True):
            if self.word(t, s):
                common.append(t)
                continue
            for piece in self.pieces(t):
                (common if piece != t and self.word(piece, False) else core).append(piece)
        return (core, common) if any(len(t) > 1 for t in core) else (name.tokens, [])


def ordered(a: list[str], b: list[str]) -> str:
    """Tokens of ``a`` joined in the order of their best matches in ``b``."""
    if len(a) < 2 or len(b) < 2:
        return "".join(a)
    place = [max(range(len(b)), key=lambda k, t=t: (likeness(t, b[k]), -k)) for t in a]
    return "".join(t for _, t in sorted(zip(place, a, strict=True), key=lambda x: x[0]))


def core_ratio(a: list[str], b: list[str]) -> float:
    """Common-subsequence ratio of two cores in matching order; abbreviations count as what they stand for; a core without vowels is compared with the other's consonants."""
    if not a or not b:
        return 0.0
    if len(a) != len(b):  # initials without a partner say nothing
        a, b = [t for t in a if len(t) > 1] or a, [t for t in b if len(t) > 1] or b
    if len(a) == len(b) and len(a) > 1:
        a, b = list(a), list(b)
        for k, t in enumerate(a):
            for j, u in enumerate(b):
                if t != u and (likeness(t, u) == 0.95 or 1 in (len(t), len(u)) and t[0] == u[0]):
                    if len(t) < len(u):
                        a[k] = u
                    else:
                        b[j] = t
                    break
    x, y, plain_a, plain_b = ordered(a, b), ordered(b, a), "".join(a), "".join(b)
    best = ratio(x, plain_b)
    if x != plain_a or y != plain_b:
        best = max(best, ratio(plain_a, y))
    cx, cy = consonants(x), consonants(plain_b)
    if min(len(cx), len(cy)) >= 4 and (cx == x or cy == plain_b):
        best = max(best, ratio(cx, cy))
    return best


def common_share(a: list[str], b: list[str]) -> float | None:
    """Share of the shorter list of common words that the longer one has too; None if one has none."""
    few, many = sorted((a, b), key=len)
    return sum(any(t == u or likeness(t, u) >= COMMON_LIKE or t.startswith(u) or u.startswith(t) for u in many) for t in few) / len(few) if few else None


def similarity(a: tuple[list[str], list[str]], b: tuple[list[str], list[str]], least: float = 0.0) -> float:
    """Similarity in [0, 1] of two split names: cores by common subsequence, common words by overlap of the shorter list; 0 if it can't reach ``least``."""
    shared = common_share(a[1], b[1])
    rest = (1 - CORE) * (1.0 if shared is None else shared)
    if CORE + rest < least - 1e-9:
        return 0.0
    return CORE * core_ratio(a[0], b[0]) + rest
