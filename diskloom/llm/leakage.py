"""Evaluation passages inside training texts: winnowed fingerprints, then extension of the hits.

Words are compared, so case, spacing, markup and punctuation don't matter. A
passage counts if at least ``PASSAGE`` words of an item occur in order with at
most one edit (word changed, missing or added) per ``EDIT_EVERY`` words.

Such a passage always holds ``RUN`` equal words in a row: n words with e edits
leave n - e words in at most e + 1 runs, and (n - n // 6) / (n // 6 + 1) > 3 for
n >= 12. Winnowing keeps the smallest hash of ``GRAM`` words in each window of
``WINDOW`` grams, which covers GRAM + WINDOW - 1 = RUN words, so every run
shares a kept fingerprint. It is enough to test spans of 12 words with two edits
and of 18 with three: a longer span that keeps the rate has a part that does.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PASSAGE, EDIT_EVERY = 12, 6
RUN, GRAM, WINDOW = 4, 3, 2
#: Spans tested around a run, with their edits.
SPANS = ((PASSAGE, PASSAGE // EDIT_EVERY), (PASSAGE + EDIT_EVERY, PASSAGE // EDIT_EVERY + 1))
#: Evaluation text sent to the workers at once, in characters; more text goes in further blocks, each with its own pass.
BLOCK_CHARS = 16_000_000

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def words(text: str | None) -> list[str]:
    """Words of a text without markup, in compatibility form and lower case."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
    return _WORD.findall(text.casefold())


def _hash(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each GRAM of word ids, and whether all its words are known."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            part = ids[k:k + n]
            ok &= part >= 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h, ok


def winnow(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept: the least hash of every window of WINDOW grams whose words are all known."""
    h, ok = _hash(ids)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    both = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    full = np.lib.stride_tricks.sliding_window_view(ok, WINDOW).all(axis=1)
    at = np.unique((np.arange(n) + both.argmin(axis=1))[full])
    return at, h[at]


def near(pattern: list, text: list, edits: int) -> bool:
    """Whether ``pattern`` occurs anywhere in ``text`` within ``edits`` changed, missing or added words (bit-parallel)."""
    where: dict = {}
    for k, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << k
    last = 1 << len(pattern) - 1
    state = [(1 << j) - 1 for j in range(edits + 1)]
    if state[edits] & last:
        return True
    for w in text:
        mask = where.get(w, 0)
        old, before = state[0], 0
        state[0] = now = (old << 1 | 1) & mask
        for j in range(1, edits + 1):
            before, old = old, state[j]
            state[j] = now = (old << 1 | 1) & mask | before | (before | now) << 1 | 1
        if now & last:
            return True
    return False


class Index:
    """Winnowed fingerprints of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.keys, parts, owner, place = [k for k, _ in items], [], [], []
        self.items = []
        for n, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int64)
            self.items.append(ids)
            at, h = winnow(ids)
            parts.append(h)
            owner.append(np.full(len(at), n))
            place.append(at)
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if parts else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if parts else np.zeros(0, np.int64)

    def found(self, text: str | None) -> set[int]:
        """Keys of the items that leaked into a text."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], dtype=np.int64)
        at, h = winnow(ids)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        many = hi - lo
        if not many.any():
            return set()
        d = np.repeat(at, many)
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        result: set[int] = set()
        seen: set[tuple[int, int, int]] = set()
        size = len(ids)
        for p, n, q in zip(d.tolist(), self.owner[entry].tolist(), self.place[entry].tolist(), strict=True):
            if n in result:
                continue
            item = self.items[n]
            while p > 0 and q > 0 and ids[p - 1] == item[q - 1]:
                p, q = p - 1, q - 1
            if (p, n, q) in seen:
                continue
            seen.add((p, n, q))
            run = GRAM
            while p + run < size and q + run < len(item) and ids[p + run] == item[q + run]:
                run += 1
            if run >= PASSAGE:
                result.add(n)
            elif run >= RUN and self._spans(ids, item, p, q, run):
                result.add(n)
        return {self.keys[n] for n in result}

    @staticmethod
    def _spans(ids: np.ndarray, item: np.ndarray, p: int, q: int, run: int) -> bool:
        """Whether a span that holds the run at item word ``q`` and text word ``p`` occurs near there."""
        for length, edits in SPANS:
            first, last = max(0, q + run - length), min(q, len(item) - length)
            if first > last:
                continue
            part = item[first:last + length].tolist()
            lo = max(0, p - (length - run) - edits)
            doc = ids[lo:p + length + edits].tolist()
            there = set(doc)
            hit = [w in there for w in part]
            inside = sum(hit[:length])
            for k in range(last - first + 1):
                if k:
                    inside += hit[k + length - 1] - hit[k - 1]
                if inside >= length - edits and near(part[k:k + length], doc, edits):
                    return True
        return False


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver."""
    block, held = [], 0
    for k, t in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).distinct().orderBy(key, text).toLocalIterator():
        if block and held + len(t) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((k, t))
        held += len(t)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``item_key``, ``doc_key`` of each document with a passage of an item.

    Null, empty and short texts (under PASSAGE words) neither leak nor hold a
    leak; null keys are left out; repeated rows change nothing; without items or
    documents the result is empty. Whole documents are read, in one pass without
    a shuffle of texts for each block of items.
    """
    spark = docs.sparkSession
    kinds = f"{item_key} {items.schema[item_key].dataType.simpleString()}, {doc_key} {docs.schema[doc_key].dataType.simpleString()}"
    read = docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    result = spark.createDataFrame([], kinds)
    for n, block in enumerate(blocks(items, item_key, text)):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for frame in frames:
                pairs = [(i, k) for k, t in zip(frame["k"].tolist(), frame["t"].tolist(), strict=True) for i in index.found(t)]
                yield pd.DataFrame({item_key: [i for i, _ in pairs], doc_key: [k for _, k in pairs]})

        part = read.mapInPandas(run, kinds)
        result = part if n == 0 else result.unionByName(part)
    return result.distinct()
