"""Abusive, hateful and sexual content: sentence scores joined by noisy-or, learnt from document labels.

Multiple-instance learning: a document is a bag of sentences, it is abusive if
at least one of them is, P(doc) = 1 - prod(1 - p(sentence)). Only documents are
labelled; the gradient of the bag's likelihood tells which sentences carry the
label, so scoring also locates the offending sentence.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.once import once_per_key

#: Labelled documents the model is fitted on; more are sampled down by hash of their key.
MAX_LABELLED = 12_000
#: Size of the hashed feature space (word parts in the first half, word pairs in the second).
SPACE = 1 << 19
HALF = SPACE // 2
#: Features seen in fewer labelled documents than this are left out.
LEAST_SEEN = 4
#: Steps and rate of the fit; the ridge is RIDGE over the root of the number of documents, so few labels bind the weights more.
STEPS, RATE, RIDGE = 120, 0.05, 0.1
#: A document is a case from this probability on.
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, digits and signs used as letters.
_LOOKALIKE = str.maketrans("абвгеіјкмнорстухѕԁӏԛԝαβεικνορτυχ", "abbreijkmhopctyxsdlqwabeiknoptux")
_LEET = str.maketrans("01345789@$!|", "oieastbgasil")

_FORMAT = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?[a-z!][^<>]*>")
_MARK = re.compile(r"[̀-ͯ]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_*~])[^\W_])(?:\1[^\W_])+(?![^\W_])")
_INNER = re.compile(r"(?<=[^\W\d_])[\-_~'’](?=[^\W\d_])")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[\r\n]+|\s{3,}")
_WORD = re.compile(r"[^\W_]+(?:[@$!|*#]+[^\W_]+)*")
_MASK = re.compile(r"[*#]+")
_REPEAT = re.compile(r"(.)\1+")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1 << 18)
def plain(word: str) -> str:
    """A word in its undisguised form: look-alikes mapped, digits within letters read as letters, repeated letters once; masked letters become *, numbers #."""
    if word.isdigit():
        return "#"
    if "*" in word or "#" in word:
        return _MASK.sub("*", word)
    if not word.isalpha():
        letters = sum(c.isalpha() for c in word)
        word = word.translate(_LEET) if 2 * letters >= len(word) and not word[0].isdigit() or letters >= 3 and len(word) - letters <= 2 else _DIGITS.sub("#", word)
    return _REPEAT.sub(r"\1", word)


def sentences(text: str | None) -> list[tuple[str, list[str]]]:
    """(sentence in lower case, its plain words) of a text; sentences without words are left out."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", text)
        text = _MARK.sub("", unicodedata.normalize("NFKD", text.lower())).translate(_LOOKALIKE)
    text = _TAG.sub("\n", text.lower())
    text = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text)
    text = _INNER.sub("", text)
    out = []
    for part in _SENTENCE.split(text):
        found = list(map(plain, _WORD.findall(part)))
        if found:
            out.append((part.strip(), found))
    return out


class Words:
    """Numbers of distinct words and the hashed features of each: the word and its four-letter parts."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hash: list[int] = []
        self.parts: list[list[int]] = []

    def __call__(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.hash)
            h = crc32(word.encode())
            self.hash.append(h)
            edged = f"^{word}$"
            self.parts.append([h % HALF, *{crc32(edged[k:k + 4].encode(), 7) % HALF for k in range(len(edged) - 3)}] if len(word) > 2 else [h % HALF])
            if "*" in word:
                self.parts[n].append(crc32(b"*", 7) % HALF)
        return n


def pairs(h: np.ndarray, sentence: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of word pairs ``gap`` apart within a sentence, and their sentences."""
    if len(h) <= gap:
        return np.zeros(0, np.int64), np.zeros(0, sentence.dtype)
    same = sentence[gap:] == sentence[:-gap]
    mixed = (h[:-gap].astype(np.uint64) * np.uint64(0x9E3779B1) + h[gap:].astype(np.uint64) * np.uint64(0x85EBCA77) + np.uint64(gap * 77)) >> np.uint64(7)
    return (mixed[same] % np.uint64(HALF)).astype(np.int64) + HALF, sentence[gap:][same]


GAPS = (1, 2)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def sentence_scores(self, bags: list[list[list[str]]], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every sentence, its bag's number) over bags of sentences of plain words."""
        number, sent, bag, n = [], [], [], 0
        for b, bagged in enumerate(bags):
            for s in bagged:
                number += [words(w) for w in s]
                sent += [n] * len(s)
                bag.append(b)
                n += 1
        if not n:
            return np.zeros(0), np.zeros(0, np.int64)
        if len(self.of_word) < len(words.hash):
            fresh = [float(self.weight[p].sum()) for p in words.parts[len(self.of_word):]]
            self.of_word = np.concatenate([self.of_word, fresh])
        number, sent = np.array(number), np.array(sent)
        logit = np.full(n, self.bias) + np.bincount(sent, self.of_word[number], n)
        h = np.array(words.hash, dtype=np.int64)[np.array(number)]
        for gap in GAPS:
            f, s = pairs(h, sent, gap)
            logit += np.bincount(s, self.weight[f], n)
        return logit, np.array(bag)

    def __post_init__(self):
        self.of_word = np.zeros(0)


def spread(texts: list[str | None]) -> list[str]:
    """Plain words of texts as one string each: words parted by spaces, sentences by line ends."""
    return ["\n".join(" ".join(w) for _, w in sentences(t)) for t in texts]


def fit(texts: list[str | None], labels: list[float]) -> Model:
    """Fit the sentence model to document labels in [0, 1] (several verdicts on one document are averaged)."""
    return fit_words(spread(texts), labels)


def fit_words(spread_texts: list[str], labels: list[float]) -> Model:
    """As ``fit``, from texts already taken apart.

    A sentence's logit is the sum of its words' weights, each the sum over the
    word's parts, and of its pairs' weights; words are summed once for each
    distinct word, so a step costs one pass over words and frequent pairs.
    """
    words = Words()
    number_, sent_, bag_ = array("i"), array("i"), array("i")
    for b, text in enumerate(spread_texts):
        for line in text.split("\n") if text else ():
            found = line.split(" ")
            number_.extend([words(w) for w in found])
            sent_.extend([len(bag_)] * len(found))
            bag_.append(b)
    number, sent, bag = (np.frombuffer(x, np.int32).astype(np.int64) for x in (number_, sent_, bag_)) if len(bag_) else (np.zeros(0, np.int64),) * 3
    n, docs = len(bag), len(spread_texts)
    if not n:
        return Model(np.zeros(SPACE, np.float32), -5.0)
    part_word = np.repeat(np.arange(len(words.parts)), [len(p) for p in words.parts])
    part = np.array([f for p in words.parts for f in p], np.int64)
    h = np.array(words.hash, np.int64)[number]
    both = [pairs(h, sent, gap) for gap in GAPS]
    pair, pair_sent = np.concatenate([f for f, _ in both]), np.concatenate([s for _, s in both])
    # Rare features say nothing; the rest are renumbered.
    seen = np.zeros(SPACE, np.int64)
    in_doc = np.unique(number * docs + bag[sent])
    doc_word, start = in_doc // docs, np.concatenate(([0], np.cumsum(np.bincount(part_word, minlength=len(words.parts)))))
    many = np.diff(start)[doc_word]
    at = np.repeat(start[doc_word] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    for f in (np.unique(part[at] * docs + np.repeat(in_doc % docs, many)) // docs, np.unique(pair * docs + bag[pair_sent]) // docs):
        seen += np.bincount(f, minlength=SPACE)
    kept = np.flatnonzero(seen >= LEAST_SEEN)
    place = np.full(SPACE, -1, np.int64)
    place[kept] = np.arange(len(kept))
    use = place[part] >= 0
    part, part_word = place[part][use], part_word[use]
    use = place[pair] >= 0
    pair, pair_sent = place[pair][use], pair_sent[use]
    vocabulary, size = len(words.parts), len(kept)
    target, ridge = np.asarray(labels, float), RIDGE / docs**0.5
    rare = max(target.mean(), 1e-3)
    weight, bias = np.zeros(size), float(np.log(rare / (max(n / docs, 1) - rare + 1e-9)) if n > docs else -1.0)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        of_word = np.bincount(part_word, weight[part], vocabulary)
        logit = np.clip(bias + np.bincount(sent, of_word[number], n) + np.bincount(pair_sent, weight[pair], n), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        stay = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), docs)  # log of P(no sentence is abusive)
        none = np.exp(stay)
        case = np.maximum(1 - none, 1e-9)
        # d loss / d logit of a sentence: p for the clean share of the label, -p * none / case for the abusive share
        slope = p * ((1 - target) - target * none / case)[bag] / docs
        to_word = np.bincount(number, slope[sent], vocabulary)
        grad = ridge * weight + np.bincount(part, to_word[part_word], size) + np.bincount(pair, slope[pair_sent], size)
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(SPACE, np.float32)
    full[kept] = weight
    return Model(full, bias)


def judge(model: Model, texts: list[str | None], words: Words) -> tuple[list[float], list[str | None]]:
    """Score of each text and its worst sentence (null for texts without words, which score 0)."""
    cut = [sentences(t) for t in texts]
    logit, bag = model.sentence_scores([[w for _, w in s] for s in cut], words)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    score = 1 - np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))) if len(bag) else np.zeros(len(texts))
    worst: list[str | None] = []
    at = 0
    for s in cut:
        worst.append(s[int(np.argmax(logit[at:at + len(s)]))][0] if s else None)
        at += len(s)
    return score.tolist(), worst


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "abusive", most: int = MAX_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents (a documented bound), chosen by hash of the key.

    Null labels and labels of missing documents are left out; several verdicts
    on a document are averaged. Without labels every text scores near 0.
    """
    verdicts = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = verdicts.orderBy(F.xxhash64("k"), "k").limit(most)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen), "k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "y": frame["y"], "words": spread(frame["t"].tolist())})

    kind = docs.schema[key].dataType.simpleString()
    taken = rows.mapInPandas(run, f"k {kind}, y double, words string").toPandas().drop_duplicates("k").sort_values("k")
    return fit_words(taken["words"].tolist(), taken["y"].tolist())


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score``, ``worst_sentence`` of every distinct key.

    Null, empty and wordless texts score 0 and have no worst sentence; whole
    texts are read; rows that repeat a key count once; null keys are kept as one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, words = shared.value, Words()
        known.of_word = np.zeros(0)
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at:at + 500]
                if len(words.hash) > 500_000:  # memory, not results
                    words = Words()
                    known.of_word = np.zeros(0)
                s, worst = judge(known, part["t"].tolist(), words)
                yield pd.DataFrame({"k": part["k"], "score": s, "worst_sentence": worst})

    once = once_per_key(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    return once.mapInPandas(run, f"k {kind}, score double, worst_sentence string").withColumnRenamed("k", key)


def cases(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` of every document scored at ``threshold`` or more."""
    return scores(docs, train(docs, labels)).where(F.col("score") >= threshold).where(F.col("doc_id").isNotNull()).select("doc_id")


def source_rates(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source``, ``documents``, ``abusive``, ``rate``: share of abusive documents of each source (a null source is one)."""
    scored = scores(docs, train(docs, labels)).select("doc_id", "score")
    sources = docs.select("doc_id", "source").dropDuplicates(["doc_id"])
    return (
        sources.join(scored, "doc_id")
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"))
        .withColumn("rate", F.col("abusive") / F.col("documents"))
    )
