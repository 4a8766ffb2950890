"""Corpus encoding with a byte-level BPE vocabulary: exact merges in linear time.

Each split of a text is encoded by backtracking: an Aho-Corasick pass over the
reversed bytes gives the longest vocabulary entry that starts at each position,
and an entry is taken only if it is compatible with its left neighbour, that is
if merging by rank could really leave the two side by side. Distinct splits are
encoded once per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.once import once_per_key

#: Distinct splits a worker remembers; beyond it the memory starts afresh (speed only).
REMEMBERED = 300_000
#: Splits longer than this many bytes aren't remembered.
LONG_SPLIT = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder over a vocabulary file whose ids are merge ranks."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = model["vocab"]
        self.split = regex.compile(pattern).findall
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        merged = set()
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.pair[left, right] = whole
            self.parts[whole] = (left, right)
            merged.add(a + b)
        known = {s: i for s, i in ids.items() if len(s) == 1 or s in merged}
        for s, i in known.items():
            if len(s) == 1:
                self.parts[i] = (i, i)
        self.bytes_of = {i: raw(s) for s, i in known.items()}
        self.by_bytes = {b: i for i, b in self.bytes_of.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        #: The next shorter entry that starts like an entry, -1 if none.
        self.shorter = {i: next((self.by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.by_bytes), -1) for i, b in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.by_bytes.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.memory: dict[str, list[int]] = {}
        self.compatible = lru_cache(maxsize=1 << 17)(self._compatible)
        # Decoding: all entries' bytes in one buffer, found by an offset table.
        top = max(self.bytes_of) + 1
        sizes = np.zeros(top + 1, dtype=np.int64)
        for i, b in self.bytes_of.items():
            sizes[i + 1] = len(b)
        self.offsets = np.cumsum(sizes)
        self.buffer = b"".join(self.bytes_of.get(i, b"") for i in range(top))

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave ``left`` and ``right`` as neighbours.

        Each entry is built by its merges in order of rank, and while it grows its
        edge towards the other entry is some piece of it. The two stay apart if at
        no time the two edges present then make an entry of lower rank than the
        merge that changes one of them next.
        """
        pair = self.pair
        edge, other = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        never = len(self.length) + 1
        while True:
            whole = pair.get((edge[i], other[j]), never)
            next_left = edge[i + 1] if i + 1 < len(edge) else never
            next_right = other[j + 1] if j + 1 < len(other) else never
            # Of equal ranks the leftmost merge goes first.
            if whole < next_left and whole <= next_right:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _edge(self, entry: int, side: int) -> list[int]:
        """Pieces at the right (1) or left (0) edge of an entry while it is merged together, smallest first."""
        out = [entry]
        while self.parts[out[-1]][side] != out[-1]:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one split."""
        whole = self.by_bytes.get(data)
        n = len(data)
        if n < 2 or (whole is not None and n <= 2):
            return [whole] if n else []
        longest = [0] * n
        best = -1
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            if end != best:  # matches at an end come longest first
                longest[n - 1 - end] = token
                best = end
        length, shorter, compatible = self.length, self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text gives an empty list."""
        if not text:
            return []
        memory, out = self.memory, []
        for s in self.split(text):
            ids = memory.get(s)
            if ids is None:
                data = s.encode("utf-8")
                ids = self.piece(data)
                if len(data) <= LONG_SPLIT:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[s] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        o = self.offsets
        return b"".join(self.buffer[o[i]:o[i + 1]] for i in ids)


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    """One encoder per worker process."""
    return Bpe(path, pattern)


def encode_texts(rows: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key``, ``ids``: the ids of each text without special tokens, one row per key.

    Texts are encoded as stored. Null and empty texts give an empty list, a
    null key counts as one key. Rows that repeat a key are encoded once (any one
    of them, if they differ). Texts are encoded where they are read; only keys are
    shuffled, to find the repeated ones. Other columns are ignored.
    """
    import pyarrow as pa

    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    once = once_per_key(rows.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["k", "ids"])

    kind = once.schema["k"].dataType.simpleString()
    return once.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
