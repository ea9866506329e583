"""Problem 8: exact byte-level BPE ids by dynamic programming over prefixes."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

VOCABULARY = os.environ.get("CODELOAM_BPE", "/opt/tokenizers/byte_bpe_50k.json")
#: Fixed value: the published pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids in a worker before the cache is emptied.
CACHED_WORDS = 200_000


def read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Ids of a text under a byte-level BPE whose ids are its merge order.

    A prefix of a word has exactly one token that can end its encoding. An automaton of
    the vocabulary lists the tokens that end at each position; the one that is compatible
    with the last token of the prefix before it is stored, and back-pointers give the ids.
    """

    def __init__(self, vocabulary: bytes | None = None) -> None:
        model = json.loads(vocabulary or read(VOCABULARY))["model"]
        ids: dict[str, int] = model["vocab"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        #: Latin-1 character of a byte -> the character that stands for it in the vocabulary.
        self.stands = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[a + b]
            self.joined[ids[a], ids[b]] = whole
            self.parts[whole] = (ids[a], ids[b])
        self.automaton = ahocorasick.Automaton()
        reachable = set(self.parts) | {ids[c] for c in self.stands.values()}
        for token, number in ids.items():
            if number in reachable:
                self.automaton.add_word(token, (number, len(token)))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave both tokens apart when they stand side by side.

        The later of the two last merges is undone again and again; at each step a merge
        across the border that would have come first refutes the pair.
        """
        joined, parts, bound = self.joined, self.parts, 1 << 60
        while True:
            across = joined.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                if left not in parts:
                    return True
                bound, left = left, parts[left][1]
            else:
                if right not in parts:
                    return True
                bound, right = right + 1, parts[right][0]

    def word(self, word: str) -> list[int]:
        points = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stands)
        n = len(points)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(points):
            start = end + 1 - length
            if last[end + 1] < 0 and (start == 0 or last[start] >= 0 and self.compatible(last[start], token)):
                last[end + 1], back[end + 1] = token, start
        if n and last[n] < 0:
            raise ValueError(f"the vocabulary has no tokens for {word!r}")
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for w in self.split(text):
            found = cache.get(w)
            if found is None:
                found = self.word(w)
                if len(w) <= 64:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[w] = found
            out += found
        return out


@lru_cache(maxsize=1)
def _encoder(shared: Broadcast) -> Encoder:
    return Encoder(shared.value)


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for each row; no special tokens, whose strings are ordinary text.

    NULL and empty texts give the empty list. Repeated rows stay repeated. Extra columns
    are ignored. White space is text. The driver reads the vocabulary and ships it to the workers.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read(vocabulary))
    rows = spread(documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [np.asarray(encoder.encode(t), np.int32) if t else np.empty(0, np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")
