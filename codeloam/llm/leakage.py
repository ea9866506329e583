"""Problem 9: passages of held-out items inside a corpus, by the q-gram lemma."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, code_points, spread

_WORD = re.compile(r"[^\W_]+")
#: Characters hashed at once, and characters of held-out text indexed at once.
CHUNK, BLOCK = 1 << 20, 4_000_000
#: q-gram matches grouped at once, and passages aligned at once.
HITS, ALIGNED = 4_000_000, 4096


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)]


def banded_distances(passages: list[np.ndarray], regions: list[np.ndarray], band: int) -> np.ndarray:
    """Least edit distance of each passage to any stretch of its region, all aligned side by side.

    The stretch may begin anywhere in the first ``band`` + 1 places of the region, and its
    alignment keeps to the ``band`` + 1 diagonals that begin there. Past a region's end nothing matches.
    """
    sizes = np.array([len(p) for p in passages], np.int64)
    out = np.zeros(len(passages), np.int64)
    if not len(passages):
        return out
    longest = int(sizes.max())
    p = np.full((len(passages), longest), 0xFFFFFFFF, np.uint32)
    r = np.full((len(passages), longest + band), 0xFFFFFFFE, np.uint32)
    inside = np.zeros((len(passages), longest + band + 1), np.int32)
    for k, (x, y) in enumerate(zip(passages, regions)):
        p[k, : len(x)] = x
        y = y[: longest + band]
        r[k, : len(y)] = y
        inside[k, len(y) + 1 :] = 1 << 20  # behind the region's end
    diagonals = np.arange(band + 1, dtype=np.int32)
    row = inside[:, : band + 1].copy()
    for i in range(longest):
        new = row + (p[:, i, None] != r[:, i : i + band + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.minimum.accumulate(new - diagonals, axis=1) + diagonals
        row = np.maximum(new, inside[:, i + 1 : i + band + 2])
        done = sizes == i + 1
        if done.any():
            out[done] = row[done].min(axis=1)
    return out


class PassageIndex:
    """Finds which items share a passage of ``run`` words with a text.

    A passage of n characters with at most ``edits`` edits shares n - q + 1 - edits * q
    q-grams with its source, all in one band of diagonals. Texts are normalised to their
    words between single spaces. ``edits`` = 0 asks for identical words.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = 12, edits: int = 0) -> None:
        self.run, self.edits = run, edits
        self.hash = RollingHash()
        self.items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for item, text in items:
            w = words(text or "")
            if len(w) >= run:
                ends = np.cumsum([0, *(len(x) + 1 for x in w)])
                n = len(w) - run + 1
                self.items.append((item, code_points(" " + " ".join(w) + " "), ends[:n], ends[run:] + 1))
        shortest = min((int((e - s).min()) for _, _, s, e in self.items), default=2 * run + 1)
        self.q = max(4, min(2 * run, shortest // (edits + 3)) if edits else min(2 * run, shortest))
        #: The lemma's bound for each passage of an item, the least of them for each item, and that of all.
        self.bounds = [np.maximum(1, e - s - self.q + 1 - edits * self.q) for _, _, s, e in self.items]
        self.least = np.array([b.min() for b in self.bounds], np.int64)
        self.span = max(1, shortest - self.q + 1)
        self.bound = max(1, self.span - edits * self.q)
        self.longest = max((len(p) for _, p, _, _ in self.items), default=0)
        grams, owner, place = [], [], []
        for k, (_, points, _, _) in enumerate(self.items):
            h = self.hash.windows(self.hash.prefix(points), self.q)
            grams.append(h)
            owner.append(np.full(len(h), k, np.int64))
            place.append(np.arange(len(h), dtype=np.int64))
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.grams = h[order]
        self.owner = np.concatenate(owner)[order] if grams else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.empty(0, np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(index of the text, item) pairs of a chunk of texts, each once."""
        if not self.items:
            return
        norm = [" " + " ".join(words(t)) + " \x00" for t in texts]
        points = code_points("".join(norm))
        starts = np.cumsum([0, *map(len, norm)])
        h = self.hash.windows(self.hash.prefix(points), self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        left = np.searchsorted(self.grams, h[at])
        hit = left < len(self.grams)
        hit[hit] = self.grams[left[hit]] == h[at[hit]]
        at, left = at[hit], left[hit]
        # Regions that hold enough q-grams of any item at all.
        span = self.span + self.edits
        present = np.zeros(len(h) + span + 1, np.int32)
        present[at] = 1
        total = np.concatenate([[0], np.cumsum(present)])
        dense = total[span:] - total[:-span] >= self.bound
        reach = np.zeros(len(present) + 1, np.int32)
        opens = np.flatnonzero(dense)
        np.add.at(reach, opens, 1)
        np.add.at(reach, np.minimum(opens + span, len(present)), -1)
        inside = np.cumsum(reach)[at] > 0
        at, left = at[inside], left[inside]
        if not len(at):
            return
        n = np.searchsorted(self.grams, h[at], side="right") - left
        upto = np.cumsum(n)
        found: set[tuple[int, int]] = set()
        i = 0
        while True:  # in pieces that overlap by the longest item, so that texts made of one phrase need no more memory than others
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS)))
            last = int(np.searchsorted(at, at[min(j, len(at)) - 1] + self.longest + 4 * self.edits + 4))
            self._search(points, starts, at[i:last], left[i:last], n[i:last], found)
            if j >= len(at):
                break
            i = j
        yield from found

    def _search(self, points, starts, at, left, n, found: set[tuple[int, int]]) -> None:
        """Adds the pairs that the q-grams at ``at`` lead to."""
        entry = np.repeat(left - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        owner, place = self.owner[entry], self.place[entry]
        width = self.edits + 1
        band = (np.repeat(at, n) - place) // width
        lowest = int(band.min()) - 1
        many = int(band.max()) - lowest + 1
        # Item, band and place in one number, so that one sort brings each band's places together.
        key = (owner * many + (band - lowest)) * self.longest + place
        if self.edits:  # bands of two widths, each overlapping the next by half
            key = np.concatenate([key, key - self.longest])
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        group, place = np.divmod(key, self.longest)
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(new, len(group)))
        enough = size >= self.least[group[new] // many]
        likely: list[tuple[int, int, int, int, int]] = []
        others: list[tuple[int, int, int, int, int]] = []
        for first, count in zip(new[enough].tolist(), size[enough].tolist()):
            k, b = divmod(int(group[first]), many)
            places = place[first : first + count]
            _, _, s, e = self.items[k]
            spare = np.searchsorted(places, e - self.q, side="right") - np.searchsorted(places, s) - self.bounds[k]
            kept = np.flatnonzero(spare >= 0)
            if len(kept):
                diagonal, best = (b + lowest) * width, int(kept[spare[kept].argmax()])
                docs = np.searchsorted(starts, (s[kept] + e[kept]) // 2 + diagonal, side="right") - 1
                for i, d in zip(kept.tolist(), docs.tolist()):
                    (likely if i == best else others).append((d, k, diagonal, int(s[i]), int(e[i])))
        self._verify(points, starts, likely, found)
        self._verify(points, starts, others, found)

    def _verify(self, points, starts, candidates: list[tuple[int, int, int, int, int]], found: set[tuple[int, int]]) -> None:
        """Adds the pairs of which a passage aligns within the edit budget, in bands of diagonals from the one given."""
        reach = 2 * self.edits + 1 if self.edits else 0
        for at in range(0, len(candidates), ALIGNED):
            part = [c for c in candidates[at : at + ALIGNED] if (c[0], self.items[c[1]][0]) not in found and 0 <= c[0] < len(starts) - 1]
            passages = [self.items[k][1][s:e] for _, k, _, s, e in part]
            regions = []
            for d, _, diagonal, s, e in part:
                a, b = s + diagonal, min(int(starts[d + 1]) - 1, e + diagonal + reach)
                before = max(0, int(starts[d]) - a)
                regions.append(np.concatenate([np.full(before, 0xFFFFFFFE, np.uint32), points[a + before : max(a + before, b)]]))
            near = banded_distances(passages, regions, reach) <= self.edits
            found.update((c[0], self.items[c[1]][0]) for c, ok in zip(part, near) if ok)


def find_leaks(documents: DataFrame, items: DataFrame, run: int = 12, edits: int = 0) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a passage of ``run`` words of an item.

    A passage may differ from the item's by ``edits`` characters put in, left out or replaced,
    once both are brought to words in lower case between single spaces.

    ``items`` is a held-out set, sent to the executors in blocks of at most BLOCK
    characters, each against all documents. NULL, empty or shorter texts hold nothing;
    repeated rows count once; other columns are ignored.
    """
    spark = documents.sparkSession
    texts = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK) or 1
    docs = spread(documents.select("doc_id", "text").filter("text IS NOT NULL"))
    out = None
    for block in range(blocks):
        held = texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in held])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(shared.value, run, edits)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at = 0
                while at < len(ids):
                    end, size = at, 0
                    while end < len(ids) and (end == at or size + len(texts[end]) <= CHUNK):
                        size += len(texts[end])
                        end += 1
                    pairs = sorted((ids[at + k], item) for k, item in index.find(texts[at:end]))
                    if pairs:
                        a, b = zip(*pairs)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id"])
                    at = end

        part = docs.mapInArrow(search, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
