"""Problem 2: long exact spans shared between records, by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, record_text, spread, written

#: Code points hashed at once by a worker.
CHUNK = 1 << 20


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - width + span], out[width - span :]) if span < width else out


def anchors(hashes: np.ndarray, sizes: np.ndarray, length: int, least: int) -> np.ndarray:
    """Positions of windows chosen so that every run of ``least`` characters holds one.

    ``hashes`` are those of all windows of ``length`` over texts of ``sizes`` laid end to
    end. The rightmost of the smallest hashes within a run is chosen, which depends on
    the run's characters alone.
    """
    width = least - length + 1
    starts = np.cumsum(sizes) - sizes
    runs = np.maximum(sizes - least + 1, 0)
    first = np.repeat(starts, runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    if width == 1 or not len(first):
        return first
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    best = sliding_minimum((hashes & ~low) | (low - place), width)[first]
    chosen = (low - (best & low)).astype(np.int64)
    return chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]


def _emit(length: int, least: int):
    """Arrow function: (file_id, class, start, text) -> the chosen windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
                    n += len(texts[end])
                    end += 1
                sizes = np.array([len(t) for t in texts[at:end]])
                points = np.frombuffer("".join(texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
                h = hasher.windows(hasher.prefix(points), length)
                where = anchors(h, sizes, length, least)
                if len(where):
                    ends = np.cumsum(sizes)
                    row = np.searchsorted(ends, where, side="right")
                    own = at + row
                    pos = where - (ends - sizes)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(h[where].view(np.int64)), *(pa.array(k[own]) for k in keys), pa.array(pos.astype(np.int32))], ["h", "file_id", "class", "start", "pos"])
                at = end

    return run


def _narrow(length: int, least: int):
    """Arrow function: cuts each text to what lies within ``least`` characters of a window that survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for file_id, start, text, kept in zip(*(c.to_pylist() for c in batch.columns)):
                low = high = -1
                for p in sorted(kept):
                    a, b = max(0, p + length - least), min(len(text), p + least)
                    if a > high - least + 1 and high >= 0:  # no run of that length can reach across
                        out.append((file_id, file_id, start + low, text[low:high]))
                        low = a
                    elif high < 0:
                        low = a
                    high = max(high, b)
                out.append((file_id, file_id, start + low, text[low:high]))
            out = [x for x in out if len(x[3]) >= least]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["file_id", "class", "start", "text"])

    return run


class SharedSpans:
    """Spans of at least ``least`` characters that stand in more than one text.

    Exact copies form classes first, each represented by its smallest file_id. Windows of
    a quarter of ``least`` are taken at chosen positions, so that every run of ``least``
    characters holds one; those in one text alone are dropped, and the surroundings of the
    rest are tried at twice the length, until the windows have the full length and stand
    at every position. Windows are equal when their 64-bit hashes are.

    NULL texts count as empty; texts below ``least`` share nothing; repeated rows of a
    file_id count once. Hot windows are counted with map-side combining and joined with
    one row a hash, so that no group is ever gathered.
    """

    def __init__(self, files: DataFrame, least: int = 300) -> None:
        if least < 8 or least % 4:
            raise ValueError("least must be a multiple of four")
        self.least = least
        texts = files.select("file_id", record_text().alias("text")).filter("file_id IS NOT NULL")
        self.sizes = texts.select("file_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
        texts = texts.filter(F.length("text") >= least)
        digest = F.md5("text")
        self.members = written(texts.select("file_id", digest.alias("digest")).distinct())
        self.classes = self.members.groupBy("digest").agg(F.min("file_id").alias("class_id"), F.count("*").alias("copies"))
        code = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        regions = texts.select("file_id", code.alias("class"), F.lit(0).alias("start"), "text")
        for length in (least // 4, least // 2):
            regions = self._level(spread(regions), length)
        found = written(spread(regions).mapInArrow(_emit(least, least), "h long, file_id long, class long, start int, pos int").select("h", "file_id", (F.col("start") + F.col("pos")).alias("pos")))
        self.windows, self.alive = found, self._alive(found, "file_id")

    @staticmethod
    def _alive(windows: DataFrame, by: str) -> DataFrame:
        return windows.groupBy("h").agg(F.min(by).alias("_low"), F.max(by).alias("_high")).filter("_low < _high").select("h")

    def _level(self, regions: DataFrame, length: int) -> DataFrame:
        found = written(regions.mapInArrow(_emit(length, self.least), "h long, file_id long, class long, start int, pos int"))
        kept = found.join(self._alive(found, "class"), "h").select("file_id", "start", "pos")
        representatives = self.classes.select(F.col("class_id").alias("file_id"))
        kept = kept.join(representatives, "file_id", "left_semi").groupBy("file_id", "start").agg(F.collect_set("pos").alias("kept"))
        near = regions.join(kept, ["file_id", "start"]).select("file_id", "start", "text", "kept")
        return written(near.mapInArrow(_narrow(length, self.least), "file_id long, class long, start int, text string"))

    @cached_property
    def _groups(self) -> DataFrame:
        """(h, class_id, n, top, settled): the sets of n classes that hold a window, each once, by member.

        ``top`` is the largest set of the class. A set is settled if all its members have the
        same top: it is then a part of that set and links nothing that the top doesn't.
        """
        holders = self.windows.select("h", "file_id").distinct()
        who = [F.count("*").alias("n"), F.min("file_id").alias("low"), F.max("file_id").alias("high"), *(F.bit_xor(F.xxhash64("file_id", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
        sets = holders.groupBy("h").agg(*who).filter("low < high")
        chosen = sets.groupBy("n", "low", "high", "x1", "x2").agg(F.min("h").alias("h")).select("h", "n")
        rows = written(holders.join(chosen, "h").select("h", F.col("file_id").alias("class_id"), "n"))
        ranked = rows.join(rows.groupBy("class_id").agg(F.max(F.struct("n", "h")).alias("top")), "class_id")
        settled = ranked.groupBy("h").agg((F.min("top.h") == F.max("top.h")).alias("settled"))
        return written(ranked.join(settled, "h").select("h", "class_id", "n", "top", "settled"))

    def span_groups(self) -> DataFrame:
        """(group_id, class_id, classes): classes that hold a common span, as groups of ``classes`` members.

        Two classes share a span if and only if they are in one group together. Groups that are
        known to be part of another are left out. This form grows with the number of classes,
        not of their pairs, however common a span is.
        """
        return self._groups.filter("NOT settled OR h = top.h").select(F.col("h").alias("group_id"), "class_id", F.col("n").alias("classes"))

    def class_pairs(self) -> DataFrame:
        """(class_a, class_b) of the classes that share a span, class_a < class_b.

        Pairs are made in the groups of ``span_groups``, so a long common passage is paired
        no more often than a short one.
        """
        rows = self.span_groups().select("group_id", "class_id")
        a, b = rows.withColumnRenamed("class_id", "class_a"), rows.withColumnRenamed("class_id", "class_b")
        return a.join(b, "group_id").filter("class_a < class_b").select("class_a", "class_b").distinct()

    def membership(self) -> DataFrame:
        """(file_id, class_id, copies) of each record long enough to share a span."""
        return self.members.join(self.classes, "digest").select("file_id", "class_id", "copies")

    def linked_classes(self) -> DataFrame:
        """(file_id, class_id, copies, links): links is the number of other classes that share a span with the record's.

        A class of which all groups lie in its largest has as many links as that has other
        members; only for the rest are members of common groups joined and counted.
        """
        within = F.col("settled") | (F.col("h") == F.col("top.h"))
        kinds = self._groups.groupBy("class_id").agg(F.bool_and(within).alias("settled"), (F.max("top.n") - 1).alias("links"))
        rest = self.span_groups().select("group_id", F.col("class_id").alias("other"))
        open_ones = kinds.filter("NOT settled").select("class_id").join(self.span_groups().select("group_id", "class_id"), "class_id")
        counted = open_ones.join(rest, "group_id").filter("class_id <> other").groupBy("class_id").agg(F.count_distinct("other").alias("links"))
        links = kinds.filter("settled").select("class_id", "links").unionByName(counted)
        return self.membership().join(links, "class_id", "left").select("file_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def record_pairs(self) -> DataFrame:
        """(file_id_a, file_id_b) of all records that share a span, exact copies included."""
        of = self.membership().select("file_id", "class_id")
        a = of.select(F.col("class_id").alias("class_a"), F.col("file_id").alias("a"))
        b = of.select(F.col("class_id").alias("class_b"), F.col("file_id").alias("b"))
        several = self.membership().filter("copies > 1").select("file_id", "class_id")
        across = self.class_pairs().join(a, "class_a").join(b, "class_b").select(F.least("a", "b").alias("file_id_a"), F.greatest("a", "b").alias("file_id_b"))
        inside = several.select("class_id", F.col("file_id").alias("file_id_a")).join(several.select("class_id", F.col("file_id").alias("file_id_b")), "class_id").filter("file_id_a < file_id_b").select("file_id_a", "file_id_b")
        return across.unionByName(inside)

    def shared_characters(self) -> DataFrame:
        """(file_id, n_chars, shared_chars) of every record."""
        places = self.windows.join(self.alive, "h").select("file_id", "pos").distinct()
        ahead = F.lead("pos").over(Window.partitionBy("file_id").orderBy("pos")) - F.col("pos")
        cover = places.select("file_id", F.least(F.coalesce(ahead, F.lit(self.least)), F.lit(self.least)).alias("n")).groupBy("file_id").agg(F.sum("n").alias("covered"))
        of = self.membership().join(cover.withColumnRenamed("file_id", "class_id"), "class_id", "left")
        sizes = self.sizes.groupBy("file_id").agg(F.max("n_chars").alias("n_chars"))
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
        return sizes.join(of, "file_id", "left").select("file_id", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"))
