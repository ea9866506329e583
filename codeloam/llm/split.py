"""Problem 7: oversized texts cut at natural boundaries, with overlaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BOUNDARIES = ("\n\n", "\n", " ")


def cuts(text: str, limit: int = 4000, overlap: int = 200) -> Iterator[tuple[int, int]]:
    """Pieces (start, end) of ``text``; none if it is within the limit.

    Each piece ends at the strongest boundary in the second half of its span, the last
    one of its kind, and the next piece starts ``overlap`` characters before that end.
    """
    if len(text) <= limit:
        return
    start, half = 0, limit // 2
    while len(text) - start > limit:
        for mark in BOUNDARIES:
            at = text.rfind(mark, start + half + 1 - len(mark), start + limit)
            if at >= 0:
                end = at + len(mark)
                break
        else:
            end = start + limit
        yield start, end
        start = end - overlap
    yield start, len(text)


def cut_near(text: str, start: int, end: int) -> int:
    """The strongest boundary in the middle half of a span, of its kind the nearest to the midpoint; the midpoint without any."""
    middle, quarter = (start + end) // 2, (end - start) // 4
    low, high = max(start + 1, middle - quarter), min(end - 1, middle + quarter)
    for mark in BOUNDARIES:
        n = len(mark)
        before, after = text.rfind(mark, low - n, middle) + n, text.find(mark, middle - n + 1, high) + n
        near = [at for at in (before, after) if at >= max(low, n) and at <= high]
        if near:
            return min(near, key=lambda at: (abs(at - middle), at))
    return middle


def bisected(text: str, limit: int = 4000, overlap: int = 200) -> Iterator[tuple[int, int]]:
    """Pieces (start, end) of ``text`` by recursive bisection; none if it is within the limit.

    A span longer than ``limit`` less ``overlap`` is cut near its midpoint and its halves
    are tried again; then each piece but the first is begun ``overlap`` characters earlier.
    """
    if len(text) <= limit:
        return
    stack = [(0, len(text))]
    while stack:
        start, end = stack.pop()
        if end - start <= limit - overlap:
            yield max(0, start - overlap), end
        else:
            at = cut_near(text, start, end)
            stack += [(at, end), (start, at)]


def _pieces(cut: Callable, texts: DataFrame, id_column: str, text_column: str, limit: int, overlap: int) -> DataFrame:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    long = texts.select(F.col(id_column).alias("file_id"), F.col(text_column).alias("text")).filter((F.length("text") > limit) & F.col("file_id").isNotNull())
    return map_rows(long, lambda i, t: ((i, s, e) for s, e in cut(t, limit, overlap)), "file_id long, start_char int, end_char int").distinct()


def split_oversized(texts: DataFrame, id_column: str = "file_id", text_column: str = "full_content", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(id, start_char, end_char) of each text above ``limit`` code points.

    NULL, empty and short texts and NULL ids give no rows; repeated rows of one id give its pieces
    once. Other columns of the input are ignored. ``overlap`` must be below half the limit.
    """
    return _pieces(cuts, texts, id_column, text_column, limit, overlap)


def bisect_oversized(texts: DataFrame, id_column: str = "file_id", text_column: str = "full_content", limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(id, start_char, end_char) of each text above ``limit`` code points, cut by recursive bisection; else as ``split_oversized``."""
    return _pieces(bisected, texts, id_column, text_column, limit, overlap)
