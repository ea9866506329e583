"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows, spread
from ..sources.tables import table, written

__all__ = ["CODE_EXTENSIONS", "CONFIG_EXTENSIONS", "RollingHash", "code_points", "code_records", "map_rows", "record_text", "spread", "table", "written"]

CODE_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".c")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml")

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def record_text() -> Column:
    """Text of a record: full_content, or content_preview where that is NULL."""
    return F.coalesce(F.col("full_content"), F.col("content_preview"))


def code_records(files: DataFrame) -> DataFrame:
    return files.filter(F.col("extension").isin(*CODE_EXTENSIONS) & F.col("full_content").isNotNull())


class RollingHash:
    """Hashes of all windows of a code-point array, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = 1 << max(16, n - 1).bit_length() if n > 65536 else 65536
            p, q = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            p[0] = q[0] = 1
            self._powers, self._inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)

    def prefix(self, points: np.ndarray) -> np.ndarray:
        n = len(points)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(7)) * self._powers[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Mixed hashes of the windows [i, i + length), for all i or those in ``starts``."""
        if starts is None:
            n = max(0, len(prefix) - length)
            raw = (prefix[length:] - prefix[:n]) * self._inverses[:n]
        else:
            raw = (prefix[starts + length] - prefix[starts]) * self._inverses[starts]
        raw ^= raw >> np.uint64(32)
        raw *= np.uint64(0xD6E8FEB86659FD93)
        raw ^= raw >> np.uint64(32)
        return raw


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
