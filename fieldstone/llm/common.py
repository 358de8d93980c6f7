"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, written

__all__ = ["SLICE_ROWS", "WordTable", "bounded_sample", "flat", "fold", "kept", "segment_sum", "shared_dir", "slices", "table", "written"]

#: Rows that a Python worker holds as objects at once.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, modulus: int) -> Column:
    """crc32(key as text) mod modulus; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df by a hash of key, or all rows if there are no more; the same rows in every run."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """The lists end to end, and the offsets at which each begins and ends."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return [y for x in lists for y in x], offsets


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (rows) between consecutive offsets; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


_KEPT: dict[str, tuple[str, object]] = {}


def kept(kind: str, version: str, make: Callable[[], object]) -> object:
    """What make() builds for this version, built once in a Python worker; one version of each kind stays."""
    if kind not in _KEPT or _KEPT[kind][0] != version:
        _KEPT[kind] = (version, make())
    return _KEPT[kind][1]


class WordTable:
    """Values of words, worked out once for each distinct word and kept for up to `limit` words."""

    def __init__(self, values: Callable[[list], np.ndarray], limit: int = 300_000):
        self.make, self.limit, self.index, self.held = values, limit, {}, values([])

    def rows(self, words: list) -> np.ndarray:
        """One row of values for each of words."""
        if len(self.index) > self.limit:
            self.index = {}
        if new := list(set(words) - self.index.keys()):
            n, more = len(self.index), self.make(new)
            if n + len(new) > len(self.held):
                room = np.zeros((2 * (n + len(new)), *more.shape[1:]), more.dtype)
                room[:n] = self.held[:n]
                self.held = room
            self.held[n : n + len(new)] = more
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
        return self.held[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]
