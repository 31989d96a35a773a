"""Word-shingle expressions for the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, SIMILARITY = 5, 0.8


def shingle_hashes(words: Column, size: int = SIZE) -> Column:
    """Hash of every run of ``size`` words, in order; the whole sequence where there are fewer, none where there are none.

    ``words`` should be a column, not an expression, as it is evaluated once for each shingle.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def occurrences(hashes: Column) -> Column:
    """A multiset of hashes as a set: the k-th copy of a hash becomes a value of its own.

    ``hashes`` should be a sorted column.
    """
    return F.transform(hashes, lambda h, i: F.when(F.element_at(hashes, i + 1) == F.get(hashes, i - 1), F.xxhash64(h, i - F.array_position(hashes, h))).otherwise(h))
