"""Chunks of rows that follow the order of `order`, a whole number."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(rows: DataFrame, chunks: int) -> np.ndarray:
    """At most chunks - 1 numbers, ascending, that cut the rows into about equal runs."""
    if chunks < 2:
        return np.zeros(0, np.int64)
    found = rows.approxQuantile("order", [k / chunks for k in range(1, chunks)], 1 / (8 * chunks))
    least = -float(1 << 63)
    return np.array(sorted({int(x) for x in found if x > least}), np.int64)


def chunk_of(cuts: np.ndarray, order: Column) -> Column:
    """How many cuts are at or below order, by a search in two steps; the cuts are two literals of 8 bytes a cut, whatever their number."""
    if not len(cuts):
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    tops = cuts[::step]
    held = F.lit(cuts)
    below = lambda a: F.size(F.filter(a, lambda x: x <= order))
    top = F.greatest(below(F.lit(tops)) - 1, F.lit(0))
    return (top * step + below(F.slice(held, top * step + 1, F.lit(step)))).cast("int")
