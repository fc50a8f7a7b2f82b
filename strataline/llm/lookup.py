"""Figures for the keys of a corpus (words, byte grams, pairs of ids): frequent keys as a bounded table, the rest by a join.

``frequent`` cuts a table of counts at the count that leaves ``most`` keys at most; those travel to the tasks, which hold them in
``Numbers`` or a dictionary. What is below the cut is shuffled to its figures. A key that is below holds less than one part in ``most`` of
the occurrences or so, hence no hot keys meet in that join, however uneven the corpus is. Both ways together cover every key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

EMPTY = np.int64(-1)


class Numbers:
    """Index of different non-negative 64-bit numbers: open addressing over arrays, many keys at a time."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self.key, self.value = np.full(size, EMPTY), np.zeros(size, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.key[at] == EMPTY
            self.key[at[free]] = keys[left[free]]  # of several the last one stays
            won = free & (self.key[at] == keys[left])
            self.value[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among those of the index, -1 where it has none."""
        keys = np.ascontiguousarray(keys, np.int64)
        at = self._home(keys)
        there = self.key[at]
        out = np.where(there == keys, self.value[at], -1)
        left = np.flatnonzero((there != keys) & (there != EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            there, want = self.key[at], keys[left]
            hit = there == want
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (there != EMPTY)
            left, at = left[on], at[on]
        return out


def _low(n: Column) -> Column:
    """``n`` without its bits below the six highest: few different values, so that they can be counted."""
    return F.when(n < 64, n).otherwise(F.expr("shiftleft(shiftright({0}, {1}), {1})".format("__n", "int(floor(log2(__n))) - 5")))


def cut_at(counts: DataFrame, n: str, most: int) -> int:
    """The least count whose keys, with all that occur more often, are ``most`` at most. ``counts``: a row for each key."""
    bins = counts.select(F.col(n).alias("__n")).select(_low(F.col("__n")).alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("keys"))
    held, cut = 0, 1 << 62
    for low, keys in sorted(map(tuple, bins.collect()), reverse=True):  # some 2,000 rows at most
        if low < 1 or held + keys > most:
            break
        held, cut = held + keys, low
    return cut


def frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of ``counts`` at or above the cut: ``most`` at most."""
    return counts.filter(F.col(n) >= cut_at(counts, n, most))


ship(__name__)
