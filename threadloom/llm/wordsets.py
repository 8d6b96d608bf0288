"""Distinct words of short support texts, and their rare-first order."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are near-same if this share of the words of either are in both.
SHARE = 0.7
#: Texts of fewer distinct words are never near-same.
LEAST_WORDS = 6


def normal_text(text: Column) -> Column:
    """Lower-case words joined by single blanks: links, @handles and an agent signature at the end are left out."""
    # most texts lack what the costlier patterns look for
    bare = F.when(text.contains("http") | text.contains("www."), F.regexp_replace(text, r"https?://\S+|www\.\S+", " ")).otherwise(text)
    bare = F.when(text.contains("@"), F.regexp_replace(bare, r"(?U)@\w+", " ")).otherwise(bare)
    signed = text.contains("^") | text.contains("~") | text.contains("*") | text.contains("/")
    bare = F.when(signed, F.regexp_replace(bare, r"[\s.!?]*[\^~*/][A-Z]{1,3}\s*$", " ")).otherwise(bare)
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def with_words(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """``kept`` and ``words``, the sorted distinct words, of the rows with enough of them; null texts have none.

    The words are the output of a generator, so that what follows doesn't work them out again.
    """
    # sort_array: its order is built in, that of array_sort is an interpreted lambda
    words = F.sort_array(F.array_distinct(F.split(normal_text(F.col(text)), " ")))
    return rows.where(F.col(text).isNotNull()).select(*kept, F.explode(F.array(words)).alias("words")).where(F.size("words") >= LEAST_WORDS)


def _ratio(share: float) -> tuple[int, int]:
    """The share as whole numbers, so that no rounding decides at the threshold."""
    den = 1000
    num = round(share * den)
    g = math.gcd(num, den)
    return num // g, den // g


def near(common: Column, n_a: Column, n_b: Column, share: float = SHARE) -> Column:
    num, den = _ratio(share)
    return common * den >= (n_a + n_b - common) * num


#: Counters that words are counted in by hash: a table of fixed size, whatever the vocabulary.
COUNTERS = 1 << 20
#: Parts that the order is cut into for the suffix filter.
PARTS = 8


def level(count: np.ndarray) -> np.ndarray:
    """Four steps per doubling; 0 is a word of one set only."""
    return np.minimum(127, np.floor(4 * np.log2(np.maximum(count, 1)))).astype(np.int64)


@dataclass
class Order:
    """A rare-first order of words by counts over all sets.

    A word's place is a number: its level above 56 bits of its hash. Words that share a
    counter look more frequent than they are, which costs some speed and no result: any
    order that is the same for all sets keeps the filters complete. A word of level 0
    has its counter alone and stands in one set only.
    """

    levels: np.ndarray  # per counter
    pivots: np.ndarray  # places that cut the words of more than one set into parts of about the same number of rows

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[hashes & (len(self.levels) - 1)] << 56 | (hashes.view(np.uint64) >> np.uint64(8)).view(np.int64)


def rare_first(sets: DataFrame, hashes: str = "hashes") -> Order:
    """The order by the counts of every word of ``sets``; at most ``COUNTERS`` numbers reach the driver."""
    counter = F.pmod(F.col("h"), F.lit(COUNTERS)).cast("int").alias("counter")
    counts = sets.select(F.explode(hashes).alias("h")).groupBy(counter).agg(F.count("*").alias("n")).where("n > 1").toArrow()
    levels, n = np.zeros(COUNTERS, np.int64), counts.column("n").to_numpy()
    levels[counts.column("counter").to_numpy()] = level(n)
    mass = np.bincount(level(n), weights=n, minlength=128)
    upto = np.cumsum(mass)
    pivots = []
    for k in range(1, PARTS):
        want = upto[-1] * k / PARTS
        at = min(int(np.searchsorted(upto, want)), 127)
        inside = (want - (upto[at] - mass[at])) / mass[at] if mass[at] else 0.0
        pivots.append(at << 56 | min(int(inside * (1 << 56)), (1 << 56) - 1))
    return Order(levels, np.array(pivots, np.int64))
