"""Near-duplicate texts by rare-first prefix filtering.

Texts with the same words are one class, and only classes are compared. The words of a
class are ordered rare first, by counts over all classes. Two classes that share enough
words share their first k common words within prefixes that are k - 1 words longer than
the plain ones, so classes are joined on prefix n-grams: on single words where these are
rare, on word pairs that begin with a frequent word otherwise; words of one class only
join nothing. An n-gram that more than ``HOT`` classes have is extended by one more word,
and so on up to ``LONGEST``. Small classes may have no further word in common: those that
an n-gram alone makes near-same are joined on it and their sizes, however many they are.
Length, positional and suffix filters act inside the join; the pairs left are made
distinct and verified once on their whole word sets.

Rows of the join are five numbers: the n-gram, the class, where the n-gram ends (with
its size and the class's), and how many words behind it lie in each of eight parts of
the order. The last are the suffix filter: common words behind the n-gram are at most
the sum over the parts of the lesser number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.conversations import components
from threadloom.llm.spread import spread
from threadloom.llm.tables import dropped, stored
from threadloom.llm.wordsets import PARTS, SHARE, Order, _ratio, level, near, rare_first, with_words
from threadloom.session import checkpoint

#: Classes that may share an n-gram before it is extended.
HOT = 64
#: Words of the longest n-grams. Classes that share as many of their rarest common words are joined however many they are.
LONGEST = 12
#: Rows that a batch of n-grams holds at most, about.
BATCH = 1 << 20
#: Larger classes pass the suffix filter, as their counts wouldn't fit.
LARGE = (1 << 15) - 1
GRAM = "key bigint, rep bigint, info bigint, s0 bigint, s1 bigint"


def classes(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, rep)`` and classes ``(rep, first, words)`` of texts with enough words, checkpointed.

    A class is a number; ``first`` is its least id. Rows with a null id or a text of too
    few words (null and empty ones too) belong to no class; repeated rows count once.
    """
    spark = rows.sparkSession
    sets = with_words(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")), "text", "id")
    table = stored(sets.select("id", F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"), "words"), "sets")
    held = spark.read.parquet(table)
    # one representative per word set: aggregates only, so a set that a third of all rows have is no hot group
    named = held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.first("words").alias("words"))
    named = checkpoint(named.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "first", "words"))
    members = checkpoint(held.select("id", "h1", "h2").distinct().join(named.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep"))
    dropped(spark, table)
    return members, named.select("rep", "first", "words")


def _needed(n: np.ndarray, share: float) -> np.ndarray:
    """Words that a set of n must have in common with any near-same set."""
    num, den = _ratio(share)
    return -(-n * num // den)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers in their order."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ranges ``first .. first + count - 1`` its members and its own number."""
    own = np.repeat(np.arange(len(first)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]


class Places:
    """The words of a batch of sets as places in the order, rare first within each set."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, pivots: np.ndarray):
        self.row = np.repeat(np.arange(len(n)), n)
        self.n, self.start = n, np.cumsum(n) - n
        self.flat = flat[np.lexsort((flat, self.row))]
        self.pos = np.arange(len(flat)) - self.start[self.row]
        # words of each part before a word, over the whole batch
        part = np.searchsorted(pivots, self.flat, side="right")
        one = (part[:, None] == np.arange(PARTS)) & (self.flat >> 56 > 0)[:, None]
        self.before = np.concatenate([np.zeros((1, PARTS), np.int64), np.cumsum(one, axis=0, dtype=np.int64)])

    def behind(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words behind those at ``at``, in their sets, by part: four counts to a number."""
        end = (self.start + self.n)[self.row[at]]
        left = np.minimum(self.before[end] - self.before[at + 1], LARGE)
        return tuple(left[:, 4 * k] | left[:, 4 * k + 1] << 16 | left[:, 4 * k + 2] << 32 | left[:, 4 * k + 3] << 48 for k in (0, 1))


def _info(size: int | np.ndarray, n: np.ndarray, last: np.ndarray) -> np.ndarray:
    return size | n << 8 | last << 36


def first_grams(places: Places, rep: np.ndarray, share: float, frequent: int) -> Iterator[list[np.ndarray]]:
    """Rows of single words up to the level ``frequent``, and of pairs that begin with a word above it."""
    n, level_, row = places.n, places.flat >> 56, places.row
    spare = n - _needed(n, share)  # the first common word is at this place at the latest
    opens = (places.pos <= spare[row]) & (level_ > 0)
    one = np.flatnonzero(opens & ((level_ <= frequent) | (_needed(n, share)[row] <= 1)))
    yield [places.flat[one], rep[row[one]], _info(1, n[row[one]], places.pos[one]), *places.behind(one)]
    two = np.flatnonzero(opens & (level_ > frequent))
    count = np.minimum(n - 1, spare + 1)[row[two]] - places.pos[two]
    for part in np.split(np.arange(len(two)), np.searchsorted(np.cumsum(count), np.arange(BATCH, int(count.sum()), BATCH))):
        own, last = _ranges(two[part] + 1, count[part])
        yield [_mix(places.flat[two[part]][own], places.flat[last]), rep[row[last]], _info(2, n[row[last]], places.pos[last]), *places.behind(last)]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All members of a batch's lists, and their numbers."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), np.diff(ends)


def _portions(n: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Rows and their words, some rows at a time: about ``BATCH`` words, or one row that has more."""
    ends = np.cumsum(n)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(BATCH, int(ends[-1]) if len(n) else 0, BATCH)) + 1, [len(n)]]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield slice(lo, hi), slice(int(ends[lo] - n[lo]), int(ends[hi - 1]))


def _part(column: str, k: int) -> Column:
    return F.shiftright(column, 16 * k).bitwiseAND(F.lit(LARGE))


def candidates(named: DataFrame, share: float = SHARE, hot: int = HOT, longest: int = LONGEST) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of classes ``named(rep, words)`` that pass the filters on some common prefix n-gram. Checkpointed.

    Complete: no near-same pair is missing.
    """
    spark = named.sparkSession
    hashed = named.select("rep", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    order = spark.sparkContext.broadcast(rare_first(hashed))  # of fixed size
    frequent = int(level(np.array([hot]))[0])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        for b in batches:
            hashes, n = _lists(b.column(1))
            for rows, words in _portions(n):
                for columns in first_grams(Places(o.places(hashes[words]), n[rows], o.pivots), b.column(0).to_numpy()[rows], share, frequent):
                    yield _batch(columns, ["key", "rep", "info", "s0", "s1"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Order = order.value
        for b in batches:
            hashes, sizes = _lists(b.column(3))
            for rows, words in _portions(sizes):
                n = sizes[rows]
                places = Places(o.places(hashes[words]), n, o.pivots)
                key, rep, info = (b.column(k).to_numpy()[rows] for k in range(3))
                size, last = info & 255, info >> 36
                count = np.maximum(np.minimum(n - 1, n - _needed(n, share) + size) - last, 0)
                for part in np.split(np.arange(len(n)), np.searchsorted(np.cumsum(count), np.arange(BATCH, int(count.sum()), BATCH))):
                    own, at = _ranges((places.start + last + 1)[part], count[part])
                    own = part[own]
                    yield _batch([_mix(key[own], places.flat[at]), rep[own], _info(size[own] + 1, n[own], places.pos[at]), *places.behind(at)], ["key", "rep", "info", "s0", "s1"])

    grams, tables, found, ended = spread(hashed).mapInArrow(begin, GRAM), [], None, None
    for size in range(2, longest + 1):
        often = grams.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        tables.append(stored(grams.join(often, "key"), "grams"))
        grams = spark.read.parquet(tables[-1])
        met = _met(grams if size == longest else grams.where(F.col("c") <= hot), share)
        found = met if found is None else found.unionByName(met)
        more = grams.where(F.col("c") > hot)
        if size == longest or more.isEmpty():
            break
        enough = _enough(more, share)
        ended = enough if ended is None else ended.unionByName(enough)
        grams = spread(more.select("key", "rep", "info").join(hashed, "rep").select("key", "rep", "info", "hashes")).mapInArrow(extend, GRAM)
    if ended is not None:
        found = found.unionByName(_alike(checkpoint(ended), share))
    found = checkpoint(found.distinct())
    dropped(spark, *tables)
    return found


def _enough(grams: DataFrame, share: float) -> DataFrame:
    """Classes that an n-gram alone may make near-same to another: ``(key, rep, size, n)``."""
    size, n = F.col("info").bitwiseAND(F.lit(255)), F.shiftright("info", 8).bitwiseAND(F.lit((1 << 28) - 1))
    return grams.select("key", "rep", size.alias("size"), n.alias("n")).where(near(F.col("size"), F.col("n"), F.col("size"), share))  # no class has fewer words than the n-gram


def _alike(side: DataFrame, share: float) -> DataFrame:
    """Pairs of classes with a common n-gram that makes them near-same, joined on it and on each size that is near enough: no others meet."""
    num, den = _ratio(share)
    most = F.floor(F.col("size") * (num + den) / num).cast("bigint") - F.col("n")  # words that the larger class has at most
    a = side.where(most >= F.col("n")).select("key", F.col("rep").alias("rep_a"), F.col("n").alias("n_a"), F.explode(F.sequence(F.col("n"), most)).alias("n"))
    met = a.join(side.select("key", F.col("rep").alias("rep_b"), "n"), ["key", "n"]).where((F.col("n_a") < F.col("n")) | (F.col("rep_a") < F.col("rep_b")))
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def _met(grams: DataFrame, share: float) -> DataFrame:
    """Pairs of classes with a common n-gram, after the length, positional and suffix filters."""
    n, last = F.shiftright("info", 8).bitwiseAND(F.lit((1 << 28) - 1)), F.shiftright("info", 36)
    side = grams.select("key", "rep", n.alias("n"), (n - last - 1).alias("left"), F.col("info").bitwiseAND(F.lit(255)).alias("size"), "s0", "s1")
    a, b = (side.select("key", *((F.col("size"),) if s == "a" else ()), *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "left", "s0", "s1"))) for s in "ab")
    ahead = F.lit(0).cast("bigint")
    for column in ("s0", "s1"):
        for k in range(4):
            ahead = ahead + F.least(_part(f"{column}_a", k), _part(f"{column}_b", k))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return (
        a.join(b, "key")
        .where(F.col("rep_a") < F.col("rep_b"))
        .where(near(F.least(n_a, n_b), n_a, n_b, share))  # length
        .where(near(F.col("size") + F.least("left_a", "left_b"), n_a, n_b, share))  # position: the n-gram's words are the first common ones
        .where((F.greatest(n_a, n_b) > LARGE) | near(F.col("size") + ahead, n_a, n_b, share))  # suffix
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )


def verified(pairs: DataFrame, named: DataFrame, share: float = SHARE) -> DataFrame:
    """``(a, b, common, n_a, n_b)`` of the pairs whose whole word sets are near-same."""
    own = named.select("rep", "words")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(own.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("common"), F.size("wa").alias("n_a"), F.size("wb").alias("n_b"))
    return sized.where(near(F.col("common"), F.col("n_a"), F.col("n_b"), share))


def near_duplicates(rows: DataFrame, key: str, text: str, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, rep)`` and verified links ``(a, b, ...)`` between classes."""
    members, named = classes(rows, key, text)
    return members, checkpoint(verified(candidates(named, share), named, share))


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair ``(a, b)``, a < b, of different ids: between linked classes and within a class."""
    crowded = members.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1")
    own = crowded.select(F.col("rep").alias("ra"), F.col("rep").alias("rb"))
    between = links.select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    left, right = members.select(F.col("rep").alias("ra"), F.col("id").alias("x")), members.select(F.col("rep").alias("rb"), F.col("id").alias("y"))
    met = own.unionByName(between).join(left, "ra").join(right, "rb").where((F.col("x") < F.col("y")) | ((F.col("ra") != F.col("rb")) & (F.col("x") > F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per member: its class, its group (connected near-same classes), both named by their least id, and its class's links.

    An id with several texts has a row for each of its classes.
    """
    grouped = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("rep"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    names = members.groupBy("rep").agg(F.min("id").alias("class_id")).join(grouped, "rep", "left").join(degree, "rep", "left")
    names = checkpoint(names.withColumn("component", F.coalesce("component", "rep")))
    groups = names.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return members.join(names.join(groups, "component"), "rep").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
