"""Hash samples, salted orders, strata with backfill, exact-normal dedupe, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fraction(key: Column) -> Column:
    """The first 32 bits of md5 as a fraction of their largest value."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967295.0


def hash_sample(rows: DataFrame, key: str, percent: float) -> DataFrame:
    return rows.where(fraction(F.col(key).cast("string")) < percent / 100)


def salted_top(rows: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n rows of the least salted hash (a sampling operator)."""
    return rows.withColumn("u", fraction(F.concat(F.col(key).cast("string"), F.lit("|" + salt)))).orderBy("u", key).limit(n)


def stratified_take(rows: DataFrame, key: str, buckets: dict[str, Column], each: int | dict[str, int]) -> DataFrame:
    """Per bucket, in their order, ``each`` rows by key (or a number per bucket and for ``filler``) that no earlier bucket took; the last bucket fills up from the rest.

    A bucket needs at most as many rows by key as it and the earlier ones take, so only those are carried.
    """
    names = [*buckets, "filler"]
    sizes = {n: each for n in names} if isinstance(each, int) else each
    tops, need = [], 0
    for i, (name, test) in enumerate([*buckets.items(), ("filler", F.lit(True))]):
        need += sizes[name]
        tops.append(rows.where(test).orderBy(key).limit(need).select(key, F.lit(i).alias("b")))
    pool = tops[0]
    for t in tops[1:]:
        pool = pool.unionByName(t)  # a few rows from here on
    taken = None
    for i, name in enumerate(names):
        now = pool.where(F.col("b") == i)
        if taken is not None:
            now = now.join(taken.select(key), key, "left_anti")
        now = now.orderBy(key).limit(sizes[name]).select(key, F.lit(name).alias("bucket"))
        taken = now if taken is None else taken.unionByName(now)
    return taken


def dedupe_normal(rows: DataFrame, order: str, text: str) -> DataFrame:
    """The first row of each text that is equal but for case and blanks: ``order, digest, copies``."""
    normal = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")
    return rows.groupBy(F.md5(normal).alias("digest")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def dedupe_stats(kept: DataFrame) -> DataFrame:
    """One row on the result of ``dedupe_normal``: rows in, kept, dropped, and the share dropped."""
    g = kept.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_input"), F.count("*").alias("kept"))
    dropped = F.col("n_input") - F.col("kept")
    return g.select("n_input", "kept", dropped.alias("dropped"), F.round(F.when(F.col("n_input") > 0, dropped / F.col("n_input")).otherwise(F.lit(0.0)), 6).alias("rate"))


def content_hash(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Order-independent digest of ``rows``: the sum of each row's 60-bit hash, and their number.

    Unlike a hash over sorted lines this needs no sort and no task that holds all lines.
    """
    line = F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *columns)))
    return rows.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def latest(rows: DataFrame, key: str, order: str, *carried: str) -> DataFrame:
    """The last row per key of an append-only log, by aggregation; ties take the greatest."""
    return rows.groupBy(key).agg(F.max(F.struct(order, *carried)).alias("r")).select(key, "r.*")


def cache_key(model: Column, version: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\x00"), version, F.lit("\x00"), text), 256)


def lookup(asked: DataFrame, cache: DataFrame, key: str, on_miss: str = "null") -> DataFrame:
    """``asked`` with the cached response; ``on_miss="fail"`` raises where there is none."""
    found = asked.join(cache, key, "left")
    if on_miss == "fail":
        return found.withColumn("response", F.when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("no cached response for "), F.col(key)))).otherwise(F.col("response")))
    return found


def class_share(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Each class's cumulative share of all labelled rows, for draws by prior. Classes are few."""
    c = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(label))
    return c.select(label, (upto / F.sum("n").over(Window.partitionBy())).alias("upto"), ((upto - F.col("n")) / F.sum("n").over(Window.partitionBy())).alias("above"))
