"""Numbers of rows within groups of which some may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import checkpoint

#: Rows that one window sorts at most, but for those of one group and instant.
LIMIT = 100_000


def numbered(rows: DataFrame, sizes: DataFrame, key: str, time: str, ties: list[Column | str], name: str, limit: int = LIMIT) -> DataFrame:
    """``rows`` with their 0-based number in the group ``key``, by ``time`` (null first) and ``ties``.

    ``sizes(key, n)`` says how large the groups are, and should be checkpointed. Groups of
    up to ``limit`` rows are one window each. For larger ones the rows before an hour and
    before an instant are counted, and a window holds one instant only; so is a group that
    holds a third of all rows spread over tasks.
    """
    order = [F.col(time).asc_nulls_first(), *ties]
    plain = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    large = sizes.where(F.col("n") > limit).select(key)
    if large.isEmpty():
        return rows.withColumn(name, plain)
    small = rows.join(large, key, "left_anti").withColumn(name, plain)
    big = rows.join(large, key, "left_semi").withColumn("_hour", F.date_trunc("hour", time))
    instants = big.groupBy(key, "_hour", time).agg(F.count("*").alias("_c"))
    hours = instants.groupBy(key, "_hour").agg(F.sum("_c").alias("_c"))
    up_to = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(F.col(key).alias("_k1"), F.col("_hour").alias("_h1"), up_to(Window.partitionBy(key).orderBy(F.col("_hour").asc_nulls_first())).alias("_b1"))
    instants = instants.select(F.col(key).alias("_k2"), F.col("_hour").alias("_h2"), F.col(time).alias("_t2"), up_to(Window.partitionBy(key, "_hour").orderBy(F.col(time).asc_nulls_first())).alias("_b2"))
    before = instants.join(hours, (F.col("_k1") == F.col("_k2")) & F.col("_h1").eqNullSafe(F.col("_h2"))).select("_k2", "_t2", (F.col("_b1") + F.col("_b2")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, time).orderBy(*ties)) - 1
    met = big.withColumn("_within", within).join(before, (F.col(key) == F.col("_k2")) & F.col(time).eqNullSafe(F.col("_t2")))
    return small.unionByName(met.select(*rows.columns, (F.col("_before") + F.col("_within")).cast("int").alias(name)))


def previous(rows: DataFrame, key: str, time: str, ties: list[Column | str], column: str, name: str, limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``name``, the value of ``column`` in the row before it in its group; null in the first one.

    Groups of up to ``limit`` rows are one window each; in larger ones a row finds the one
    before it by its number.
    """
    order = [F.col(time).asc_nulls_first(), *ties]
    sizes = checkpoint(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit))
    if sizes.isEmpty():
        return rows.withColumn(name, F.lag(column).over(Window.partitionBy(key).orderBy(*order)))
    small = rows.join(sizes.select(key), key, "left_anti").withColumn(name, F.lag(column).over(Window.partitionBy(key).orderBy(*order)))
    big = checkpoint(numbered(rows.join(sizes.select(key), key, "left_semi"), sizes, key, time, ties, "_k", limit))
    before = big.select(key, (F.col("_k") + 1).alias("_k"), F.col(column).alias(name))
    return small.unionByName(big.join(before, [key, "_k"], "left").select(*rows.columns, name))
