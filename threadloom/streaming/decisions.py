"""Streams: per-message marks, repeat contacts with keyed state, an append-only log kept to its last rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.functions import text as X
from threadloom.operators.sampling import cache_key, latest


def marked(messages: DataFrame) -> DataFrame:
    """Stateless marks of each message; the same plan serves a batch and a stream."""
    t = F.col("text")
    masked, found = X.masked(t)
    return messages.withColumns(
        {
            "masked": masked,
            "patterns": found,
            "injection": X.matches(t, X.any_of(X.INJECTION)),
            "unsafe": X.matches(t, X.any_of(X.SELF_HARM)) | X.matches(t, X.any_of(X.THREAT)) | X.matches(t, X.ABUSE),
            "amounts": X.amounts(t),
        }
    )


def repeat_contacts(messages: DataFrame, days: float = 7.0) -> DataFrame:
    """``author, id, repeated``: whether the author wrote within the window before, by event time.

    State is one instant per author and expires with the window behind the watermark.
    """
    window_us = int(days * 86_400_000_000)

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # an author's rows of one batch; the last instant before each row is a running maximum
        rows = pd.concat(list(frames)).sort_values(["made", "id"])
        now = rows["made"].to_numpy().astype("datetime64[us]").astype(np.int64)
        least = np.iinfo(np.int64).min
        before = np.maximum.accumulate(np.concatenate([[least if last is None else last], now]))
        gap = np.where(before[:-1] == least, -1, now - before[:-1])
        last = int(before[-1])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + window_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"author": key[0], "id": rows["id"].to_numpy(), "repeated": (gap >= 0) & (gap <= window_us)})

    source = messages.select("author", "id", "made").withWatermark("made", f"{int(days * 24)} hours")
    return source.groupBy("author").applyInPandasWithState(step, "author string, id bigint, repeated boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def keep_latest(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each batch's last rows per key to a log; ``read_latest`` reads it.

    Nothing that is there is ever rewritten: every function has a folder of its own, so a
    stream that starts anew keeps the history, and a batch that is run again replaces its
    own part only. Rows that are written twice do no harm, as the last one wins.
    """
    run = f"{path}/run={uuid.uuid4().hex}"

    def merge(batch: DataFrame, epoch: int) -> None:
        carried = [c for c in batch.columns if c not in (key, order)]
        latest(batch, key, order, *carried).write.mode("overwrite").parquet(f"{run}/epoch={epoch}")

    return merge


def read_latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The last row per key over all parts of a log."""
    rows = spark.read.parquet(path).drop("run", "epoch")
    return latest(rows, key, order, *(c for c in rows.columns if c not in (key, order)))


def compact(spark: SparkSession, path: str, key: str, order: str, to: str) -> None:
    """Write the last rows of a log as the first part of a new one."""
    read_latest(spark, path, key, order).write.parquet(f"{to}/run=compact/epoch=0")


def answered(messages: DataFrame, cache: DataFrame, model: str, version: str, text: str = "text") -> DataFrame:
    """Messages with the answers of a cache, one more look for those that can't be read, and an ``error`` instead of a dropped row.

    An answer is read as ``intent, confidence``; where that fails, the answer that the
    cache has for the repair version is read instead (``repair_attempts`` 1). A message
    without a readable answer gets the rest class with confidence 0 and says why. The plan
    is a join with a static table, so it serves a stream as well.
    """
    c = F.col
    keyed = messages.withColumn("_k", cache_key(F.lit(model), F.lit(version), X.text(c(text)))).withColumn("_r", cache_key(F.lit(model), F.lit(version + "/repair"), X.text(c(text))))
    first, second = (cache.select(c("key").alias(k), c("response").alias(r)) for k, r in (("_k", "_a"), ("_r", "_b")))
    met = keyed.join(first, "_k", "left").join(second, "_r", "left")
    bare = lambda x: F.regexp_replace(x, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    a, b = (F.from_json(bare(c(x)), "intent STRING, confidence DOUBLE") for x in ("_a", "_b"))
    again = c("_a").isNotNull() & a["intent"].isNull()
    got = F.when(again, b["intent"]).otherwise(a["intent"])
    error = F.when(c("_a").isNull(), "no cached answer").when(got.isNull(), "unreadable answer")
    confidence = F.coalesce(F.when(again, b["confidence"]).otherwise(a["confidence"]), F.lit(0.0))
    return met.select(*messages.columns, F.coalesce(got, F.lit("other_unclear")).alias("intent"), F.when(error.isNull(), confidence).otherwise(F.lit(0.0)).alias("confidence"), again.cast("int").alias("repair_attempts"), error.alias("error"))
