"""References to rows that are absent, deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import id_list, id_number, instant
from threadloom.session import checkpoint

REPLY, LIST = "in_response_to_tweet_id", "response_tweet_id"


def _referring(messages: DataFrame) -> DataFrame:
    """One row per tweet: first arrival, first readable creation, its references of either field."""
    rows = messages.select(
        id_number(F.col("tweet_id")).alias("tweet"),
        F.col("ingested_at").alias("at"),
        instant(F.col("created_at")).alias("made"),
        id_number(F.col(REPLY)).alias("up"),
        F.when(F.col(LIST).rlike(r"\d"), F.col(LIST)).alias("down"),
    ).where(F.col("tweet").isNotNull())
    return rows.groupBy("tweet").agg(
        F.min("at").alias("at"), F.min("made").alias("made"), F.collect_set("up").alias("up"), F.collect_set("down").alias("down")
    )


def _children(messages: DataFrame) -> DataFrame:
    """``tweet, at, made, field, key``: every reference, each list member apart."""
    refs = _referring(messages)
    return refs.select(
        "tweet",
        "at",
        "made",
        F.explode(
            F.concat(
                F.transform("up", lambda x: F.struct(F.lit(REPLY).alias("field"), x.alias("key"))),
                F.transform(F.array_distinct(F.flatten(F.transform("down", id_list))), lambda x: F.struct(F.lit(LIST).alias("field"), x.alias("key"))),
            )
        ).alias("ref"),
    ).select("tweet", "at", "made", "ref.field", "ref.key")


def orphan_references(messages: DataFrame, deletions: DataFrame) -> DataFrame:
    """Every reference whose target is deleted, missing or (replies only) late.

    Parent keys, deleted keys and child keys are unioned in long form and grouped by
    key; the flags of a group are aggregates, so a key that a third of all rows name
    costs one row per map task. Only groups that lack a parent, are deleted or have an
    earlier child are joined back to their references.

    Result: ``tweet_id, ref_field, ref_tweet_id`` (BIGINT), ``ref_state, made``; rows
    are distinct. Rows without a tweet id refer to nothing; a null ``ingested_at`` is
    never late; repeated deliveries of a tweet count once, from its first arrival.
    """
    child = _children(messages)
    key = id_number(F.col("tweet_id")).alias("key")
    none = F.lit(None).cast("timestamp")
    tagged = (
        messages.select(key, F.lit(1).alias("held"), F.lit(0).alias("gone"), F.col("ingested_at").alias("held_at"), none.alias("named_at"), F.lit(0).alias("named"))
        .unionByName(deletions.select(key, F.lit(0).alias("held"), F.lit(1).alias("gone"), none.alias("held_at"), none.alias("named_at"), F.lit(0).alias("named")))
        .unionByName(
            child.select(
                "key", F.lit(0).alias("held"), F.lit(0).alias("gone"), none.alias("held_at"), F.when(F.col("field") == REPLY, F.col("at")).alias("named_at"), F.lit(1).alias("named")
            )
        )
    )
    groups = (
        tagged.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(*(F.max(x).alias(x) for x in ("held", "gone", "named")), F.min("held_at").alias("held_at"), F.min("named_at").alias("named_at"))
        .where("named = 1 and (gone = 1 or held = 0 or held_at > named_at)")
        .select("key", "held", "gone", "held_at")
    )
    state = F.when(F.col("gone") == 1, "deleted").when(F.col("held") == 0, "missing").when((F.col("field") == REPLY) & (F.col("held_at") > F.col("at")), "late")
    return (
        child.join(groups, "key")
        .select(F.col("tweet").alias("tweet_id"), F.col("field").alias("ref_field"), F.col("key").alias("ref_tweet_id"), state.alias("ref_state"), "made")
        .where(F.col("ref_state").isNotNull())
    )


def orphan_counts(messages: DataFrame, deletions: DataFrame) -> DataFrame:
    """``ref_field, ref_state, month, n`` of all orphan references, by the month in which the referring tweet was made (null: unreadable).

    References are counted per key, field and month before they meet their parents, and
    the counts of groups that lack a parent are summed; references are joined back one by
    one only for keys that arrived after one of them.
    """
    child = _children(messages)
    key, none = id_number(F.col("tweet_id")).alias("key"), F.lit(None)
    month = F.date_format("made", "yyyy-MM").alias("month")
    per = child.groupBy("key", "field", month).agg(F.count("*").alias("n"), F.min(F.when(F.col("field") == REPLY, F.col("at"))).alias("named_at"))
    ref = F.struct("field", "month", "n")
    no_ref = F.when(F.lit(False), F.struct(F.lit("").alias("field"), none.cast("string").alias("month"), F.lit(0).cast("bigint").alias("n")))
    tagged = (
        messages.select(key, F.lit(1).alias("held"), F.lit(0).alias("gone"), F.col("ingested_at").alias("held_at"), none.cast("timestamp").alias("named_at"), no_ref.alias("ref"))
        .unionByName(deletions.select(key, F.lit(0).alias("held"), F.lit(1).alias("gone"), none.cast("timestamp").alias("held_at"), none.cast("timestamp").alias("named_at"), no_ref.alias("ref")))
        .unionByName(per.select("key", F.lit(0).alias("held"), F.lit(0).alias("gone"), none.cast("timestamp").alias("held_at"), "named_at", ref.alias("ref")))
    )
    # a key's counts are at most two per month
    groups = tagged.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("held").alias("held"), F.max("gone").alias("gone"), F.min("held_at").alias("held_at"), F.min("named_at").alias("named_at"), F.collect_list("ref").alias("refs"))
    groups = checkpoint(groups.where((F.size("refs") > 0) & ((F.col("gone") == 1) | (F.col("held") == 0) | (F.col("held_at") > F.col("named_at")))))
    state = F.when(F.col("gone") == 1, "deleted").when(F.col("held") == 0, "missing")
    whole = groups.select(state.alias("ref_state"), F.explode("refs").alias("r")).where("ref_state is not null").select(F.col("r.field").alias("ref_field"), "ref_state", F.col("r.month").alias("month"), F.col("r.n").alias("n"))
    after = groups.where("gone = 0 and held = 1").select("key", "held_at")
    late = child.where(F.col("field") == REPLY).join(after, "key").where(F.col("held_at") > F.col("at")).select(F.lit(REPLY).alias("ref_field"), F.lit("late").alias("ref_state"), month, F.lit(1).cast("bigint").alias("n"))
    return whole.unionByName(late).groupBy("ref_field", "ref_state", "month").agg(F.sum("n").alias("n"))
