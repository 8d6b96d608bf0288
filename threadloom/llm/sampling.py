"""A sample that any rerun, partitioning or later record leaves in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import id_number, tidy_label

SALT = "stable-sample-1"
RATE = 0.1


def unit(key: Column, salt: str = SALT) -> Column:
    """The salted hash of a key in [0, 1): 52 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def stable_sample(records: DataFrame, rate: float = RATE, rates: dict[str, float] | None = None, salt: str = SALT) -> DataFrame:
    """``stratum, conversation, message_id, u`` of the sampled records, one row per message.

    A conversation is in if the hash of its id is below the highest rate among the strata
    of its records, so it is in as a whole, and later records can only let it in. The
    first logged row of a message decides its conversation and stratum; a message whose
    conversation is null or no number stands for itself. Strata are compared in one
    spelling; none is ``none``. Rows without a message id are no records.
    """
    number = id_number(F.col("conversation_id"))
    own = F.coalesce(number.cast("string"), F.concat(F.lit("message:"), F.col("message_id")))
    first = (
        records.where(F.col("message_id").isNotNull())
        .select("message_id", "logged_at", own.alias("conversation"), F.coalesce(tidy_label(F.col("stratum")), F.lit("none")).alias("stratum"))
        .groupBy("message_id")
        # nulls last, then the least; aggregates only, so a message with a third of all rows is no hot group
        .agg(F.min(F.struct(F.col("logged_at").isNull(), "logged_at", "conversation", "stratum")).alias("r"))
        .select("message_id", "r.conversation", "r.stratum")
    )
    u = unit(F.col("conversation"), salt)
    if not rates:
        return first.withColumn("u", u).where(F.col("u") < rate)
    of = F.coalesce(*(F.when(F.col("stratum") == k, F.lit(v)) for k, v in rates.items()), F.lit(rate))
    sampled = first.withColumn("u", u).withColumn("rate", of)
    kept = sampled.where(F.col("u") < F.col("rate")).select("conversation").distinct()
    return sampled.where(F.col("u") < max(rate, *rates.values())).join(kept, "conversation", "left_semi").drop("rate").select("message_id", "conversation", "stratum", "u")
