"""Ordered conversations from message rows without conversation ids.

A conversation is a connected component over the reply links, found by alternating
large-star and small-star rounds, each a join of edge rows with one minimum per node: a
component of any size or depth is only ever a set of edge rows. The turns of a
component are then validated by aggregates; those of a large one are numbered per
instant, so that a component with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import id_number, instant, tidy_label
from threadloom.operators.order import LIMIT, numbered
from threadloom.session import checkpoint


def _fingerprint(edges: DataFrame):
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least id of the component of each node of ``edges(u, v)``.

    Self-loops and repeated edges add nothing; no edges, no rows.
    """
    edges = checkpoint(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(edges)
    while seen[0]:
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("u").alias("x"), F.col("v").alias("u")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e"))
        edges = checkpoint(small.select("e.u", "e.v").distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: A part number such as 1/3, (2 of 3) or [2/2], also with a signature directly after it.
_START = r"^\s*(?:@\w+\s+)*[(\[]?(\d{1,3})\s?(?:/|of)\s?(\d{1,3})(?![\d]|/\d)[)\]]?(?=$|[\s^~*/:.,\-])"
_END = r"(?:^|[\s.!?])[(\[]?(\d{1,3})\s?(?:/|of)\s?(\d{1,3})[)\]]?[\s.!?\-]*(?:[\^~*/\-]\s?[A-Za-z]{1,3})?\s*(?:https?://\S+)?\s*$"


def part_number(text: Column) -> Column:
    """The part number at the start or else the end of a text; null where there is none or it exceeds its total."""

    def read(pattern: str) -> Column:
        n, of = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2))
        return F.when((n >= 1) & (n <= of), n)

    return F.when(text.rlike(r"\d\s?(?:/|of)\s?\d"), F.coalesce(read(_START), read(_END)))


def speaker(inbound: Column, author: Column) -> Column:
    """``customer`` or ``brand`` by the inbound mark, else by the author: a number is a customer's; null where neither tells."""
    said = tidy_label(inbound)
    kind = F.when(author.rlike(r"^\s*\d+(\.\d*)?\s*$"), "customer").when(author.rlike(r"\S"), "brand")
    return F.when(said.isin("true", "t", "1", "yes"), "customer").when(said.isin("false", "f", "0", "no"), "brand").otherwise(kind)


def messages_once(messages: DataFrame) -> DataFrame:
    """One row per tweet id: ``id, up, made, part, who, spoken``. Deliveries that disagree: the least readable value."""
    text = F.col("text")
    return (
        messages.select(
            id_number(F.col("tweet_id")).alias("id"),
            id_number(F.col("in_response_to_tweet_id")).alias("up"),
            instant(F.col("created_at")).alias("made"),
            part_number(text).alias("part"),
            speaker(F.col("inbound"), F.col("author_id")).alias("who"),
            F.coalesce(text.rlike(r"(?U)[^\s]"), F.lit(False)).alias("spoken"),
        )
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("up").alias("up"), F.min("made").alias("made"), F.min("part").alias("part"), F.min("who").alias("who"), F.max("spoken").alias("spoken"))
    )


def _labelled(messages: DataFrame) -> DataFrame:
    once = checkpoint(messages_once(messages))
    labels = components(once.where("up is not null").select(F.col("id").alias("u"), F.col("up").alias("v")))
    return once.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _judged(labelled: DataFrame) -> DataFrame:
    """Per component: its tweet without a reply link, and why it can't be kept (null: kept)."""
    order = F.struct("made", F.coalesce("part", F.lit(1 << 30)).alias("part"), "id")
    per = labelled.groupBy("component").agg(
        F.min(F.when(F.col("up").isNull(), F.col("id"))).alias("conversation"),
        F.count("*").alias("tweets"),
        F.count_if(F.col("made").isNull()).alias("undated"),
        F.count_if("spoken").alias("turns"),
        F.count_if(F.col("spoken") & (F.col("who") == "brand")).alias("answers"),
        F.min_by(F.when(F.col("spoken"), F.col("who")), F.when(F.col("spoken"), order)).alias("opener"),
    )
    why = (
        F.when(F.col("conversation").isNull(), "broken_link")
        .when(F.col("undated") > 0, "unreadable_time")
        .when(F.col("turns") == 0, "empty")
        .when(F.coalesce(F.col("opener") != "customer", F.lit(True)), "not_opened_by_customer")
        .when(F.col("answers") == 0, "unanswered")
    )
    return per.withColumn("dropped", why)


def rebuild(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``conversation_id, turn_no, tweet_id`` (BIGINT ids), ``speaker, made`` of the kept conversations.

    Kept: the component holds a tweet without reply link (so none leads to an absent tweet
    or a loop), every tweet's creation can be read, the first turn is a customer's and
    some turn a brand's. Turns are tweets with text, by instant, part number (none last)
    and tweet id. Rows without a tweet id belong to no conversation; a tweet delivered
    several times is one turn; an empty table gives no rows.
    """
    labelled = checkpoint(_labelled(messages))
    kept = checkpoint(_judged(labelled).where("dropped is null").select("component", "conversation", "turns"))
    turns = labelled.where("spoken").join(kept.drop("turns"), "component").select("conversation", "made", F.coalesce("part", F.lit(1 << 30)).alias("part"), "id", "who")
    out = numbered(turns, kept.select("conversation", F.col("turns").alias("n")), "conversation", "made", ["part", "id"], "turn_no", limit)
    return out.select(F.col("conversation").alias("conversation_id"), F.col("turn_no").cast("int").alias("turn_no"), F.col("id").alias("tweet_id"), F.col("who").alias("speaker"), "made")


def outcome_counts(messages: DataFrame) -> DataFrame:
    """``outcome, conversations, tweets``: kept, or why not."""
    judged = _judged(_labelled(messages))
    return judged.groupBy(F.coalesce("dropped", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("conversations"), F.sum("tweets").alias("tweets"))
