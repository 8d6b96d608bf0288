"""Messages and reply threads: one row per tweet, root-to-leaf branches, turn order, precedents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.keys import id_number, instant, tidy_label
from threadloom.operators.forest import chains, hierarchy, trees
from threadloom.operators.order import LIMIT, numbered, previous
from threadloom.session import checkpoint


def deliveries_once(messages: DataFrame) -> DataFrame:
    """``id, author, inbound, made, text, up``: of each tweet the first delivery (nulls last, then the least text)."""
    at, t = F.col("ingested_at"), F.col("text")
    row = F.struct(at.isNull(), at, t.isNull(), t, F.col("author_id").alias("author"), tidy_label(F.col("inbound")).alias("inbound"), instant(F.col("created_at")).alias("made"))
    return (
        messages.select(id_number(F.col("tweet_id")).alias("id"), id_number(F.col("in_response_to_tweet_id")).alias("up"), row.alias("r"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("r").alias("r"), F.min("up").alias("up"))
        .select("id", "r.author", (F.col("r.inbound") == "true").alias("inbound"), "r.made", "r.text", "up")
    )


def reply_roots(once: DataFrame) -> DataFrame:
    """``id, is_root``: no parent is named, or the named one is absent."""
    held = once.select(F.col("id").alias("up"), F.lit(True).alias("held"))
    return once.join(held, "up", "left").select("id", F.col("held").isNull().alias("is_root"))


def branches(once: DataFrame) -> DataFrame:
    """One row per root-to-leaf path: ``root, leaf, length, path`` (ids); loops have none."""
    tree = hierarchy(once.select("id", F.col("up").alias("parent")), paths=True)
    parents = once.select(F.col("up").alias("id")).where("id is not null").distinct()
    return tree.where("depth >= 0").join(parents, "id", "left_anti").select("root", F.col("id").alias("leaf"), (F.col("depth") + 1).alias("length"), "path")


def best_leaves(once: DataFrame, tree: DataFrame) -> DataFrame:
    """``root, leaf, length, brand_last``: per root of ``tree(id, root, depth)`` the leaf that ends with a brand, else the deepest, else the least. No paths are built."""
    parents = once.select(F.col("up").alias("id")).where("id is not null").distinct()
    ends = tree.where("depth >= 0").join(parents, "id", "left_anti").join(once.select("id", (~F.coalesce("inbound", F.lit(False))).cast("int").alias("brand_last")), "id")
    row = F.struct(F.col("id").alias("leaf"), (F.col("depth") + 1).alias("length"), "brand_last")
    return ends.groupBy("root").agg(F.max_by(row, F.struct("brand_last", "depth", -F.col("id"))).alias("b")).select("root", "b.*")


def ordered_turns(best: DataFrame, ways: DataFrame, once: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``root, turn, id, author, inbound, made, text, follow, last``: turns by time and id, runs of one author and instant by part number.

    ``best(root, leaf, length)`` are the chosen branches, ``ways`` those of ``forest.trees``.
    ``follow`` is the text of the next turn, ``last`` says that there is none. Threads
    whose first turn isn't a customer's or that no brand takes part in are left out.

    Runs lie within one instant of a thread, and so do their windows. As long as no thread
    has more than ``limit`` turns, rows are dealt by thread once and every window finds them
    in place; else none but the numbers of small threads relies on a window over a thread.
    """
    large = not best.where(F.col("length") > limit).isEmpty()
    turns = chains(ways, best).join(once.drop("up"), "id")
    if not large:
        turns = turns.repartition("root")
    instant_ = Window.partitionBy("root", "made").orderBy("id")
    new = (~F.col("author").eqNullSafe(F.lag("author").over(instant_)) | F.lag("id").over(instant_).isNull()).cast("int")
    runs = turns.withColumn("new", new).withColumn("part", X.part(F.col("text")))
    runs = runs.withColumn("run", F.sum("new").over(instant_.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy("root", "made", "run")
    marked = (F.count("*").over(one) > 1) & F.max("part").over(one).isNotNull()
    ranked = runs.withColumn("slot", F.when(marked, F.coalesce("part", F.lit(1_000_000))).otherwise(0))
    opener, answered = F.max(F.when((F.col("turn") == 0) & F.col("inbound"), 1)), F.max((~F.coalesce("inbound", F.lit(False))).cast("int"))
    names = ["root", "turn", "id", "author", "inbound", "made", "text", "follow", "last"]
    if not large:
        by = Window.partitionBy("root").orderBy(F.col("made").asc_nulls_first(), "run", "slot", "id")
        out = ranked.withColumn("turn", F.row_number().over(by) - 1).withColumn("follow", F.lead("text").over(by)).withColumn("last", F.lead("id").over(by).isNull())
        whole = Window.partitionBy("root")
        return out.withColumn("o", opener.over(whole)).withColumn("a", answered.over(whole)).where("o = 1 and a = 1").select(names)
    out = checkpoint(numbered(ranked, best.select("root", F.col("length").alias("n")), "root", "made", ["run", "slot", "id"], "turn", limit))
    kept = out.groupBy("root").agg(opener.alias("o"), answered.alias("a")).where("o = 1 and a = 1").select("root")
    nxt = out.select("root", (F.col("turn") - 1).alias("turn"), F.col("text").alias("follow"), F.lit(True).alias("more"))
    return out.join(kept, "root", "left_semi").join(nxt, ["root", "turn"], "left").withColumn("last", F.col("more").isNull()).select(names)


def threads(messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    once = checkpoint(deliveries_once(messages))
    tree, ways = trees(once.select("id", F.col("up").alias("parent")))
    return ordered_turns(checkpoint(best_leaves(once, tree)), ways, once, limit)


def resolutions(turns: DataFrame) -> DataFrame:
    """``root, brand, confirmed``: per thread its first brand turn with a step, and whether the next turn confirms it."""
    t = turns.where(~F.coalesce("inbound", F.lit(False))).where(X.resolves(F.col("text")))
    ok = t.withColumn("confirmed", ~F.col("last") & X.matches(F.col("follow"), X.CONFIRMATION))
    return ok.groupBy("root").agg(F.min_by(F.struct("author", "confirmed"), "turn").alias("r")).select("root", F.col("r.author").alias("brand"), "r.confirmed")


def precedents(turns: DataFrame) -> DataFrame:
    """Per thread its first brand turn that resolves (with a follow-up: that is confirmed)."""
    follow_up = F.when(~F.col("last"), X.text(F.col("follow")))
    ok = ~F.coalesce("inbound", F.lit(False)) & X.resolves(F.col("text"), follow_up)
    # only openers and resolving turns meet the aggregate
    some = turns.withColumn("ok", F.coalesce(ok, F.lit(False))).where("ok or turn = 0")
    first = F.min_by(F.struct("id", "author", "text", (~F.col("last")).alias("confirmed")), F.when(F.col("ok"), F.col("turn"))).alias("p")
    per = some.groupBy("root").agg(first, F.max(F.when(F.col("turn") == 0, X.text(F.col("text")))).alias("asked")).where("p is not null")
    return per.select(
        F.concat(F.lit("t_"), F.col("p.id").cast("string")).alias("evidence_id"), F.col("root").cast("string").alias("conversation_id"), X.normalise(F.col("asked")).alias("customer_text"), X.normalise(F.col("p.text")).alias("brand_reply"), F.col("p.author").alias("brand"), "p.confirmed"
    )


def repeat_contacts(once: DataFrame, days: float = 7.0, limit: int = LIMIT) -> DataFrame:
    """Customer messages with the days since the same author's last one, and whether that is within the window."""
    asked = once.where("inbound and made is not null and author is not null").select("id", "author", "made")
    held = previous(asked, "author", "made", ["id"], "made", "before", limit)
    gap = (F.unix_micros("made") - F.unix_micros("before")) / F.lit(86_400_000_000.0)
    return held.select("id", F.round(gap, 6).alias("gap_days"), F.coalesce(gap <= days, F.lit(False)).alias("repeated"))
