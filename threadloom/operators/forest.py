"""Parent links to full hierarchies: roots, depths, paths, descendants, loops.

Hash splitters cut every chain into short walks. Each node walks to its next splitter
(or root), the pointer graph between splitters is solved alone, and both are composed.
All walks double their length per round and run as joins, so a chain of any depth takes
a logarithmic number of rounds and no task ever holds a whole tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import id_list, id_number
from threadloom.session import checkpoint

#: One node in so many is a splitter.
SPLIT = 8


def reply_links(messages: DataFrame) -> DataFrame:
    """``(id, parent)`` BIGINT, one row per distinct tweet; parent null where none is named.

    The parent is that of in_response_to_tweet_id; without one, the smallest tweet
    whose response_tweet_id lists this one. Deliveries that disagree: the smallest.
    Rows without a tweet id are no tweets.
    """
    rows = messages.select(id_number(F.col("tweet_id")).alias("id"), id_number(F.col("in_response_to_tweet_id")).alias("up"), F.col("response_tweet_id").alias("list")).where("id is not null")
    none = F.lit(None).cast("bigint")
    listed = rows.where(F.col("list").rlike(r"\d")).select(F.explode(id_list(F.col("list"))).alias("id"), none.alias("up"), F.col("id").alias("lister"), F.lit(0).alias("held"))
    return (
        rows.select("id", "up", none.alias("lister"), F.lit(1).alias("held"))
        .unionByName(listed)
        .groupBy("id")
        .agg(F.min("up").alias("up"), F.min("lister").alias("lister"), F.max("held").alias("held"))
        .where("held = 1")
        .select("id", F.coalesce("up", "lister").alias("parent"))
    )


def is_splitter(c) -> F.Column:
    return F.pmod(F.xxhash64(c), F.lit(SPLIT)) == 0


def _walk(state: DataFrame, stops_at_splitters: bool, paths: bool) -> tuple[DataFrame, DataFrame]:
    """Walk every node to its terminal by doubling; returns (arrived, never arriving).

    ``state``: id, cur, d (steps), low (least id walked over, without cur), done, and
    with ``paths`` way (ids walked over, from the node on). A node that isn't done is at
    least half as far from its terminal after each round, so a round in which no node
    arrives leaves only nodes that lead into loops.
    """
    left = state.where("not done").count()
    while left:
        ahead = state.select(
            F.col("id").alias("cur"), F.col("cur").alias("cur2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("done").alias("done2"), *([F.col("way").alias("way2")] if paths else [])
        )
        # no-one looks up a splitter while walks stop there
        if stops_at_splitters:
            ahead = ahead.where(~is_splitter(F.col("cur")) | (F.col("d2") == 0))
        moved = state.where("not done").join(ahead, "cur").select(
            "id",
            F.col("cur2").alias("cur"),
            (F.col("d") + F.col("d2")).alias("d"),
            F.least("low", "low2").alias("low"),
            F.col("done2").alias("done"),
            *([F.concat("way", F.when(F.col("d2") > 0, F.col("way2")).otherwise(F.array().cast("array<bigint>"))).alias("way")] if paths else []),
        )
        state = checkpoint(state.where("done").unionByName(moved))
        now = state.where("not done").count()
        if now == left:
            break
        left = now
    return state.where("done"), state.where("not done")


def _loops(links: DataFrame, stuck: DataFrame) -> DataFrame:
    """Root (least id of its loop) of each stuck node. ``links``: id, cur, low of the single steps."""
    step = links.join(stuck.select("id"), "id", "left_semi").select("id", "cur", "low")
    far, held = step, -1
    # the nodes that 2^r steps reach only ever get fewer; once as many as after half the steps, they are the loops
    while (now := far.agg(F.count_distinct("cur")).first()[0]) != held:
        held = now
        far = checkpoint(far.select("id", "cur").join(far.select(F.col("id").alias("cur"), F.col("cur").alias("c2")), "cur").select("id", F.col("c2").alias("cur")))
    inside = far.select(F.col("cur").alias("id")).distinct()
    ring = checkpoint(step.join(inside, "id", "left_semi"))
    held, now = None, ring.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]
    # a least id that twice as many steps don't lower is that of the whole loop
    while now != held:
        held = now
        ring = checkpoint(
            ring.join(ring.select(F.col("id").alias("cur"), F.col("cur").alias("c2"), F.col("low").alias("l2")), "cur").select("id", F.col("c2").alias("cur"), F.least("low", "l2").alias("low"))
        )
        now = ring.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]
    return far.select("id", "cur").join(ring.select(F.col("id").alias("cur"), F.col("low").alias("root")), "cur").select("id", "root")


def _steps(links: DataFrame, paths: bool) -> DataFrame:
    """Each node's single step to its parent, with ``paths`` with the id walked over; roots stay where they are."""
    held = links.select(F.col("id").alias("parent"), F.lit(True).alias("held"))
    rooted = links.join(held, "parent", "left").select("id", F.when(F.col("held"), F.col("parent")).alias("nxt"))
    return rooted.select(
        "id",
        F.coalesce("nxt", "id").alias("cur"),
        F.when(F.col("nxt").isNull(), 0).otherwise(1).alias("d"),
        F.col("id").alias("low"),
        (F.col("nxt").isNull() | is_splitter(F.col("nxt"))).alias("done"),
        *([F.when(F.col("nxt").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("id")).alias("way")] if paths else []),
    )


def trees(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hierarchy`` without paths, and each node's short way to its next splitter or root, for ``chains``."""
    return _solve(links, True, False)


def hierarchy(links: DataFrame, paths: bool = False) -> DataFrame:
    """``id, root, depth`` and with ``paths`` also ``path`` (ids from the root to the node).

    ``links``: ``id`` (distinct) and ``parent``, BIGINT. A node whose parent is null or
    absent is a root of depth 0. Nodes in a loop or leading into one have depth -1, as
    root the least id of the loop, and as path themselves alone. Empty input: empty.
    """
    return _solve(links, paths, paths)[0]


def _solve(links: DataFrame, ways: bool, paths: bool) -> tuple[DataFrame, DataFrame]:
    """Hierarchy and ways; only with ``paths`` are ways longer than to the next splitter."""
    links = checkpoint(links)
    empty = F.array().cast("array<bigint>")
    one = checkpoint(_steps(links, ways))
    arrived, lost = _walk(one, True, ways)
    n_lost = not lost.isEmpty()
    cols = ["id", "cur", "d", "low"] + (["way"] if paths else [])
    # the reduced graph: splitters and roots
    reduced = arrived.where(is_splitter(F.col("id")) | (F.col("d") == 0)).select(*cols, (F.col("d") == 0).alias("done"))
    if n_lost:  # loops without a splitter; a splitter that leads into one ends a walk
        tails = checkpoint(_loops(one, lost))
        ends = tails.where(is_splitter(F.col("id"))).select("id", F.col("id").alias("cur"), F.lit(0).alias("d"), F.col("id").alias("low"), *([empty.alias("way")] if paths else []), F.lit(True).alias("done"))
        reduced = reduced.unionByName(ends)
    reduced = checkpoint(reduced)
    solved, ringed = _walk(reduced, False, paths)
    anchors = solved.select(F.col("id").alias("cur"), F.col("cur").alias("root"), F.col("d").alias("above"), *([F.col("way").alias("rest")] if paths else []))
    if n_lost:
        anchors = anchors.join(tails.select(F.col("id").alias("root"), F.col("root").alias("loop")), "root", "left")
        anchors = anchors.withColumn("above", F.when(F.col("loop").isNull(), F.col("above")).otherwise(-1)).withColumn("root", F.coalesce("loop", "root")).drop("loop")
    if not ringed.isEmpty():
        rings = _loops(reduced, ringed)
        anchors = anchors.unionByName(rings.select(F.col("id").alias("cur"), "root", F.lit(-1).alias("above"), *([empty.alias("rest")] if paths else [])))
    depth = F.when(F.col("above") < 0, -1).otherwise(F.col("above") + F.col("d")).cast("int")
    out = arrived.join(anchors, "cur").select(
        "id",
        "root",
        depth.alias("depth"),
        *([F.when(F.col("above") < 0, F.array("id")).otherwise(F.reverse(F.concat("way", "rest", F.array("root")))).alias("path")] if paths else []),
    )
    if n_lost:
        out = out.unionByName(tails.select("id", "root", F.lit(-1).alias("depth"), *([F.array("id").alias("path")] if paths else [])))
    return out, arrived


def chains(arrived: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(root, id)``: every node from each of ``leaves(root, leaf)`` up to its root, one leaf per root.

    ``arrived`` are the ways of ``trees``; only these short ones are ever arrays. The
    splitters above a leaf are marked by steps of halving length, then the ways of the
    marked ones are expanded: the work is that of the links, not of all paths. Leaves must
    not lead into loops.
    """
    arrived = checkpoint(arrived.select("id", "cur", "d", "way"))
    own = arrived.join(leaves.select("root", F.col("leaf").alias("id")), "id")
    jump = arrived.where(is_splitter(F.col("id")) & (F.col("d") > 0)).select("id", "cur")
    jumps, held, n = [], -1, jump.count()
    while n and n != held:  # a round that ends no chain leaves only those of loops
        jumps.append(jump)
        jump = checkpoint(jump.join(jump.select(F.col("id").alias("cur"), F.col("cur").alias("c2")), "cur").select("id", F.col("c2").alias("cur")))
        held, n = n, jump.count()
    marked = own.select("root", F.col("cur").alias("id"))
    for step in reversed(jumps):
        marked = checkpoint(marked.unionByName(marked.join(step, "id").select("root", F.col("cur").alias("id"))).distinct())
    passed = marked.join(arrived.select("id", "way"), "id").select("root", F.explode("way").alias("id"))
    return own.select("root", F.explode("way").alias("id")).unionByName(passed).unionByName(leaves.select("root", F.col("root").alias("id"))).distinct()


def descendants(with_paths: DataFrame) -> DataFrame:
    """``(id, descendant, distance)`` of every proper ancestor; nodes of loops have none."""
    return with_paths.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "id")).where("at < depth").select("id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
