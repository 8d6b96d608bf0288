"""References and hierarchies against plain Python on small fixtures."""

import datetime as dt
import random

import pytest

from threadloom.functions.keys import id_list, id_number, instant, tidy_label
from threadloom.operators import forest, references

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, ingested_at timestamp"


def at(minute):
    return dt.datetime(2020, 1, 1, 0, minute, tzinfo=dt.timezone.utc)


def row(i, up=None, down=None, minute=0):
    return (i, "1", "True", "Tue Oct 31 22:10:47 +0000 2017", "x", down, up, at(minute) if minute is not None else None)


def test_keys(spark):
    df = spark.createDataFrame([(" 12 ",), ("12.0",), ("nan",), ("",), (None,), ("x1",), ("12.",)], "s string")
    assert [r[0] for r in df.select(id_number(df.s)).collect()] == [12, 12, None, None, None, None, 12]
    lists = spark.createDataFrame([("1, 2.0,,nan,2",), (None,)], "s string")
    assert [r[0] for r in lists.select(id_list(lists.s)).collect()] == [[1, 2], []]
    times = spark.createDataFrame([("Mon Nov 27 20:10:40 +0100 2017",), ("2017-11-27T19:10:40Z",), ("0000-00-00",), ("n/a",), (None,)], "s string")
    got = [r[0] for r in times.selectExpr("s").select(instant(times.s).cast("string")).collect()]
    assert got == ["2017-11-27 19:10:40", "2017-11-27 19:10:40", None, None, None]
    labels = spark.createDataFrame([(" Policy-Trap",), ("policy_trap",), (" ",), (None,)], "s string")
    assert [r[0] for r in labels.select(tidy_label(labels.s)).collect()] == ["policy_trap", "policy_trap", None, None]


def test_references(spark):
    rows = [row("1", None, "2, 9", 5), row("2", "1.0", None, 1), row(" 2", "1", None, 3), row("3", "8", None, 2), row("4", "7", "nan", None), row(None, "5"), row("5", "2", None, 9)]
    twcs = spark.createDataFrame(rows, RAW)
    gone = spark.createDataFrame([("7", at(1), None), ("5", at(1), "x"), (None, None, None)], "tweet_id string, deleted_at timestamp, reason string")
    got = {(r.tweet_id, r.ref_field, r.ref_tweet_id, r.ref_state) for r in references.orphan_references(twcs, gone).collect()}
    up, down = references.REPLY, references.LIST
    assert got == {(1, down, 9, "missing"), (2, up, 1, "late"), (3, up, 8, "missing"), (4, up, 7, "deleted")}
    counts = {(r.ref_field, r.ref_state): r.n for r in references.orphan_counts(twcs, gone).collect()}
    assert counts[(up, "late")] == 1
    assert references.orphan_references(twcs.limit(0), gone.limit(0)).count() == 0


def test_references_with_extra_columns(spark):
    twcs = spark.createDataFrame([(*row("3", "8"), "a", 1)], RAW + ", held string, key int")
    gone = spark.createDataFrame([("8", 1)], "tweet_id string, held int")
    assert [r.ref_state for r in references.orphan_references(twcs, gone).collect()] == ["deleted"]


def walk(links):
    """(root, depth) of each node by walking alone."""
    out = {}
    for n in links:
        x, seen = n, []
        while True:
            if x in seen:
                out[n] = (min(seen[seen.index(x) :]), -1)
                break
            seen.append(x)
            p = links[x]
            if p is None or p not in links:
                out[n] = (x, len(seen) - 1)
                break
            x = p
    return out


@pytest.mark.parametrize("kind", ["chain", "loops", "mixed", "one", "empty"])
def test_hierarchy(spark, kind):
    rnd = random.Random(kind)
    if kind == "chain":
        links = {i: i - 1 if i else None for i in range(400)}
    elif kind == "loops":  # small loops without a splitter, long ones with some, tails into both, a loop of one
        links = {i: (i + 1) % 3 for i in range(3)} | {3: 0, 4: 3, 5: 5, 6: 5} | {10 + i: 10 + (i + 1) % 60 for i in range(60)} | {100 + i: 99 + i if i else 12 for i in range(40)}
    elif kind == "mixed":
        links = {i: rnd.choice([None, rnd.randrange(600), rnd.randrange(300), 9999]) for i in range(300)}
    else:
        links = {7: 7} if kind == "one" else {}
    df = spark.createDataFrame(list(links.items()), "id bigint, parent bigint")
    got = forest.hierarchy(df, paths=True).collect()
    assert {r.id: (r.root, r.depth) for r in got} == walk(links)
    assert len(got) == len(links)
    for r in got:
        if r.depth >= 0:
            assert r.path[0] == r.root and r.path[-1] == r.id and all(links[b] == a for a, b in zip(r.path, r.path[1:])) and len(r.path) == r.depth + 1
        else:
            assert r.path == [r.id]


def test_reply_links(spark):
    twcs = spark.createDataFrame([row("1", None, "2,3"), row("2", "5"), row("3"), row("4", None, "3"), row("1 ", None, "2,3")], RAW)
    assert {r.id: r.parent for r in forest.reply_links(twcs).collect()} == {1: None, 2: 5, 3: 1, 4: None}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2)], "id bigint, parent bigint")
    got = {(r.id, r.descendant, r.distance) for r in forest.descendants(forest.hierarchy(df, paths=True)).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)}


def test_hybrid_fusion_ranks_the_whole_class(spark, tmp_path):
    from threadloom.plans.evaluation import hybrid_fusion

    rows = [(0, [1.0, 0.0], 1), *((i, [1.0 - i / 1000, 0.0], 2) for i in range(1, 50)), *((i, [0.9, 0.0], None) for i in range(51, 56)), *((i, [-i / 1000, 0.0], 1) for i in range(101, 111))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r.id for r in hybrid_fusion(spark, str(tmp_path)).where("q = 0").orderBy("fused_rank").collect()]
    # the class lies beyond the nearest 50, and its rank n counts as much as rank n of all; ties by the id as text
    assert got == [1, 101, 102, 2, 103, 3, 104, 4, 105, 5]


def test_cluster_stability_takes_the_best_mean(spark):
    from threadloom.operators.models import cluster_stability

    rnd = random.Random(4)
    rows = [(i, [100.0 * (i % 2) + rnd.random(), rnd.random()]) for i in range(60)]
    got = cluster_stability(spark.createDataFrame(rows, "id bigint, v array<double>"), (5, 2, 70), 2).collect()
    assert [r.k for r in got] == [5, 2, 70] and [r.best for r in got] == [False, True, False]
    assert 0 < got[0].ari < got[1].ari == 1.0 and got[2].ari == 0.0
