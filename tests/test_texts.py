"""Text expressions, threads and statistics on worked examples."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import messages as M
from threadloom.operators import retrieval as R
from threadloom.operators import sampling as H
from threadloom.operators import stats as S


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_normalise(spark):
    cases = ["@amy see https://t.co/x  now ^SM", "1/3 hello /AL", "www.a.b ok ~AT *AMV", None, "", "  a\n b "]
    assert column(spark, cases, X.normalise) == ["@user see [URL] now", "hello", "[URL] ok", "", "", "a b"]


def test_masks(spark):
    cases = ["mail a.b@c.de or +1 312 555 0143", "order 123-1234567-1234567", "card 4111 1111 1111 1111", "none", None]
    assert column(spark, cases, lambda c: F.array_join(X.masked(c)[1], ",")) == ["email,phone", "order_number", "card_like", "", ""]
    assert column(spark, cases[:1], lambda c: X.masked(c)[0]) == ["mail <EMAIL> or <PHONE>"]


def test_markers(spark):
    assert column(spark, ["I have an issue", "I will sue", None], lambda c: X.matches(c, X.any_word(X.LEGAL))) == [False, True, False]
    assert column(spark, ["costs $1,250.50 or £3", "x"], X.amounts) == [[1250.5, 3.0], []]
    assert column(spark, ["Did you try?", "Which device?", "", None], lambda c: X.resolves(c)) == [True, False, False, False]


def test_commitments(spark):
    c = {k: column(spark, ["We refunded $12.50 within 2 business weeks. We'll escalate this"], lambda t, k=k: X.commitments(t)[k])[0] for k in ("refund_offered", "refund_window_days", "compensation_amount", "promised_timeline", "escalation_promise")}
    assert c == {"refund_offered": True, "refund_window_days": 14, "compensation_amount": 12.5, "promised_timeline": "2 business weeks", "escalation_promise": "We'll escalate"}


def test_branches_and_order(spark):
    t = lambda s: f"Tue Oct 31 22:10:{s:02d} +0000 2017"
    rows = [
        ("1", "77", "True", t(0), "my app fails", None, None),
        ("2", "Acme", "False", t(5), "3/3 then reset it", None, "1"),
        ("3", "Acme", "False", t(5), "1/3 Hello", None, "2"),
        ("4", "Acme", "False", t(5), "2/3 go to settings", None, "3"),
        ("5", "77", "True", t(9), "that worked", None, "4"),
        ("6", "77", "True", t(9), "another", None, "1"),
        ("8", "77", "True", t(1), "lost", None, "99"),
    ]
    raw = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, ingested_at timestamp"
    df = spark.createDataFrame([(*r, dt.datetime(2020, 1, 1)) for r in rows], raw)
    once = M.deliveries_once(df)
    assert {r.id for r in M.reply_roots(once).where("is_root").collect()} == {1, 8}
    paths = M.branches(once)
    assert {tuple(r.path) for r in paths.collect()} == {(1, 2, 3, 4, 5), (1, 6), (8,)}
    turns = M.threads(df)
    assert [r.id for r in turns.where("root = 1").orderBy("turn").collect()] == [1, 3, 4, 2, 5]
    split = M.threads(df, 1)  # every thread as if it were a large one
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, turns.collect()), key=str)
    assert sorted(map(tuple, M.precedents(split).collect())) == sorted(map(tuple, M.precedents(turns).collect()))
    p = M.precedents(turns).collect()
    assert [(r.evidence_id, r.confirmed) for r in p] == [("t_2", True)]
    assert M.threads(df.limit(0)).count() == 0


def test_wilson(spark):
    df = spark.createDataFrame([(78, 100), (25, 25), (0, 0)], "k int, n int")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    got = [tuple(round(x, 3) for x in r) for r in df.select(lo, hi).collect()]
    assert got == [(0.689, 0.85), (0.867, 1.0), (0.0, 1.0)]


def test_mcnemar(spark):
    df = spark.createDataFrame([(27, 13), (26, 14), (32, 15), (14, 14), (0, 0)], "b int, c int")
    chi, p = S.mcnemar(F.col("b"), F.col("c"))
    assert [(round(r[0], 4), round(r[1], 4)) for r in df.select(chi, p).collect()] == [(4.225, 0.0398), (3.025, 0.0820), (5.4468, 0.0196), (0.0357, 0.8501), (0.0, 1.0)]


def test_holm_stops(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "name string, p double")
    assert {r.name: r.rejected for r in S.holm(df).collect()} == {"a": True, "d": True, "c": False, "b": False}


def test_kappa_paradox(spark):
    df = spark.createDataFrame([(True, True)] * 5 + [(True, False)] * 5 + [(False, True)] * 5 + [(False, False)] * 185, "a boolean, b boolean")
    r = S.agreement(df, F.col("a"), F.col("b")).first()
    assert (r.p0, r.kappa, r.pabak) == (0.95, 0.473684, 0.9)


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "app error 503"), (2, "app works"), (3, "app fine"), (4, "app ok app"), (5, None)], "id int, t string")
    q = spark.createDataFrame([(9, "app 503")], "q int, qt string")
    assert [r.id for r in R.bm25_topk(docs, "id", "t", q, "q", "qt", 10).collect()] == [1]


@pytest.mark.parametrize("frequent", [3, 50])
def test_bm25_lists_equal_brute_force(spark, monkeypatch, frequent):
    """Frequent terms are left out of the join only where they can't change the list."""
    monkeypatch.setattr(R, "FREQUENT", frequent)
    rnd = random.Random(frequent)
    vocabulary = [f"t{i}" for i in range(60)]
    draw = lambda n: [vocabulary[min(59, int(rnd.expovariate(0.12)))] for _ in range(n)]
    docs = {i: draw(rnd.randrange(0, 25)) for i in range(250)}
    asked = {i: docs[i] for i in range(0, 250, 10)}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for w in docs.values() for t in set(w))
    want = set()
    for q, terms in asked.items():
        score = {}
        for d, w in docs.items():
            tf, s = Counter(w), 0.0
            for t in terms:
                if tf[t] and (idf := math.log((n - df[t] + 0.5) / (df[t] + 0.5))) > 0:
                    s += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean))
            if s and d != q:
                score[d] = round(s, 6)
        want |= {(q, d, s, k + 1) for k, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id int, t string")
    got = R.bm25_topk(table, "id", "t", table.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("t").alias("qt")), "q", "qt", 5).collect()
    assert {(r.q, r.id, r.score, r["rank"]) for r in got} == want


def test_bm25_pairs_are_no_rows(spark, monkeypatch):
    """No checkpoint holds more rows than queries have terms or results, though every query meets nearly every document; slices and blocks change nothing."""
    rnd, seen = random.Random(5), []
    held = R.checkpoint
    monkeypatch.setattr(R, "checkpoint", lambda df: (lambda x: (seen.append(x.count()), x)[1])(held(df)))
    texts = [(f"t_{i:03}", " ".join(f"w{rnd.randrange(30)}" for _ in range(12))) for i in range(300)]
    texts += [(f"u_{i}", texts[i][1]) for i in range(20)] + [(None, "w1 w2 w3"), ("v_0", None), ("v_1", "...")]
    table = spark.createDataFrame(texts, "id string, t string")
    asks = table.where("id like '%0'").select(F.col("id").alias("q"), F.col("t").alias("qt"))
    whole = R.bm25_topk(table, "id", "t", asks, "q", "qt", 10)
    lists = {(r.q, r.id, r.score, r["rank"]) for r in whole.collect()}
    assert len(lists) == 32 * 10 and max(seen) <= 32 * 12  # 32 queries with a text
    cut = R.bm25_topk(table, "id", "t", asks, "q", "qt", 10, block=7, slice_=40)
    assert {(r.q, r.id, r.score, r["rank"]) for r in cut.collect()} == lists
    assert not R.bm25_topk(table.limit(0), "id", "t", asks, "q", "qt", 10).count() and not R.bm25_topk(table, "id", "t", asks.limit(0), "q", "qt", 10).count()


def test_hash_sample_is_monotone(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    five, ten = ({r.k for r in H.hash_sample(df, "k", p).collect()} for p in (5.0, 10.0))
    assert five < ten and 50 < len(five) < 160


def test_cache(spark):
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, t int, response string")
    last = H.latest(log, "key", "t", "response").select("key", "response")
    assert {r.key: r.response for r in last.collect()} == {"k": "b", "m": "c"}
    asked = spark.createDataFrame([("k",), ("z",)], "key string")
    assert {r.key: r.response for r in H.lookup(asked, last, "key").collect()} == {"k": "b", "z": None}
    try:
        H.lookup(asked, last, "key", on_miss="fail").collect()
    except Exception as e:
        assert "no cached response for z" in str(e)
    else:
        raise AssertionError("a miss must fail")


def test_mmr_avoids_copies(spark):
    pool = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.7, [0.0, 1.0])], "q int, id int, rel double, v array<double>")
    got = {r.pick: r.id for r in R.diversify(pool, "q", "id", "rel", "v", k=2).collect()}
    assert got == {1: 1, 2: 3}
