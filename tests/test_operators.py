"""Guards, grounding, statistics, rules, retrieval and large threads on small fixtures."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import filters, forest, grounding, order, retrieval, rules, sampling, verdicts
from threadloom.operators import stats as S

REPLIES = ["Try logging out and reinstall the app", "We refunded the 30 day charge and a credit of $10.00, see https://help.example/a. Call +44 20 7946 0018"]


def reasons(spark, draft, replies=REPLIES):
    df = spark.createDataFrame([(draft, replies)], "d string, r array<string>")
    return df.select(grounding.draft_reasons(F.col("d"), F.col("r"))).first()[0]


@pytest.mark.parametrize(
    "draft,kinds",
    [
        ("Please log out and reinstall.", []),
        ("You get a credit of $10.", []),
        ("We can offer a refund within 90 days.", ["window", "timeline", "number"]),
        ("See https://help.example/a/ for steps.", []),
        ("See https://evil.example/b now.", ["link"]),
        ("All done ^AB", ["mark"]),
        ("We're here 24/7, 100% of the time.", ["date"]),
        ("A credit of $75.50 is on its way", ["amount", "number"]),
        ("Call +44 20 7946 0018.", []),
        ("Call +1 555 010 9999.", ["number", "number", "number", "phone"]),
        ("You're entitled to a free year.", ["entitlement"]),
        ("", []),
        (None, []),
    ],
)
def test_drafts_are_held_to_their_evidence(spark, draft, kinds):
    assert [r.split(":")[0] for r in reasons(spark, draft)] == kinds


def test_a_demand_is_no_evidence_but_a_playbook_is(spark):
    assert [r.split(":")[0] for r in reasons(spark, "We offer a refund.", [])] == ["refund"]
    assert reasons(spark, "We offer a refund.", ["Playbook: refunds are fine", None]) == []
    assert [r.split(":")[0] for r in reasons(spark, "We offer a refund.", None)] == ["refund"]


def test_prompt_lines_and_schema(spark):
    df = spark.createDataFrame([([("t_1", "hi", None)],), (None,)], "e array<struct<evidence_id string, customer_text string, brand_reply string>>")
    assert [r[0] for r in df.select(grounding.exemplar_lines(F.col("e"))).collect()] == ["1. [t_1] hi | ", ""]
    got = grounding.strict_schema({"type": "object", "properties": {"a": {"type": "array", "items": {"properties": {"b": {}}}}}})
    assert got["required"] == ["a"] and got["properties"]["a"]["items"] == {"properties": {"b": {}}, "required": ["b"], "additionalProperties": False}


def test_guards_are_loud(spark):
    df = spark.createDataFrame([("a", "random"), ("b", None), ("c", "policy_trap")], "id string, stratum string")
    with pytest.raises(filters.GuardError, match="None, policy_trap"):
        filters.only_slice(df, "stratum", "random")
    assert filters.only_slice(df.where("id = 'a'"), "stratum", "random").count() == 1
    turns = spark.createDataFrame([(1, 0, "7", True), (1, 1, "Acme", False), (2, 0, "8", True), (2, 1, "Other", False)], "root int, turn int, author string, inbound boolean")
    assert {r.root for r in filters.brand_threads(turns, "ACME").collect()} == {1}
    with pytest.raises(filters.GuardError, match="no outbound message"):
        filters.brand_threads(turns, "Nobody")
    assert filters.long_threads(turns, 3).count() == 0 and filters.long_threads(turns, 2).count() == 4
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("", "x"), ("c", None)], "intent string, action string")
    assert filters.resolved_rows(labels, "intent", "action", known=["a", "b"]).count() == 2
    with pytest.raises(filters.GuardError, match="b"):
        filters.resolved_rows(labels, "intent", "action", known=["a"])


def test_leaks_are_found_in_every_leaf(spark):
    long = "x" * 201
    row = (long, {"a": long, "b": 1}, [{"c": long}, {"c": "y"}], [[long, "z"]], {"k": long}, "n")
    df = spark.createDataFrame([row], "top string, s struct<a string, b int>, l array<struct<c string>>, n array<array<string>>, m map<string, string>, note string")
    got = {r.field: r.n for r in filters.leaks(df, 200, ("top",), ("note",)).where("n > 0").collect()}
    assert got == {"s.a": 1, "l[].c": 1, "n[][]": 1, "m[]": 1, "note not empty": 1}


def test_allow_list_reaches_nested_fields(spark):
    df = spark.createDataFrame([("1", ("a", "b"), [("c", "d")])], "id string, s struct<x string, y string>, l array<struct<u string, v string>>")
    with pytest.raises(filters.GuardError, match="l, s.y"):
        filters.allowed_only(df, {"id": None, "s": ["x"]})
    with pytest.raises(filters.GuardError, match="l.v"):
        filters.allowed_only(df, {"id": None, "s": ["x", "y"], "l": ["u"]})
    kept = filters.allowed_only(df, {"s": ["y", "x"], "id": None, "l": None})
    assert kept.columns == ["s", "id", "l"] and kept.first().s.y == "b"


def test_blanking_stray_fields_and_ids(spark):
    df = spark.createDataFrame([("1", "escalate", "why"), ("2", "auto", "why"), ("3", None, " ")], "id string, action string, reason string")
    rows, changed = filters.blanked(df, "reason")
    assert {r.reason for r in rows.collect()} == {""} and changed.first().changed == 2
    got = {r.id: (r.reason, list(r.notes)) for r in filters.without_stray(df, "reason", F.col("action") == "escalate", "dropped").collect()}
    assert got == {"1": ("why", []), "2": (None, ["dropped"]), "3": (None, ["dropped"])}
    ids = filters.sequential_ids(df.withColumn("s", F.lit("b")), "s", "id", {"a": 0, "b": 999}).collect()
    assert sorted(r.id for r in ids) == ["g1000", "g1001", "g1002"]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"intents": [{"name": "b"}, {"name": "a"}]}), encoding="utf-8")
    assert filters.labels_of(filters.read_config(str(tmp_path / "c.json"))) == ["b", "a"]
    assert len(filters.config_hash(str(tmp_path / "c.json"))) == 64


def test_numbers_of_a_large_group(spark):
    rnd = random.Random(1)
    t = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rnd.randrange(20) * 1800) if rnd.random() < 0.9 else None
    rows = [(i, "big" if i % 3 else f"g{i}", t()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, made timestamp")
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    want = {r.id: r.k for r in order.numbered(df, sizes, "g", "made", ["id"], "k").collect()}
    got = {r.id: r.k for r in order.numbered(df, sizes, "g", "made", ["id"], "k", limit=50).collect()}
    assert got == want and sorted(v for k, v in got.items() if k % 3) == list(range(200))


def test_previous_rows_of_a_large_group(spark):
    rnd = random.Random(2)
    rows = [(i, "big" if i % 3 else f"g{i % 9}", dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rnd.randrange(200) * 600)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, made timestamp")
    want = {r.id: r.b for r in order.previous(df, "g", "made", ["id"], "id", "b").collect()}
    assert {r.id: r.b for r in order.previous(df, "g", "made", ["id"], "id", "b", limit=50).collect()} == want
    assert list(want.values()).count(None) == 4


def test_no_task_sorts_a_large_group(spark):
    """A group with a third of all rows: the largest window of the plan holds one instant."""
    df = spark.range(6000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("g"), (F.lit(dt.datetime(2020, 1, 1)) + F.make_dt_interval(secs=F.col("id") % 500)).alias("made"))
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    out = order.numbered(df, sizes, "g", "made", ["id"], "k", limit=100)
    assert [r.k for r in out.where("g = 0").orderBy("made", "id").collect()] == list(range(2000))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan  # the large group leaves the plain window


def test_chains_equal_walks(spark):
    rnd = random.Random(5)
    parent = {i: (rnd.randrange(max(0, i - 3), i) if rnd.random() < 0.97 else None) if i else None for i in range(400)}
    parent.update({900: 901, 901: 902, 902: 900, 903: 900, **{1000 + i: 1000 + i - 1 for i in range(1, 90)}, 1000: None})
    links = spark.createDataFrame(list(parent.items()), "id bigint, parent bigint")
    want, leaves = set(), []
    for leaf in [399, 380, 1089]:
        way = [leaf]
        while parent[way[-1]] is not None:
            way.append(parent[way[-1]])
        if all(way[-1] != r for r, _ in leaves):
            leaves.append((way[-1], leaf))
            want |= {(way[-1], x) for x in way}
    got = {(r.root, r.id) for r in forest.chains(forest.trees(links)[1], spark.createDataFrame(leaves, "root bigint, leaf bigint")).collect()}
    assert got == want and len(want) > 100


def test_percentiles_are_exact(spark):
    rnd = random.Random(3)
    x = [rnd.choice([1.0, 5.0, rnd.random() * 100]) for _ in range(501)] + [1e6]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    got = S.percentiles(df, "x", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
    assert [got.a, got.b, got.c, got.d] == [round(float(np.percentile(x, q)), 4) for q in (50, 95, 0, 100)]
    assert S.percentiles(spark.createDataFrame([(4.0,)], "x double"), "x", {"a": 0.5}).first().a == 4.0


def labelled(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = [(f"m{i}", rnd.choice([0.3, 0.9, round(rnd.random(), 6)]), rnd.random() < 0.3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, conf double, wrong boolean")


def test_ranks_and_risk_against_plain_sorting(spark):
    from hashlib import md5

    rows, df = labelled(spark)
    done = sorted(rows, key=lambda r: (-r[1], md5(r[0].encode()).hexdigest()))
    errors = np.cumsum([r[2] for r in done])
    got = {r["rank"]: r.errors for r in S.ranked(df, F.col("id")).collect()}
    assert got == {i + 1: int(e) for i, e in enumerate(errors)}
    s = S.risk_summary(df, F.col("id")).first()
    n, right = len(rows), sum(not r[2] for r in rows)
    ranks = np.arange(1, n + 1)
    assert s.aurc == pytest.approx((errors / ranks).mean(), abs=2e-6) and s.aurc_oracle == pytest.approx((np.maximum(0, ranks - right) / ranks).mean(), abs=2e-6)


def test_calibration_sums_exactly(spark):
    rows = [(f"m{i}", c, False) for i, c in enumerate([0.3787825, 0.3787825, 0.37878249, 0.37878251])]
    df = spark.createDataFrame(rows, "id string, conf double, wrong boolean")
    means = {S.calibration(df.orderBy(F.rand(k)).repartition(k + 1)).where("bin = 3").first().mean_conf for k in range(4)}
    assert means == {0.378783}
    rows, df = labelled(spark)
    got = S.calibration_summary(df).first()
    conf, y = np.array([r[1] for r in rows]), np.array([not r[2] for r in rows], float)
    assert got.brier == pytest.approx(((conf - y) ** 2).mean(), abs=1e-6)
    assert got.uncertainty == pytest.approx(y.mean() * (1 - y.mean()), abs=1e-6)


def test_resampling_counts_equals_theory(spark):
    cells = spark.createDataFrame([("a", "a", 60), ("a", "b", 10), ("b", "b", 25), ("b", "c", 5)], "gold string, pred string, c bigint")
    got = {r.metric: r for r in S.bootstrap_cells(cells, "labels").collect()}
    assert {r.reps for r in got.values()} == {10_000}
    half = 1.96 * np.sqrt(0.85 * 0.15 / 100)
    assert got["accuracy"].low == pytest.approx(0.85 - half, abs=0.012) and got["accuracy"].high == pytest.approx(0.85 + half, abs=0.012)
    assert got["macro_f1_score_zero"].median <= got["macro_f1_drop_class"].median
    pairs = spark.createDataFrame([(True, False, 20), (False, True, 5), (True, True, 75)], "gold boolean, pred boolean, c bigint")
    p = S.bootstrap_cells(pairs, "pairs").first()
    assert 0 < p.low < 0.15 < p.high and p.p < 0.01
    with pytest.raises(ValueError):
        S.bootstrap_cells(cells.limit(0), "labels")


def test_rules_are_mined_and_used(spark):
    texts = [("want my money back", "refund")] * 3 + [("money please", "refund"), ("the app is slow", "tech"), ("app crash again", "tech"), ("app", "tech"), ("hello", "other")] + [("hello app", "tech")]
    df = spark.createDataFrame(texts, "text string, label string")
    mined = rules.mine(df, most=3).orderBy("rule").collect()
    assert [(r.intent, r.pattern, r.support, r.precision) for r in mined] == [("tech", "app", 4, 1.0), ("refund", "money", 4, 1.0), ("refund", "want my", 3, 1.0)]
    asked = spark.createDataFrame([(1, "MONEY for the app"), (2, "nothing"), (3, None)], "id int, text string")
    got = {r.id: (r.predicted, r.matched) for r in rules.predict(rules.mine(df, most=3), rules.majority(df), asked, "id").collect()}
    assert got == {1: ("tech", True), 2: ("refund", False), 3: ("refund", False)}


def test_verdicts(spark):
    rows = [("1", s, c, s == "own", False, "q" if s == "own" else None) for s in ("own", "historical", "constant") for c in ("x", "y")] + [("2", "own", "x", True, True, " ")]
    v = spark.createDataFrame(rows, "message_id string, system string, criterion string, pass boolean, flip boolean, quote string")
    q = verdicts.quoted(v, "x")
    assert [(r.message_id, r["pass"]) for r in q.where("downgraded").collect()] == [("2", False)]
    with pytest.raises(ValueError, match="constant"):
        verdicts.reply_table(v.where("system != 'constant'"), ("historical", "constant"))
    t = {(r.system, r.criterion): (r.k, r.n, r.flips) for r in verdicts.reply_table(q, ("historical", "constant")).collect()}
    assert t["own", "x"] == (1, 2, 1) and t["own", "all"] == (1, 2, None) and t["constant", "y"] == (0, 1, 0)
    p = {(r.criterion, r.other): (r.paired, r.only_a) for r in verdicts.reply_pairs(q, "own").collect()}
    assert p["all", "constant"] == (1, 1) and p["x", "historical"] == (1, 1)


def test_citations(spark):
    lines = spark.createDataFrame([("- Reset the router [evidence: a, b]",), ("* nothing cited",), ("plain",), ("- Reset [evidence: c]",)], "line string")
    known = spark.createDataFrame([("a", "please reset your modem"), ("b", "other words here")], "id string, text string")
    assert tuple(verdicts.citations(lines, known).first()) == (3, 2, 0.666667, 3, 1, 1)


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id bigint, v array<double>, label int")
    ask = df.where("id % 9 = 0").select(F.col("id").alias("q"), "v")
    want = {(q, i, r + 1) for q in range(0, 90, 9) for r, i in enumerate(sorted((i for i in range(90) if i != q), key=lambda i: (-x[i] @ x[q], i))[:5])}
    assert {(r.q, r.id, r["rank"]) for r in retrieval.dense_topk(df, ask, 5, block=3, slice_=20).collect()} == want
    best = {(r.q, r.label): r.score for r in retrieval.best_per_label(df, ask, block=3, slice_=20).collect()}
    assert best == {(q, c): max(x[i] @ x[q] for i in range(90) if i % 4 == c and i != q) for q in range(0, 90, 9) for c in range(4)}


def test_hybrid_lists_fill_up_and_stay_in_the_pool(spark):
    rows = [(i, "A" if i < 8 else "B", "x" if i % 2 else "y", ["red apple pie", "green apple", "blue car", None][i % 4]) for i in range(12)]
    docs = spark.createDataFrame(rows, "id bigint, brand string, intent string, text string")
    got = retrieval.hybrid(docs, spark.createDataFrame([(1,), (8,)], "q bigint"), candidates=4, k=3, tail=2).collect()
    assert {r.q for r in got} == {1, 8} and all(len([r for r in got if r.q == q]) == 3 for q in (1, 8))
    assert all(r.id < 8 for r in got if r.q == 1) and all(r.id >= 8 and r.id != 8 for r in got if r.q == 8)
    assert {r.id for r in retrieval.pools(docs, 2).where(F.col("pool").startswith("A") & F.col("pool").endswith("x")).collect()} == {1, 3, 5, 7, 0, 2}


def test_sizes_per_stratum(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i < 4 else "b") for i in range(9)], "k string, t string")
    got = sampling.stratified_take(df, "k", {"first": F.col("t") == "a", "second": F.lit(True)}, {"first": 2, "second": 3, "filler": 1}).collect()
    assert sorted((r.bucket, r.k) for r in got) == [("filler", "k5"), ("first", "k0"), ("first", "k1"), ("second", "k2"), ("second", "k3"), ("second", "k4")]
