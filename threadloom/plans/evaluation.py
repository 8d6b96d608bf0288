"""Queries of sampling, retrieval, classification and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.keys import id_number, tidy_label
from threadloom.operators import retrieval as R
from threadloom.operators import rules
from threadloom.operators import sampling as H
from threadloom.operators import stats as S
from threadloom.plans.general import _ID
from threadloom.session import checkpoint, table

#: The reply of the degenerate control.
CONSTANT_REPLY = "Please send us a DM with your details so that we can look into this."


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per precedent."""
    e = table(spark, sf_dir, "exemplar")
    return e.where("evidence_id is not null").groupBy("evidence_id").agg(*(F.max(c).alias(c) for c in ("conversation_id", "customer_text", "brand_reply", "intent", "brand", "dense_score")))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_id, stratum, gold, pred, conf, wrong``: the predicted intent against that of the first evidence."""
    d = table(spark, sf_dir, "decision_record").select(
        "message_id", tidy_label(F.col("stratum")).alias("stratum"), F.get("evidence", F.lit(0))["intent"].alias("gold"), F.col("predicted_intent").alias("pred"), F.col("intent_confidence").alias("conf"), "grounding_passed",
        F.col("decision.action").alias("action"), "cache_hit",
    )
    return d.where("gold is not null and pred is not null and conf is not null").distinct().withColumn("wrong", F.col("gold") != F.col("pred"))


def sample_md5(spark, sf_dir):
    return H.hash_sample(table(spark, sf_dir, "twcs").select("tweet_id").distinct(), "tweet_id", 5.0)


def salted_order_topn(spark, sf_dir):
    return H.salted_top(table(spark, sf_dir, "exemplar").select("evidence_id").distinct(), "evidence_id", "pilot", 30).select("evidence_id")


def _buckets(c):
    return {"refund": c.rlike("(?i)refund"), "broken": c.rlike("(?i)broken|freezes|crashes"), "money": c.rlike(X.MONEY)}


def stratified_buckets(spark, sf_dir):
    return H.stratified_take(_exemplars(spark, sf_dir), "evidence_id", _buckets(F.col("customer_text")), 20)


def dedupe_normalised(spark, sf_dir):
    return H.dedupe_normal(table(spark, sf_dir, "exemplar"), "evidence_id", "brand_reply")


def content_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "decision_record").where(tidy_label(F.col("stratum")) == "random").select("message_id", "predicted_intent", F.col("decision.action").alias("action")).distinct()
    return H.content_hash(rows, "message_id", "predicted_intent", "action")


def cache_latest(spark, sf_dir):
    return H.latest(_log(spark, sf_dir), "key", "logged_at", "response").select("key", "response")


def _log(spark, sf_dir):
    d = table(spark, sf_dir, "decision_record").where("input_text_redacted is not null")
    return d.select(H.cache_key(F.lit("m1"), F.lit("v1"), F.col("input_text_redacted")).alias("key"), "logged_at", F.coalesce("predicted_intent", F.lit("")).alias("response"))


def cache_miss(spark, sf_dir):
    """Customer texts of precedents that the log has no answer for."""
    asked = _exemplars(spark, sf_dir).select("evidence_id", H.cache_key(F.lit("m1"), F.lit("v1"), F.col("customer_text")).alias("key"))
    return H.lookup(asked, H.latest(_log(spark, sf_dir), "key", "logged_at", "response").select("key", "response"), "key").where("response is null").select("evidence_id")


def heldout_antijoin(spark, sf_dir):
    held = table(spark, sf_dir, "decision_record").where(tidy_label(F.col("stratum")).isNotNull()).select(id_number(F.col("conversation_id")).alias("c")).distinct()
    return _exemplars(spark, sf_dir).withColumn("c", id_number(F.col("conversation_id"))).join(held, "c", "left_anti").select("evidence_id")


def rejoin_coverage(spark, sf_dir):
    """Per stratum how many records' messages are still held."""
    d = table(spark, sf_dir, "decision_record").select("message_id", tidy_label(F.col("stratum")).alias("stratum"), id_number(F.substring("message_id", 3, 30)).alias("id")).distinct()
    held = table(spark, sf_dir, "twcs").select(id_number(F.col("tweet_id")).alias("id"), F.lit(1).alias("held")).distinct()
    return d.join(held, "id", "left").groupBy("stratum").agg(F.count("*").alias("n"), F.count("held").alias("found"))


def invariants(spark, sf_dir):
    """Violations of the record rules."""
    d = table(spark, sf_dir, "decision_record")
    g = F.col("decision")
    rules = {
        "confidence_in_unit": ~F.col("intent_confidence").between(0, 1),
        "draft_within_280": F.char_length(g["reply_draft"]) > 280,
        "reason_iff_escalated": (g["action"] == "escalate") != g["escalation_reason"].isNotNull(),
        "evidence_listed": F.coalesce(F.size(g["evidence_ids"]) < 1, F.lit(True)),
        "plain_pattern_left": F.size(X.masked(F.col("input_text_redacted"))[1]) > 0,
    }
    return d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("broken")) for n, c in rules.items()))).alias("r")).groupBy("r.rule").agg(F.count_if("r.broken").alias("violations"))


def run_report(spark, sf_dir):
    d = table(spark, sf_dir, "decision_record")
    whole = d.agg(
        F.count("*").alias("n"), F.sum(F.col("tokens_in").cast("bigint")).alias("tokens_in"), F.sum(F.col("tokens_out").cast("bigint")).alias("tokens_out"),
        F.round(F.avg(F.col("cache_hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg((F.col("repair_attempts") > 0).cast("double")), 6).alias("repair_rate"),
    )
    return whole.crossJoin(S.percentiles(d, "latency_ms", {"p50": 0.5, "p95": 0.95}))  # two single rows


def layer_counts(spark, sf_dir):
    return table(spark, sf_dir, "decision_record").groupBy("policy_layer_fired", F.col("decision.action").alias("action")).agg(F.count("*").alias("n"))


def evidence_support(spark, sf_dir):
    """Numbers and links of each draft that no reply in its evidence has."""
    d = table(spark, sf_dir, "decision_record").select("message_id", F.col("decision.reply_draft").alias("t"), X.evidence_text(F.col("evidence.brand_reply")).alias("e")).where("t is not null").distinct()
    plain = F.array(*(F.lit(x) for x in X.PLAIN_NUMBERS))
    numbers = F.filter(F.regexp_extract_all("t", F.lit(X.NUMBER), F.lit(0)), lambda x: ~F.array_contains(plain, F.regexp_replace(x, ",", "")) & ~F.contains(F.col("e"), x))
    links = F.filter(F.regexp_extract_all("t", F.lit(X.LINK), F.lit(0)), lambda x: ~F.contains(F.col("e"), F.regexp_replace(F.lower(x), r"[/.,]+$", "")))
    return d.select("message_id", F.size(numbers).alias("numbers"), F.size(links).alias("links"), F.col("t").rlike(X.SIGIL_END).alias("mark"))


def error_groups(spark, sf_dir):
    return _labelled(spark, sf_dir).where("wrong").groupBy("stratum", "gold", "pred").agg(F.count("*").alias("n"))


def paired_ids(spark, sf_dir):
    """Conversations that the messages, the log and the precedents all know."""
    a = table(spark, sf_dir, "twcs").select(id_number(F.col("tweet_id")).alias("c"), F.lit("tweets").alias("s"))
    b = table(spark, sf_dir, "decision_record").select(id_number(F.col("conversation_id")).alias("c"), F.lit("log").alias("s"))
    c = table(spark, sf_dir, "exemplar").select(id_number(F.col("conversation_id")).alias("c"), F.lit("precedents").alias("s"))
    return a.union(b).union(c).where("c is not null").groupBy("c").agg(F.count_distinct("s").alias("k")).where("k = 3").select("c")


def _asked(e, key):
    return e.where(F.pmod(id_number(F.substring(key, 3, 30)), F.lit(50)) == 0)


def bm25_topk(spark, sf_dir):
    e = _exemplars(spark, sf_dir)
    q = _asked(e, "evidence_id").select(F.col("evidence_id").alias("q"), F.col("customer_text").alias("qt"))
    return R.bm25_topk(e, "evidence_id", "customer_text", q, "q", "qt", 10)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.dense_topk(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 10)


def hybrid_fusion(spark, sf_dir):
    """Dense ranks fused with those among all rows of the query's own class, each list 50 long."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 50 = 0").select(F.col("id").alias("q"), "v", "label")
    near, own = R.dense_topk(v, q, 50), R.dense_topk(v, q, 50, within="label")
    return R.reciprocal_ranks(near.select("q", "id", "rank").unionByName(own.select("q", "id", "rank")), "q", "id").where("fused_rank <= 10").select("q", "id", "score", "fused_rank")


def mmr(spark, sf_dir):
    """Three of the nearest 50, diversified."""
    v = _vectors(spark, sf_dir)
    near = R.dense_topk(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 50)
    return R.diversify(checkpoint(near.join(v.select("id", "v"), "id")), "q", "id", "score", "v").select("q", "id", "pick", "value")


def ir_metrics(spark, sf_dir):
    """Rows of the query's class are relevant: hits by label, and a count per class instead of pairs."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 50 = 0").select(F.col("id").alias("q"), "v", F.col("label").alias("ql"))
    near = R.dense_topk(v, q, 10).join(v.select("id", "label"), "id").join(q.select("q", "ql"), "q").withColumn("hit", F.col("label") == F.col("ql"))
    sizes = v.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("relevant"))
    return R.ranking_measures(near, q.select("q", "ql").join(sizes, "ql").select("q", "relevant"), "q", 10)


def one_nn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = R.dense_topk(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), 1)
    return near.join(v.select("id", "label"), "id").select("q", F.col("label").alias("predicted"))


def nearest_centroid(spark, sf_dir):
    return R.nearest_centroid(_vectors(spark, sf_dir)).select("id", "label", "nearest")


def wilson(spark, sf_dir):
    return S.proportions(_labelled(spark, sf_dir), ["stratum"], ~F.col("wrong"))


def grounding_failures(spark, sf_dir):
    d = table(spark, sf_dir, "decision_record").where("grounding_passed is not null").select(tidy_label(F.col("stratum")).alias("stratum"), "grounding_passed")
    return S.proportions(d, ["stratum"], ~F.col("grounding_passed"))


def per_class_f1(spark, sf_dir):
    p = S.per_class(S.cells(_labelled(spark, sf_dir)))
    return p.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def macro_f1(spark, sf_dir):
    p = S.per_class(S.cells(_labelled(spark, sf_dir), "stratum"), "stratum")
    return p.groupBy("stratum").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg(F.when(F.col("label") != "other_unclear", F.col("f1"))), 6).alias("in_scope"))


def confusion_top(spark, sf_dir):
    return S.confused(S.cells(_labelled(spark, sf_dir)))


def _votes(spark, sf_dir):
    """Two systems on the same rows: the classifier, and its most common class."""
    d = _labelled(spark, sf_dir)
    top = d.groupBy(F.col("gold").alias("guess")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "guess").limit(1).select("guess")
    return d.crossJoin(F.broadcast(top)).select("message_id", "stratum", (~F.col("wrong")).alias("a"), (F.col("gold") == F.col("guess")).alias("b"))


def majority(spark, sf_dir):
    return _votes(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("b").alias("right"))


def mcnemar(spark, sf_dir):
    g = _votes(spark, sf_dir).groupBy("stratum").agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c"))
    chi, p = S.mcnemar(F.col("b"), F.col("c"))
    return g.select("stratum", "b", "c", F.round(chi, 6).alias("chi2"), F.round(p, 4).alias("p"))


def holm(spark, sf_dir):
    return S.holm(mcnemar(spark, sf_dir).select(F.coalesce("stratum", F.lit("none")).alias("name"), "p"))


def kappa(spark, sf_dir):
    return S.agreement(table(spark, sf_dir, "decision_record"), F.col("grounding_passed"), F.col("decision.action") != "escalate")


#: What breaks ties of confidence, by its md5.
_TIE = ("message_id", "gold", "pred")


def risk_coverage(spark, sf_dir):
    """The curve, one row per record; ranks in the order of confidence, ties by the md5 of the record."""
    return S.risk_coverage(_labelled(spark, sf_dir), F.concat_ws("|", *_TIE))


def risk_summary(spark, sf_dir):
    return S.risk_summary(_labelled(spark, sf_dir), F.concat_ws("|", *_TIE))


def calibration(spark, sf_dir):
    return S.calibration(_labelled(spark, sf_dir))


def calibration_summary(spark, sf_dir):
    return S.calibration_summary(_labelled(spark, sf_dir))


def brier(spark, sf_dir):
    y = (~F.col("wrong")).cast("int")
    g = _labelled(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"), F.sum(S.units((F.col("conf") - y) * (F.col("conf") - y))).alias("sq"), F.sum(y).alias("k"))
    p = F.col("k") / F.col("n")
    return g.select("stratum", S.mean6(F.col("sq"), F.col("n")).alias("brier"), F.round(p * (1 - p), 6).alias("uncertainty"))


def oos_detection(spark, sf_dir):
    return S.out_of_scope(S.cells(_labelled(spark, sf_dir), "stratum"), "other_unclear", "stratum")


def confusion_matrix(spark, sf_dir):
    return S.confusion(S.cells(_labelled(spark, sf_dir)))


def mcnemar_report(spark, sf_dir):
    return S.mcnemar_report(_votes(spark, sf_dir), "stratum")


def agreement_report(spark, sf_dir):
    return S.agreement_report(table(spark, sf_dir, "decision_record"), F.col("grounding_passed"), F.col("decision.action") != "escalate")


def bootstrap_cells(spark, sf_dir):
    """10,000 resamples: accuracy, and macro-F1 with classes that a resample lacks dropped or scored 0."""
    return S.bootstrap_cells(S.cells(_labelled(spark, sf_dir)), "labels")


def paired_bootstrap_cells(spark, sf_dir):
    """10,000 resamples of the classifier's lead over its most common class, the same rows for both."""
    return S.bootstrap_cells(_votes(spark, sf_dir).groupBy(F.col("a").alias("gold"), F.col("b").alias("pred")).agg(F.count("*").alias("c")), "pairs")


def bootstrap_ci(spark, sf_dir):
    return S.bootstrap_rate(_labelled(spark, sf_dir), F.concat_ws("|", "message_id", "conf", "gold"), ~F.col("wrong"))


def tau_sweep(spark, sf_dir):
    taus = F.transform(F.sequence(F.lit(6), F.lit(19)), lambda k: F.round(k * 0.05, 2))
    each = _labelled(spark, sf_dir).withColumn("tau", F.explode(taus))  # fourteen thresholds, reduced in the map
    g = each.groupBy("tau").agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= F.col("tau")).alias("automated"), F.count_if((F.col("conf") >= F.col("tau")) & F.col("wrong")).alias("bad"))
    return g.withColumn("share", F.round(S.ratio(F.col("bad"), F.col("automated")), 6))


#: What a wrong automated row costs against a needless hand-over; fixed value.
COST_RATIO = 20


def tau_choice(spark, sf_dir):
    """Of the cuts whose wrong share is at most 1 / (1 + R) the one that automates most, ties to the higher; else the highest."""
    s = tau_sweep(spark, sf_dir)
    ok = s.where((F.col("automated") > 0) & (F.col("bad") * (COST_RATIO + 1) <= F.col("automated")))
    return ok.agg(F.coalesce(F.max_by("tau", F.struct("automated", "tau")), F.lit(0.95)).alias("tau"))


def class_thresholds(spark, sf_dir):
    """Per class the confidence cut (of 19) with the best F1, the least of equals."""
    d = _labelled(spark, sf_dir).withColumn("t", F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda k: F.round(k * 0.05, 2))))
    said = F.col("conf") >= F.col("t")
    p = d.where(said).groupBy(F.col("pred").alias("label"), "t").agg(F.count_if(~F.col("wrong")).alias("tp"), F.count_if("wrong").alias("fp"))
    n = d.groupBy(F.col("gold").alias("label"), "t").agg(F.count("*").alias("pos"))
    f1 = F.round(S.ratio(2 * F.coalesce("tp", F.lit(0)), F.coalesce("tp", F.lit(0)) + F.coalesce("fp", F.lit(0)) + F.col("pos")), 6)
    s = n.join(p, ["label", "t"], "left").withColumn("f1", f1)
    return s.groupBy("label").agg(F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("t"))).alias("b")).select("label", "b.t", "b.f1")


def prior_draw(spark, sf_dir):
    """A label per record by the shares of the labels and the record's hash."""
    d = _labelled(spark, sf_dir)
    u = H.fraction(F.concat(F.col("message_id"), F.lit("|prior")))
    ids = d.select("message_id").distinct().withColumn("u", u)
    return ids.join(F.broadcast(S.few(H.class_share(d, "message_id", "gold"))), (F.col("u") >= F.col("above")) & (F.col("u") < F.col("upto"))).select("message_id", F.col("gold").alias("draw"))


def _rows(spark, sf_dir):
    return _exemplars(spark, sf_dir).select("evidence_id", F.col("intent").alias("label"), F.col("customer_text").alias("text")).where("label is not null and text is not null")


def rules_fit(spark, sf_dir):
    """The mined rules of all precedents: precision of at least one half, support of at least 2, the best 15."""
    return rules.mine(_rows(spark, sf_dir))


def rules_predict(spark, sf_dir):
    rows = checkpoint(_rows(spark, sf_dir))
    return rules.predict(rules.mine(rows), rules.majority(rows), rows, "evidence_id")


def rules_coverage(spark, sf_dir):
    """Share of the precedents that any rule matches, and accuracy on these and on all."""
    rows = checkpoint(_rows(spark, sf_dir))
    p = rules.predict(rules.mine(rows), rules.majority(rows), rows, "evidence_id", "label")
    right = F.col("label") == F.col("predicted")
    return p.agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & right).alias("right_matched"), F.count_if(right).alias("right")).withColumn("coverage", F.round(F.col("matched") / F.col("n"), 6))


def _compared(spark, sf_dir):
    """``stratum, gold, pred, text, key``: labelled records with their text."""
    d = table(spark, sf_dir, "decision_record").where("input_text_redacted is not null").groupBy("message_id").agg(F.min("input_text_redacted").alias("text"))
    return _labelled(spark, sf_dir).groupBy("message_id").agg(*(F.min(c).alias(c) for c in ("stratum", "gold", "pred"))).join(d, "message_id")


def baseline_comparison(spark, sf_dir):
    """Baselines fitted to all strata but ``random`` against the classifier on ``random``: accuracy with interval, macro-F1, and the paired test against the classifier."""
    rows = checkpoint(_compared(spark, sf_dir))
    train = rows.where("stratum is not null and stratum != 'random'").withColumn("label", F.col("gold"))
    test = rows.where("stratum = 'random'")
    fallback = rules.majority(train)
    shares = H.class_share(train, "message_id", "gold").withColumnRenamed("gold", "draw")
    u = H.fraction(F.concat("message_id", F.lit("|prior")))
    drawn = test.select("message_id", u.alias("u")).join(F.broadcast(S.few(shares)), (F.col("u") >= F.col("above")) & (F.col("u") < F.col("upto")), "left").select("message_id", "draw")
    ruled = rules.predict(rules.mine(train), fallback, test, "message_id", "gold", "pred")
    wide = ruled.join(drawn, "message_id").crossJoin(fallback)  # one row
    systems = {"classifier": "pred", "constant": "fallback", "prior": "draw", "rules": "predicted"}
    each = wide.select("message_id", "gold", (F.col("gold") == F.col("pred")).alias("a"), F.explode(F.array(*(F.struct(F.lit(n).alias("system"), F.coalesce(c, F.lit("")).alias("pred")) for n, c in systems.items()))).alias("s")).select("message_id", "gold", "a", "s.*")
    each = checkpoint(each.withColumn("b", F.col("gold") == F.col("pred")))
    macro = S.per_class(S.cells(each, "system"), "system").groupBy("system").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    accuracy = S.proportions(each, ["system"], F.col("b")).drop("rule_of_three")
    paired = S.mcnemar_report(each, "system").select("system", "only_a", "only_b", "chi2", "p")
    return accuracy.join(macro, "system").join(paired, "system")


def constant_reply(spark, sf_dir):
    """The degenerate control: one reply for every record, and how it fares under the checks of a draft."""
    d = table(spark, sf_dir, "decision_record").select("message_id").where("message_id is not null").distinct().withColumn("reply", F.lit(CONSTANT_REPLY))
    return d.select("message_id", "reply", F.char_length("reply").alias("chars"), X.matches(F.col("reply"), X.DM).alias("asks_for_message"))


def prediction_gold(spark, sf_dir):
    """Predictions joined with gold labels, which are the intents of the first cited precedents; only records that both sides know."""
    d = table(spark, sf_dir, "decision_record")
    gold = d.select("message_id", F.get("evidence", F.lit(0))["evidence_id"].alias("evidence_id")).distinct().join(_exemplars(spark, sf_dir).select("evidence_id", F.col("intent").alias("gold_intent")), "evidence_id").where("gold_intent is not null").groupBy("message_id").agg(F.min("gold_intent").alias("gold_intent"))
    pred = d.select("message_id", "predicted_intent", "intent_confidence").where("predicted_intent is not null").distinct().select("message_id", F.col("predicted_intent").alias("pred_intent"), F.col("intent_confidence").alias("pred_intent_confidence"))
    return gold.join(pred, "message_id")


def error_kinds(spark, sf_dir):
    """Wrong calls of the random stratum by kind: intents against the first evidence, actions against whether the draft was supported."""
    d = _labelled(spark, sf_dir).where("stratum = 'random'")
    handled = F.when(F.col("action").isin("auto_send", "request_info"), "auto_handle").otherwise("escalate")
    due = F.when(F.col("grounding_passed"), "auto_handle").when(~F.col("grounding_passed"), "escalate")
    kinds = F.array(F.struct(F.lit("intent").alias("kind"), F.col("gold").alias("truth"), F.col("pred").alias("guess")), F.struct(F.lit("action").alias("kind"), due.alias("truth"), handled.alias("guess")))
    return d.select(F.explode(kinds).alias("k")).select("k.*").where("truth != guess").groupBy("kind", "truth", "guess").agg(F.count("*").alias("n"))


def action_rates(spark, sf_dir):
    """Hand-over against need per stratum: the four cells, how far they agree, what handing everything over would score, and the automation rate."""
    d = table(spark, sf_dir, "decision_record").where("grounding_passed is not null and decision.action is not null").select(tidy_label(F.col("stratum")).alias("stratum"), (~F.col("grounding_passed")).alias("due"), (~F.col("decision.action").isin("auto_send", "request_info")).alias("handed"))
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) / n, 6)
    due, handed = F.col("due"), F.col("handed")
    return d.groupBy("stratum").agg(
        n.alias("n"), F.count_if(due & handed).alias("handed_due"), F.count_if(due & ~handed).alias("bad_auto"), F.count_if(~due & handed).alias("needless"), F.count_if(~due & ~handed).alias("auto_fine"),
        share(due == handed).alias("accuracy"), share(due).alias("always_handed_accuracy"), share(~handed).alias("automation_rate"),
    )


def index_stats(spark, sf_dir):
    return _exemplars(spark, sf_dir).groupBy("brand", "intent").agg(F.count("*").alias("n"), F.round(F.avg(F.char_length("brand_reply")), 4).alias("reply_length"), F.round(F.max("dense_score"), 6).alias("best"))


def action_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "decision_record").select(tidy_label(F.col("stratum")).alias("stratum"), F.col("decision.action").alias("a"), F.col("grounding_passed").alias("g"))
    auto = F.col("a").isin("auto_send", "request_info")
    return d.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(auto & F.col("g")).alias("auto_grounded"), F.count_if(auto & ~F.col("g")).alias("auto_ungrounded"), F.count_if(~auto).alias("handed_over"))


_NAMES = (
    "sample_md5 salted_order_topn stratified_buckets dedupe_normalised content_hash cache_latest cache_miss heldout_antijoin rejoin_coverage invariants run_report layer_counts evidence_support error_groups "
    "paired_ids bm25_topk dense_topk hybrid_fusion mmr ir_metrics one_nn nearest_centroid wilson grounding_failures per_class_f1 macro_f1 confusion_top majority mcnemar holm kappa risk_coverage calibration brier "
    "bootstrap_ci tau_sweep tau_choice class_thresholds prior_draw rules_fit rules_predict index_stats action_confusion risk_summary calibration_summary oos_detection confusion_matrix mcnemar_report agreement_report "
    "bootstrap_cells paired_bootstrap_cells rules_coverage baseline_comparison constant_reply prediction_gold error_kinds action_rates"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TIDY = r"nullif(regexp_replace(lower(trim(stratum)), '[\s\-_]+', '_', 'g'), '')"
_U = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967295.0"
_EX = "e AS (SELECT evidence_id, max(conversation_id) AS conversation_id, max(customer_text) AS customer_text, max(brand_reply) AS brand_reply, max(intent) AS intent, max(brand) AS brand, max(dense_score) AS dense_score FROM exemplar WHERE evidence_id IS NOT NULL GROUP BY evidence_id)"
_LAB = f"l AS (SELECT DISTINCT message_id, {_TIDY} AS stratum, evidence[1].intent AS gold, predicted_intent AS pred, intent_confidence AS conf, grounding_passed, decision.action AS action, cache_hit, evidence[1].intent <> predicted_intent AS wrong FROM decision_record WHERE evidence[1].intent IS NOT NULL AND predicted_intent IS NOT NULL AND intent_confidence IS NOT NULL)"
_LOG = "log AS (SELECT sha256('m1' || chr(0) || 'v1' || chr(0) || input_text_redacted) AS key, logged_at, coalesce(predicted_intent, '') AS response FROM decision_record WHERE input_text_redacted IS NOT NULL), latest AS (SELECT key, response FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY logged_at DESC NULLS LAST, response DESC) = 1)"


def _wilson_sql(k: str, n: str) -> str:
    p, z = f"({k} / CAST({n} AS DOUBLE))", 1.96
    mid, half, under = f"({p} + {z * z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})))", f"(1 + {z * z} / {n})"
    return f"round(greatest(0.0, ({mid} - {half}) / {under}), 6) AS low, round(least(1.0, ({mid} + {half}) / {under}), 6) AS high"


def _props_sql(source: str, flag: str) -> str:
    return f"SELECT stratum, n, k, round(k / n, 6) AS rate, {_wilson_sql('k', 'n')}, CASE WHEN k = 0 THEN round(3.0 / n, 6) END AS rule_of_three FROM (SELECT stratum, count(*) AS n, count(*) FILTER ({flag}) AS k FROM {source} GROUP BY stratum)"


_PER = """c AS (SELECT {by} gold, pred, count(*) AS c FROM l GROUP BY ALL), s AS (SELECT {by} label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
SELECT {by} gold AS label, CASE WHEN gold = pred THEN c ELSE 0 END AS tp, 0 AS fp, CASE WHEN gold <> pred THEN c ELSE 0 END AS fn FROM c UNION ALL SELECT {by} pred, 0, c, 0 FROM c WHERE gold <> pred) GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM s),
g AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM f)"""
_VOTES = f"{_LAB}, top AS (SELECT gold AS guess FROM l GROUP BY gold ORDER BY count(*) DESC, gold LIMIT 1), v AS (SELECT message_id, stratum, NOT wrong AS a, gold = guess AS b FROM l, top)"
_CHI = "CASE WHEN b + c = 0 THEN 0.0 ELSE (abs(b - c) - 1) * (abs(b - c) - 1) / CAST(b + c AS DOUBLE) END"
_TT = "(1.0 / (1.0 + 0.3275911 * sqrt(chi / 2)))"
_ERFC = f"({_TT} * (0.254829592 + {_TT} * (-0.284496736 + {_TT} * (1.421413741 + {_TT} * (-1.453152027 + {_TT} * 1.061405429)))) * exp(-chi / 2))"
_MC = f"{_VOTES}, d AS (SELECT stratum, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM v GROUP BY stratum), x AS (SELECT *, {_CHI} AS chi FROM d), mc AS (SELECT stratum, b, c, round(chi, 6) AS chi2, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {_ERFC} END, 4) AS p FROM x)"
_SWEEP = f"{_LAB}, t AS (SELECT CAST(round(k * 0.05, 2) AS DOUBLE) AS tau FROM range(6, 20) r(k)), sw AS (SELECT tau, count(*) AS n, count(*) FILTER (conf >= tau) AS automated, count(*) FILTER (conf >= tau AND wrong) AS bad FROM l, t GROUP BY tau), sweep AS (SELECT *, round(CASE WHEN automated = 0 THEN 0 ELSE bad / automated END, 6) AS share FROM sw)"
_DOT = "round(list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 12)"
_VEC = "v AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings), s AS (SELECT q.id AS q, v.id, round(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])), 6) AS score FROM v q JOIN v ON v.id <> q.id WHERE q.id % 50 = 0), near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)"
_TERMS = "list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"


def _mined(rows: str) -> str:
    """Common tables ``r`` of the rules and ``fb`` of the fallback, mined from a table of label and text."""
    return f"""tk AS (SELECT label, regexp_extract_all(lower(coalesce(text, '')), '{X.TOKEN}') AS w FROM {rows} WHERE label IS NOT NULL), te AS (SELECT label, unnest({_TERMS}) AS pattern FROM tk),
pl AS (SELECT pattern, label, count(*) AS c FROM te GROUP BY ALL), pb AS (SELECT pattern, label AS intent, c, sum(c) OVER (PARTITION BY pattern) AS support, row_number() OVER (PARTITION BY pattern ORDER BY c DESC, label) AS k FROM pl),
r AS (SELECT CAST(row_number() OVER (ORDER BY c / support DESC, support DESC, intent DESC, pattern DESC) AS INT) AS rule, intent, pattern, CAST(support AS BIGINT) AS support, round(c / support, 6) AS precision FROM pb WHERE k = 1 AND c / support >= 0.5 AND support >= 2 QUALIFY rule <= 15),
fb AS (SELECT label AS fallback FROM {rows} WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), fo AS (SELECT intent, min(rule) AS place FROM r GROUP BY intent)"""


def _ruled(texts: str, key: str) -> str:
    return f"""tt AS (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '{X.TOKEN}') AS w FROM {texts}), th AS (SELECT {key}, unnest({_TERMS}) AS pattern FROM tt),
hi AS (SELECT th.{key}, arg_min(r.intent, place) AS intent FROM th JOIN r USING (pattern) JOIN fo ON fo.intent = r.intent GROUP BY 1), pr AS (SELECT t.*, coalesce(hi.intent, fallback) AS predicted, hi.intent IS NOT NULL AS matched FROM {texts} t LEFT JOIN hi USING ({key}), fb)"""


_ROWS = f"{_EX}, x AS (SELECT evidence_id, intent AS label, customer_text AS text FROM e WHERE intent IS NOT NULL AND customer_text IS NOT NULL)"
_RULED = f"WITH {_ROWS}, {_mined('x')}, {_ruled('x', 'evidence_id')} "
_MEAN6 = "(((2 * {0} + {1} * 1000) // (2 * {1} * 1000)) / 1000000.0)"
_SQ = "CAST(round((conf - CAST(NOT wrong AS INT)) * (conf - CAST(NOT wrong AS INT)) * 1000000000) AS BIGINT)"
_BINS = "b AS (SELECT CAST(" + " + ".join(f"(conf >= {e!r}::DOUBLE)::INT" for e in S.EDGES) + " AS INT) AS bin, count(*) AS n, CAST(sum(CAST(round(conf * 1000000000) AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (NOT wrong) AS hits FROM l GROUP BY 1)"
_RANKED = "k AS (SELECT wrong, conf, row_number() OVER w AS rank, CAST(sum(wrong::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors, count(*) OVER () AS n, count(*) FILTER (NOT wrong) OVER () AS hits FROM l WINDOW w AS (ORDER BY conf DESC, md5(message_id || '|' || gold || '|' || pred)))"
_PLAIN_SQL = "[" + ", ".join(f"'{x}'" for x in X.PLAIN_NUMBERS) + "]"
_POISSON = " + ".join(f"CASE WHEN u >= {e} THEN 1 ELSE 0 END" for e in (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759))
_MASK_T = "coalesce(input_text_redacted, '')"


def _any_mask() -> str:
    e, tests = _MASK_T, []
    for _, pattern, to in X.MASKS:
        tests.append(f"regexp_matches({e}, '{pattern}')")
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return "(" + " OR ".join(tests) + ")"


def _take_sql(each: int) -> str:
    conds = {"refund": "regexp_matches(customer_text, 'refund', 'i')", "broken": "regexp_matches(customer_text, 'broken|freezes|crashes', 'i')", "money": f"regexp_matches(customer_text, '{X.MONEY}')", "filler": "true"}
    parts, earlier = [], []
    for n, c in conds.items():
        skip = "".join(f" AND evidence_id NOT IN (SELECT evidence_id FROM k_{x})" for x in earlier)
        parts.append(f"k_{n} AS (SELECT evidence_id, '{n}' AS bucket FROM e WHERE {c}{skip} ORDER BY evidence_id LIMIT {each})")
        earlier.append(n)
    return f"WITH {_EX}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM k_{n}" for n in conds)


_KAPPA = "WITH g AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS yes, count(*) FILTER (NOT a AND NOT b) AS no, count(*) FILTER (a) / count(*) AS pa, count(*) FILTER (b) / count(*) AS pb FROM (SELECT grounding_passed AS a, decision.action <> 'escalate' AS b FROM decision_record) WHERE a IS NOT NULL AND b IS NOT NULL), h AS (SELECT *, (yes + no) / n AS p0, pa * pb + (1 - pa) * (1 - pb) AS pe, (pa + pb) * (1 - (pa + pb) / 2) AS ge FROM g) SELECT n, yes, no, round(p0, 6) AS p0, round(pe, 6) AS pe, round(CASE WHEN pe = 1 THEN 1 ELSE (p0 - pe) / (1 - pe) END, 6) AS kappa, round(2 * p0 - 1, 6) AS pabak, round((p0 - ge) / (1 - ge), 6) AS ac1"
ORACLES = {
    "sample_md5": f"SELECT DISTINCT tweet_id FROM twcs WHERE {_U.format('tweet_id')} < 0.05",
    "salted_order_topn": f"SELECT evidence_id FROM (SELECT DISTINCT evidence_id FROM exemplar) ORDER BY {_U.format(chr(39).join(['evidence_id || ', '|pilot', '']))}, evidence_id LIMIT 30",
    "stratified_buckets": _take_sql(20),
    "dedupe_normalised": r"SELECT md5(regexp_replace(lower(regexp_replace(coalesce(brand_reply, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS digest, min(evidence_id) AS evidence_id, count(*) AS copies FROM exemplar GROUP BY 1",
    "content_hash": f"SELECT count(*) AS rows, CAST(sum(CAST(CAST(('0x' || substr(sha256(message_id || chr(0) || coalesce(predicted_intent, '') || chr(0) || coalesce(action, '')), 1, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM (SELECT DISTINCT message_id, predicted_intent, decision.action AS action FROM decision_record WHERE {_TIDY} = 'random')",
    "cache_latest": f"WITH {_LOG} SELECT key, response FROM latest",
    "cache_miss": f"WITH {_EX}, {_LOG} SELECT evidence_id FROM e WHERE sha256('m1' || chr(0) || 'v1' || chr(0) || customer_text) NOT IN (SELECT key FROM latest) OR customer_text IS NULL",
    "heldout_antijoin": f"WITH {_EX} SELECT evidence_id FROM e WHERE {_ID.format('conversation_id')} IS NULL OR {_ID.format('conversation_id')} NOT IN (SELECT {_ID.format('conversation_id')} FROM decision_record WHERE {_TIDY} IS NOT NULL AND {_ID.format('conversation_id')} IS NOT NULL)",
    "rejoin_coverage": f"WITH d AS (SELECT DISTINCT message_id, {_TIDY} AS stratum, {_ID.format('substr(message_id, 3)')} AS id FROM decision_record), h AS (SELECT DISTINCT {_ID.format('tweet_id')} AS id FROM twcs) SELECT stratum, count(*) AS n, count(h.id) AS found FROM d LEFT JOIN h ON d.id = h.id GROUP BY stratum",
    "invariants": "SELECT rule, count(*) FILTER (broken) AS violations FROM (SELECT unnest(["
    + ", ".join(
        f"{{'rule': '{n}', 'broken': coalesce({c}, false)}}"
        for n, c in (
            ("confidence_in_unit", "NOT (intent_confidence BETWEEN 0 AND 1)"), ("draft_within_280", "length(decision.reply_draft) > 280"), ("reason_iff_escalated", "(decision.action = 'escalate') <> (decision.escalation_reason IS NOT NULL)"),
            ("evidence_listed", "len(decision.evidence_ids) IS NULL OR len(decision.evidence_ids) < 1"), ("plain_pattern_left", _any_mask()),
        )
    )
    + "], recursive := true) FROM decision_record) GROUP BY rule",
    "run_report": "SELECT count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(avg(CAST(cache_hit AS DOUBLE)), 6) AS hit_rate, round(avg(CAST(repair_attempts > 0 AS DOUBLE)), 6) AS repair_rate FROM decision_record",
    "layer_counts": "SELECT policy_layer_fired, decision.action AS action, count(*) AS n FROM decision_record GROUP BY ALL",
    "evidence_support": rf"""WITH d AS (SELECT DISTINCT message_id, decision.reply_draft AS t, lower(regexp_replace(array_to_string(list_filter(list_transform(evidence, lambda s: s.brand_reply), lambda y: y IS NOT NULL), ' '), '\s+', ' ', 'g')) AS e FROM decision_record WHERE decision.reply_draft IS NOT NULL)
SELECT message_id, CAST(len(list_filter(regexp_extract_all(t, '{X.NUMBER}'), lambda x: NOT list_contains({_PLAIN_SQL}, replace(x, ',', '')) AND NOT contains(e, x))) AS INT) AS numbers,
CAST(len(list_filter(regexp_extract_all(t, '{X.LINK.removeprefix("(?i)")}', 0, 'i'), lambda x: NOT contains(e, regexp_replace(lower(x), '[/.,]+$', '')))) AS INT) AS links, regexp_matches(t, '{X.SIGIL_END}') AS mark FROM d""",
    "error_groups": f"WITH {_LAB} SELECT stratum, gold, pred, count(*) AS n FROM l WHERE wrong GROUP BY ALL",
    "paired_ids": f"SELECT c FROM (SELECT {_ID.format('tweet_id')} AS c FROM twcs INTERSECT SELECT {_ID.format('conversation_id')} FROM decision_record INTERSECT SELECT {_ID.format('conversation_id')} FROM exemplar) WHERE c IS NOT NULL",
    "bm25_topk": rf"""WITH {_EX}, d AS (SELECT evidence_id, regexp_extract_all(lower(coalesce(customer_text, '')), '{X.TOKEN}') AS w FROM e), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT evidence_id, term, count(*) AS tf FROM (SELECT evidence_id, unnest(w) AS term FROM d) GROUP BY ALL), i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
s AS (SELECT q.evidence_id AS q, p.evidence_id, round(sum(q.tf * idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(d.w) / avgdl))), 6) AS score FROM p q JOIN i USING (term) JOIN p USING (term) JOIN d ON d.evidence_id = p.evidence_id
WHERE idf > 0 AND {_ID.format('substr(q.evidence_id, 3)')} % 50 = 0 AND q.evidence_id <> p.evidence_id GROUP BY ALL)
SELECT q, evidence_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, evidence_id) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "dense_topk": f"WITH {_VEC} SELECT q, id, score, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10",
    "hybrid_fusion": f"""WITH {_VEC}, o AS (SELECT near.q, near.id, row_number() OVER (PARTITION BY near.q ORDER BY near.score DESC, near.id) AS rank FROM near JOIN v a ON a.id = near.id JOIN v b ON b.id = near.q WHERE a.label = b.label),
f AS (SELECT q, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT q, id, rank FROM near UNION ALL SELECT * FROM o) WHERE rank <= 50 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(id AS VARCHAR)) AS INT) AS fused_rank FROM f QUALIFY fused_rank <= 10""",
    "ir_metrics": f"""WITH {_VEC}, rel AS (SELECT a.id AS q, b.id FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 50 = 0), c AS (SELECT q, count(*) AS r FROM rel GROUP BY q),
h AS (SELECT near.q, rank, rel.id IS NOT NULL AS hit FROM near LEFT JOIN rel ON rel.q = near.q AND rel.id = near.id WHERE rank <= 10)
SELECT h.q, round(coalesce(count(*) FILTER (hit) / max(r), 0), 6) AS recall, round(coalesce(max(1.0 / rank) FILTER (hit), 0), 6) AS mrr,
round(coalesce(sum(1.0 / log2(rank + 1)) FILTER (hit) / max(list_sum(list_transform(range(1, least(r, 10) + 1), lambda i: 1.0 / log2(i + 1)))), 0), 6) AS ndcg FROM h LEFT JOIN c ON c.q = h.q GROUP BY h.q""",
    "one_nn": f"WITH {_VEC} SELECT q, label AS predicted FROM near JOIN v USING (id) WHERE rank = 1",
    "nearest_centroid": """WITH x AS (SELECT vec_id AS id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL),
f AS (SELECT x.id, x.label, m.label AS k, round(sum((m - x) * (m - x)), 6) AS far FROM x JOIN m USING (d) GROUP BY ALL) SELECT id, label, k AS nearest FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, k) = 1""",
    "wilson": f"WITH {_LAB} " + _props_sql("l", "NOT wrong"),
    "grounding_failures": f"WITH d AS (SELECT {_TIDY} AS stratum, grounding_passed FROM decision_record WHERE grounding_passed IS NOT NULL) " + _props_sql("d", "NOT grounding_passed"),
    "per_class_f1": f"WITH {_LAB}, {_PER.format(by='')} SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM g",
    "macro_f1": f"WITH {_LAB}, {_PER.format(by='stratum,')} SELECT stratum, round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (label <> 'other_unclear'), 6) AS in_scope FROM g GROUP BY stratum",
    "confusion_top": f"WITH {_LAB}, c AS (SELECT gold, pred, count(*) AS c FROM l GROUP BY ALL), n AS (SELECT gold, sum(c) AS n FROM c GROUP BY gold) SELECT c.gold, c.pred, c.c, round(c.c / n, 6) AS share, round(least(c.c, coalesce(r.c, 0)) / (c.c + coalesce(r.c, 0)), 6) AS symmetry FROM c JOIN n ON n.gold = c.gold LEFT JOIN c r ON r.gold = c.pred AND r.pred = c.gold WHERE c.gold <> c.pred ORDER BY c.c DESC, c.gold, c.pred LIMIT 5",
    "majority": f"WITH {_VOTES} SELECT stratum, count(*) AS n, count(*) FILTER (b) AS right FROM v GROUP BY stratum",
    "mcnemar": f"WITH {_MC} SELECT * FROM mc",
    "holm": f"WITH {_MC}, r AS (SELECT coalesce(stratum, 'none') AS name, p, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, coalesce(stratum, 'none')) + 1) AS lim FROM mc) SELECT name, p, round(lim, 6) AS limit, min(CAST(p <= lim AS INT)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM r",
    "kappa": _KAPPA + " FROM h",
    "agreement_report": _KAPPA + f", {_wilson_sql('(yes + no)', 'n')}, CASE WHEN pe = 1 OR (p0 - pe) / (1 - pe) >= 0.8 THEN 'reliable' WHEN (p0 - pe) / (1 - pe) >= 0.667 THEN 'tentative' ELSE 'discard' END AS band FROM h",
    "mmr": f"""WITH {_VEC}, n AS (SELECT near.q, near.id, near.score AS rel, v.v FROM near JOIN v USING (id) WHERE rank <= 50),
p1 AS (SELECT *, round(rel, 6) AS value FROM n QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(rel, 6) DESC, id) = 1),
n2 AS (SELECT n.*, {_DOT.format('n.v', 'p1.v')} AS seen FROM n JOIN p1 USING (q) WHERE n.id <> p1.id), p2 AS (SELECT *, round(0.7 * rel - (1 - 0.7) * seen, 6) AS value FROM n2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7 * rel - (1 - 0.7) * seen, 6) DESC, id) = 1),
n3 AS (SELECT n2.q, n2.id, n2.rel, greatest(n2.seen, {_DOT.format('n2.v', 'p2.v')}) AS seen FROM n2 JOIN p2 USING (q) WHERE n2.id <> p2.id), p3 AS (SELECT *, round(0.7 * rel - (1 - 0.7) * seen, 6) AS value FROM n3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7 * rel - (1 - 0.7) * seen, 6) DESC, id) = 1)
SELECT q, id, CAST(1 AS INT) AS pick, value FROM p1 UNION ALL SELECT q, id, 2, value FROM p2 UNION ALL SELECT q, id, 3, value FROM p3""",
    "risk_coverage": f"WITH {_LAB}, {_RANKED} SELECT rank, errors, round(rank / n, 6) AS coverage, round(errors / rank, 6) AS risk FROM k",
    "risk_summary": f"WITH {_LAB}, {_RANKED}, m AS (SELECT max(n) AS n, max(hits) AS hits, avg(errors / rank) AS a, avg(greatest(0, rank - hits) / rank) AS o FROM k) SELECT n, round(a, 6) AS aurc, round(o, 6) AS aurc_oracle, round(a - o, 6) AS e_aurc, round(hits / n, 6) AS accuracy FROM m",
    "calibration": f"WITH {_LAB}, {_BINS} SELECT CAST(r.i AS INT) AS bin, coalesce(n, 0) AS n, {_MEAN6.format('total', 'n')} AS mean_conf, round(hits / n, 6) AS accuracy FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i",
    "calibration_summary": f"""WITH {_LAB}, {_BINS}, t AS (SELECT count(*) AS n, CAST(sum({_SQ}) AS BIGINT) AS sq, count(*) FILTER (NOT wrong) AS hits FROM l),
m AS (SELECT sum(b.n / t.n * (total / (b.n * 1e9) - b.hits / b.n) ** 2) AS rel, sum(b.n / t.n * (b.hits / b.n - t.hits / t.n) ** 2) AS res, sum(b.n / t.n * abs(total / (b.n * 1e9) - b.hits / b.n)) AS ece FROM b, t)
SELECT n, {_MEAN6.format('sq', 'n')} AS brier, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(hits / n * (1 - hits / n), 6) AS uncertainty, round(ece, 6) AS ece, round(n / 10, 6) AS rows_per_bin FROM m, t""",
    "brier": f"WITH {_LAB}, g AS (SELECT stratum, count(*) AS n, CAST(sum({_SQ}) AS BIGINT) AS sq, count(*) FILTER (NOT wrong) AS k FROM l GROUP BY stratum) SELECT stratum, {_MEAN6.format('sq', 'n')} AS brier, round(k / n * (1 - k / n), 6) AS uncertainty FROM g",
    "oos_detection": f"""WITH {_LAB}, g AS (SELECT stratum, count(*) FILTER (gold = 'other_unclear' AND pred = 'other_unclear') AS tp, count(*) FILTER (gold <> 'other_unclear' AND pred = 'other_unclear') AS fp, count(*) FILTER (gold = 'other_unclear' AND pred <> 'other_unclear') AS fn FROM l GROUP BY stratum),
h AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM g) SELECT stratum, tp + fn AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM h""",
    "confusion_matrix": f"""WITH {_LAB}, c AS (SELECT gold, pred, count(*) AS c FROM l GROUP BY ALL), n AS (SELECT gold, sum(c) AS n FROM c GROUP BY gold), j AS (SELECT c.*, n, coalesce(r.c, 0) AS rev, c.gold <> c.pred AS off FROM c JOIN n USING (gold) LEFT JOIN c r ON r.gold = c.pred AND r.pred = c.gold)
SELECT gold, pred, c, round(c / n, 6) AS share, CASE WHEN off THEN rev END AS reverse, CASE WHEN off THEN round(least(c, rev) / (c + rev), 6) END AS symmetry, CASE WHEN off THEN CASE WHEN least(c, rev) / (c + rev) > 0.35 THEN 'symmetric' ELSE 'asymmetric' END END AS diagnosis FROM j""",
    "mcnemar_report": f"WITH {_MC}, t AS (SELECT stratum, count(*) AS n FROM v GROUP BY stratum) SELECT mc.stratum, n, b AS only_a, c AS only_b, chi2, p, chi2 > 3.841 AS significant, CASE WHEN b + c > 0 THEN round(100.0 * (sqrt(3.841 * (b + c)) + 1) / n, 6) END AS detectable_points FROM mc JOIN t ON t.stratum IS NOT DISTINCT FROM mc.stratum",
    "rules_coverage": _RULED + "SELECT count(*) AS n, count(*) FILTER (matched) AS matched, count(*) FILTER (matched AND label = predicted) AS right_matched, count(*) FILTER (label = predicted) AS right, round(count(*) FILTER (matched) / count(*), 6) AS coverage FROM pr",
    "baseline_comparison": f"""WITH {_LAB}, d AS (SELECT message_id, min(input_text_redacted) AS text FROM decision_record WHERE input_text_redacted IS NOT NULL GROUP BY message_id), a AS (SELECT message_id, min(stratum) AS stratum, min(gold) AS gold, min(pred) AS pred FROM l GROUP BY message_id), x AS (SELECT * FROM a JOIN d USING (message_id)),
tr AS (SELECT *, gold AS label FROM x WHERE stratum <> 'random'), ts AS (SELECT * FROM x WHERE stratum = 'random'), {_mined('tr')}, {_ruled('ts', 'message_id')},
ct AS (SELECT gold AS draw, count(*) AS n FROM tr GROUP BY gold), sh AS (SELECT draw, sum(n) OVER (ORDER BY draw) / sum(n) OVER () AS upto, (sum(n) OVER (ORDER BY draw) - n) / sum(n) OVER () AS above FROM ct),
wd AS (SELECT pr.*, fallback, draw FROM pr LEFT JOIN sh ON {_U.format("message_id || '|prior'")} >= above AND {_U.format("message_id || '|prior'")} < upto, fb),
each AS (SELECT gold, gold = pred AS a, unnest([{{'system': 'classifier', 'guess': pred}}, {{'system': 'constant', 'guess': fallback}}, {{'system': 'prior', 'guess': coalesce(draw, '')}}, {{'system': 'rules', 'guess': predicted}}], recursive := true) FROM wd),
c AS (SELECT system, gold, guess AS pred, count(*) AS c FROM each GROUP BY ALL), s AS (SELECT system, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT system, gold AS label, CASE WHEN gold = pred THEN c ELSE 0 END AS tp, 0 AS fp, CASE WHEN gold <> pred THEN c ELSE 0 END AS fn FROM c UNION ALL SELECT system, pred, 0, c, 0 FROM c WHERE gold <> pred) GROUP BY ALL),
f AS (SELECT system, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM s), m AS (SELECT system, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS macro_f1 FROM f GROUP BY system),
g AS (SELECT system, count(*) AS n, count(*) FILTER (gold = guess) AS k, count(*) FILTER (a AND gold <> guess) AS b, count(*) FILTER (NOT a AND gold = guess) AS c FROM each GROUP BY system), h AS (SELECT *, {_CHI} AS chi FROM g)
SELECT h.system, n, k, round(k / n, 6) AS rate, {_wilson_sql('k', 'n')}, macro_f1, b AS only_a, c AS only_b, round(chi, 6) AS chi2, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {_ERFC} END, 4) AS p FROM h JOIN m USING (system)""",
    "constant_reply": f"SELECT DISTINCT message_id, '{CONSTANT_REPLY}' AS reply, CAST({len(CONSTANT_REPLY)} AS INT) AS chars, regexp_matches('{CONSTANT_REPLY}', '{X.DM.removeprefix('(?i)')}', 'i') AS asks_for_message FROM decision_record WHERE message_id IS NOT NULL",
    "prediction_gold": f"""WITH {_EX}, g AS (SELECT message_id, min(intent) AS gold_intent FROM (SELECT DISTINCT message_id, evidence[1].evidence_id AS evidence_id FROM decision_record) JOIN e USING (evidence_id) WHERE intent IS NOT NULL GROUP BY message_id)
SELECT DISTINCT message_id, gold_intent, predicted_intent AS pred_intent, intent_confidence AS pred_intent_confidence FROM g JOIN decision_record USING (message_id) WHERE predicted_intent IS NOT NULL""",
    "error_kinds": f"WITH {_LAB}, k AS (SELECT 'intent' AS kind, gold AS truth, pred AS guess FROM l WHERE stratum = 'random' UNION ALL SELECT 'action', CASE WHEN grounding_passed THEN 'auto_handle' WHEN NOT grounding_passed THEN 'escalate' END, CASE WHEN action IN ('auto_send', 'request_info') THEN 'auto_handle' ELSE 'escalate' END FROM l WHERE stratum = 'random') SELECT kind, truth, guess, count(*) AS n FROM k WHERE truth <> guess GROUP BY ALL",
    "action_rates": f"WITH d AS (SELECT {_TIDY} AS stratum, NOT grounding_passed AS due, decision.action NOT IN ('auto_send', 'request_info') AS handed FROM decision_record WHERE grounding_passed IS NOT NULL AND decision.action IS NOT NULL) SELECT stratum, count(*) AS n, count(*) FILTER (due AND handed) AS handed_due, count(*) FILTER (due AND NOT handed) AS bad_auto, count(*) FILTER (NOT due AND handed) AS needless, count(*) FILTER (NOT due AND NOT handed) AS auto_fine, round(count(*) FILTER (due = handed) / count(*), 6) AS accuracy, round(count(*) FILTER (due) / count(*), 6) AS always_handed_accuracy, round(count(*) FILTER (NOT handed) / count(*), 6) AS automation_rate FROM d GROUP BY stratum",
    "bootstrap_ci": f"WITH {_LAB}, x AS (SELECT rep, CAST(('0x' || substr(md5(rep || ':' || message_id || '|' || conf || '|' || gold), 1, 8)) AS BIGINT) / 4294967296.0 AS u, CAST(NOT wrong AS INT) AS f FROM l, range(1, 201) r(rep)), s AS (SELECT rep, sum({_POISSON}) AS n, sum(({_POISSON}) * f) AS k FROM x GROUP BY rep) SELECT count(*) AS reps, round(quantile_cont(k / n, 0.025), 6) AS low, round(quantile_cont(k / n, 0.5), 6) AS median, round(quantile_cont(k / n, 0.975), 6) AS high FROM s WHERE n > 0",
    "tau_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "tau_choice": f"WITH {_SWEEP} SELECT coalesce((SELECT tau FROM sweep WHERE automated > 0 AND bad * 21 <= automated ORDER BY automated DESC, tau DESC LIMIT 1), CAST(0.95 AS DOUBLE)) AS tau",
    "class_thresholds": f"WITH {_LAB}, d AS (SELECT l.*, CAST(round(k * 0.05, 2) AS DOUBLE) AS t FROM l, range(1, 20) r(k)), p AS (SELECT pred AS label, t, count(*) FILTER (NOT wrong) AS tp, count(*) FILTER (wrong) AS fp FROM d WHERE conf >= t GROUP BY ALL), n AS (SELECT gold AS label, t, count(*) AS pos FROM d GROUP BY ALL), s AS (SELECT n.label, n.t, round(2 * coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp, 0) + pos), 6) AS f1 FROM n LEFT JOIN p ON p.label = n.label AND p.t = n.t) SELECT label, t, f1 FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) = 1",
    "prior_draw": f"WITH {_LAB}, c AS (SELECT gold, count(*) AS n FROM l GROUP BY gold), b AS (SELECT gold, sum(n) OVER (ORDER BY gold) / sum(n) OVER () AS upto, (sum(n) OVER (ORDER BY gold) - n) / sum(n) OVER () AS above FROM c), i AS (SELECT DISTINCT message_id, {_U.format(chr(39).join(['message_id || ', '|prior', '']))} AS u FROM l) SELECT message_id, gold AS draw FROM i JOIN b ON u >= above AND u < upto",
    "rules_fit": f"WITH {_ROWS}, {_mined('x')} SELECT * FROM r",
    "rules_predict": _RULED + "SELECT evidence_id, predicted, matched FROM pr",
    "index_stats": f"WITH {_EX} SELECT brand, intent, count(*) AS n, round(avg(length(brand_reply)), 4) AS reply_length, round(max(dense_score), 6) AS best FROM e GROUP BY ALL",
    "action_confusion": f"WITH d AS (SELECT {_TIDY} AS stratum, decision.action IN ('auto_send', 'request_info') AS auto, grounding_passed AS g FROM decision_record) SELECT stratum, count(*) AS n, count(*) FILTER (auto AND g) AS auto_grounded, count(*) FILTER (auto AND NOT g) AS auto_ungrounded, count(*) FILTER (NOT auto) AS handed_over FROM d GROUP BY stratum",
}
