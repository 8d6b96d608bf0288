"""Further queries: resolved threads, pools, citations, votes, paired statistics, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.keys import tidy_label
from threadloom.operators import messages as M
from threadloom.operators import models as L
from threadloom.operators import retrieval as R
from threadloom.operators import stats as S
from threadloom.plans import evaluation as E
from threadloom.plans import texts as T
from threadloom.session import table


def resolved_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 50 threads per brand: those whose first resolving brand turn is confirmed, then the rest."""
    first = M.resolutions(M.threads(table(spark, sf_dir, "twcs")))
    return R.top(first.withColumn("c", F.col("confirmed").cast("int")), "brand", "c", F.col("root"), 50).select("brand", "root", "confirmed", "rank")


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the size of its brand's and intent's pool, and the first five others of the brand."""
    e = E._exemplars(spark, sf_dir).where("brand is not null and intent is not null").select("evidence_id", "brand", "intent")
    q = E._asked(e, "evidence_id")
    size = e.groupBy("brand", "intent").agg((F.count("*") - 1).alias("pool"))
    # five per brand and intent hold the first five of any "all but one intent"
    heads = R.top(e.withColumn("one", F.lit(1)).withColumn("bi", F.struct("brand", "intent")), "bi", "one", F.col("evidence_id"), 5).select("brand", F.col("intent").alias("other"), F.col("evidence_id").alias("tail"))
    tails = q.join(heads, "brand").where("other != intent").withColumn("k", F.row_number().over(Window.partitionBy("evidence_id").orderBy("tail"))).where("k <= 5")
    listed = tails.groupBy("evidence_id").agg(F.array_join(F.array_sort(F.collect_list("tail")), ",").alias("tail"))
    return q.join(size, ["brand", "intent"]).join(listed, "evidence_id", "left").select("evidence_id", "pool", F.coalesce("tail", F.lit("")).alias("tail"))


def partial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the three labels whose nearest vectors are nearest, over all vectors, and always the rest class -1."""
    v = E._vectors(spark, sf_dir)
    best = R.top(R.best_per_label(v, v.where("id % 50 = 0").select(F.col("id").alias("q"), "v")), "q", "score", F.col("label"), 3)
    return best.select("q", "label").unionByName(best.select("q", F.lit(-1).alias("label")).distinct())


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence per record that no precedent is, or that shares no word of five letters with the draft."""
    d = table(spark, sf_dir, "decision_record").select("message_id", F.col("decision.reply_draft").alias("draft"), F.explode("decision.evidence_ids").alias("evidence_id")).distinct()
    known = E._exemplars(spark, sf_dir).select("evidence_id", "brand_reply")
    long = lambda c: F.regexp_extract_all(F.lower(X.text(c)), F.lit("[a-z]{5,}"), F.lit(0))
    j = d.join(known.withColumn("known", F.lit(True)), "evidence_id", "left")
    weak = F.col("known") & (F.size(long(F.col("draft"))) > 0) & ~F.arrays_overlap(long(F.col("draft")), long(F.col("brand_reply")))
    return j.groupBy("message_id").agg(F.count("*").alias("cited"), F.count_if(F.col("known").isNull()).alias("dangling"), F.count_if(weak).alias("weak"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote per delivery of a record and criterion."""
    d = table(spark, sf_dir, "decision_record").where(F.col("decision.reply_draft").isNotNull())
    t = F.col("decision.reply_draft")
    criteria = {"grounded": F.col("grounding_passed"), "short": F.char_length(t) <= 280, "unsigned": ~t.rlike(X.SIGIL_END), "plain": F.size(X.masked(t)[1]) == 0}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), c.alias("pass")) for n, c in criteria.items()))).alias("v")
    return d.select("message_id", tidy_label(F.col("stratum")).alias("stratum"), "cache_hit", each).select("message_id", "stratum", "cache_hit", "v.*").where("pass is not null")


def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion passes if all votes do; votes that differ are a disagreement."""
    return _votes(spark, sf_dir).groupBy("message_id", "criterion").agg(F.bool_and("pass").alias("pass"), (F.count_distinct("pass") > 1).alias("disagreed"))


def reply_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdict_merge(spark, sf_dir)
    every = v.groupBy("message_id").agg(F.bool_and("pass").alias("pass"), F.bool_or("disagreed").alias("disagreed")).withColumn("criterion", F.lit("all"))
    return S.proportions(v.unionByName(every.select("message_id", "criterion", "pass", "disagreed")), ["criterion"], F.col("pass"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the classifier's lead over its most common class, with the same draws for both."""
    v = E._votes(spark, sf_dir).select(F.concat_ws("|", "message_id", F.coalesce("stratum", F.lit(""))).alias("key"), (F.col("a").cast("int") - F.col("b").cast("int")).alias("d"))
    each = v.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(200))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), "key")), 1, 8), 16, 10).cast("double") / 4294967296.0
    sums = each.withColumn("w", S.poisson_weight(u)).groupBy("rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("d")).alias("k")).where("n > 0").select((F.col("k") / F.col("n")).alias("r"))
    return sums.agg(F.round(F.avg((F.col("r") <= 0).cast("double")), 6).alias("p"), *(F.round(F.percentile("r", F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sensitivity(E._labelled(spark, sf_dir))


def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of predicted intents and reference intents as two clusterings."""
    return L.adjusted_rand(E._labelled(spark, sf_dir).groupBy(F.col("gold").alias("a"), F.col("pred").alias("b")).agg(F.count("*").alias("c")))


def noise_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E._labelled(spark, sf_dir)
    return d.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == "other_unclear").alias("unclear"))


def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cluster_stability(E._vectors(spark, sf_dir))


def text_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E._exemplars(spark, sf_dir).select("evidence_id", F.col("customer_text").alias("text"), F.col("intent").alias("label"))
    return L.svm_accuracy(rows, "evidence_id")


def vector_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.vector_regression(E._vectors(spark, sf_dir), "id")


_NAMES = "resolved_threads candidate_pool partial_labels citation_check verdict_merge reply_quality paired_bootstrap cost_sensitivity ari noise_share cluster_stability text_svm vector_regression".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_VOTE_ROWS = f"""v AS (SELECT message_id, unnest([{{'criterion': 'grounded', 'pass': grounding_passed}}, {{'criterion': 'short', 'pass': length(t) <= 280}}, {{'criterion': 'unsigned', 'pass': NOT regexp_matches(t, '{X.SIGIL_END}')}}, {{'criterion': 'plain', 'pass': NOT {E._any_mask().replace("coalesce(input_text_redacted, '')", "t")}}}], recursive := true) FROM (SELECT message_id, grounding_passed, decision.reply_draft AS t FROM decision_record WHERE decision.reply_draft IS NOT NULL)),
m AS (SELECT message_id, criterion, bool_and(pass) AS pass, count(DISTINCT pass) > 1 AS disagreed FROM v WHERE pass IS NOT NULL GROUP BY ALL)"""
ORACLES = {
    "resolved_threads": T._THREADS
    + f""", f AS (SELECT *, lead(text) OVER (PARTITION BY root ORDER BY turn) AS follow, lead(id) OVER (PARTITION BY root ORDER BY turn) IS NULL AS last FROM kept),
ok AS (SELECT root, author AS brand, NOT last AND {T._re("coalesce(follow, '')", X.CONFIRMATION)} AS confirmed FROM f WHERE NOT coalesce(inbound, false) AND {T._STEP} QUALIFY row_number() OVER (PARTITION BY root ORDER BY turn) = 1)
SELECT brand, root, confirmed, CAST(row_number() OVER (PARTITION BY brand ORDER BY confirmed DESC, root) AS INT) AS rank FROM ok QUALIFY rank <= 50""",
    "candidate_pool": f"""WITH {E._EX}, x AS (SELECT evidence_id, brand, intent FROM e WHERE brand IS NOT NULL AND intent IS NOT NULL), q AS (SELECT * FROM x WHERE {E._ID.format('substr(evidence_id, 3)')} % 50 = 0),
p AS (SELECT brand, intent, count(*) - 1 AS pool FROM x GROUP BY ALL), t AS (SELECT q.evidence_id, x.evidence_id AS tail FROM q JOIN x ON x.brand = q.brand AND x.intent <> q.intent QUALIFY row_number() OVER (PARTITION BY q.evidence_id ORDER BY x.evidence_id) <= 5)
SELECT q.evidence_id, pool, coalesce((SELECT string_agg(tail, ',' ORDER BY tail) FROM t WHERE t.evidence_id = q.evidence_id), '') AS tail FROM q JOIN p USING (brand, intent)""",
    "partial_labels": f"WITH {E._VEC}, b AS (SELECT q, label, max(score) AS score FROM near JOIN v USING (id) GROUP BY ALL), t AS (SELECT q, label FROM b QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, label) <= 3) SELECT q, label FROM t UNION ALL SELECT DISTINCT q, CAST(-1 AS INT) FROM t",
    "citation_check": f"""WITH {E._EX}, d AS (SELECT DISTINCT message_id, decision.reply_draft AS draft, unnest(decision.evidence_ids) AS evidence_id FROM decision_record),
j AS (SELECT message_id, e.evidence_id IS NOT NULL AS known, regexp_extract_all(lower(coalesce(draft, '')), '[a-z]{{5,}}') AS a, regexp_extract_all(lower(coalesce(brand_reply, '')), '[a-z]{{5,}}') AS b FROM d LEFT JOIN e USING (evidence_id))
SELECT message_id, count(*) AS cited, count(*) FILTER (NOT known) AS dangling, count(*) FILTER (known AND len(a) > 0 AND NOT list_has_any(a, b)) AS weak FROM j GROUP BY message_id""",
    "verdict_merge": f"WITH {_VOTE_ROWS} SELECT * FROM m",
    "reply_quality": f"WITH {_VOTE_ROWS}, a AS (SELECT criterion, pass FROM m UNION ALL SELECT 'all', bool_and(pass) FROM m GROUP BY message_id) " + E._props_sql("a", "pass").replace("stratum", "criterion"),
    "paired_bootstrap": f"WITH {E._VOTES}, x AS (SELECT rep, CAST(('0x' || substr(md5(rep || ':' || message_id || '|' || coalesce(stratum, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS u, CAST(a AS INT) - CAST(b AS INT) AS d FROM v, range(1, 201) r(rep)), s AS (SELECT rep, sum(({E._POISSON}) * d) / sum({E._POISSON}) AS r FROM x GROUP BY rep) SELECT round(avg(CAST(r <= 0 AS DOUBLE)), 6) AS p, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM s",
    "cost_sensitivity": f"WITH {E._LAB}, g AS (SELECT CAST(ratio AS INT) AS ratio, count(*) AS n, count(*) FILTER (conf >= ratio / (ratio + 1.0)) AS kept, count(*) FILTER (conf >= ratio / (ratio + 1.0) AND wrong) AS bad, count(*) FILTER (conf < ratio / (ratio + 1.0) AND NOT wrong) AS needless FROM l, (SELECT unnest([5, 10, 20, 50]) AS ratio) GROUP BY ratio), w AS (SELECT *, {E._wilson_sql('bad', 'nullif(kept, 0)')} FROM g) SELECT ratio, round(ratio / (ratio + 1.0), 6) AS threshold, n, kept, bad, round(kept / n, 6) AS coverage, round(bad / greatest(kept, 1), 6) AS risk, CASE WHEN kept = 0 THEN 0.0 ELSE low END AS low, CASE WHEN kept = 0 THEN 1.0 ELSE high END AS high, round(100.0 * (bad * ratio + needless) / n, 4) AS cost, ratio = 20 AS is_default FROM w",
    "ari": f"WITH {E._LAB}, c AS (SELECT gold, pred, count(*) AS c FROM l GROUP BY ALL), x AS (SELECT (SELECT sum(c * (c - 1) / 2.0) FROM c) AS s, (SELECT sum(c) FROM c) AS n, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT sum(c) AS c FROM c GROUP BY gold)) AS sa, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT sum(c) AS c FROM c GROUP BY pred)) AS sb) SELECT round((s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari FROM x",
    "noise_share": f"WITH {E._LAB} SELECT stratum, count(*) AS n, count(*) FILTER (pred = 'other_unclear') AS unclear FROM l GROUP BY stratum",
}
