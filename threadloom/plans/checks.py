"""Queries of grounding, hybrid retrieval, guards, and the harness of reply verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.keys import id_number, tidy_label
from threadloom.operators import filters as G
from threadloom.operators import grounding as V
from threadloom.operators import messages as M
from threadloom.operators import retrieval as R
from threadloom.operators import sampling as H
from threadloom.operators import stats as S
from threadloom.operators import verdicts as J
from threadloom.plans import evaluation as E
from threadloom.plans import texts as T
from threadloom.plans.general import _ID
from threadloom.session import checkpoint, table


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_id, draft, replies``: each draft with the replies that it was written from."""
    d = table(spark, sf_dir, "decision_record")
    return d.select("message_id", F.col("decision.reply_draft").alias("draft"), F.col("evidence.brand_reply").alias("replies"), "evidence").where("message_id is not null")


def evidence_slots(spark, sf_dir):
    """Commitments of each draft that its evidence doesn't support."""
    reasons = V.slot_reasons(X.commitments(F.col("draft")), X.evidence_text(F.coalesce("replies", F.array().cast("array<string>"))))
    return _drafts(spark, sf_dir).where("draft is not null").select("message_id", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) == 0).alias("passed")).distinct()


def draft_validate(spark, sf_dir):
    """Why each draft can't be sent."""
    reasons = V.draft_reasons(F.col("draft"), F.col("replies"))
    return _drafts(spark, sf_dir).select("message_id", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) == 0).alias("passed")).distinct()


def exemplar_prompt(spark, sf_dir):
    return _drafts(spark, sf_dir).select("message_id", V.exemplar_lines(F.col("evidence")).alias("prompt")).distinct()


def judge_input(spark, sf_dir):
    """What a judge reads: the message, its draft, the evidence, and the criteria once in each order."""
    d = table(spark, sf_dir, "decision_record").where("message_id is not null and decision.reply_draft is not null")
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("ordering"), F.lit(", ".join(c)).alias("criteria")) for n, c in (("forward", CRITERIA), ("reverse", CRITERIA[::-1]))))).alias("o")
    parts = [F.lit("MESSAGE"), X.text(F.col("input_text_redacted")), F.lit("DRAFT"), F.col("draft"), F.lit("EVIDENCE"), V.exemplar_lines(F.col("evidence")), F.lit("CRITERIA"), F.col("o.criteria")]
    return d.select("message_id", "input_text_redacted", F.col("decision.reply_draft").alias("draft"), "evidence", asked).select("message_id", "o.ordering", F.array_join(F.array(*parts), "\n").alias("prompt")).distinct()


def top1_similarity(spark, sf_dir):
    return _drafts(spark, sf_dir).select("message_id", F.round(R.top1_similarity(F.col("evidence")), 6).alias("top1")).distinct()


def _docs(spark, sf_dir):
    return E._exemplars(spark, sf_dir).select(id_number(F.substring("evidence_id", 3, 30)).alias("id"), "brand", "intent", F.col("customer_text").alias("text")).where("id is not null")


def hybrid_retrieve(spark, sf_dir):
    """Three precedents for each query by a lexical and a dense list of its brand's and intent's pool; vectors are hashed token counts."""
    docs = checkpoint(_docs(spark, sf_dir))
    return R.hybrid(docs, docs.where("id % 50 = 0").select(F.col("id").alias("q")))


def leak_scan(spark, sf_dir):
    """Long strings anywhere in the log outside two known fields, and drafts of records that shouldn't have one."""
    return G.leaks(table(spark, sf_dir, "decision_record"), 200, ("input_text_redacted", "raw_model_output")).where("n > 0")


def allow_list(spark, sf_dir):
    """The records with four top-level fields and two fields of the decision."""
    d = table(spark, sf_dir, "decision_record").select("message_id", "stratum", "predicted_intent", "decision")
    d = d.withColumn("decision", F.when(F.col("decision").isNotNull(), F.struct("decision.intent", "decision.action")))
    kept = G.allowed_only(d, {"message_id": None, "stratum": None, "predicted_intent": None, "decision": ["intent", "action"]})
    return kept.select("message_id", "stratum", "predicted_intent", F.col("decision.intent").alias("intent"), F.col("decision.action").alias("action")).distinct()


def blank_column(spark, sf_dir):
    """How many deletion reasons blanking would empty."""
    return G.blanked(table(spark, sf_dir, "tweet_deletions"), "reason")[1]


def stray_fields(spark, sf_dir):
    """Escalation reasons of decisions that don't escalate, nulled with a note."""
    d = table(spark, sf_dir, "decision_record").select("message_id", F.col("decision.action").alias("action"), F.col("decision.escalation_reason").alias("reason"))
    d = G.without_stray(d, "reason", F.col("action") == "escalate", "reason dropped")
    return d.select("message_id", "action", "reason", F.array_join("notes", ",").alias("notes")).distinct()


def slice_violations(spark, sf_dir):
    d = table(spark, sf_dir, "decision_record").select(tidy_label(F.col("stratum")).alias("stratum"))
    return G.slice_violations(d, "stratum", "random")


#: First numbers of the strata's ids; fixed values.
OFFSETS = {"random": 0, "stratified": 100, "adversarial": 160, "policy_trap": 185}


def sequential_ids(spark, sf_dir):
    """Numbered ids of a sample: per stratum the records of the least salted hash, as many as its range has room for."""
    d = table(spark, sf_dir, "decision_record").select("message_id", tidy_label(F.col("stratum")).alias("stratum")).where("message_id is not null").distinct()
    sample = R.top(d.where(F.col("stratum").isin(list(OFFSETS))).withColumn("u", -H.fraction(F.concat("message_id", F.lit("|golden")))), "stratum", "u", F.col("message_id"), 15)
    return G.sequential_ids(sample.select("message_id", "stratum"), "stratum", "message_id", OFFSETS)


def semi_sample(spark, sf_dir):
    """All messages of the sampled conversations' openers."""
    rows = table(spark, sf_dir, "decision_record").select("message_id", id_number(F.col("conversation_id")).cast("string").alias("conversation")).where("conversation is not null").distinct()
    return G.semi_sample(rows, "conversation", H.hash_sample(rows.select("conversation").distinct(), "conversation", 10.0))


def label_quota(spark, sf_dir):
    """Strata by predicate, each of its own size, filled up from the rest in the order of ids."""
    return H.stratified_take(E._exemplars(spark, sf_dir), "evidence_id", E._buckets(F.col("customer_text")), {"refund": 25, "broken": 10, "money": 5, "filler": 30})


def dedupe_stats(spark, sf_dir):
    return H.dedupe_stats(H.dedupe_normal(table(spark, sf_dir, "exemplar"), "evidence_id", "brand_reply"))


def _brand(spark, sf_dir) -> str:
    """The brand that writes the most messages (ties: the lesser name)."""
    t = table(spark, sf_dir, "twcs").where((tidy_label(F.col("inbound")) == "false") & F.col("author_id").rlike("[A-Za-z]"))
    return t.groupBy("author_id").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "author_id").first()[0]


def brand_threads(spark, sf_dir):
    """Threads of the busiest brand with at least four turns: found by its own turns on the best branch."""
    turns = checkpoint(M.threads(table(spark, sf_dir, "twcs")).select("root", "turn", "id", "author", "inbound"))
    return G.long_threads(G.brand_threads(turns, _brand(spark, sf_dir).upper()), 4).groupBy("root").agg(F.count("*").alias("turns"))


def thread_gate(spark, sf_dir):
    """Running number of each record of a conversation by the time it was logged, gated from the fourth on."""
    d = table(spark, sf_dir, "decision_record").where("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(F.min("logged_at").alias("at"), F.min(id_number(F.col("conversation_id"))).alias("conversation"))
    return G.thread_gate(d.where("conversation is not null"), "conversation", "at", 4).select("id", "conversation", "number", "gated")


def resolved_rows(spark, sf_dir):
    """Labelled records per intent; an intent beside those of the precedents would be an error."""
    known = [r[0] for r in S.few(E._exemplars(spark, sf_dir).where("intent is not null").select("intent").distinct()).collect()]
    d = table(spark, sf_dir, "decision_record").select("message_id", "predicted_intent", F.col("decision.action").alias("action"), "intent_confidence").where(F.col("predicted_intent").isin(known)).distinct()
    return G.resolved_rows(d, "predicted_intent", "action", "intent_confidence", known=known).groupBy("predicted_intent").agg(F.count("*").alias("n"))


def label_report(spark, sf_dir):
    """Per stratum: labelled records, how many labels a reviewer (the first evidence) changed, and the rate of unclear ones."""
    d = E._labelled(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("wrong").alias("changed"), F.count_if(F.col("gold") == "other_unclear").alias("unclear"))
    return d.select("stratum", "n", "changed", F.round(F.col("changed") / F.col("n"), 6).alias("override_rate"), F.round(F.col("unclear") / F.greatest(F.lit(1), F.col("n")), 6).alias("unclear_rate"))


CRITERIA = ("grounded", "short", "unsigned", "plain")


def _checked(text: F.Column, grounded: F.Column) -> dict:
    return {"grounded": grounded, "short": F.char_length(text) <= 280, "unsigned": ~text.rlike(X.SIGIL_END), "plain": F.size(X.masked(text)[1]) == 0}


def _verdicts(spark, sf_dir) -> DataFrame:
    """``message_id, system, criterion, pass, flip, quote``: drafts, historical replies and the constant one under the same checks.

    A delivery of a record is one reading of it; ``flip`` says that readings differ.
    """
    d = table(spark, sf_dir, "decision_record").where("message_id is not null")
    first = F.get("evidence", F.lit(0))["brand_reply"]
    texts = {"draft": F.col("decision.reply_draft"), "historical": first, "constant": F.lit(E.CONSTANT_REPLY)}
    grounded = {"draft": F.col("grounding_passed"), "historical": F.lit(True), "constant": F.lit(False)}
    rows = [F.struct(F.lit(s).alias("system"), F.lit(n).alias("criterion"), c.alias("pass"), first.alias("quote")) for s, t in texts.items() for n, c in _checked(t, grounded[s]).items()]
    each = d.select("message_id", F.explode(F.array(*rows)).alias("v")).select("message_id", "v.*").where("pass is not null")
    return each.groupBy("message_id", "system", "criterion").agg(F.bool_and("pass").alias("pass"), (F.count_distinct("pass") > 1).alias("flip"), F.max("quote").alias("quote"))


def verdict_quotes(spark, sf_dir):
    """A pass of ``grounded`` without a quote is a fail."""
    v = J.quoted(_verdicts(spark, sf_dir), "grounded")
    return v.groupBy("system", "criterion").agg(F.count("*").alias("n"), F.count_if("pass").alias("passed"), F.count_if("downgraded").alias("downgraded"))


def reply_quality_systems(spark, sf_dir):
    """Pass rates with intervals and flips, per system and criterion; the two controls must be there."""
    v = J.quoted(_verdicts(spark, sf_dir), "grounded")
    return J.reply_table(v, ("historical", "constant"))


def reply_pairs(spark, sf_dir):
    """Drafts against each control on the records that all three have, per criterion and over all."""
    return J.reply_pairs(J.quoted(_verdicts(spark, sf_dir), "grounded"), "draft")


def judge_summary(spark, sf_dir):
    """One row per criterion: every system's passes, rate and flips side by side, and the paired results."""
    v = checkpoint(J.quoted(_verdicts(spark, sf_dir), "grounded"))
    return J.reply_summary(J.reply_table(v, ("historical", "constant")), J.reply_pairs(v, "draft"))


def paraphrase_flips(spark, sf_dir):
    """Share of records whose verdict differs over three wordings of the limit on length."""
    d = table(spark, sf_dir, "decision_record").where("decision.reply_draft is not null").groupBy("message_id").agg(F.min("decision.reply_draft").alias("t"))
    variants = F.array(F.char_length("t") <= 140, F.char_length(F.trim("t")) <= 140, F.char_length("t") < 140)
    return J.flip_rate(d.select("message_id", F.explode(variants).alias("pass")), "message_id", "pass")


def human_scores(spark, sf_dir):
    """Verdicts on drafts with the scores of a reviewer (the guard's own flags) where all of them are filled."""
    v = _verdicts(spark, sf_dir)
    d = table(spark, sf_dir, "decision_record").where("message_id is not null").groupBy("message_id").agg(F.min("grounding_passed").alias("grounded"), F.min(F.col("repair_attempts") == 0).alias("plain"))
    return J.with_scores(v.select("message_id", "system", "criterion", "pass"), d, "draft", ["grounded", "plain"])


def noise_sample(spark, sf_dir):
    """Thirty unclear records by salted hash, with the share of unclear ones."""
    d = table(spark, sf_dir, "decision_record").where("message_id is not null and predicted_intent is not null").groupBy("message_id").agg(F.min("predicted_intent").alias("p"))
    share = d.agg(F.round(F.count_if(F.col("p") == "other_unclear") / F.count("*"), 6).alias("share"))
    return H.salted_top(d.where("p = 'other_unclear'").select("message_id"), "message_id", "noise", 30).select("message_id").crossJoin(share)  # one row


def intent_threads(spark, sf_dir):
    """Per intent up to 50 conversations of precedents, confirmed ones first: a confirmed one's reply is followed by thanks."""
    turns = checkpoint(M.threads(table(spark, sf_dir, "twcs")))
    p = M.resolutions(turns)
    intents = E._exemplars(spark, sf_dir).where("intent is not null").select(id_number(F.col("conversation_id")).alias("root"), "intent").where("root is not null").groupBy("root").agg(F.min("intent").alias("intent"))
    ranked = R.top(p.join(intents, "root").withColumn("c", F.col("confirmed").cast("int")), "intent", "c", F.col("root"), 50)
    return ranked.select("intent", "root", "confirmed", "rank")


def index_summary(spark, sf_dir):
    """Threads, those held out, brand replies in the pool, precedents, their share, and how many of their replies are copies."""
    t = table(spark, sf_dir, "twcs")
    turns = checkpoint(M.threads(t).select("root", "turn", "id", "author", "inbound", "text", "follow", "last"))
    held = table(spark, sf_dir, "decision_record").where(tidy_label(F.col("stratum")).isNotNull()).select(id_number(F.col("conversation_id")).alias("root")).where("root is not null").distinct()
    pool = turns.join(held, "root", "left_anti")
    whole = turns.agg(F.count_distinct("root").alias("threads"))
    kept = pool.agg(F.count_distinct("root").alias("pool"), F.count_if(~F.coalesce("inbound", F.lit(False))).alias("brand_replies"))
    found = M.precedents(pool).agg(F.count("*").alias("precedents"), F.count_distinct("brand_reply").alias("distinct_replies"))
    return whole.crossJoin(kept).crossJoin(found).select(  # single rows
        "threads", (F.col("threads") - F.col("pool")).alias("held_out"), "brand_replies", "precedents", F.round(S.ratio(F.col("precedents"), F.col("brand_replies")), 6).alias("precedent_ratio"), (F.col("precedents") - F.col("distinct_replies")).alias("copies")
    )


def citation_lines(spark, sf_dir):
    """Drafts as list items that cite their precedents, read back from the text."""
    ids = F.col("decision.evidence_ids")
    cited = F.when(F.size(ids) > 0, F.concat(F.lit(" [evidence: "), F.array_join(ids, ", "), F.lit("]"))).otherwise(F.lit(""))
    lines = table(spark, sf_dir, "decision_record").where("decision.reply_draft is not null").select("message_id", F.concat(F.lit("- "), F.regexp_replace("decision.reply_draft", r"[\[\]]", " "), cited).alias("line")).distinct()
    return J.citations(lines, E._exemplars(spark, sf_dir).select(F.col("evidence_id").alias("id"), F.col("brand_reply").alias("text")))


_NAMES = (
    "evidence_slots draft_validate exemplar_prompt judge_input top1_similarity hybrid_retrieve leak_scan allow_list blank_column stray_fields slice_violations sequential_ids semi_sample label_quota dedupe_stats brand_threads thread_gate "
    "resolved_rows label_report verdict_quotes reply_quality_systems reply_pairs judge_summary paraphrase_flips human_scores noise_sample intent_threads index_summary citation_lines"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TIDY, _EX, _LAB, _U = E._TIDY, E._EX, E._LAB, E._U
_CORPUS = r"lower(regexp_replace(coalesce(array_to_string(list_filter(replies, lambda y: y IS NOT NULL), ' '), ''), '\s+', ' ', 'g'))"
_RAW = "coalesce(array_to_string(list_filter(replies, lambda y: y IS NOT NULL), chr(10)), '')"
_SLOTS = ", ".join(f"{e} AS {n}" for n, e in T.SLOTS.items())
_BASE = f"b AS (SELECT message_id, decision.reply_draft AS text, list_transform(evidence, lambda s: s.brand_reply) AS replies, evidence FROM decision_record WHERE message_id IS NOT NULL), s AS (SELECT message_id, text, {_SLOTS}, {_CORPUS} AS corpus, {_RAW} AS raw FROM b)"
_LINE = r"lower(regexp_replace(promised_timeline, '\s+', ' ', 'g'))"
_SLOT_REASONS = rf"""list_filter([CASE WHEN refund_offered AND NOT regexp_matches(corpus, '\brefund') THEN 'refund' END, CASE WHEN NOT contains(corpus, CAST(refund_window_days AS VARCHAR)) THEN 'window:' || refund_window_days END,
CASE WHEN compensation_amount IS NOT NULL AND NOT (contains(corpus, printf('%.2f', compensation_amount)) OR contains(corpus, format('{{:,.2f}}', compensation_amount)) OR contains(corpus, CASE WHEN compensation_amount = floor(compensation_amount) THEN CAST(CAST(compensation_amount AS BIGINT) AS VARCHAR) ELSE CAST(compensation_amount AS VARCHAR) END)) THEN 'amount:' || printf('%.2f', compensation_amount) END,
CASE WHEN NOT contains(corpus, {_LINE}) THEN 'timeline:' || {_LINE} END, CASE WHEN entitlement_claimed IS NOT NULL AND NOT regexp_matches(corpus, '\bentitle') THEN 'entitlement' END], lambda x: x IS NOT NULL)"""


def _found(expr: str, pattern: str) -> str:
    return T._all_sql(expr, pattern)


_BARE_LINK = "regexp_replace(lower({0}), '[/.,]+$', '')"
_DRAFT = "coalesce(text, '')"
_DRAFT_REASONS = f"""list_concat(list_concat(list_concat(list_concat(list_concat({_SLOT_REASONS},
list_transform(list_filter({_found(_DRAFT, X.NUMBER)}, lambda x: NOT list_contains({E._PLAIN_SQL}, replace(x, ',', '')) AND NOT contains(corpus, lower(x))), lambda x: 'number:' || x)),
list_transform(list_filter({_found(_DRAFT, X.DATE)}, lambda x: NOT contains(corpus, lower(x))), lambda x: 'date:' || x)),
list_transform(list_filter({_found(_DRAFT, X.LINK)}, lambda x: NOT list_contains(list_transform({_found('raw', X.LINK)}, lambda u: {_BARE_LINK.format('u')}), {_BARE_LINK.format('x')})), lambda x: 'link:' || x)),
list_transform(list_filter({_found(_DRAFT, X.PHONE)}, lambda x: NOT list_contains(list_transform({_found('raw', X.PHONE)}, lambda u: regexp_replace(u, '[^0-9]', '', 'g')), regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: 'phone:' || x)),
CASE WHEN regexp_matches(text, '{X.SIGIL_END}') THEN ['mark'] ELSE [] END)"""
_DOCS = f"d AS (SELECT {_ID.format('substr(evidence_id, 3)')} AS id, brand, intent, customer_text AS text FROM e)"
_WIDE = f"""{_EX}, {_DOCS}, dk AS (SELECT * FROM d WHERE id IS NOT NULL), w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '{X.TOKEN}') AS w FROM dk), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY ALL), i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
m AS (SELECT id, brand, intent, brand || chr(31) || intent AS pool FROM dk WHERE brand IS NOT NULL AND intent IS NOT NULL), g AS (SELECT DISTINCT brand, intent, pool FROM m),
pl AS (SELECT pool, id FROM m UNION ALL (SELECT g.pool, m.id FROM g JOIN m ON m.brand = g.brand AND m.intent <> g.intent QUALIFY row_number() OVER (PARTITION BY g.pool ORDER BY m.id) <= 5)),
q AS (SELECT id AS q, pool FROM m WHERE id % 50 = 0), s AS (SELECT q.q, pl.id, coalesce(b.score, 0.0) AS score FROM q JOIN pl ON pl.pool = q.pool AND pl.id <> q.q LEFT JOIN (
  SELECT q.q, x.id, round(sum(a.tf * idf * x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * len(w.w) / avgdl))), 6) AS score FROM q JOIN p a ON a.id = q.q JOIN i ON i.term = a.term AND idf > 0 JOIN p x ON x.term = a.term JOIN w ON w.id = x.id GROUP BY ALL) b ON b.q = q.q AND b.id = pl.id),
lx AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 50),
hv AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) AS h FROM (SELECT id, unnest(w) AS t FROM w)), bk AS (SELECT id, h % 64 AS b, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM hv GROUP BY ALL), nm AS (SELECT id, sqrt(sum(x * x)) AS len FROM bk GROUP BY id),
v AS (SELECT id, list_transform(range(64), lambda j: coalesce(mp[j], 0.0) / CASE WHEN len = 0 THEN 1 ELSE len END) AS v FROM (SELECT id, map(list(b), list(CAST(x AS DOUBLE))) AS mp FROM bk GROUP BY id) JOIN nm USING (id) UNION ALL SELECT id, list_transform(range(64), lambda j: 0.0) FROM w WHERE len(w) = 0),
ds AS (SELECT q.q, pl.id, round(list_dot_product(a.v, b.v), 6) AS score FROM q JOIN pl ON pl.pool = q.pool AND pl.id <> q.q JOIN v a ON a.id = q.q JOIN v b ON b.id = pl.id), de AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM ds QUALIFY rank <= 50),
fu AS (SELECT q, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM (SELECT * FROM lx UNION ALL SELECT * FROM de) GROUP BY ALL), sc AS (SELECT fu.*, ds.score AS rel FROM fu JOIN ds USING (q, id)),
p1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY rel DESC, id) = 1), n2 AS (SELECT sc.*, list_dot_product(a.v, b.v) AS seen FROM sc JOIN p1 USING (q) JOIN v a ON a.id = sc.id JOIN v b ON b.id = p1.id WHERE sc.id <> p1.id),
p2 AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7 * rel - (1 - 0.7) * seen, 6) DESC, id) = 1), n3 AS (SELECT n2.q, n2.id, n2.rel, n2.rrf_score, greatest(n2.seen, list_dot_product(a.v, b.v)) AS seen FROM n2 JOIN p2 USING (q) JOIN v a ON a.id = n2.id JOIN v b ON b.id = p2.id WHERE n2.id <> p2.id),
p3 AS (SELECT * FROM n3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7 * rel - (1 - 0.7) * seen, 6) DESC, id) = 1), pk AS (SELECT q, id, 1 AS pick, rrf_score, rel FROM p1 UNION ALL SELECT q, id, 2, rrf_score, rel FROM p2 UNION ALL SELECT q, id, 3, rrf_score, rel FROM p3)"""
_FIRST = "evidence[1].brand_reply"
_SYSTEMS = {"draft": ("decision.reply_draft", "grounding_passed"), "historical": (_FIRST, "true"), "constant": (f"'{E.CONSTANT_REPLY}'", "false")}


def _checks_sql(t: str, grounded: str) -> dict[str, str]:
    return {"grounded": grounded, "short": f"length({t}) <= 280", "unsigned": f"NOT regexp_matches({t}, '{X.SIGIL_END}')", "plain": f"({t} IS NULL OR NOT {E._any_mask().replace(E._MASK_T, t)})"}


_READ = "rv AS (" + " UNION ALL ".join(f"SELECT message_id, '{s}' AS system, '{n}' AS criterion, {c} AS pass, {_FIRST} AS quote FROM decision_record WHERE message_id IS NOT NULL" for s, (t, g) in _SYSTEMS.items() for n, c in _checks_sql(t, g).items()) + "), vd AS (SELECT message_id, system, criterion, bool_and(pass) AS raw, count(DISTINCT pass) > 1 AS flip, max(quote) AS quote FROM rv WHERE pass IS NOT NULL GROUP BY ALL)"
_VERDICTS = _READ + r""", vq AS (SELECT message_id, system, criterion, flip, criterion = 'grounded' AND raw AND NOT coalesce(regexp_matches(quote, '\S'), false) AS downgraded, raw AND NOT (criterion = 'grounded' AND raw AND NOT coalesce(regexp_matches(quote, '\S'), false)) AS pass FROM vd),
va AS (SELECT message_id, system, criterion, pass, flip FROM vq UNION ALL SELECT message_id, system, 'all', bool_and(pass), NULL FROM vq GROUP BY message_id, system)"""
_TABLE = f"tb AS (SELECT system, criterion, n, k, round(k / n, 6) AS rate, {E._wilson_sql('k', 'n')}, flips FROM (SELECT system, criterion, count(*) AS n, count(*) FILTER (pass) AS k, CAST(sum(CAST(flip AS INT)) AS BIGINT) AS flips FROM va GROUP BY ALL))"
_PAIRS = f"""sd AS (SELECT message_id, criterion, max(CASE WHEN system = 'draft' THEN pass::INT END) = 1 AS a, max(CASE WHEN system = 'historical' THEN pass::INT END) = 1 AS h, max(CASE WHEN system = 'constant' THEN pass::INT END) = 1 AS k FROM va GROUP BY ALL HAVING count(*) = 3),
ot AS (SELECT criterion, 'historical' AS other, a, h AS o FROM sd UNION ALL SELECT criterion, 'constant', a, k FROM sd), pc AS (SELECT criterion, other, count(*) AS paired, count(*) FILTER (a AND NOT o) AS b, count(*) FILTER (NOT a AND o) AS c FROM ot GROUP BY ALL),
px AS (SELECT *, {E._CHI} AS chi FROM pc), pr AS (SELECT criterion, other, paired, b AS only_a, c AS only_b, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {E._ERFC} END, 4) AS p FROM px)"""
_LEAVES = [
    "message_id", "conversation_id", "stratum", "predicted_intent", "playbook_id", "policy_layer_fired", "commitments.promised_timeline", "commitments.entitlement_claimed", "commitments.escalation_promise",
    *(f"decision.{c}" for c in "intent action reply_draft escalation_code escalation_reason route_to priority".split()), "validation_errors[]", "decision.evidence_ids[]", *(f"evidence[].{c}" for c in "evidence_id conversation_id customer_text brand_reply intent".split()),
]


def _leaf(path: str) -> str:
    if path.endswith("[]"):
        return path[:-2]
    if "[]." in path:
        return "list_transform({0}, lambda s: s.{1})".format(*path.split("[]."))
    return f"[{path}]"


_LINES = "array_to_string(list_transform(list_zip(coalesce(evidence, []), range(1, len(coalesce(evidence, [])) + 1)), lambda z: z[2] || '. [' || coalesce(z[1].evidence_id, '') || '] ' || coalesce(z[1].customer_text, '') || ' | ' || coalesce(z[1].brand_reply, '')), chr(10))"
ORACLES = {
    "evidence_slots": f"WITH {_BASE} SELECT DISTINCT message_id, array_to_string({_SLOT_REASONS}, '|') AS reasons, len({_SLOT_REASONS}) = 0 AS passed FROM s WHERE text IS NOT NULL",
    "draft_validate": f"WITH {_BASE}, r AS (SELECT message_id, CASE WHEN {_DRAFT} = '' THEN [] ELSE {_DRAFT_REASONS} END AS r FROM s) SELECT DISTINCT message_id, array_to_string(r, '|') AS reasons, len(r) = 0 AS passed FROM r",
    "exemplar_prompt": f"SELECT DISTINCT message_id, {_LINES} AS prompt FROM decision_record WHERE message_id IS NOT NULL",
    "judge_input": f"""SELECT DISTINCT message_id, ordering, array_to_string(['MESSAGE', coalesce(input_text_redacted, ''), 'DRAFT', decision.reply_draft, 'EVIDENCE', {_LINES}, 'CRITERIA', criteria], chr(10)) AS prompt
FROM decision_record, (VALUES ('forward', '{", ".join(CRITERIA)}'), ('reverse', '{", ".join(CRITERIA[::-1])}')) o(ordering, criteria) WHERE message_id IS NOT NULL AND decision.reply_draft IS NOT NULL""",
    "top1_similarity": "SELECT DISTINCT message_id, round(coalesce(list_max(list_transform(evidence, lambda s: coalesce(s.dense_score, s.rrf_score))), 0.0), 6) AS top1 FROM decision_record WHERE message_id IS NOT NULL",
    "hybrid_retrieve": f"WITH {_WIDE} SELECT pk.q, pk.id, CAST(pick AS INT) AS pick, CAST(lx.rank AS INT) AS bm25_rank, CAST(de.rank AS INT) AS dense_rank, rrf_score, rel AS dense_score FROM pk LEFT JOIN lx USING (q, id) LEFT JOIN de ON de.q = pk.q AND de.id = pk.id",
    "leak_scan": "SELECT field, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS field, sum(coalesce(len(list_filter({_leaf(p)}, lambda x: length(x) > 200)), 0)) AS n FROM decision_record" for p in _LEAVES) + ") WHERE n > 0",
    "allow_list": "SELECT DISTINCT message_id, stratum, predicted_intent, decision.intent AS intent, decision.action AS action FROM decision_record",
    "blank_column": r"SELECT count(*) FILTER (regexp_matches(reason, '\S')) AS changed FROM tweet_deletions",
    "stray_fields": "WITH d AS (SELECT message_id, decision.action AS action, decision.escalation_reason AS reason, coalesce(NOT coalesce(decision.action = 'escalate', false) AND decision.escalation_reason <> '', false) AS stray FROM decision_record) SELECT DISTINCT message_id, action, CASE WHEN NOT stray THEN reason END AS reason, CASE WHEN stray THEN 'reason dropped' ELSE '' END AS notes FROM d",
    "slice_violations": f"SELECT stratum, count(*) AS n FROM (SELECT {_TIDY} AS stratum FROM decision_record) WHERE stratum IS DISTINCT FROM 'random' GROUP BY stratum",
    "sequential_ids": f"""WITH d AS (SELECT DISTINCT message_id, {_TIDY} AS stratum FROM decision_record WHERE message_id IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_U.format("message_id || '|golden'")}, message_id) AS k FROM d WHERE stratum IN ({', '.join(f"'{x}'" for x in OFFSETS)}))
SELECT message_id, stratum, 'g' || lpad(CAST(CASE stratum {' '.join(f"WHEN '{k}' THEN {v}" for k, v in OFFSETS.items())} END + row_number() OVER (PARTITION BY stratum ORDER BY message_id) AS VARCHAR), 3, '0') AS id FROM t WHERE k <= 15""",
    "semi_sample": f"WITH r AS (SELECT DISTINCT message_id, CAST({_ID.format('conversation_id')} AS VARCHAR) AS conversation FROM decision_record) SELECT * FROM r WHERE conversation IS NOT NULL AND {_U.format('conversation')} < 0.1",
    "label_quota": f"""WITH {_EX}, a AS (SELECT evidence_id, 'refund' AS bucket FROM e WHERE regexp_matches(customer_text, 'refund', 'i') ORDER BY 1 LIMIT 25), b AS (SELECT evidence_id, 'broken' AS bucket FROM e WHERE regexp_matches(customer_text, 'broken|freezes|crashes', 'i') AND evidence_id NOT IN (SELECT evidence_id FROM a) ORDER BY 1 LIMIT 10),
c AS (SELECT evidence_id, 'money' AS bucket FROM e WHERE regexp_matches(customer_text, '{X.MONEY}') AND evidence_id NOT IN (SELECT evidence_id FROM a UNION ALL SELECT evidence_id FROM b) ORDER BY 1 LIMIT 5), f AS (SELECT evidence_id, 'filler' AS bucket FROM e WHERE evidence_id NOT IN (SELECT evidence_id FROM a UNION ALL SELECT evidence_id FROM b UNION ALL SELECT evidence_id FROM c) ORDER BY 1 LIMIT 30)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f""",
    "dedupe_stats": r"SELECT count(*) AS n_input, count(DISTINCT t) AS kept, count(*) - count(DISTINCT t) AS dropped, round((count(*) - count(DISTINCT t)) / count(*), 6) AS rate FROM (SELECT regexp_replace(lower(regexp_replace(coalesce(brand_reply, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS t FROM exemplar)",
    "brand_threads": T._THREADS + ", br AS (SELECT author_id FROM twcs WHERE lower(trim(inbound)) = 'false' AND regexp_matches(author_id, '[A-Za-z]') GROUP BY author_id ORDER BY count(*) DESC, author_id LIMIT 1) SELECT root, count(*) AS turns FROM kept WHERE root IN (SELECT root FROM kept, br WHERE NOT coalesce(inbound, true) AND lower(author) = lower(author_id)) GROUP BY root HAVING count(*) >= 4",
    "thread_gate": f"WITH d AS (SELECT message_id AS id, min(logged_at) AS made, min({_ID.format('conversation_id')}) AS conversation FROM decision_record WHERE message_id IS NOT NULL GROUP BY 1), n AS (SELECT id, conversation, row_number() OVER (PARTITION BY conversation ORDER BY made NULLS FIRST, id) AS number FROM d WHERE conversation IS NOT NULL) SELECT *, number >= 4 AS gated FROM n",
    "resolved_rows": f"WITH {_EX}, d AS (SELECT DISTINCT message_id, predicted_intent, decision.action AS action, intent_confidence FROM decision_record WHERE predicted_intent IN (SELECT intent FROM e)) SELECT predicted_intent, count(*) AS n FROM d WHERE trim(predicted_intent) <> '' AND trim(action) <> '' AND intent_confidence IS NOT NULL GROUP BY 1",
    "label_report": f"WITH {_LAB} SELECT stratum, count(*) AS n, count(*) FILTER (wrong) AS changed, round(count(*) FILTER (wrong) / count(*), 6) AS override_rate, round(count(*) FILTER (gold = 'other_unclear') / count(*), 6) AS unclear_rate FROM l GROUP BY stratum",
    "verdict_quotes": f"WITH {_VERDICTS} SELECT system, criterion, count(*) AS n, count(*) FILTER (pass) AS passed, count(*) FILTER (downgraded) AS downgraded FROM vq GROUP BY ALL",
    "reply_quality_systems": f"WITH {_VERDICTS}, {_TABLE} SELECT * FROM tb",
    "reply_pairs": f"WITH {_VERDICTS}, {_PAIRS} SELECT * FROM pr",
    "judge_summary": f"WITH {_VERDICTS}, {_TABLE}, {_PAIRS}, lf AS (SELECT criterion, string_agg(x, '; ' ORDER BY x) AS systems FROM (SELECT criterion, system || ' ' || k || ' ' || printf('%.4f', rate) || ' ' || printf('%.4f', low) || ' ' || printf('%.4f', high) || ' ' || coalesce(CAST(flips AS VARCHAR), '-') AS x FROM tb) GROUP BY 1), rg AS (SELECT criterion, max(paired) AS paired, string_agg(x, '; ' ORDER BY x) AS pairs FROM (SELECT criterion, paired, other || ' ' || only_a || ' ' || only_b || ' ' || printf('%.4f', p) AS x FROM pr) GROUP BY 1) SELECT * FROM lf JOIN rg USING (criterion)",
    "paraphrase_flips": "WITH d AS (SELECT message_id, min(decision.reply_draft) AS t FROM decision_record WHERE decision.reply_draft IS NOT NULL GROUP BY message_id), f AS (SELECT NOT (length(t) <= 140 AND length(trim(t)) <= 140 AND length(t) < 140) AND (length(t) <= 140 OR length(trim(t)) <= 140 OR length(t) < 140) AS flip FROM d) SELECT count(*) AS n, count(*) FILTER (flip) AS flips, round(count(*) FILTER (flip) / count(*), 6) AS rate FROM f",
    "human_scores": f"WITH {_READ}, d AS (SELECT message_id, min(grounding_passed) AS grounded, min(repair_attempts = 0) AS plain FROM decision_record WHERE message_id IS NOT NULL GROUP BY 1) SELECT vd.message_id, system, criterion, raw AS pass, CASE WHEN system = 'draft' AND grounded IS NOT NULL AND plain IS NOT NULL THEN CASE criterion WHEN 'grounded' THEN grounded WHEN 'plain' THEN plain END END AS human FROM vd LEFT JOIN d USING (message_id)",
    "noise_sample": f"WITH d AS (SELECT message_id, min(predicted_intent) AS p FROM decision_record WHERE message_id IS NOT NULL AND predicted_intent IS NOT NULL GROUP BY 1), s AS (SELECT round(count(*) FILTER (p = 'other_unclear') / count(*), 6) AS share FROM d) SELECT message_id, share FROM (SELECT message_id FROM d WHERE p = 'other_unclear' ORDER BY {_U.format(chr(39).join(['message_id || ', '|noise', '']))}, message_id LIMIT 30), s",
    "intent_threads": T._THREADS
    + f""", {_EX.replace("e AS (", "ex AS (", 1)}, f AS (SELECT *, lead(text) OVER (PARTITION BY root ORDER BY turn) AS follow, lead(id) OVER (PARTITION BY root ORDER BY turn) IS NULL AS last FROM kept),
ok AS (SELECT root, NOT last AND {T._re("coalesce(follow, '')", X.CONFIRMATION)} AS confirmed FROM f WHERE NOT coalesce(inbound, false) AND {T._STEP} QUALIFY row_number() OVER (PARTITION BY root ORDER BY turn) = 1),
it AS (SELECT {_ID.format('conversation_id')} AS root, min(intent) AS intent FROM ex WHERE intent IS NOT NULL GROUP BY 1) SELECT intent, ok.root, confirmed, CAST(row_number() OVER (PARTITION BY intent ORDER BY confirmed DESC, ok.root) AS INT) AS rank FROM ok JOIN it USING (root) QUALIFY rank <= 50""",
    "index_summary": T._THREADS
    + f""", hd AS (SELECT DISTINCT {_ID.format('conversation_id')} AS root FROM decision_record WHERE {_TIDY} IS NOT NULL AND {_ID.format('conversation_id')} IS NOT NULL), po AS (SELECT * FROM kept WHERE root NOT IN (SELECT root FROM hd)),
f AS (SELECT *, lead(text) OVER (PARTITION BY root ORDER BY turn) AS follow, lead(id) OVER (PARTITION BY root ORDER BY turn) IS NULL AS last FROM po), ok AS (SELECT {T._normal_sql('text')} AS reply FROM f WHERE NOT coalesce(inbound, false) AND {T._STEP} AND (last OR {T._re("coalesce(follow, '')", X.CONFIRMATION)}) QUALIFY row_number() OVER (PARTITION BY root ORDER BY turn) = 1),
wt AS (SELECT count(DISTINCT root) AS threads FROM kept), wp AS (SELECT count(DISTINCT root) AS pool, count(*) FILTER (NOT coalesce(inbound, false)) AS brand_replies FROM po), wc AS (SELECT count(*) AS precedents, count(DISTINCT reply) AS d FROM ok)
SELECT threads, threads - pool AS held_out, brand_replies, precedents, round(CASE WHEN brand_replies = 0 THEN 0.0 ELSE precedents / brand_replies END, 6) AS precedent_ratio, precedents - d AS copies FROM wt, wp, wc""",
    "citation_lines": rf"""WITH {_EX}, ln AS (SELECT DISTINCT message_id, '- ' || regexp_replace(decision.reply_draft, '[\[\]]', ' ', 'g') AS body, CASE WHEN len(decision.evidence_ids) > 0 THEN decision.evidence_ids ELSE [] END AS ids FROM decision_record WHERE decision.reply_draft IS NOT NULL),
c AS (SELECT regexp_extract_all(lower(body), '[a-z]{{5,}}') AS a, trim(unnest(ids)) AS id FROM ln), j AS (SELECT a, e.evidence_id IS NOT NULL AS known, regexp_extract_all(lower(coalesce(brand_reply, '')), '[a-z]{{5,}}') AS b FROM c LEFT JOIN e ON e.evidence_id = c.id),
w AS (SELECT count(*) AS factual, count(*) FILTER (len(ids) > 0) AS citing FROM ln), t AS (SELECT count(*) AS ids, count(*) FILTER (NOT known) AS dangling, count(*) FILTER (known AND len(a) > 0 AND NOT list_has_any(a, b)) AS weak FROM j) SELECT factual, citing, round(citing / factual, 6) AS attribution, ids, dangling, weak FROM w, t""",
}
