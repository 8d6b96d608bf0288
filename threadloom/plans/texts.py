"""Queries of text expressions and of reply threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.keys import instant
from threadloom.operators import messages as M
from threadloom.operators.forest import hierarchy
from threadloom.plans.general import _ID, _MADE
from threadloom.session import checkpoint, table


def _over_tweets(build):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # one shuffle, of the results: deliveries of one tweet mostly have the same
        return table(spark, sf_dir, "twcs").select("tweet_id", *(c.alias(n) for n, c in build(F.col("text")).items())).distinct()

    return query


def _sql(**columns: str) -> str:
    return "SELECT DISTINCT tweet_id, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM twcs"


def _q(pattern: str) -> str:
    """A pattern as an SQL string of an engine whose flags are written apart."""
    return "'" + pattern.removeprefix("(?i)").replace("'", "''") + "'" + (", 'i'" if pattern.startswith("(?i)") else "")


def _re(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {_q(pattern)})"


_T = "coalesce(text, '')"
_LOW = f"lower({_T})"


def _replace(expr: str, pattern: str, to: str) -> str:
    flag = "gi" if pattern.startswith("(?i)") else "g"
    return f"regexp_replace({expr}, '{pattern.removeprefix('(?i)')}', '{to}', '{flag}')"


def _normal_sql(expr: str) -> str:
    e = _replace(f"coalesce({expr}, '')", X.URL, "[URL]")
    e = _replace(e, X.MENTION, "@user")
    e = _replace(e, r"^\s+|\s+$", "")
    e = _replace(e, r"^\d+/\d+\b\s*", "")
    e = _replace(e, r"\s+$", "")
    e = _replace(e, X.SIGILS_END, "")
    return _replace(_replace(e, r"\s+", " "), r"^ | $", "")


def _masked_sql() -> tuple[str, str]:
    e, found = _T, []
    for name, pattern, to in X.MASKS:
        found.append(f"CASE WHEN {_re(e, pattern)} THEN '{name}' END")
        e = _replace(e, pattern, to)
    return e, "array_to_string(list_filter([" + ", ".join(found) + "], lambda x: x IS NOT NULL), ',')"


def _all_sql(expr: str, pattern: str) -> str:
    flag = ", 0, 'i'" if pattern.startswith("(?i)") else ""
    p = pattern.removeprefix("(?i)").replace("'", "''")
    return f"regexp_extract_all({expr}, '{p}'{flag})"


def normalise_text(c):
    return {"normal": X.normalise(c)}


def split_marker(c):
    return {"part": X.part(c, 1), "parts": X.part(c, 2)}


def tokenise(c):
    return {"tokens": F.array_join(X.tokens(c), " "), "n": F.size(X.tokens(c))}


def mask_patterns(c):
    t, found = X.masked(c)
    return {"masked": t, "found": F.array_join(found, ",")}


def guard_flags(c):
    families = {"self_harm": X.any_of(X.SELF_HARM), "threat": X.any_of(X.THREAT), "abuse": X.ABUSE}
    fired = F.filter(F.array(*(F.when(X.matches(c, p), F.lit(n)) for n, p in families.items())), lambda x: x.isNotNull())
    return {
        "injection": X.matches(c, X.any_of(X.INJECTION)),
        "unsafe": F.size(fired) > 0,
        "families": F.array_join(fired, ","),
        "legal": X.matches(c, X.any_word(X.LEGAL)),
        "security": X.matches(c, X.any_word(X.SECURITY)),
    }


def money_extract(c):
    a = X.amounts(c)
    return {"n": F.size(a), "highest": F.array_max(a), "total": F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), 2)}


def resolution_marks(c):
    return {"resolves": X.resolves(c), "confirms": X.matches(c, X.CONFIRMATION), "asks_for_message": X.matches(c, X.DM)}


def risky_spans(c):
    return {"spans": F.array_join(X.risky_spans(c), "|")}


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "decision_record").select("message_id", F.col("decision.reply_draft").alias("text")).distinct()
    return drafts.select("message_id", *(c.alias(n) for n, c in X.commitments(F.col("text")).items())).distinct()


def parse_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = instant(F.col("created_at"))
    t = table(spark, sf_dir, "twcs").groupBy(F.date_format(made, "yyyy-MM-dd HH").alias("hour"))
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("created_at").isNotNull() & made.isNull()).alias("unreadable"))


def dm_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "exemplar").select("evidence_id", "brand", "brand_reply").distinct()
    return replies.groupBy("brand").agg(F.count("*").alias("n"), F.count_if(X.matches(F.col("brand_reply"), X.DM)).alias("hits")).withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))


def style_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand: replies, mean and upper median of their length, rates of marks."""
    r = table(spark, sf_dir, "exemplar").select("evidence_id", "brand", F.col("brand_reply").alias("t")).where("t != ''").distinct()
    t = F.col("t")
    lengths = r.groupBy("brand", F.char_length("t").alias("len")).agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    upto = F.sum("c").over(Window.partitionBy("brand").orderBy("len"))
    middle = (
        lengths.withColumn("upto", upto)
        .withColumn("n", F.sum("c").over(Window.partitionBy("brand")))
        .where(F.col("upto") > F.floor(F.col("n") / 2))
        .groupBy("brand")
        .agg(F.min("len").alias("median_length"))
    )
    rate = lambda p: F.round(F.avg(t.rlike(p).cast("double")), 6)
    card = r.groupBy("brand").agg(
        F.count("*").alias("n"), F.round(F.avg(F.char_length("t")), 6).alias("mean_length"), rate(X.SIGIL_END).alias("signature_rate"), rate(X.EMOJI).alias("emoji_rate"),
        rate(r"\?").alias("question_rate"), rate("(?i)http").alias("url_rate"), rate(X.DM).alias("dm_rate"),
    )
    return card.join(middle.withColumnRenamed("brand", "b"), F.col("brand").eqNullSafe(F.col("b"))).drop("b")


def reply_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reply_roots(M.deliveries_once(table(spark, sf_dir, "twcs"))).select(F.col("id").cast("string").alias("tweet_id"), "is_root")


def thread_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.branches(M.deliveries_once(table(spark, sf_dir, "twcs"))).select("root", "leaf", "length", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def best_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = checkpoint(M.deliveries_once(table(spark, sf_dir, "twcs")))
    return M.best_leaves(once, hierarchy(once.select("id", F.col("up").alias("parent")))).select("root", "leaf", "length", "brand_last")


def turn_order_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threads(table(spark, sf_dir, "twcs")).select("root", "turn", "id", "inbound")


def precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.precedents(M.threads(table(spark, sf_dir, "twcs")))


def repeat_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.repeat_contacts(M.deliveries_once(table(spark, sf_dir, "twcs")))


QUERIES = {
    **{f.__name__: _over_tweets(f) for f in (normalise_text, split_marker, tokenise, mask_patterns, guard_flags, money_extract, resolution_marks, risky_spans)},
    **{f.__name__: f for f in (commitments, parse_created_at, dm_frequency, style_card, reply_roots, thread_paths, best_branch, turn_order_repair, precedents, repeat_contacts)},
}

_MASKED, _FOUND = _masked_sql()
_FAMILY = {"self_harm": X.any_of(X.SELF_HARM), "threat": X.any_of(X.THREAT), "abuse": X.ABUSE}
_FIRED = "list_filter([" + ", ".join(f"CASE WHEN {_re(_T, p)} THEN '{n}' END" for n, p in _FAMILY.items()) + "], lambda x: x IS NOT NULL)"
_AMOUNTS = f"list_transform({_all_sql(_T, X.MONEY)}, lambda m: try_cast(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE))"
_STEP = f"(regexp_matches({_LOW}, '{'|'.join(X.RESOLUTION).replace(chr(39), chr(39) * 2)}') AND regexp_matches({_LOW}, '\\S'))"


def _first_sql(pattern: str, group: int = 0) -> str:
    flag = ", 'i'" if pattern.startswith("(?i)") else ""
    p = pattern.removeprefix("(?i)").replace("'", "''")
    return f"nullif(regexp_replace(regexp_extract({_T}, '{p}', {group}{flag}), '^\\s+|\\s+$', '', 'g'), '')"


#: The six slots of commitments in SQL, over a column named text.
SLOTS = {
    "refund_offered": f"({_re(_LOW, X.REFUND)} AND NOT {_re(_LOW, X.NO_REFUND)})",
    "refund_window_days": f"CAST(try_cast(nullif(regexp_extract({_LOW}, '{X.WINDOW}', 1), '') AS INT) * CASE regexp_extract({_LOW}, '{X.WINDOW}', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 END AS INT)",
    "compensation_amount": f"{_AMOUNTS}[1]",
    "promised_timeline": _first_sql(X.DURATION),
    "entitlement_claimed": _first_sql(X.ENTITLED, 1),
    "escalation_promise": _first_sql(X.PASSED_ON),
}
_ONCE = rf"""once AS (SELECT id, author, inbound, made, text, up FROM (SELECT {_ID.format('tweet_id')} AS id, author_id AS author, lower(trim(inbound)) = 'true' AS inbound, {_MADE} AS made, text,
  min({_ID.format('in_response_to_tweet_id')}) OVER (PARTITION BY {_ID.format('tweet_id')}) AS up,
  row_number() OVER (PARTITION BY {_ID.format('tweet_id')} ORDER BY ingested_at NULLS LAST, text NULLS LAST, author_id NULLS FIRST, lower(trim(inbound)) NULLS FIRST) AS k FROM twcs) WHERE id IS NOT NULL AND k = 1)"""
_TREE = rf"""WITH RECURSIVE {_ONCE},
e AS (SELECT o.*, p.id AS parent FROM once o LEFT JOIN once p ON p.id = o.up),
w AS (SELECT id, id AS root, 1 AS length, [id] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, w.root, w.length + 1, list_append(w.path, e.id) FROM e JOIN w ON e.parent = w.id),
b AS (SELECT w.root, w.id AS leaf, w.length, w.path, CASE WHEN coalesce(o.inbound, false) THEN 0 ELSE 1 END AS brand_last FROM w JOIN once o ON o.id = w.id WHERE w.id NOT IN (SELECT up FROM once WHERE up IS NOT NULL)),
best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY root ORDER BY brand_last DESC, length DESC, leaf) = 1)"""
_THREADS = (
    _TREE
    + rf""",
n AS (SELECT best.root, o.*, row_number() OVER s AS base, CASE WHEN row_number() OVER s = 1 OR made IS DISTINCT FROM lag(made) OVER s OR author IS DISTINCT FROM lag(author) OVER s THEN 1 ELSE 0 END AS new,
  try_cast(nullif(regexp_extract(coalesce(text, ''), '^\s*(\d+)/(\d+)\b', 1), '') AS INT) AS part
  FROM (SELECT root, unnest(path) AS id FROM best) best JOIN once o USING (id) WINDOW s AS (PARTITION BY best.root ORDER BY made NULLS FIRST, id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY root ORDER BY base) AS run FROM n),
sl AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY root, run) > 1 AND max(part) OVER (PARTITION BY root, run) IS NOT NULL THEN coalesce(part, 1000000) ELSE 0 END AS slot FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY run, slot, base) - 1 AS turn FROM sl),
kept AS (SELECT * FROM t WHERE root IN (SELECT root FROM t WHERE turn = 0 AND inbound) AND root IN (SELECT root FROM t WHERE NOT coalesce(inbound, false)))"""
)
ORACLES = {
    "normalise_text": _sql(normal=_normal_sql("text")),
    "split_marker": _sql(**{n: f"try_cast(nullif(regexp_extract({_T}, '{X.PART}', {k}), '') AS INT)" for n, k in (("part", 1), ("parts", 2))}),
    "tokenise": _sql(tokens=f"array_to_string({_all_sql(_LOW, X.TOKEN)}, ' ')", n=f"CAST(len({_all_sql(_LOW, X.TOKEN)}) AS INT)"),
    "mask_patterns": _sql(masked=_MASKED, found=_FOUND),
    "guard_flags": _sql(
        injection=_re(_T, X.any_of(X.INJECTION)), unsafe=f"len({_FIRED}) > 0", families=f"array_to_string({_FIRED}, ',')", legal=_re(_T, X.any_word(X.LEGAL)), security=_re(_T, X.any_word(X.SECURITY))
    ),
    "money_extract": _sql(n=f"CAST(len({_AMOUNTS}) AS INT)", highest=f"list_max({_AMOUNTS})", total=f"round(coalesce(list_sum({_AMOUNTS}), 0.0), 2)"),
    "resolution_marks": _sql(resolves=_STEP, confirms=_re(_T, X.CONFIRMATION), asks_for_message=_re(_T, X.DM)),
    "risky_spans": _sql(
        spans="array_to_string(list_transform(list_filter(list_zip(l, range(len(l))), lambda x: list_position(l, x[1]) = x[2] + 1), lambda x: x[1]), '|')"
    ).replace("FROM twcs", "FROM (SELECT tweet_id, list_transform(" + " || ".join(_all_sql(_T, p) for p in (X.MONEY, X.DURATION, X.any_of(X.COMMITMENT), X.DATE)) + ", lambda s: lower(s)) AS l FROM twcs)"),
    "commitments": "SELECT DISTINCT message_id, " + ", ".join(f"{e} AS {n}" for n, e in SLOTS.items()) + " FROM (SELECT message_id, decision.reply_draft AS text FROM decision_record)",
    "parse_created_at": f"SELECT strftime({_MADE} AT TIME ZONE 'UTC', '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (created_at IS NOT NULL AND {_MADE} IS NULL) AS unreadable FROM twcs GROUP BY 1",
    "dm_frequency": f"SELECT brand, count(*) AS n, count(*) FILTER ({_re('brand_reply', X.DM)}) AS hits, round(count(*) FILTER ({_re('brand_reply', X.DM)}) / count(*), 6) AS rate FROM (SELECT DISTINCT evidence_id, brand, brand_reply FROM exemplar) GROUP BY brand",
    "style_card": f"""WITH r AS (SELECT DISTINCT evidence_id, brand, brand_reply AS t FROM exemplar WHERE brand_reply <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY length(t)) AS p, count(*) OVER (PARTITION BY brand) AS c FROM r)
SELECT brand, count(*) AS n, round(avg(length(t)), 6) AS mean_length, CAST(max(length(t)) FILTER (p = c // 2 + 1) AS INT) AS median_length, """
    + ", ".join(f"round(avg(CAST({_re('t', p)} AS DOUBLE)), 6) AS {n}" for n, p in (("signature_rate", X.SIGIL_END), ("emoji_rate", X.EMOJI), ("question_rate", r"\?"), ("url_rate", "(?i)http"), ("dm_rate", X.DM)))
    + " FROM k GROUP BY brand",
    "reply_roots": f"WITH {_ONCE} SELECT CAST(o.id AS VARCHAR) AS tweet_id, p.id IS NULL AS is_root FROM once o LEFT JOIN once p ON p.id = o.up",
    "thread_paths": _TREE + " SELECT root, leaf, length, array_to_string(path, '/') AS path FROM b",
    "best_branch": _TREE + " SELECT root, leaf, length, brand_last FROM best",
    "turn_order_repair": _THREADS + " SELECT root, CAST(turn AS INT) AS turn, id, inbound FROM kept",
    "precedents": _THREADS
    + f""", f AS (SELECT *, lead(text) OVER (PARTITION BY root ORDER BY turn) AS follow, lead(id) OVER (PARTITION BY root ORDER BY turn) IS NULL AS last FROM kept),
ok AS (SELECT * FROM f WHERE NOT coalesce(inbound, false) AND {_STEP} AND (last OR {_re("coalesce(follow, '')", X.CONFIRMATION)}) QUALIFY row_number() OVER (PARTITION BY root ORDER BY turn) = 1)
SELECT 't_' || ok.id AS evidence_id, CAST(ok.root AS VARCHAR) AS conversation_id, {_normal_sql('q.text')} AS customer_text, {_normal_sql('ok.text')} AS brand_reply, ok.author AS brand, NOT ok.last AS confirmed FROM ok JOIN kept q ON q.root = ok.root AND q.turn = 0""",
    "repeat_contacts": f"""WITH {_ONCE}, g AS (SELECT id, (epoch_us(made) - lag(epoch_us(made)) OVER (PARTITION BY author ORDER BY made, id)) / 86400000000.0 AS gap FROM once WHERE inbound AND made IS NOT NULL AND author IS NOT NULL)
SELECT id, round(gap, 6) AS gap_days, coalesce(gap <= 7.0, false) AS repeated FROM g""",
}
