"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.keys import id_number
from threadloom.llm import conversations, neardup, overlap, packing, pii, reading, sampling, tokenizer
from threadloom.session import table


def private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of messages, redacted inputs and drafts in long form."""
    tweets, records = table(spark, sf_dir, "twcs"), table(spark, sf_dir, "decision_record")
    key = F.coalesce(id_number(F.col("tweet_id")).cast("string"), F.trim("tweet_id"))
    return (
        tweets.select(F.lit("twcs.text").alias("field_name"), key.alias("record_id"), "text")
        .unionByName(records.select(F.lit("decision_record.input_text_redacted").alias("field_name"), F.col("message_id").alias("record_id"), F.col("input_text_redacted").alias("text")))
        .unionByName(records.select(F.lit("decision_record.decision.reply_draft").alias("field_name"), F.col("message_id").alias("record_id"), F.col("decision.reply_draft").alias("text")))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(private_texts(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_texts(private_texts(spark, sf_dir)).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "decision_record"), table(spark, sf_dir, "exemplar")).select("message_id", "evidence_id")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, exemplars = table(spark, sf_dir, "decision_record"), table(spark, sf_dir, "exemplar")
    return overlap.overlap_counts(overlap.overlaps(records, exemplars), records, exemplars)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, sf_dir, "decision_record"), table(spark, sf_dir, "exemplar")).select("message_id", "near_exemplars", "same_conversation", "near_classes")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.rebuild(table(spark, sf_dir, "twcs"))
    return turns.select(F.col("conversation_id").cast("string").alias("conversation_id"), "turn_no", F.col("tweet_id").cast("string").alias("tweet_id"), "speaker")


def p4_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.outcome_counts(table(spark, sf_dir, "twcs"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stable_sample(table(spark, sf_dir, "decision_record")).select("stratum", F.col("conversation").alias("conversation_id"), "message_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per stratum where strata have rates of their own."""
    kept = sampling.stable_sample(table(spark, sf_dir, "decision_record"), rates={"random": 0.2, "policy_trap": 0.5})
    return kept.groupBy("stratum").agg(F.count("*").alias("records"), F.countDistinct("conversation").alias("conversations"))


FIELDS = ("brand_reply", "customer_text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for field in FIELDS:
        pairs = neardup.pairs_of(*neardup.near_duplicates(table(spark, sf_dir, "exemplar"), "evidence_id", field))
        parts.append(pairs.select(F.lit(field).alias("field_name"), F.col("a").alias("evidence_id_a"), F.col("b").alias("evidence_id_b")))
    return parts[0].unionByName(parts[1])


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for field in FIELDS:
        grouped = neardup.groups_of(*neardup.near_duplicates(table(spark, sf_dir, "exemplar"), "evidence_id", field))
        parts.append(grouped.select(F.lit(field).alias("field_name"), F.col("id").alias("evidence_id"), "class_id", "group_id", "links"))
    return parts[0].unionByName(parts[1])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokenizer.count_tokens(table(spark, sf_dir, "documents"))
    return packing.pack_containers(sizes, table(spark, sf_dir, "pack_capacity"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p9_containers(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "band").distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.profile(reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")))


_ID = r"try_cast(regexp_extract({0}, '^\s*(\d{{1,19}})(\.\d*)?\s*$', 1) AS BIGINT)"
_MADE = r"""coalesce(try_cast(CASE WHEN regexp_matches(created_at, '^\s*\d{4}-\d\d-\d\d') THEN created_at END AS TIMESTAMPTZ), try_strptime(substr(trim(created_at), 5), '%b %d %H:%M:%S %z %Y'))"""
_SEEN = r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_S = r"'^\s*(?:@\w+\s+)*[(\[]?(\d{1,3})\s?(?:/|of)\s?(\d{1,3})[)\]]?(?:$|[\s^~*:.,\-]|/[^0-9])'"
_E = r"'(?:^|[\s.!?])[(\[]?(\d{1,3})\s?(?:/|of)\s?(\d{1,3})[)\]]?[\s.!?\-]*(?:[\^~*/\-]\s?[A-Za-z]{1,3})?\s*(?:https?://\S+)?\s*$'"
_N = "try_cast(regexp_extract(text, {0}, {1}) AS INT)"
_PART = "coalesce(" + ", ".join(f"CASE WHEN {_N.format(p, 1)} BETWEEN 1 AND {_N.format(p, 2)} THEN {_N.format(p, 1)} END" for p in (_S, _E)) + ")"
_TURNS = rf"""
WITH RECURSIVE raw AS (
  SELECT {_ID.format("tweet_id")} AS id, {_ID.format("in_response_to_tweet_id")} AS up, {_MADE} AS made, {_PART} AS part,
    CASE lower(trim(inbound)) WHEN 'true' THEN 'customer' WHEN 'false' THEN 'brand' ELSE CASE WHEN regexp_matches(author_id, '^\s*\d+(\.\d*)?\s*$') THEN 'customer' WHEN regexp_matches(author_id, '\S') THEN 'brand' END END AS who,
    coalesce(regexp_matches(text, '{_SEEN}'), false) AS spoken FROM twcs),
t AS (SELECT id, min(up) AS up, min(made) AS made, min(part) AS part, min(who) AS who, bool_or(spoken) AS spoken FROM raw WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, id AS conv FROM t WHERE up IS NULL UNION ALL SELECT t.id, w.conv FROM t JOIN w ON t.up = w.id),
m AS (SELECT t.*, w.conv FROM t JOIN w ON w.id = t.id),
n AS (SELECT conv, id, who, row_number() OVER (PARTITION BY conv ORDER BY made, part NULLS LAST, id) - 1 AS turn_no FROM m WHERE spoken),
g AS (SELECT conv FROM m GROUP BY conv HAVING count(*) = count(made)),
k AS (SELECT conv FROM n GROUP BY conv HAVING max(CASE WHEN turn_no = 0 THEN who END) = 'customer' AND bool_or(who = 'brand'))
"""
_SAMPLE = rf"""
WITH r AS (SELECT message_id, logged_at, coalesce(CAST({_ID.format("conversation_id")} AS VARCHAR), 'message:' || message_id) AS conversation,
  coalesce(nullif(regexp_replace(lower(trim(stratum)), '[\s\-_]+', '_', 'g'), ''), 'none') AS stratum FROM decision_record WHERE message_id IS NOT NULL),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY logged_at NULLS LAST, conversation, stratum) = 1),
u AS (SELECT *, CAST(('0x' || substr(md5('{sampling.SALT}|' || conversation), 1, 13)) AS BIGINT) / {float(1 << 52)} AS u FROM f)
"""

_BARE = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, 'https?://\S+|www\.\S+', ' ', 'g'), '@[\p{{L}}\p{{N}}_]+', ' ', 'g'), '[\s.!?]*[\^~*/][A-Z]{{1,3}}\s*$', ' '))"
_WORDS = r"list_distinct(regexp_extract_all(" + _BARE + r", '[\p{{L}}\p{{N}}]+'))"


def _near_sql(field: str) -> str:
    return f"""SELECT '{field}' AS field_name, a.id AS evidence_id_a, b.id AS evidence_id_b FROM {field} a JOIN {field} b ON a.id < b.id
WHERE len(a.w) >= 6 AND len(b.w) >= 6 AND 10 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"""


def _groups_sql(field: str) -> str:
    return f"""SELECT * FROM (WITH RECURSIVE i AS (SELECT DISTINCT evidence_id AS id, list_sort({_WORDS.format(field)}) AS s FROM exemplar WHERE evidence_id IS NOT NULL), c AS (SELECT s, min(id) AS k FROM i WHERE len(s) >= 6 GROUP BY s),
l AS (SELECT a.k AS x, b.k AS y FROM c a JOIN c b ON a.s <> b.s AND 10 * len(list_intersect(a.s, b.s)) >= 7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))), n AS (SELECT x, count(*) AS links FROM l GROUP BY x),
r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b), g AS (SELECT a, min(b) AS g FROM r GROUP BY a)
SELECT '{field}' AS field_name, i.id AS evidence_id, c.k AS class_id, g.g AS group_id, coalesce(links, 0) AS links FROM i JOIN c USING (s) JOIN g ON g.a = c.k LEFT JOIN n ON n.x = c.k)"""


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_outcomes": p4_outcomes,
    "p5_sample": p5_sample,
    "p5_rates": p5_rates,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}
_OVERLAP = (
    f"""WITH e AS (SELECT DISTINCT message_id, {_ID.format("conversation_id")} AS conv, {_WORDS.format("input_text_redacted")} AS w, stratum FROM decision_record WHERE message_id IS NOT NULL AND regexp_matches(stratum, '\\S')),
x AS (SELECT DISTINCT evidence_id, {_ID.format("conversation_id")} AS conv, {_WORDS.format("customer_text")} AS w FROM exemplar WHERE evidence_id IS NOT NULL),
p AS (SELECT message_id, evidence_id FROM e JOIN x ON e.conv = x.conv
UNION SELECT message_id, evidence_id FROM e JOIN x ON len(e.w) >= 6 AND len(x.w) >= 6 AND 10 * len(list_intersect(e.w, x.w)) >= 7 * (len(e.w) + len(x.w) - len(list_intersect(e.w, x.w))))
"""
)
ORACLES: dict[str, str] = {
    "p3_found": _OVERLAP + "SELECT message_id, evidence_id FROM p",
    "p3_counts": _OVERLAP
    + r"""SELECT stratum, brand, count(*) AS pairs, count(DISTINCT message_id) AS records, count(DISTINCT evidence_id) AS exemplars FROM p
JOIN (SELECT DISTINCT message_id, regexp_replace(lower(trim(stratum)), '[\s\-_]+', '_', 'g') AS stratum FROM e) USING (message_id)
JOIN (SELECT DISTINCT evidence_id, CASE WHEN regexp_matches(brand, '\S') THEN brand END AS brand FROM exemplar) USING (evidence_id) GROUP BY ALL""",
    "p3_classes": _OVERLAP
    + """, k AS (SELECT DISTINCT message_id, evidence_id, list_sort(x.w) AS xw FROM e JOIN x ON len(e.w) >= 6 AND len(x.w) >= 6 AND 10 * len(list_intersect(e.w, x.w)) >= 7 * (len(e.w) + len(x.w) - len(list_intersect(e.w, x.w)))),
n AS (SELECT message_id, CAST(count(*) AS BIGINT) AS near_exemplars, count(DISTINCT xw) AS near_classes FROM k GROUP BY message_id),
s AS (SELECT message_id, count(*) AS same_conversation FROM (SELECT DISTINCT e.message_id, e.conv, x.evidence_id FROM e JOIN x ON e.conv = x.conv) GROUP BY message_id)
SELECT i.message_id, coalesce(near_exemplars, 0) AS near_exemplars, coalesce(same_conversation, 0) AS same_conversation, coalesce(near_classes, 0) AS near_classes FROM (SELECT DISTINCT message_id FROM e) i LEFT JOIN n USING (message_id) LEFT JOIN s USING (message_id)""",
    "p4_found": _TURNS + "SELECT CAST(conv AS VARCHAR) AS conversation_id, CAST(turn_no AS INT) AS turn_no, CAST(id AS VARCHAR) AS tweet_id, who AS speaker FROM n WHERE conv IN (SELECT conv FROM g) AND conv IN (SELECT conv FROM k)",
    "p4_outcomes": _TURNS
    + """, o AS (SELECT id, conv AS c FROM w UNION ALL SELECT id, c FROM (WITH RECURSIVE x AS (SELECT id, up AS c FROM t WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, x.c FROM t JOIN x ON t.up = x.id) SELECT * FROM x)),
a AS (SELECT id, c FROM (WITH RECURSIVE y AS (SELECT id, up AS c FROM t WHERE id NOT IN (SELECT id FROM o) UNION SELECT y.id, t.up FROM y JOIN t ON t.id = y.c) SELECT * FROM y)),
z AS (SELECT id, min(c) AS c FROM a WHERE c IN (SELECT id FROM a WHERE id = c) GROUP BY id),
h AS (SELECT o.c, t.* FROM o JOIN t USING (id) UNION ALL SELECT z.c, t.* FROM z JOIN t USING (id)),
d AS (SELECT c, count(*) AS tweets, bool_or(up IS NULL) AS rooted, count(*) - count(made) AS undated, count(*) FILTER (spoken) AS turns, count(*) FILTER (spoken AND who = 'brand') AS answers FROM h GROUP BY c),
f AS (SELECT c, who FROM h WHERE spoken QUALIFY row_number() OVER (PARTITION BY c ORDER BY made, part NULLS LAST, id) = 1)
SELECT CASE WHEN NOT rooted THEN 'broken_link' WHEN undated > 0 THEN 'unreadable_time' WHEN turns = 0 THEN 'empty' WHEN coalesce(f.who <> 'customer', true) THEN 'not_opened_by_customer' WHEN answers = 0 THEN 'unanswered' ELSE 'kept' END AS outcome, count(*) AS conversations, CAST(sum(tweets) AS BIGINT) AS tweets
FROM d LEFT JOIN f ON f.c = d.c GROUP BY 1""",
    "p5_sample": _SAMPLE + f"SELECT stratum, conversation AS conversation_id, message_id FROM u WHERE u < {sampling.RATE}",
    "p7_found": "WITH "
    + ", ".join(f"{x} AS (SELECT DISTINCT evidence_id AS id, {_WORDS.format(x)} AS w FROM exemplar WHERE evidence_id IS NOT NULL)" for x in FIELDS)
    + " " + " UNION ".join(map(_near_sql, FIELDS)),
    "p7_groups": " UNION ALL ".join(map(_groups_sql, FIELDS)),
    "p5_rates": _SAMPLE
    + f""", h AS (SELECT *, CASE stratum WHEN 'random' THEN 0.2 WHEN 'policy_trap' THEN 0.5 ELSE {sampling.RATE} END AS rate FROM u)
SELECT stratum, count(*) AS records, count(DISTINCT conversation) AS conversations FROM h WHERE conversation IN (SELECT conversation FROM h WHERE u < rate) GROUP BY stratum""",
}
