"""Verdicts ``(message_id, system, criterion, pass, flip, quote)`` on replies, and citations of playbook lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import stats as S

#: The criterion that stands for all of them.
ALL = "all"


def quoted(verdicts: DataFrame, *criteria: str) -> DataFrame:
    """A pass of one of ``criteria`` without a quote is a fail, marked as downgraded."""
    down = F.col("criterion").isin(*criteria) & F.col("pass") & ~F.coalesce(F.col("quote").rlike(r"\S"), F.lit(False))
    return verdicts.withColumn("downgraded", down).withColumn("pass", F.col("pass") & ~F.col("downgraded"))


def _with_all(verdicts: DataFrame) -> DataFrame:
    every = verdicts.groupBy("message_id", "system").agg(F.bool_and("pass").alias("pass")).select("message_id", "system", F.lit(ALL).alias("criterion"), "pass", F.lit(None).cast("boolean").alias("flip"))
    return verdicts.select("message_id", "system", "criterion", "pass", "flip").unionByName(every)


def reply_table(verdicts: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Per system and criterion, and over all of them: passes with their interval, and flips (null over all). A required system that is missing is an error."""
    systems = {r[0] for r in S.few(verdicts.select("system").distinct()).collect()}
    missing = [x for x in required if x not in systems]
    if missing:
        raise ValueError(f"no verdicts on {', '.join(missing)}")
    v = _with_all(verdicts)
    flips = v.groupBy("system", "criterion").agg(F.sum(F.col("flip").cast("int")).alias("flips"))
    return S.proportions(v, ["system", "criterion"], F.col("pass")).drop("rule_of_three").join(flips, ["system", "criterion"])


def reply_pairs(verdicts: DataFrame, system: str) -> DataFrame:
    """``system`` against every other one per criterion: discordant counts and p, over the records on which every system has a verdict."""
    v = _with_all(verdicts)
    n = len(S.few(v.select("system").distinct()).collect())
    # passes of all systems of one record and criterion side by side: as many as there are systems
    sides = v.groupBy("message_id", "criterion").agg(F.collect_list(F.struct("system", "pass")).alias("v")).where(F.size("v") == n)
    own = F.get(F.filter("v", lambda x: x["system"] == system), F.lit(0))["pass"]
    each = sides.select("criterion", own.alias("a"), F.explode(F.filter("v", lambda x: x["system"] != system)).alias("o")).select("criterion", F.col("o.system").alias("other"), "a", F.col("o.pass").alias("b"))
    return S.mcnemar_report(each, "criterion", "other").select("criterion", "other", F.col("n").alias("paired"), "only_a", "only_b", "p")


def reply_summary(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per criterion: each system's passes, rate, interval and flips, and each paired result, as lists in the order of the systems."""
    one = F.concat_ws(" ", "system", "k", F.format_string("%.4f", "rate"), F.format_string("%.4f", "low"), F.format_string("%.4f", "high"), F.coalesce(F.col("flips").cast("string"), F.lit("-")))
    other = F.concat_ws(" ", "other", "only_a", "only_b", F.format_string("%.4f", "p"))
    left = table.groupBy("criterion").agg(F.array_join(F.array_sort(F.collect_list(one)), "; ").alias("systems"))
    right = pairs.groupBy("criterion").agg(F.max("paired").alias("paired"), F.array_join(F.array_sort(F.collect_list(other)), "; ").alias("pairs"))
    return left.join(right, "criterion")


def flip_rate(outcomes: DataFrame, key: str, outcome: str) -> DataFrame:
    """Share of keys with more than one outcome over their variants."""
    per = outcomes.groupBy(key).agg((F.min(outcome) != F.max(outcome)).alias("flip"))
    return per.agg(F.count("*").alias("n"), F.count_if("flip").alias("flips"), F.round(S.ratio(F.count_if("flip"), F.count("*")), 6).alias("rate"))


def with_scores(verdicts: DataFrame, scores: DataFrame, system: str, criteria: list[str]) -> DataFrame:
    """``verdicts`` with ``human``, the score of ``scores(message_id, criteria...)`` for one system's records whose scores are all filled; else null."""
    filled = scores
    for c in criteria:
        filled = filled.where(F.col(c).isNotNull())
    long = filled.select("message_id", F.lit(system).alias("system"), F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("human")) for c in criteria))).alias("h")).select("message_id", "system", "h.*")
    return verdicts.join(long, ["message_id", "system", "criterion"], "left")


_EVIDENCE = r"\[evidence:\s*([^\]]+)\]"


def citations(lines: DataFrame, known: DataFrame) -> DataFrame:
    """One row on ``lines(line)`` that cite ``known(id, text)`` as ``[evidence: a, b]``.

    Factual lines (those that open a list item), lines that cite, their share, cited ids,
    those that are unknown, and those whose text shares no word of five letters with the line.
    """
    marked = lines.withColumn("factual", F.col("line").rlike(r"^\s*(?:-|\*|1\.)")).withColumn("cited", F.regexp_extract("line", _EVIDENCE, 1))
    whole = marked.agg(F.count_if("factual").alias("factual"), F.count_if(F.col("cited") != "").alias("citing"))
    long = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), F.lit(0))
    claims = marked.where("cited != ''").select(long(F.regexp_replace("line", _EVIDENCE, " ")).alias("claim"), F.explode(F.split("cited", ",")).alias("id")).select("claim", F.trim("id").alias("id")).where("id != ''")
    met = claims.join(known.select("id", "text", F.lit(True).alias("known")), "id", "left")
    weak = F.col("known") & (F.size("claim") > 0) & ~F.arrays_overlap("claim", long(F.coalesce("text", F.lit(""))))
    found = met.agg(F.count("*").alias("ids"), F.count_if(F.col("known").isNull()).alias("dangling"), F.count_if(weak).alias("weak"))
    return whole.crossJoin(found).select("factual", "citing", F.round(S.ratio(F.col("citing"), F.col("factual")), 6).alias("attribution"), "ids", "dangling", "weak")  # single rows
