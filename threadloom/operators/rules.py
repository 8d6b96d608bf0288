"""Rules for labels: words and word pairs of labelled texts, mined, pruned and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import tokens


def terms(text: Column) -> Column:
    """Distinct tokens of a text and pairs of neighbouring ones."""
    t = tokens(text)
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(t, pairs))


def mine(rows: DataFrame, precision: float = 0.5, support: int = 2, most: int = 15) -> DataFrame:
    """``rule, intent, pattern, support, precision``: the terms of ``rows(text, label)`` that tell a label best, in order.

    A term's label is the one it stands with most often (ties: the lesser). Terms of too
    little precision or support are pruned; the ``most`` with the highest (precision,
    support, label, term) are kept. Counts cover all rows, by aggregation only.
    """
    each = rows.where("label is not null").select("label", F.explode(terms(F.col("text"))).alias("pattern"))
    per = each.groupBy("pattern", "label").agg(F.count("*").alias("c"))
    best = per.groupBy("pattern").agg(F.sum("c").alias("support"), F.max(F.struct("c")).alias("m"), F.min_by("label", F.struct(-F.col("c"), "label")).alias("intent"))
    kept = best.select("intent", "pattern", "support", (F.col("m.c") / F.col("support")).alias("p")).where((F.col("p") >= precision) & (F.col("support") >= support))
    top = kept.orderBy(F.desc("p"), F.desc("support"), F.desc("intent"), F.desc("pattern")).limit(most)  # a top-k report
    listed = top.agg(F.collect_list(F.struct((-F.col("p")).alias("p"), (-F.col("support")).alias("s"), "intent", "pattern", "support")).alias("x"))
    ordered = F.array_sort("x", lambda a, b: F.when(a["p"] != b["p"], F.when(a["p"] < b["p"], -1).otherwise(1)).when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).when(a["intent"] != b["intent"], F.when(a["intent"] > b["intent"], -1).otherwise(1)).when(a["pattern"] != b["pattern"], F.when(a["pattern"] > b["pattern"], -1).otherwise(1)).otherwise(0))
    return listed.select(F.posexplode(ordered).alias("i", "r")).select((F.col("i") + 1).alias("rule"), "r.intent", "r.pattern", "r.support", F.round(-F.col("r.p"), 6).alias("precision"))


def majority(rows: DataFrame) -> DataFrame:
    """One row: the most common label, ties to the lesser."""
    return rows.where("label is not null").groupBy("label").agg(F.count("*").alias("c")).agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("fallback"))


def predict(rules: DataFrame, fallback: DataFrame, texts: DataFrame, *kept: str) -> DataFrame:
    """``kept, predicted, matched`` of ``texts(text)``: the first label with a rule that fires, labels in the order of their first rule; else the fallback."""
    first = rules.groupBy("intent").agg(F.min("rule").alias("place"))
    table = rules.join(first, "intent").agg(F.collect_list(F.struct("place", "intent", "pattern")).alias("rules")).crossJoin(fallback)  # one row of a bounded list
    own = texts.select(*kept, terms(F.col("text")).alias("terms")).crossJoin(F.broadcast(table))
    hit = F.array_min(F.transform(F.filter("rules", lambda r: F.array_contains("terms", r["pattern"])), lambda r: F.struct(r["place"].alias("place"), r["intent"].alias("intent"))))
    return own.select(*kept, F.coalesce(hit["intent"], F.col("fallback")).alias("predicted"), hit.isNotNull().alias("matched"))
