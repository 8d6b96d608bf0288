"""Statistics of labelled decisions. Rows are first reduced to counts of few cells; windows run over those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Z = 1.96


def few(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows``, for a broadcast: more than ``most`` are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return rows


def percentiles(rows: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row of exact percentiles, interpolated between neighbours and rounded to four decimals.

    Values are counted, the counts summed over 10,000 equal parts of their range, and
    windows run over the parts and over the values of one part.
    """
    value = F.col(column).cast("double").alias("v")
    counts = rows.where(F.col(column).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(9999), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10_000))).otherwise(0)
    each = counts.crossJoin(ends).withColumn("part", part.cast("int"))  # one row of ends
    parts = each.groupBy("part").agg(F.sum("c").alias("c"))
    before = parts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    upto = each.withColumn("inside", F.sum("c").over(Window.partitionBy("part").orderBy("v"))).join(before, "part").withColumn("upto", F.col("before") + F.col("inside"))
    aggs = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("n") - 1)
        aggs += [F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias(f"{name}_lo"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("v"))).alias(f"{name}_hi")]
    g = upto.agg(F.max("n").alias("n"), *aggs)
    share = {k: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for k, q in wanted.items()}
    return g.select(*(F.round(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * share[k], 4).alias(k) for k in wanted))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b != 0, b))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The score interval of k of n, within [0, 1]; all of it for n = 0."""
    n_ = F.when(n > 0, n.cast("double"))
    p = k / n_
    mid, half = p + Z * Z / (2 * n_), Z * F.sqrt(p * (1 - p) / n_ + Z * Z / (4 * n_ * n_))
    under = 1 + Z * Z / n_
    return F.greatest(F.lit(0.0), (mid - half) / under), F.least(F.lit(1.0), (mid + half) / under)


def proportions(rows: DataFrame, by: list[str], flag: Column) -> DataFrame:
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    none = F.when(F.col("k") == 0, F.round(3.0 / F.col("n"), 6))
    return g.select(*by, "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), none.alias("rule_of_three"))


def cells(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of (gold, pred): as many rows as pairs of labels."""
    return rows.groupBy(*by, "gold", "pred").agg(F.count("*").alias("c"))


def per_class(counts: DataFrame, *by: str) -> DataFrame:
    """Per label tp, fp, fn, precision, recall, F1 (0 where both are 0)."""
    hit = F.col("gold") == F.col("pred")
    t = counts.select(*by, F.col("gold").alias("label"), F.when(hit, F.col("c")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~hit, F.col("c")).otherwise(0).alias("fn"))
    p = counts.where(~hit).select(*by, F.col("pred").alias("label"), F.lit(0).alias("tp"), F.col("c").alias("fp"), F.lit(0).alias("fn"))
    s = t.unionByName(p).groupBy(*by, "label").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confused(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k largest off-diagonal cells with their share of the gold label and their symmetry."""
    back = counts.select(F.col("gold").alias("pred"), F.col("pred").alias("gold"), F.col("c").alias("rev"))
    size = counts.groupBy("gold").agg(F.sum("c").alias("n"))
    off = counts.where("gold != pred").join(size, "gold").join(back, ["gold", "pred"], "left").withColumn("rev", F.coalesce("rev", F.lit(0)))
    sym = F.round(F.least("c", "rev") / (F.col("c") + F.col("rev")), 6)
    return off.orderBy(F.desc("c"), "gold", "pred").limit(k).select("gold", "pred", "c", F.round(F.col("c") / F.col("n"), 6).alias("share"), sym.alias("symmetry"))


def erfc(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for x >= 0, error below 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """Continuity-corrected chi-square and p of b against c discordant pairs; none: (0, 1)."""
    n = b + c
    chi = F.when(n == 0, F.lit(0.0)).otherwise((F.abs(b - c) - 1) * (F.abs(b - c) - 1) / F.when(n != 0, n.cast("double")))
    return chi, F.when(n == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(chi / 2)))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Step-down over ``tests(name, p)``, a short list: rejected until the first that fails."""
    w = Window.orderBy("p", "name")
    n = F.count("*").over(Window.partitionBy())
    ranked = tests.withColumn("k", F.row_number().over(w)).withColumn("limit", alpha / (n - F.col("k") + 1))
    ok = F.min((F.col("p") <= F.col("limit")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("name", "p", F.round("limit", 6).alias("limit"), (ok == 1).alias("rejected"))


def agreement(rows: DataFrame, a: Column, b: Column, *by: str) -> DataFrame:
    """Two boolean raters: observed and chance agreement, kappa, PABAK, AC1."""
    g = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("yes"), F.count_if(~a & ~b).alias("no"), F.count_if(a).alias("ra"), F.count_if(b).alias("rb")
    )
    n = F.col("n")
    p0, pa, pb = (F.col("yes") + F.col("no")) / n, F.col("ra") / n, F.col("rb") / n
    pe, q = pa * pb + (1 - pa) * (1 - pb), (pa + pb) / 2
    kappa = F.when(pe == 1, F.lit(1.0)).otherwise((p0 - pe) / F.when(pe != 1, 1 - pe))
    ge = 2 * q * (1 - q)
    return g.select(*by, "n", "yes", "no", *(F.round(x, 6).alias(k) for k, x in (("p0", p0), ("pe", pe), ("kappa", kappa), ("pabak", 2 * p0 - 1), ("ac1", (p0 - ge) / (1 - ge)))))


#: Confidences are summed in whole units of this size, so that no sum depends on the order of its rows.
UNIT = 1_000_000_000


def units(c: Column) -> Column:
    return F.round(c * UNIT).cast("bigint")


def mean6(total: Column, n: Column) -> Column:
    """Mean of a sum in units, rounded half up to six decimals in whole numbers."""
    per = UNIT // 1_000_000
    return _div(2 * total + n * per, 2 * n * per) / 1_000_000.0


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, b)


def ranked(rows: DataFrame, key: Column) -> DataFrame:
    """``rank, errors, conf`` of ``rows(conf, wrong)``, the most confident first, ties by the md5 of ``key``; ``errors`` counts the wrong ones so far.

    Counts are summed over the confidences of four decimals (a window of at most 10,001
    rows), then over the confidences and first two digits of the md5 within one of these;
    the last window holds rows of one confidence and two digits only, so that a confidence
    that a third of all rows have is split too.
    """
    each = rows.where("conf is not null").select("conf", "wrong", F.md5(key).alias("h"))
    each = each.withColumn("part", F.floor(F.col("conf") * 10_000)).withColumn("two", F.substring("h", 1, 2))
    small = each.groupBy("part", "conf", "two").agg(F.count("*").alias("n"), F.count_if("wrong").alias("w"))
    large = small.groupBy("part").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))

    def before(over: WindowSpec) -> list[Column]:
        return [F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}0") for c in ("n", "w")]

    above = large.select("part", *before(Window.orderBy(F.desc("part")))).select("part", F.col("n0").alias("n1"), F.col("w0").alias("w1"))
    within = small.select("part", "conf", "two", *before(Window.partitionBy("part").orderBy(F.desc("conf"), "two"))).join(above, "part").select("conf", "two", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("w0") + F.col("w1")).alias("w0"))
    inside = Window.partitionBy("conf", "two").orderBy("h")
    own = each.withColumn("k", F.row_number().over(inside)).withColumn("e", F.sum(F.col("wrong").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(within, ["conf", "two"]).select((F.col("n0") + F.col("k")).alias("rank"), (F.col("w0") + F.col("e")).alias("errors"), "conf")


def risk_coverage(rows: DataFrame, key: Column) -> DataFrame:
    """Coverage and risk after each row, most confident first."""
    r = ranked(rows, key)
    n = F.count("*").alias("n")
    return r.crossJoin(r.agg(n)).select("rank", "errors", F.round(F.col("rank") / F.col("n"), 6).alias("coverage"), F.round(F.col("errors") / F.col("rank"), 6).alias("risk"))  # one row


def risk_summary(rows: DataFrame, key: Column) -> DataFrame:
    """Mean risk over all ranks, that of the best order, what the order costs, and accuracy at full coverage."""
    r = ranked(rows, key)
    total = rows.where("conf is not null").agg(F.count("*").alias("n"), F.count_if(~F.col("wrong")).alias("right"))
    oracle = F.greatest(F.lit(0), F.col("rank") - F.col("right")) / F.col("rank")
    means = r.crossJoin(total).agg(F.avg(F.col("errors") / F.col("rank")).alias("a"), F.avg(oracle).alias("o"), F.max("n").alias("n"), F.max("right").alias("right"))  # one row
    return means.select("n", F.round("a", 6).alias("aurc"), F.round("o", 6).alias("aurc_oracle"), F.round(F.col("a") - F.col("o"), 6).alias("e_aurc"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))


#: Lower ends of the ten bins of confidence but the first; the products that a grid of tenths has.
EDGES = [i * 0.1 for i in range(1, 10)]


def bins_of(rows: DataFrame) -> DataFrame:
    """``bin, n, total, right`` of the bins with rows; ``total`` is their confidence in units."""
    at = F.lit(0)
    for e in EDGES:
        at = at + F.when(F.col("conf") >= e, 1).otherwise(0)
    return rows.where("conf is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(units(F.col("conf"))).alias("total"), F.count_if(~F.col("wrong")).alias("right"))


def calibration(rows: DataFrame) -> DataFrame:
    """Per tenth of confidence: rows, mean confidence, accuracy; empty bins stay, the last is closed."""
    every = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    g = bins_of(rows).select("bin", "n", mean6(F.col("total"), F.col("n")).alias("mean_conf"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))
    return every.join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_conf", "accuracy")


def calibration_summary(rows: DataFrame) -> DataFrame:
    """Brier score, its reliability, resolution and uncertainty over ten bins, expected calibration error, mean rows per bin."""
    y = (~F.col("wrong")).cast("int")
    whole = rows.where("conf is not null").agg(F.count("*").alias("all"), F.sum(units((F.col("conf") - y) * (F.col("conf") - y))).alias("sq"), F.sum(y).alias("hits"))
    b = bins_of(rows).crossJoin(whole)  # one row
    mean, acc, base, share = F.col("total") / (F.col("n") * float(UNIT)), F.col("right") / F.col("n"), F.col("hits") / F.col("all"), F.col("n") / F.col("all")
    g = b.agg(
        F.max("all").alias("n"), F.max("sq").alias("sq"), F.max("hits").alias("hits"), F.sum(share * (mean - acc) * (mean - acc)).alias("rel"),
        F.sum(share * (acc - base) * (acc - base)).alias("res"), F.sum(share * F.abs(mean - acc)).alias("ece"),
    )
    p = F.col("hits") / F.col("n")
    return g.select("n", mean6(F.col("sq"), F.col("n")).alias("brier"), *(F.round(x, 6).alias(k) for k, x in (("reliability", F.col("rel")), ("resolution", F.col("res")), ("uncertainty", p * (1 - p)), ("ece", F.col("ece")), ("rows_per_bin", F.col("n") / 10))))


def out_of_scope(counts: DataFrame, other: str, *by: str) -> DataFrame:
    """Precision, recall, F1 and support of one label against all others, from ``counts(gold, pred, c)``; 0 where undefined."""
    is_, said = F.col("gold") == other, F.col("pred") == other
    g = counts.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(x, F.col("c"))), F.lit(0)).alias(k) for k, x in (("tp", is_ & said), ("fp", ~is_ & said), ("fn", is_ & ~said))))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(*by, (F.col("tp") + F.col("fn")).alias("support"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"))


#: Above this symmetry two labels are one problem of the taxonomy; fixed value.
SYMMETRIC = 0.35


def confusion(counts: DataFrame) -> DataFrame:
    """Every cell with its share of the gold label; off the diagonal the reverse count, the symmetry and what that says."""
    back = counts.select(F.col("gold").alias("pred"), F.col("pred").alias("gold"), F.col("c").alias("rev"))
    size = counts.groupBy("gold").agg(F.sum("c").alias("n"))
    rev = F.coalesce("rev", F.lit(0))
    symmetry = F.least("c", rev) / (F.col("c") + rev)
    off = F.col("gold") != F.col("pred")
    return counts.join(size, "gold").join(back, ["gold", "pred"], "left").select(
        "gold", "pred", "c", F.round(F.col("c") / F.col("n"), 6).alias("share"), F.when(off, rev).alias("reverse"), F.when(off, F.round(symmetry, 6)).alias("symmetry"),
        F.when(off, F.when(symmetry > SYMMETRIC, "symmetric").otherwise("asymmetric")).alias("diagnosis"),
    )


#: Chi-square of one degree at 0.05; fixed value.
CHI_05 = 3.841


def mcnemar_report(pairs: DataFrame, *by: str) -> DataFrame:
    """``pairs(a, b)``: discordant counts, the test, whether it is significant, and the least difference in points that could be."""
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    chi, p = mcnemar(F.col("only_a"), F.col("only_b"))
    d = F.col("only_a") + F.col("only_b")
    least = F.when(d > 0, 100.0 * (F.sqrt(CHI_05 * d) + 1) / F.col("n"))
    return g.select(*by, "n", "only_a", "only_b", F.round(chi, 6).alias("chi2"), F.round(p, 4).alias("p"), (chi > CHI_05).alias("significant"), F.round(least, 6).alias("detectable_points"))


def agreement_report(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """``agreement`` with the interval of the raw agreement and the band of the chance-corrected one: from 0.8 reliable, from 0.667 tentative."""
    g = agreement(rows, a, b)
    lo, hi = wilson(F.col("yes") + F.col("no"), F.col("n"))
    band = F.when(F.col("kappa") >= 0.8, "reliable").when(F.col("kappa") >= 0.667, "tentative").otherwise("discard")
    return g.select("*", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), band.alias("band"))


def sensitivity(rows: DataFrame, ratios: tuple[int, ...] = (5, 10, 20, 50), default: int = 20) -> DataFrame:
    """Per cost ratio R the cut R / (R + 1): what is kept, its risk and interval (0 to 1 if nothing is), and the cost of a hundred rows.

    A wrong row that is kept costs R, a right one that isn't costs 1.
    """
    d = rows.where("conf is not null").withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))  # a few ratios, reduced in the map
    keep = F.col("conf") >= F.col("ratio") / (F.col("ratio") + 1.0)
    g = d.groupBy("ratio").agg(F.count("*").alias("n"), F.count_if(keep).alias("kept"), F.count_if(keep & F.col("wrong")).alias("bad"), F.count_if(~keep & ~F.col("wrong")).alias("needless"))
    lo, hi = wilson(F.col("bad"), F.col("kept"))
    cost = 100.0 * (F.col("bad") * F.col("ratio") + F.col("needless")) / F.col("n")
    return g.select(
        "ratio", F.round(F.col("ratio") / (F.col("ratio") + 1.0), 6).alias("threshold"), "n", "kept", "bad", F.round(F.col("kept") / F.col("n"), 6).alias("coverage"), F.round(ratio(F.col("bad"), F.col("kept")), 6).alias("risk"),
        F.round(F.coalesce(lo, F.lit(0.0)), 6).alias("low"), F.round(F.coalesce(hi, F.lit(1.0)), 6).alias("high"), F.round(cost, 4).alias("cost"), (F.col("ratio") == default).alias("is_default"),
    )


def bootstrap_cells(counts: DataFrame, metrics: str, reps: int = 10_000, seed: int = 42, chunk: int = 500) -> DataFrame:
    """``metric, reps, low, median, high``: percentile intervals over ``reps`` resamples of all rows.

    ``counts(gold, pred, c)`` is all that a resample needs: n draws with replacement from
    the rows are one multinomial draw over the cells, so a replicate costs the number of
    cells, not of rows. The cells of a few labels reach the driver. ``metrics``: "labels" gives
    accuracy and macro-F1 with absent classes dropped or scored 0; "pairs" takes gold and
    pred as whether two systems are right and gives their difference, and the share of
    replicates in which the first leads by nothing.
    """
    cells = counts.where("c > 0").orderBy("gold", "pred").limit(100_001).collect()
    if len(cells) > 100_000:
        raise ValueError("more than 100,000 cells")
    n = sum(r["c"] for r in cells)
    if not n:
        raise ValueError("cannot resample no rows")
    share = np.array([r["c"] for r in cells], float) / n
    labels = sorted({r["gold"] for r in cells} | {r["pred"] for r in cells})
    at = {x: i for i, x in enumerate(labels)}
    gold, pred = (np.array([at[r[k]] for r in cells]) for k in ("gold", "pred"))
    values = np.array([int(r["gold"]) - int(r["pred"]) for r in cells]) if metrics == "pairs" else None

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (x for b in batches for x in b.column(0).to_pylist()):
            rng = np.random.default_rng([seed, task])
            drawn = rng.multinomial(n, share, min(chunk, reps - task * chunk)).astype(float)
            if values is not None:
                out = {"difference": drawn @ values / n}
            else:
                hit = gold == pred
                tp, fp, fn = (drawn @ np.stack([m & (k == i) for i in range(len(labels))], 1).astype(float) for m, k in ((hit, gold), (~hit, pred), (~hit, gold)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    f1 = np.where(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn), np.nan)
                out = {"accuracy": drawn @ hit / n, "macro_f1_drop_class": np.nanmean(f1, 1), "macro_f1_score_zero": np.nan_to_num(f1).mean(1)}
            for k, v in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(v)), pa.array(v)], ["metric", "value"])

    tasks = counts.sparkSession.range(0, -(-reps // chunk))
    drawn = tasks.mapInArrow(draw, "metric string, value double")
    worse = [F.round(F.avg((F.col("value") <= 0).cast("double")), 6).alias("p")] if metrics == "pairs" else []
    return drawn.groupBy("metric").agg(F.count("*").alias("reps"), *worse, *(F.round(F.percentile("value", F.lit(q)), 6).alias(k) for k, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw of a uniform number, up to 7."""
    w = F.lit(0)
    for edge in (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759):
        w = w + F.when(u >= edge, 1).otherwise(0)
    return w


def bootstrap_rate(rows: DataFrame, key: Column, flag: Column, reps: int = 200) -> DataFrame:
    """Percentile interval of a rate by a Poisson bootstrap whose draws are hashes of (replicate, key).

    Each row meets each replicate in the map; what is shuffled is one partial sum per replicate.
    """
    each = rows.select(key.cast("string").alias("key"), flag.cast("int").alias("f")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), "key")), 1, 8), 16, 10).cast("double") / 4294967296.0
    sums = each.withColumn("w", poisson_weight(u)).groupBy("rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("f")).alias("k"))
    rates = sums.where("n > 0").select((F.col("k") / F.col("n")).alias("r"))
    return rates.agg(F.count("*").alias("reps"), *(F.round(F.percentile("r", F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))))
