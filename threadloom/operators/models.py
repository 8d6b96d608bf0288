"""Models of pyspark.ml on labelled texts and vectors, and agreement of clusterings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, NGram, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import tokens
from threadloom.operators.stats import few
from threadloom.session import checkpoint


def fold(key, k: int = 5):
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def svm_accuracy(rows: DataFrame, key: str, features: int = 1 << 12, iterations: int = 5) -> DataFrame:
    """Accuracy per label on the rows of one fold of a one-vs-rest linear SVM over tf-idf of words and word pairs, fitted to the other folds."""
    marked = rows.where("text is not null and label is not null").select(tokens(F.col("text")).alias("w"), "label", fold(key).alias("fold"))
    stages = [
        StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"),
        NGram(n=2, inputCol="w", outputCol="w2"),
        HashingTF(inputCol="w", outputCol="tf1", numFeatures=features),
        HashingTF(inputCol="w2", outputCol="tf2", numFeatures=features),
        IDF(inputCol="tf1", outputCol="x1"),
        IDF(inputCol="tf2", outputCol="x2"),
        VectorAssembler(inputCols=["x1", "x2"], outputCol="features"),
    ]
    shaped = Pipeline(stages=stages).fit(marked.where("fold > 0")).transform(marked)
    shaped = checkpoint(shaped.select("label", "y", "features", "fold"))  # read once per iteration and class
    model = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.1), labelCol="y", featuresCol="features", parallelism=4).fit(shaped.where("fold > 0"))
    out = model.transform(shaped.where("fold = 0"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4).alias("accuracy"))


def vector_regression(rows: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Balanced logistic regression on ``rows(key, v, label)``: accuracy of each fold."""
    n = F.count("*")
    share = rows.groupBy("label").agg(n.alias("c"))
    total = share.agg(F.sum("c").alias("total"), F.count("*").alias("k"))
    weighed = rows.join(F.broadcast(few(share.crossJoin(total))), "label").select(fold(key, folds).alias("fold"), F.col("label").cast("double").alias("y"), array_to_vector("v").alias("features"), (F.col("total") / (F.col("k") * F.col("c"))).alias("w"))
    out = None
    for k in range(folds):
        model = LogisticRegression(labelCol="y", weightCol="w", maxIter=40, regParam=0.01).fit(weighed.where(F.col("fold") != k))
        part = model.transform(weighed.where(F.col("fold") == k)).agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency ``cells(a, b, c)``."""
    pairs = lambda x: x * (x - 1) / 2.0
    both = cells.agg(F.sum(pairs(F.col("c"))).alias("s"), F.sum("c").alias("n"))
    side = lambda k: cells.groupBy(k).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(f"s{k}"))
    x = both.crossJoin(side("a")).crossJoin(side("b"))  # three single rows
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0))), 6).alias("ari"))


def cluster_stability(vectors: DataFrame, ks: tuple[int, ...] = (15, 25, 40), pairs: int = 5, seed: int = 42) -> DataFrame:
    """``(k, ari, best)``: for each k the mean agreement of the clusterings of ``pairs`` pairs of samples of four fifths of ``vectors(id, v)``.

    A pair is compared on the rows that both samples hold; with fewer than k of these it is left out, and without a pair
    the mean is 0. Samples are drawn by salted hashes. ``best`` marks the first k with the highest mean.
    """
    rows = checkpoint(vectors.select("id", array_to_vector("v").alias("features")))  # read once per iteration
    held = lambda salt: F.pmod(F.xxhash64(F.lit(f"{seed}|{salt}"), "id"), F.lit(5)) > 0
    means = []
    for k in ks:
        found = []
        for rep in range(pairs):
            sides = held(f"{rep}|a"), held(f"{rep}|b")
            shared = rows.where(sides[0] & sides[1])
            if shared.count() < k:
                continue
            a, b = (KMeans(k=k, seed=s).fit(rows.where(side)) for side, s in zip(sides, (seed + rep, seed + 100 + rep), strict=True))
            cells = b.transform(a.transform(shared).withColumnRenamed("prediction", "a")).groupBy("a", F.col("prediction").alias("b")).agg(F.count("*").alias("c"))
            found.append(adjusted_rand(cells).first()["ari"])
        means.append(round(sum(found) / len(found), 6) if found else 0.0)
    first = means.index(max(means))
    return vectors.sparkSession.createDataFrame([(k, m, i == first) for i, (k, m) in enumerate(zip(ks, means, strict=True))], "k int, ari double, best boolean")
