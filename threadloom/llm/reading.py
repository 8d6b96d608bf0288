"""Reading level of documents: a pairwise ranker over syntax and vocabulary features.

Every document is cut into units (sentences or lines, long ones into windows of words),
because a level is that of most of a text, not of its mean: features are word-weighted
quantiles over units as well as means. A linear ranker is fitted to pairs of rated
documents of different ratings, its scores are mapped to ratings by isotonic regression,
and the scores at which the fit crosses the middle between two bands are the cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.spread import spread
from threadloom.session import checkpoint

#: Rated documents that the ranker is fitted to at most: those with the least hash of their id.
FIT_DOCS = 5000
#: Partners that each rated document is paired with.
PARTNERS = 20
LEAST_WORDS = 50
WINDOW = 16

_UNIT = re.compile(r"(?:[.!?;:…]+[\"')\]]*\s+)|[\r\n]+|\s+-\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyáéíóúàèäöü]+")
#: Connectives that open subordinate clauses.
_JOINS = frozenset("although because whereas which while since unless whether provided notwithstanding whose that when before after until though if".split())
NAMES = (
    *(f"{q}_{x}" for x in ("length", "syllables", "short", "long") for q in ("q25", "median", "q75", "mean")),
    "unit_words",
    "commas",
    "joins",
    "very_long",
    "distinct",
)


def features(text: str) -> list[float]:
    """One number per name of ``NAMES``; zeros for a text without words."""
    rows: list[tuple[int, float, float, float, float]] = []
    units = joins = very_long = n = 0
    seen: set[str] = set()
    for part in _UNIT.split(text):
        words = _WORD.findall(part.lower())
        if not words:
            continue
        units += 1
        seen.update(words)
        cuts = [*range(0, len(words), WINDOW), len(words)]
        if len(cuts) > 2 and cuts[-1] - cuts[-2] < 4:
            del cuts[-2]  # a stub of a long unit tells too little by itself: it joins the window before
        for at, to in zip(cuts, cuts[1:], strict=False):
            w, k = words[at:to], to - at
            sizes = [len(x) for x in w]
            rows.append((k, sum(sizes) / k, max(k, len(_VOWELS.findall(" ".join(w)))) / k, sum(x <= 4 for x in sizes) / k, sum(x >= 9 for x in sizes) / k))
            joins += sum(x in _JOINS for x in w)
            very_long += sum(x >= 12 for x in sizes)
            n += k
    if not rows:
        return [0.0] * len(NAMES)
    a = np.array(rows)
    weight, out = a[:, 0], []
    total = weight.sum()
    for c in range(1, 5):
        order = np.argsort(a[:, c], kind="stable")
        v, cum = a[order, c], np.cumsum(weight[order]) / total
        out += [float(v[np.searchsorted(cum, q)]) for q in (0.25, 0.5, 0.75)] + [float((a[:, c] * weight).sum() / total)]
    return out + [np.log1p(n / units), text.count(",") / n, joins / n, very_long / n, len(seen) / n]


@dataclass
class Model:
    weights: list[float]
    cuts: list[float]  # scores between the bands


def _pool(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, k in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, k2, c2 = blocks.pop()
            v1, k1, c1 = blocks.pop()
            blocks.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, c1 + c2])
    return np.concatenate([np.full(int(c), v) for v, _, c in blocks])


def fit(x: np.ndarray, rating: np.ndarray, votes: np.ndarray, bands: int = 3, ridge: float = 1e-2, steps: int = 30) -> Model:
    """Ranker weights (on raw features) and cuts. ``rating``: mean band per document."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - center) / scale
    rng = np.random.default_rng(7)
    i = np.repeat(np.arange(len(z)), PARTNERS)
    j = rng.integers(0, len(z), len(i))
    gap = rating[i] - rating[j]
    keep = np.abs(gap) >= 0.5
    d, weight = (z[i] - z[j])[keep] * np.sign(gap[keep])[:, None], np.minimum(votes[i], votes[j])[keep].astype(float)
    w = np.zeros(z.shape[1])
    if len(d):
        for _ in range(steps):  # Newton's method for the logistic loss of each pair's order
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g = d.T @ (weight * (1 - p)) / weight.sum() - ridge * w
            h = (d * (weight * p * (1 - p))[:, None]).T @ d / weight.sum() + ridge * np.eye(len(w))
            move = np.linalg.solve(h, g)
            w += move
            if np.abs(move).max() < 1e-8:
                break
    s = z @ w
    order = np.lexsort((rating, s))
    fitted = _pool(rating[order], votes[order].astype(float))
    cuts, s = [], s[order]
    for b in range(1, bands):
        at = int(np.searchsorted(fitted, b + 0.5))
        cuts.append(float(s[-1] + 1 if at == len(s) else s[0] - 1 if at == 0 else (s[at - 1] + s[at]) / 2))
    weights = w / scale
    shift = float(center @ weights)
    return Model(weights.tolist(), [c + shift for c in cuts])


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, x`` of the documents with at least 50 words; texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t) for t in b.column(3).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], x], ["doc_id", "lang", "source", "x"])

    long = F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)[\s\x1C-\x1F]+", " ")), " ")) >= LEAST_WORDS
    source = docs.select("doc_id", "lang", "source", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.lower(F.trim("lang")) == "en"))
    return spread(source.where(long)).mapInArrow(run, "doc_id bigint, lang string, source string, x array<double>")


def train(scored: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fits to at most ``fit_docs`` rated documents, brought to the driver (some numbers each).

    Null bands rate nothing; raters that disagree count by their mean. Without ratings of
    two levels every cut is beyond all scores and every document gets the one level known,
    or level 1.
    """
    rated = labels.where("doc_id is not null and band is not null").groupBy("doc_id").agg(F.avg("band").alias("rating"), F.count("*").alias("votes"))
    rows = scored.select("doc_id", "x").join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).collect()
    rating = np.array([r["rating"] for r in rows])
    if len(np.unique(rating)) < 2:
        only = round(float(rating[0])) if len(rows) else 1
        return Model([0.0] * len(NAMES), [-1.0 if only > b else 1.0 for b in (1, 2)])
    return fit(np.array([r["x"] for r in rows]), rating, np.array([r["votes"] for r in rows]))


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, score, band`` of each English document of at least 50 words.

    A repeated document gives repeated rows; null texts and ids give none.
    """
    scored = checkpoint(document_features(docs))
    model = train(scored, labels)
    score = sum((F.get("x", i) * w for i, w in enumerate(model.weights)), F.lit(0.0))
    band = F.lit(1)
    for c in model.cuts:
        band = band + F.when(F.col("score") > c, 1).otherwise(0)
    return scored.select("doc_id", "source", score.alias("score")).withColumn("band", band.cast("int"))


def profile(levels: DataFrame) -> DataFrame:
    """Documents per source and level."""
    return levels.groupBy("source", "band").agg(F.count("*").alias("documents"))
