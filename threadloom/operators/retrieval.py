"""Lexical and dense retrieval, fusion, diversification, and their measures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import TOKEN, tokens
from threadloom.session import checkpoint, shared_folder

K1, B = 1.5, 0.75
#: Classes whose mean vectors a row is compared with at most.
CLASSES = 4096


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: A term is frequent if one in so many documents has it: its posting list is read only for queries that need it.
FREQUENT = 50
#: Tokens of documents, and terms of queries, that a task holds at once, about.
TOKENS = 1 << 22
#: Scores that differ by less may be equal once they are rounded.
MARGIN = 2e-6


def weighed_terms(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """``term, df, N, avgdl, idf`` of the telling terms of ``docs(dl)``.

    idf = ln((N - df + 0.5) / (df + 0.5)), at least 0: a term that half of all documents
    hold tells nothing. Statistics cover all documents.
    """
    stats = docs.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats)  # one row of statistics
    return df.withColumn("idf", F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))).where("idf > 0")


def _gain() -> Column:
    """What a term adds to a score: columns qtf, idf, tf, dl, avgdl; at most qtf * idf * (K1 + 1)."""
    tf = F.col("tf").cast("double")
    return F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _posting_lists(flat: pa.Array, n: np.ndarray, asked: pa.Array, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of documents with ``n`` tokens each, all in ``flat``, of the terms in ``asked``: number of each of ``asked`` or -1, starts, documents, gains."""
    coded = flat.dictionary_encode()
    term = pc.fill_null(pc.index_in(asked, value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wanted = np.zeros(len(coded.dictionary), bool)
    wanted[term[term >= 0]] = True
    pair, tf = np.unique((code * len(n) + np.repeat(np.arange(len(n)), n))[wanted[code]], return_counts=True)
    doc = pair % len(n)
    return term, np.searchsorted(pair // len(n), np.arange(len(wanted) + 1)), doc, tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[doc] / mean))


def _scores(size: int, lists: list[tuple[float, np.ndarray, np.ndarray]], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a slice that may be among a query's k best, with their whole scores; never ``own``.

    ``lists`` are the weight, documents and gains of the query's terms. Rare terms are
    scored first; the k-th best of these scores is a floor of the list. Frequent terms
    whose bounds together stay below it can't bring a document into the list by
    themselves: they only add to documents that other terms found and that can still
    reach the floor.
    """
    score = np.zeros(size)

    def kth() -> float:
        if own >= 0:
            score[own] = 0.0
        return float(np.partition(score, size - k)[size - k]) if size > k else 0.0

    often = []
    for weight, docs, gains in lists:
        if len(docs) * FREQUENT > size:
            often.append((weight * (K1 + 1), weight, docs, gains))
        else:
            score[docs] += weight * gains
    floor, more = kth() if often else 0.0, 0.0
    often.sort(key=lambda x: x[0])
    weak = []
    for bound, weight, docs, gains in often:
        if more + bound < floor - MARGIN:
            more += bound
            weak.append((weight, docs, gains))
        else:
            score[docs] += weight * gains
    floor = kth()
    found = np.flatnonzero((score > 0) & (score + more >= floor - MARGIN))
    for weight, docs, gains in weak:
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        score[found] += np.where(docs[at] == found, weight * gains[at], 0.0)
    return found, score[found]


def bm25_topk(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, qtext: str, k: int, block: int = 8192, slice_: int = 32_768) -> DataFrame:
    """``(qkey, key, score, rank)``: the k documents with the highest Okapi score for each query, exactly; not the query itself. Checkpointed.

    A query's repeated terms count as often. Keys are distinct; a document without a key
    counts in the statistics only. Documents lie in slices, queries in blocks, as in
    ``dense_topk``: a task scores a block's queries against a slice one by one and keeps k
    per query, so that scores of pairs are never rows. Slices and blocks of long texts
    hold fewer of them.
    """
    spark = docs.sparkSession
    folder = shared_folder(docs, "bm25")
    docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("w")).write.parquet(folder)
    held = spark.read.parquet(folder)
    sized = held.select(F.size("w").alias("dl"))
    idf = weighed_terms(sized, held.select(F.explode(F.array_distinct("w")).alias("term")))
    asked = postings(queries, qkey, qtext).where(F.col(qkey).isNotNull()).withColumnRenamed("tf", "qtf").join(idf, "term").groupBy(F.col(qkey).alias("q"))
    asked = checkpoint(asked.agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight")))).alias("terms")))
    kind = held.schema["id"].dataType.simpleString()
    asked = asked.select("q", F.col("q").try_cast(kind).alias("own"), "terms.term", "terms.weight")
    mean, terms = sized.agg(F.avg("dl")).first()[0] or 1.0, asked.agg(F.avg(F.size("term"))).first()[0] or 1.0
    rows, asks, by = _blocks(
        held.where(F.col("id").isNotNull() & (F.size("w") > 0)).select("id", F.concat_ws(" ", "w").alias("w")), asked, max(1, min(block, int(TOKENS / terms))), max(1, min(slice_, int(TOKENS / mean))), None
    )

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id").combine_chunks()  # so that numbers of documents are in the order of ids
        q, at, scores = [], [], []
        if left.num_rows and right.num_rows:
            words = pc.split_pattern(left.column("w").combine_chunks(), " ")
            lists, weights = right.column("term").combine_chunks(), right.column("weight").combine_chunks().flatten().to_numpy()
            term, start, docs, gains = _posting_lists(words.flatten(), pc.list_value_length(words).to_numpy().astype(np.int64), lists.flatten(), mean)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            own = pc.fill_null(pc.index_in(right.column("own").combine_chunks(), value_set=left.column("id").combine_chunks()), -1).to_numpy(zero_copy_only=False)
            for i, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                spans = [(weights[j], slice(start[term[j]], start[term[j] + 1])) for j in range(lo, hi) if term[j] >= 0]
                found, score = _scores(left.num_rows, [(w, docs[s], gains[s]) for w, s in spans], int(own[i]), k)
                score = np.round(score, 6)
                best = np.lexsort((found, -score))[:k]
                q.append(np.full(len(best), i))
                at.append(found[best])
                scores.append(score[best])
        q, at, scores = (np.concatenate(x) if x else np.zeros(0) for x in (q, at, scores))
        return pa.table({"q": right.column("q").take(pa.array(q, pa.int64())), "id": left.column("id").take(pa.array(at, pa.int64())), "score": pa.array(scores, pa.float64())})

    of_q = asked.schema["q"].dataType.simpleString()
    best = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(match, f"q {of_q}, id {kind}, score double")
    found = checkpoint(top(best, "q", "score", F.col("id"), k).select(F.col("q").alias(qkey), F.col("id").alias(key), "score", "rank"))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return found


def top(scored: DataFrame, by: str, score: str, tie: str | Column, k: int) -> DataFrame:
    """The k best per group with their 1-based rank; ties by ``tie``, ascending."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Scores that a task holds at once: a chunk of a query block by one slice.
HELD = 1 << 24


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best per row, ties to the lower id; scores of minus infinity are none."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    else:
        row, col = np.nonzero(np.isfinite(scores))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(vectors: DataFrame, queries: DataFrame, block: int, slice_: int, within: str | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the numbers ``s`` and ``b`` of their slice and block, each slice once per block and the reverse."""
    by = [] if within is None else [within]
    for c in by:
        vectors, queries = vectors.where(F.col(c).isNotNull()), queries.where(F.col(c).isNotNull())
    # the largest group of a column sets the number of slices of each
    n, m = (x.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 for x in (vectors, queries))
    slices, blocks = max(1, -(-n // slice_)), max(1, -(-m // block))
    rows = vectors.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    asks = queries.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    return rows, asks, ["s", "b", *by]


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192, slice_: int = 32_768, within: str | None = None) -> DataFrame:
    """``(q, id, score, rank)``: the k nearest of all ``vectors(id, v)`` to each of ``queries(q, v)`` by dot product, not itself.

    A stated query set against all rows in blocks: queries lie in blocks of about
    ``block``, rows in slices of about ``slice_``; a task multiplies one block with one
    slice, some queries at a time, and keeps k per query. A row is copied once per block,
    so blocks are as large as a task can hold. With ``within``, a column of both, a query
    meets only rows of its own value, all of them; null has none.
    """
    rows, asks, by = _blocks(vectors.select("id", "v", *([within] if within else [])), queries.select("q", "v", *([within] if within else [])), block, slice_, within)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, qs = left.column("id").to_numpy(), right.column("q").to_numpy()
            x, y = _matrix(left.column("v")), _matrix(right.column("v"))
            step = max(1, HELD // len(ids))
            for at in range(0, len(qs), step):
                some = qs[at : at + step]
                scores = np.round(y[at : at + step] @ x.T, 6)
                scores[some[:, None] == ids[None, :]] = -np.inf
                row, col = _best(scores, ids, k)
                for to, part in zip(found, (some[row], ids[col], scores[row, col]), strict=True):
                    to.append(part)
        q, i, v = (np.concatenate(x) if x else np.zeros(0) for x in found)
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(v, pa.float64())})

    best = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(multiply, "q bigint, id bigint, score double")
    return top(best, "q", "score", F.col("id"), k)


def best_per_label(vectors: DataFrame, queries: DataFrame, block: int = 8192, slice_: int = 32_768) -> DataFrame:
    """``(q, label, score)``: the nearest of all ``vectors(id, v, label)`` of each label to each of ``queries(q, v)``, not itself."""
    rows, asks, by = _blocks(vectors.select("id", "v", "label"), queries.select("q", "v"), block, slice_, None)

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            label = left.column("label").to_numpy()
            order = np.argsort(label, kind="stable")
            label, ids, x = label[order], left.column("id").to_numpy()[order], _matrix(left.column("v"))[order]
            qs, y = right.column("q").to_numpy(), _matrix(right.column("v"))
            kinds, first = np.unique(label, return_index=True)
            step = max(1, HELD // len(ids))
            for at in range(0, len(qs), step):
                some = qs[at : at + step]
                scores = np.round(y[at : at + step] @ x.T, 6)
                scores[some[:, None] == ids[None, :]] = -np.inf
                best = np.maximum.reduceat(scores, first, axis=1)
                row, col = np.nonzero(np.isfinite(best))
                for to, part in zip(found, (some[row], kinds[col], best[row, col]), strict=True):
                    to.append(part)
        q, c, v = (np.concatenate(x) if x else np.zeros(0) for x in found)
        return pa.table({"q": pa.array(q, pa.int64()), "label": pa.array(c, pa.int32()), "score": pa.array(v, pa.float64())})

    each = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(multiply, "q bigint, label int, score double")
    return each.groupBy("q", "label").agg(F.max("score").alias("score"))


def reciprocal_ranks(lists: DataFrame, by: str, item: str, k: int = 60) -> DataFrame:
    """Fusion of ranked lists ``(by, item, rank)``: the sum of 1 / (k + rank), best first, ties by the item as text."""
    fused = lists.groupBy(by, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.col(item).cast("string"))))


def diversify(pool: DataFrame, by: str, item: str, relevance: str, vector: str, k: int = 3, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: greedily ``k`` items per group, ties by the item.

    ``pool`` is a short list per group (a top-k), so each round is a window over it.
    """
    left = pool.select(by, item, F.col(relevance).alias("rel"), F.col(vector).alias("v")).withColumn("seen", F.lit(None).cast("double"))
    picked = None
    for r in range(1, k + 1):
        value = F.when(F.col("seen").isNull(), F.col("rel")).otherwise(weight * F.col("rel") - (1 - weight) * F.col("seen"))
        ranked = left.withColumn("value", F.round(value, 6)).withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), item)))
        best = ranked.where("n = 1")
        row = best.select(by, item, F.lit(r).alias("pick"), "value")
        picked = row if picked is None else picked.unionByName(row)
        chosen = best.select(by, F.col("v").alias("bv"))
        left = ranked.where("n > 1").join(chosen, by).withColumn("seen", F.greatest("seen", dot(F.col("v"), F.col("bv")))).drop("bv", "n", "value")
    return picked


def ranking_measures(ranked: DataFrame, sizes: DataFrame, by: str, k: int) -> DataFrame:
    """Per group recall, reciprocal rank and gain at k of ``ranked(by, rank, hit)``; ``sizes(by, relevant)`` says how many there are, none: 0."""
    hit = F.col("hit") & (F.col("rank") <= k)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    g = ranked.groupBy(by).agg(F.count_if(hit).alias("found"), F.max(F.when(hit, 1.0 / F.col("rank"))).alias("rr"), F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0))).alias("gain"))
    some = F.col("relevant") > 0
    return g.join(sizes, by, "left").select(
        by,
        F.round(F.coalesce(F.when(some, F.col("found") / F.col("relevant")), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce("rr", F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.when(some, F.col("gain") / ideal), F.lit(0.0)), 6).alias("ndcg"),
    )


def nearest_centroid(vectors: DataFrame) -> DataFrame:
    """``(id, label, nearest)`` of ``vectors(id, v, label)``: the class whose mean vector is nearest, ties to the lower class.

    Means are one row per class; classes are few, and each row meets each class once.
    """
    means = vectors.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))
    # classes x dimensions are broadcast: checked
    if vectors.select("label").distinct().limit(CLASSES + 1).count() > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    table = centers.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("k"), "c"))).alias("centers"))  # one row: classes x dimensions
    far = lambda c, v: F.round(F.aggregate(F.zip_with(c, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 6)
    best = F.array_min(F.transform("centers", lambda s: F.struct(far(s["c"], F.col("v")).alias("far"), s["k"].alias("k"))))
    return vectors.crossJoin(F.broadcast(table)).select("id", "label", best["k"].alias("nearest"))


def batches_of(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Hook for an external model: ``fn`` maps Arrow batches; nothing is called over a network here."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield fn(b)

    return df.mapInArrow(run, schema)


#: Numbers of a hashed vector.
WIDTH = 64
_HASHES: dict[str, int] = {}


def hashed_vector(text: str | None) -> list[float]:
    """A stand-in for an encoder: signed counts of tokens by the first 32 bits of their md5, of length 1; without tokens all 0."""
    out = np.zeros(WIDTH)
    for w in re.findall(TOKEN, (text or "").lower()):
        h = _HASHES.get(w)
        if h is None:
            if len(_HASHES) > 200_000:
                _HASHES.clear()
            h = _HASHES[w] = int(md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        out[h % WIDTH] += 1 if h // WIDTH % 2 == 0 else -1
    length = np.sqrt((out * out).sum())
    return (out / length if length else out).tolist()


def embedded(rows: DataFrame, key: str, text: str, encoder: Callable[[str | None], list[float]] = hashed_vector) -> DataFrame:
    """``(id, v)`` of ``rows(key BIGINT, text)`` by an encoder; pass a model's to have its vectors."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["id", "v"])

    return batches_of(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), run, "id bigint, v array<double>")


def pools(docs: DataFrame, tail: int = 5) -> DataFrame:
    """``(pool, id)``: per brand and intent of ``docs(id, brand, intent)`` its rows and the brand's first ``tail`` others by id.

    The first ``tail`` of each brand and intent hold the first of any "all but one intent".
    """
    named = docs.where("brand is not null and intent is not null").select("id", "brand", "intent", F.concat_ws("\x1f", "brand", "intent").alias("pool"))
    heads = top(named.withColumn("one", F.lit(1)), "pool", "one", F.col("id"), tail).select("brand", "id", F.col("intent").alias("other"))
    each = named.select("brand", "intent", "pool").distinct()
    others = each.join(heads, "brand").where("other != intent").withColumn("k", F.row_number().over(Window.partitionBy("pool").orderBy("id"))).where(F.col("k") <= tail)
    return named.select("pool", "id").unionByName(others.select("pool", "id"))


def pooled_bm25(docs: DataFrame, pool: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(q, id, rank)``: the k best of a query's pool by BM25, ties and documents that share no term by id.

    ``docs(id, text)`` give the statistics, ``pool(pool, id)`` the members, ``asked(q, pool,
    text)`` the queries. Postings are joined by pool and term, so a query never meets a
    document of another pool. A query isn't in its own list.
    """
    sized = docs.select("id", F.size(tokens(F.col("text"))).alias("dl"))
    posts = postings(docs, "id", "text")
    terms = postings(asked, "q", "text").withColumnRenamed("tf", "qtf").join(asked.select("q", "pool"), "q").join(weighed_terms(sized, posts).select("term", "idf", "avgdl"), "term")
    held = posts.join(pool, "id").join(sized, "id")
    scored = terms.join(held, ["pool", "term"]).where("q != id").groupBy("q", "id").agg(F.round(F.sum(_gain()), 6).alias("score"))
    best = top(scored, "q", "score", F.col("id"), k).select("q", "id", "score")
    # the rest of a list: the first of the pool that aren't scored; 2k + 1 of them hold k even if the query and k scored ones are among them
    first = top(pool.withColumn("one", F.lit(1)), "pool", "one", F.col("id"), 2 * k + 1).select("pool", "id")
    rest = asked.select("q", "pool").join(first, "pool").where("q != id").select("q", "id").join(best.select("q", "id"), ["q", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(best.unionByName(rest), "q", "score", F.col("id"), k).select("q", "id", "rank")


def hybrid(docs: DataFrame, asked: DataFrame, candidates: int = 50, k: int = 3, tail: int = 5, encoder: Callable[[str | None], list[float]] = hashed_vector) -> DataFrame:
    """``(q, id, pick, bm25_rank, dense_rank, rrf_score, dense_score)``: lexical and dense lists of a query's pool, fused, then diversified.

    ``docs(id, brand, intent, text)`` and the ids of ``asked(q)`` among them. A rank is
    null where only the other list has the item. Queries without brand or intent have no
    pool and no rows.
    """
    pool = checkpoint(pools(docs, tail))
    vectors = checkpoint(embedded(docs, "id", "text", encoder))
    own = asked.join(docs.where("brand is not null and intent is not null").select(F.col("id").alias("q"), F.concat_ws("\x1f", "brand", "intent").alias("pool"), "text"), "q")
    lexical = checkpoint(pooled_bm25(docs, pool, own, candidates))
    of_query = own.select("q", "pool").join(vectors.select(F.col("id").alias("q"), F.col("v").alias("v")), "q")
    dense = checkpoint(dense_topk(pool.join(vectors, "id"), of_query, candidates, within="pool"))
    fused = reciprocal_ranks(lexical.select("q", "id", "rank").unionByName(dense.select("q", "id", "rank")), "q", "id").select("q", "id", F.col("score").alias("rrf_score"))
    with_v = fused.join(vectors, "id").join(vectors.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    scored = checkpoint(with_v.withColumn("dense_score", F.round(dot(F.col("v"), F.col("qv")), 6)).drop("qv"))
    picked = diversify(scored, "q", "id", "dense_score", "v", k)
    ranks = lexical.select("q", "id", F.col("rank").alias("bm25_rank"))
    return (
        picked.select("q", "id", "pick")
        .join(scored.select("q", "id", "rrf_score", "dense_score"), ["q", "id"])
        .join(ranks, ["q", "id"], "left")
        .join(dense.select("q", "id", F.col("rank").alias("dense_rank")), ["q", "id"], "left")
        .select("q", "id", "pick", "bm25_rank", "dense_rank", "rrf_score", "dense_score")
    )


def top1_similarity(evidence: Column) -> Column:
    """The highest dense score of an array of exemplars, the fused one where that is null; 0 without any."""
    return F.coalesce(F.array_max(F.transform(evidence, lambda e: F.coalesce(e["dense_score"], e["rrf_score"]))), F.lit(0.0))
