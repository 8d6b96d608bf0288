"""Evaluation records that also occur, exactly or almost, in the training exemplars.

A normalised text is its distinct words in alphabetical order; equal texts are one class
per side. The passages of a text are its pairs of neighbouring words. Let a near-same
pair of texts have c common words and d = u - c others among the u words of either. The
others cut the common words into at most d + 1 runs, each of which is contiguous in both
texts. With the threshold above one half, c > d + 1: at least 2c - u - 1 passages are
common, and the merged intervals of the common passages cover at least 2c - u words of
either text (see ``least_shared``). So nothing is lost by asking for that coverage.

The evaluation classes are dealt into shards of a bounded number of records. Every task
takes one shard and some slices of the training texts, builds the shard's Aho-Corasick
automaton over all passages of its records once, and scans every text with it. Records
that share enough of their rarest passages with a text are its candidates; the matched
intervals of a candidate are merged into its coverage, and those that are covered far
enough are compared on their whole word sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import id_number, tidy_label
from threadloom.llm.tables import dropped, files_of, stored
from threadloom.llm.wordsets import SHARE, _ratio, with_words
from threadloom.session import checkpoint

#: Evaluation classes per shard, on average: bounds a task's automaton.
SHARD = 16_384
#: Common passages among the rarest that make a candidate (fewer where a text has fewer to share).
SHARED = 4
#: Slices (files of the training table) that one task scans at most.
SLICES = 8


@lru_cache(maxsize=65_536)
def least_shared(n: int, share: float = SHARE) -> int:
    """Passages that a text of n distinct words shares with any near-same one, at least."""
    num, den = _ratio(share)
    # u words in either of the two, c in both; the value rises with u but for the rounding of c
    least = min(2 * -(-u * num // den) - u - 1 for u in range(n, min(n * den // num, n + den) + 1))
    if least < 1:
        raise ValueError(f"texts of {n} words may be near-same at {share} without a common passage")
    return least


class Shard:
    """Automaton over the passages of some evaluation classes, and who has which.

    Passages are numbered by how many records have them, the rarest first.
    """

    def __init__(self, reps: list[str], texts: list[str], share: float = SHARE):
        import ahocorasick

        self.rep, self.text = reps, texts
        number: dict[str, int] = {}
        rows = []
        for text in texts:
            words = text.split(" ")
            rows.append([number.setdefault(f" {a} {b} ", len(number)) for a, b in zip(words, words[1:], strict=False)])
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(size.sum()))
        order = np.argsort(np.bincount(flat, minlength=len(number)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.automaton = ahocorasick.Automaton()
        for passage, k in number.items():
            self.automaton.add_word(passage, int(rank[k]))
        if number:
            self.automaton.make_automaton()
        self.n, self.start, self.passages = size + 1, np.cumsum(size) - size, rank[flat] if len(flat) else flat
        least = np.array([least_shared(int(n), share) for n in self.n], np.int64)
        self.enough = np.minimum(SHARED, least)
        # postings of the rarest passages only: with `least` to share, `enough` of these are always among them
        rec = np.repeat(np.arange(len(size)), size)
        by = np.lexsort((self.passages, rec))
        place = np.arange(len(flat)) - np.repeat(self.start, size)
        kept = by[place < np.repeat(size - least + self.enough, size)]
        kept = kept[np.argsort(self.passages[kept], kind="stable")]
        self.posted = rec[kept].astype(np.int32)
        self.at = np.searchsorted(self.passages[kept], np.arange(len(number) + 1))

    def covered(self, r: int, hits: np.ndarray) -> int:
        """Words of record r in the merged intervals of its matched passages; ``hits`` is sorted."""
        own = self.passages[self.start[r] : self.start[r] + self.n[r] - 1]
        found = hits[np.minimum(np.searchsorted(hits, own), len(hits) - 1)] == own
        return int(found[0]) + int((found[1:] | found[:-1]).sum()) + int(found[-1])


def scan(shard: Shard, texts: list[str], share: float = SHARE) -> Iterator[tuple[int, int, int, float]]:
    """``(text, record, common words, coverage of the record)`` of the near-same ones."""
    num, den = _ratio(share)
    if not len(shard.automaton):
        return
    for t, text in enumerate(texts):
        hits = np.sort(np.array([k for _, k in shard.automaton.iter(f" {text} ")], np.int64))
        n = text.count(" ") + 1
        least = least_shared(n, share)
        if len(hits) < least:
            continue
        enough = min(SHARED, least)
        rare = hits[: len(hits) - least + enough]
        lo, count = shard.at[rare], shard.at[rare + 1] - shard.at[rare]
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(total)
        rec, met = np.unique(shard.posted[at], return_counts=True)
        n_r = shard.n[rec]
        rec = rec[(met >= np.minimum(enough, shard.enough[rec])) & (np.minimum(n_r, n) * den >= np.maximum(n_r, n) * num)]
        words: set[str] | None = None
        for r in rec.tolist():
            m = int(shard.n[r])
            need = -(-(m + n) * num // (num + den))  # common words of a near-same pair of these sizes
            covered = shard.covered(r, hits)
            if covered < 3 * need - m - n:
                continue
            words = set(text.split(" ")) if words is None else words
            common = len(words.intersection(shard.text[r].split(" ")))
            if common * den >= (m + n - common) * num:
                yield t, r, common, covered / m


_HELD: dict[str, Shard | None] = {}


def _shard(uri: str, share: float) -> Shard | None:
    """The shard of a folder in shared storage; a worker keeps the last one it used."""
    if uri not in _HELD:
        _HELD.clear()
        fs, path = pafs.FileSystem.from_uri(uri)
        try:
            rows = pq.read_table(path, filesystem=fs, columns=["rep", "text"], partitioning=None)
            _HELD[uri] = Shard(rows.column("rep").to_pylist(), rows.column("text").to_pylist(), share)
        except FileNotFoundError:  # no record fell into it
            _HELD[uri] = None
    return _HELD[uri]


def near_texts(evaluation: DataFrame, training: DataFrame, share: float = SHARE, shard_size: int = SHARD) -> DataFrame:
    """``(rep_e, rep_t, common, coverage)`` of near-same classes; both inputs ``(rep, text)`` with normalised texts. Checkpointed."""
    spark = evaluation.sparkSession
    whole = stored(evaluation.select("rep", "text"), "evaluation")
    shards = max(1, -(-spark.read.parquet(whole).count() // shard_size))
    dealt = spark.read.parquet(whole).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    folder = stored(dealt.repartition(shards, "shard"), "shards", "shard")
    train = stored(training.select("rep", "text"), "training")
    slices = files_of(train)
    groups = max(1, -(-len(slices) // SLICES), min(len(slices), -(-2 * spark.sparkContext.defaultParallelism // shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (x for b in batches for x in b.column(0).to_pylist()):
            shard = _shard(f"{folder}/shard={task // groups}", share)
            if shard is None:
                continue
            for uri in slices[task % groups :: groups]:
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    for b in pq.ParquetFile(f).iter_batches(4096, columns=["rep", "text"]):
                        reps = b.column(0).to_pylist()
                        rows = [(shard.rep[r], reps[t], c, v) for t, r, c, v in scan(shard, b.column(1).to_pylist(), share)]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["rep_e", "rep_t", "common", "coverage"])

    # neighbouring tasks have the same shard, so that a worker builds it once
    tasks = spark.range(0, shards * groups, 1, shards * groups)
    links = checkpoint(tasks.mapInArrow(run, "rep_e string, rep_t string, common bigint, coverage double"))
    dropped(spark, whole, folder, train)
    return links


def _classes(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame, str]:
    """Members ``(id, rep)`` and classes ``(rep, text)`` of ``rows(id, text)``, and the table they are read from."""
    named = with_words(rows, "text", "id").select("id", F.array_join("words", " ").alias("text")).select("id", F.concat(F.lit(side), F.hex(F.xxhash64("text")), F.lit("-"), F.hex(F.hash("text"))).alias("rep"), "text")
    folder = stored(named, "texts")
    held = rows.sparkSession.read.parquet(folder)
    return held.select("id", "rep").distinct(), held.groupBy("rep").agg(F.first("text").alias("text")), folder


def _sides(records: DataFrame, exemplars: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = records.where(F.col("message_id").isNotNull() & tidy_label(F.col("stratum")).isNotNull()).select(F.col("message_id").alias("id"), id_number(F.col("conversation_id")).alias("conv"), F.col("input_text_redacted").alias("text"))
    given = exemplars.where(F.col("evidence_id").isNotNull()).select(F.col("evidence_id").alias("id"), id_number(F.col("conversation_id")).alias("conv"), F.col("customer_text").alias("text"))
    return held, given


def _near(held: DataFrame, given: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of both sides and the links of their classes, all checkpointed; the tables behind them are gone."""
    members_e, classes_e, table_e = _classes(held.select("id", "text"), "e")
    members_t, classes_t, table_t = _classes(given.select("id", "text"), "t")
    links = near_texts(classes_e, classes_t, share)
    members_e, members_t = checkpoint(members_e), checkpoint(members_t)
    dropped(held.sparkSession, table_e, table_t)
    return members_e, members_t, links


def overlaps(records: DataFrame, exemplars: DataFrame, share: float = SHARE) -> DataFrame:
    """``message_id, evidence_id, same_conversation, coverage`` of every evaluation record and exemplar that overlap.

    An overlap is the same conversation by number or near-same texts (coverage: share of
    the record's words in merged intervals of matched passages; null where only the
    conversation is the same). Records without stratum aren't evaluation records; rows
    with null ids are left out; null, empty and short texts are near nothing; repeated
    rows count once.
    """
    held, given = _sides(records, exemplars)
    none = F.lit(None).cast("double").alias("coverage")
    talk = held.where("conv is not null").select(F.col("id").alias("message_id"), "conv").distinct().join(given.where("conv is not null").select(F.col("id").alias("evidence_id"), "conv").distinct(), "conv")
    members_e, members_t, links = _near(held, given, share)
    near = (
        links.join(members_e.select(F.col("id").alias("message_id"), F.col("rep").alias("rep_e")), "rep_e")
        .join(members_t.select(F.col("id").alias("evidence_id"), F.col("rep").alias("rep_t")), "rep_t")
        .select("message_id", "evidence_id", F.lit(False).alias("same"), "coverage")
    )
    return (
        talk.select("message_id", "evidence_id", F.lit(True).alias("same"), none)
        .unionByName(near)
        .groupBy("message_id", "evidence_id")
        .agg(F.max("same").alias("same_conversation"), F.max("coverage").alias("coverage"))
    )


def overlap_classes(records: DataFrame, exemplars: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per evaluation record: ``message_id, class_id, near_classes, near_exemplars, same_conversation``.

    The bounded form of ``overlaps``: records of one word set are one class, named by its
    least record, and exemplars are counted per class and per conversation, never listed.
    A record with several texts counts each of them under its greatest class; one whose
    text is too short is its own class.
    """
    held, given = _sides(records, exemplars)
    members_e, members_t, links = _near(held, given, share)
    sizes = members_t.groupBy(F.col("rep").alias("rep_t")).agg(F.count("*").alias("copies"))
    per = links.join(sizes, "rep_t").groupBy(F.col("rep_e").alias("rep")).agg(F.count("*").alias("near_classes"), F.sum("copies").alias("near_exemplars"))
    names = members_e.groupBy("rep").agg(F.min("id").alias("class_id"))
    own = members_e.groupBy("id").agg(F.max("rep").alias("rep")).join(names, "rep").join(per, "rep", "left")
    talks = given.where("conv is not null").select("id", "conv").distinct().groupBy("conv").agg(F.count("*").alias("c"))
    talk = held.select("id", "conv").distinct().join(talks, "conv", "left").groupBy("id").agg(F.sum(F.coalesce("c", F.lit(0))).alias("same_conversation"))
    return talk.join(own, "id", "left").select(
        F.col("id").alias("message_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("near_classes", F.lit(0)).alias("near_classes"), F.coalesce("near_exemplars", F.lit(0)).alias("near_exemplars"), "same_conversation"
    )


def overlap_counts(found: DataFrame, records: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Per stratum and brand: overlapping pairs, evaluation records and exemplars."""
    strata = records.select("message_id", tidy_label(F.col("stratum")).alias("stratum")).where("stratum is not null").distinct()
    brands = exemplars.select("evidence_id", F.when(F.col("brand").rlike(r"\S"), F.col("brand")).alias("brand")).distinct()
    both = found.select("message_id", "evidence_id").join(strata, "message_id").join(brands, "evidence_id")
    return both.groupBy("stratum", "brand").agg(F.count("*").alias("pairs"), F.count_distinct("message_id").alias("records"), F.count_distinct("evidence_id").alias("exemplars"))
