"""Files: raw message CSV without inference, JSON lines with a schema, an append-only response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.sampling import latest

RAW = "tweet_id STRING, author_id STRING, inbound STRING, created_at STRING, text STRING, response_tweet_id STRING, in_response_to_tweet_id STRING"
CACHE = "key STRING, response STRING, usage MAP<STRING, BIGINT>, position BIGINT"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text: an inferred double would ruin long ids. Texts may hold line breaks."""
    return spark.read.schema(RAW).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_messages(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are left out, a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if _there(spark, path) else spark.createDataFrame([], schema)


def read_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every column as text and by its name in the header; a missing file is an empty table."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in folders of ``by`` where named."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, key: str | None = None) -> None:
    """JSON lines, range-sorted by ``key`` where one is named."""
    (df.orderBy(key) if key else df).write.mode("overwrite").json(path)


def append_cache(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each key. A line that can't be read or has no key is an error that names it, never left out."""
    if not _there(spark, path):
        return spark.createDataFrame([], CACHE)
    raw = spark.read.schema(CACHE + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_file", F.input_file_name())
    broken = F.col("_corrupt").isNotNull() | F.col("key").isNull()
    what = F.concat(F.lit("unreadable cache line in "), F.col("_file"), F.lit(": "), F.coalesce(F.substring("_corrupt", 1, 80), F.lit("no key")))
    rows = raw.withColumn("key", F.when(broken, F.raise_error(what)).otherwise(F.col("key"))).drop("_corrupt", "_file")
    rows = rows.withColumn("usage", F.to_json("usage"))  # a map has no order
    return latest(rows, "key", "position", "response", "usage").withColumn("usage", F.from_json("usage", "MAP<STRING, BIGINT>"))


def broken_lines(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """File and line number of the first hundred unreadable lines of a cache, for its repair. Numbers are counted in the order of each file."""
    text = spark.read.text(path).select(F.input_file_name().alias("file"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), "value")
    parsed = F.from_json("value", "key STRING, response STRING")
    bad = text.where((F.trim("value") != "") & parsed["key"].isNull()).orderBy("file", "at").limit(100).collect()
    out = []
    for r in bad:
        before = text.where((F.col("file") == r["file"]) & (F.col("at") < r["at"])).count()
        out.append((r["file"], before + 1))
    return out


def compact_cache(spark: SparkSession, path: str, to: str) -> int:
    """Rewrite a cache with one entry per key, sorted; returns their number."""
    read_cache(spark, path).orderBy("key").write.mode("overwrite").json(to)
    return spark.read.schema(CACHE).json(to).count()


def parse_answer(raw):
    """``intent, confidence`` of a model's answer, with code fences taken off; what can't be read is unclear with 0."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    got = F.from_json(bare, "intent STRING, confidence DOUBLE")
    return F.coalesce(got["intent"], F.lit("other_unclear")).alias("intent"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence")
