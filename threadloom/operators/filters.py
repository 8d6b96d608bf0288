"""Filters and guards that fail loudly instead of dropping rows in silence.

A guard reads its table once by an aggregate and raises on the driver with the values
that broke it; what it returns is the input itself, so that plans stay declarative.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GuardError(ValueError):
    """A table breaks a rule that a caller relies on."""


def brand_turns(once: DataFrame, brand: str) -> DataFrame:
    """Outbound messages ``once(id, author, inbound, ...)`` of a brand, by its name in any case; a brand without any is an error."""
    own = once.where(~F.coalesce("inbound", F.lit(True)) & (F.lower("author") == brand.lower()))
    if own.isEmpty():
        raise GuardError(f"no outbound message of {brand}")
    return own


def brand_threads(turns: DataFrame, brand: str) -> DataFrame:
    """Threads ``turns(root, turn, author, inbound, ...)`` that the brand takes part in by a turn of its own, never by a name in a text."""
    roots = brand_turns(turns, brand).select("root").distinct()
    return turns.join(roots, "root", "left_semi")


def long_threads(turns: DataFrame, least: int) -> DataFrame:
    """Turns of the threads with at least ``least`` turns; ``turn`` counts from 0, so one aggregate of it tells."""
    long = turns.groupBy("root").agg(F.max("turn").alias("last")).where(F.col("last") + 1 >= least).select("root")
    return turns.join(long, "root", "left_semi")


def thread_gate(once: DataFrame, thread: str, time: str, limit: int) -> DataFrame:
    """Messages with their running number in the thread, and whether that has reached the limit.

    Numbers are counted per thread and day first, so that no window holds a thread: one
    spans its days, the other one day's messages.
    """
    from pyspark.sql import Window

    day = once.withColumn("day", F.to_date(time))
    per = day.groupBy(thread, "day").agg(F.count("*").alias("n"))
    before = per.select(F.col(thread).alias("t"), F.col("day").alias("d"), (F.sum("n").over(Window.partitionBy(thread).orderBy(F.col("day").asc_nulls_first())) - F.col("n")).alias("before"))
    within = day.withColumn("within", F.row_number().over(Window.partitionBy(thread, "day").orderBy(F.col(time).asc_nulls_first(), "id")))
    met = within.join(before, within[thread].eqNullSafe(before["t"]) & within["day"].eqNullSafe(before["d"]))
    return met.select(*once.columns, (F.col("before") + F.col("within")).alias("number")).withColumn("gated", F.col("number") >= limit)


def resolved_rows(labels: DataFrame, intent: str, *needed: str, known: list[str]) -> DataFrame:
    """Rows whose label and other needed fields are filled; a label that isn't known is an error."""
    filled = labels
    for c in (intent, *needed):
        filled = filled.where(F.trim(F.col(c).cast("string")) != "")
    odd = [r[0] for r in filled.where(~F.col(intent).isin(known)).select(intent).distinct().orderBy(intent).limit(20).collect()]
    if odd:
        raise GuardError(f"labels that aren't known: {', '.join(odd)}")
    return filled


def only_slice(rows: DataFrame, column: str, value: str) -> DataFrame:
    """``rows``, or an error if any has another value: a headline never filters silently. Null is another value."""
    odd = [r[0] for r in rows.where(~F.col(column).eqNullSafe(value)).select(column).distinct().orderBy(column).limit(20).collect()]
    if odd:
        raise GuardError(f"rows beside {value}: {', '.join(map(str, odd))}")
    return rows


def slice_violations(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The values beside ``value`` and their numbers of rows: what ``only_slice`` raises for."""
    return rows.where(~F.col(column).eqNullSafe(value)).groupBy(column).agg(F.count("*").alias("n"))


def semi_sample(rows: DataFrame, key: str, sampled: DataFrame) -> DataFrame:
    """Rows whose key was sampled; the sample's keys may repeat."""
    return rows.join(sampled.select(key).distinct(), key, "left_semi")


def _member(name: str):
    return lambda e: e[name]


def _leaves(t: T.DataType, c: Column, path: str) -> list[tuple[str, Column]]:
    """Path and expression of each string leaf; those of arrays are arrays of strings, of any depth flattened."""
    if isinstance(t, T.StringType):
        return [(path, F.array(c))]
    if isinstance(t, T.StructType):
        return [x for f in t.fields for x in _leaves(f.dataType, c[f.name], f"{path}.{f.name}" if path else f.name)]
    if isinstance(t, T.MapType):
        return _leaves(T.ArrayType(t.keyType), F.map_keys(c), path + ".keys") + _leaves(T.ArrayType(t.valueType), F.map_values(c), path)
    if isinstance(t, T.ArrayType):
        inner = t.elementType
        if isinstance(inner, T.StringType):
            return [(path + "[]", c)]
        if isinstance(inner, T.ArrayType):
            return _leaves(inner, F.flatten(c), path + "[]")
        if isinstance(inner, T.StructType):
            out = []
            for f in inner.fields:
                values, name = F.transform(c, _member(f.name)), f"{path}[].{f.name}"
                out += [(name, values)] if isinstance(f.dataType, T.StringType) else _leaves(T.ArrayType(f.dataType), values, name)
            return out
        if isinstance(inner, T.MapType):
            return _leaves(T.ArrayType(T.ArrayType(inner.valueType)), F.transform(c, lambda e: F.map_values(e)), path + "[]")
    return []


def string_leaves(rows: DataFrame) -> list[tuple[str, Column]]:
    """Every string in a row, however deep: its path and an array of its values."""
    return [x for f in rows.schema.fields for x in _leaves(f.dataType, F.col(f"`{f.name}`"), f.name)]


def leaks(rows: DataFrame, limit: int = 200, allowed: tuple[str, ...] = (), empty: tuple[str, ...] = ()) -> DataFrame:
    """``field, n``: how many strings are longer than ``limit`` outside the allowed top-level fields, and how many of the fields in ``empty`` aren't.

    One pass: each row gives at most one short struct per field, counted before the shuffle.
    """
    found = []
    for path, values in string_leaves(rows):
        if path.split(".")[0].split("[")[0] not in allowed:
            found.append(F.struct(F.lit(path).alias("field"), F.size(F.filter(values, lambda v: F.char_length(v) > limit)).alias("n")))
    for c in empty:
        found.append(F.struct(F.lit(c + " not empty").alias("field"), F.coalesce(F.col(c).rlike(r"\S").cast("int"), F.lit(0)).alias("n")))
    return rows.select(F.explode(F.array(*found)).alias("f")).groupBy("f.field").agg(F.sum(F.greatest("f.n", F.lit(0))).alias("n"))


def _picked(keys: list[str]):
    return lambda e: F.struct(*(e[k].alias(k) for k in keys))


def allowed_only(rows: DataFrame, allowed: dict[str, list[str] | None]) -> DataFrame:
    """The listed columns, of struct columns only the listed fields; anything else in the schema is an error, so that nothing new leaks unseen."""
    odd = [c for c in rows.columns if c not in allowed]
    out = []
    for name, keys in allowed.items():
        if name not in rows.columns:
            raise GuardError(f"no column {name}")
        if keys is None:
            out.append(F.col(name))
            continue
        inner = rows.schema[name].dataType
        element = inner.elementType if isinstance(inner, T.ArrayType) else inner
        odd += [f"{name}.{f.name}" for f in element.fields if f.name not in keys]
        made = F.transform(F.col(name), _picked(keys)) if isinstance(inner, T.ArrayType) else F.when(F.col(name).isNotNull(), _picked(keys)(F.col(name)))
        out.append(made.alias(name))
    if odd:
        raise GuardError(f"columns that aren't allowed: {', '.join(sorted(odd))}")
    return rows.select(*out)


def blanked(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with an emptied column, and a row with how many that changes (those with something in it)."""
    return rows.withColumn(column, F.lit("")), rows.agg(F.count_if(F.col(column).rlike(r"\S")).alias("changed"))


def without_stray(rows: DataFrame, field: str, allowed: Column, note: str) -> DataFrame:
    """``field`` is nulled where it isn't allowed; each such row gets the note in ``notes``, never silently."""
    stray = ~F.coalesce(allowed, F.lit(False)) & (F.col(field) != "")
    notes = F.when(F.coalesce(stray, F.lit(False)), F.array(F.lit(note))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("notes", notes).withColumn(field, F.when(F.size("notes") == 0, F.col(field)))


def sequential_ids(rows: DataFrame, stratum: str, key: str, offsets: dict[str, int], prefix: str = "g") -> DataFrame:
    """``rows`` with ``id``: prefix and a number of three digits or more, by key within a stratum from its offset on. Other strata are left out.

    Meant for a sample (some hundred rows per stratum), whose windows are as small.
    """
    from pyspark.sql import Window

    start = F.create_map(*(x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))))[F.col(stratum)]
    number = start + F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return rows.where(F.col(stratum).isin(list(offsets))).withColumn("id", F.concat(F.lit(prefix), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))))


def config_hash(path: str) -> str:
    """sha256 of a file's bytes."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_config(path: str) -> dict:
    """A configuration as a dict: YAML where a YAML library is at hand, JSON (a part of YAML) in any case."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(raw)
    return yaml.safe_load(raw)


def labels_of(config: dict) -> list[str]:
    """The names of a taxonomy's intents, in its order."""
    return [x["name"] for x in config["intents"]]
