"""Ids that are compared by number, and instants written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_number(c: Column) -> Column:
    """BIGINT of an id. Blanks around it and a decimal tail don't change it.

    Null, blank, ``nan`` and anything else that isn't a whole number is no id: null.
    """
    return F.regexp_extract(c, r"^\s*(\d{1,19})(?:\.\d*)?\s*$", 1).try_cast("bigint")


def id_list(c: Column) -> Column:
    """Distinct numbers of a comma-separated id list; members that are no id are left out, a null list is empty."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), id_number)
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def instant(c: Column) -> Column:
    """Timestamp of ``Tue Oct 31 22:10:47 +0000 2017`` or an ISO form; null where neither can be read."""
    # EEE can't be parsed, so the weekday is cut off
    tweet = F.try_to_timestamp(F.substring(F.trim(c), 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    iso = F.when(c.rlike(r"^\s*\d{4}-\d\d-\d\d"), F.trim(c).try_cast("timestamp"))
    return F.coalesce(iso, tweet)


def tidy_label(c: Column) -> Column:
    """Lower case, one spelling for blanks, hyphens and underscores; blank is null."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")
    return F.when(t != "", t)
