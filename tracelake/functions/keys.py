"""Canonical event columns and small column helpers.

A log is a DataFrame with ``case_id string, idx long`` (place in the case, from 0),
``act string, ts timestamp`` and, where known, ``start_ts timestamp, res string``
and further attributes.  Operators order by ``idx``, never by time alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASE, IDX, ACT, TS, START, RES = "case_id", "idx", "act", "ts", "start_ts", "res"


def by_case() -> Window:
    return Window.partitionBy(CASE).orderBy(IDX)


def seconds(c: str | Column) -> Column:
    """Epoch seconds with microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def first_of(c: str) -> Column:
    """The value at a case's first event."""
    return F.min_by(c, IDX)


def last_of(c: str) -> Column:
    return F.max_by(c, IDX)


def traces(log: DataFrame) -> DataFrame:
    """case_id, seq array<string> in order."""
    pairs = F.array_sort(F.collect_list(F.struct(IDX, ACT)))
    return log.groupBy(CASE).agg(F.transform(pairs, lambda x: x[ACT]).alias("seq"))


def kept(log: DataFrame, cases: DataFrame, retain: bool = True) -> DataFrame:
    """The events of the cases that are (or aren't) among ``cases``."""
    return log.join(cases.select(CASE).distinct(), CASE, "left_semi" if retain else "left_anti")
