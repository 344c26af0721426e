"""What a run says about itself: notes, progress and the outcome of test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE = "array<struct<level: string, message: string>>"


def merged_notes(*notes: Column | str) -> Column:
    """The notes of several sources, one after the other, each level and message once, the first place kept; null is none."""
    given = [F.coalesce(F.col(n) if isinstance(n, str) else n, F.array()).cast(NOTE) for n in notes]
    return F.array_distinct(F.concat(*given))


def progress(done: Column | str, total: Column | str) -> Column:
    """The share that is done, from 0 to 1; of nothing 0."""
    d, t = (F.col(x) if isinstance(x, str) else x for x in (done, total))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(d, t))), F.lit(0.0))


def rollup(cases: DataFrame, status: str = "status") -> DataFrame:
    """One row: n_passed, n_failed, n_skipped and n_total of a table of cases."""
    counted = [F.count_if(F.col(status) == s).cast("long").alias(f"n_{s}") for s in ("passed", "failed", "skipped")]
    return cases.agg(*counted, F.count("*").cast("long").alias("n_total"))
