"""Time filters, row caps and the row-count gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from edgelens.functions import timetext as T

# Analysis window, smallest input of a model run.
WINDOW_DAYS = 7
MIN_ROWS = 5


def open_interval(
    df: DataFrame, time: str, as_of: datetime | str | Column, hours_back: int, cap: int | None = None
) -> DataFrame:
    """Rows strictly between ``as_of`` minus the look-back and ``as_of``."""
    hours = hours_back if cap is None else min(hours_back, cap)
    return df.where(
        (F.col(time) > T.cutoff(as_of, hours=hours)) & (F.col(time) < T.cutoff(as_of))
    )


def rolling_window(
    df: DataFrame, time: str, as_of: datetime | str | Column, days: int = WINDOW_DAYS
) -> DataFrame:
    """Rows at or after ``as_of`` minus ``days``; stored tables also prune by date."""
    start = T.cutoff(as_of, days=days)
    kept = df.where(F.col(time) >= start)
    if "dt" in df.columns:
        kept = kept.where(F.col("dt") >= T.date_of_iso(start))
    return kept


def cap_rows(df: DataFrame, cap: int | None, *order: Column) -> DataFrame:
    """First ``cap`` rows in ``order``; no cap by default anywhere."""
    return df if cap is None else df.orderBy(*order).limit(cap)


def at_least(df: DataFrame, rows: int = MIN_ROWS) -> DataFrame:
    """All rows, or none when there are fewer than ``rows``."""
    return df.where(df.agg(F.count(F.lit(1))).scalar() >= rows)
