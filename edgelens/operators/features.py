"""Feature columns: category codes and standard scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgelens.session import written


def cluster_input(ht: DataFrame) -> DataFrame:
    """Rows to cluster: all history with a country, counters without NULL."""
    counters = ("request_count", "bytes_total", "threats")
    return ht.where(F.col("country").isNotNull()).select(
        "bucket", "country", *(F.coalesce(c, F.lit(0)).alias(c) for c in counters)
    )


def category_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values with their 0-based place in sorted order.

    The ranking runs over distinct values only.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return values.withColumn(code, F.row_number().over(Window.orderBy(column)) - 1)


def with_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Rows with the code of their category.

    The codes are written first. Their size is then known, so Catalyst can see
    whether it may broadcast them and leave the rows where they are.
    """
    return df.join(written(category_codes(df, column, code), "codes"), column)


def spread(df: DataFrame, columns: list[str]) -> Column:
    """Mean and population deviation of each column, one scalar subquery."""
    return df.agg(
        F.struct(
            *(F.avg(c).alias(f"{c}_mean") for c in columns),
            *(F.stddev_pop(c).alias(f"{c}_std") for c in columns),
        )
    ).scalar()


def z_score(column: str, stats: Column) -> Column:
    """Standard score; a constant column scores 0."""
    mean, std = stats.getField(f"{column}_mean"), stats.getField(f"{column}_std")
    return F.when(std > 0, (F.col(column) - mean) / std).otherwise(F.lit(0.0))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = spread(df, columns)
    return df.withColumns({f"{c}_z": z_score(c, stats) for c in columns})
