"""Small inputs on many cores, short rows in tasks of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Shuffle rows only when a scan has fewer partitions than there are cores.

    A large table has far more splits than cores and stays free of shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def spread_rows(df: DataFrame, most: int = 50_000) -> DataFrame:
    """Shuffle short rows, each of much work, into tasks of about ``most`` rows.

    A split of a column of keys holds millions of rows, and a row group is never cut, so
    the number of tasks follows the counted rows (parquet footers know them) instead of
    bytes.  Only the columns that are used are shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(df.count() / most)))
