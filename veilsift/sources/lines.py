"""Lines of text columns as units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import as_units

#: Unicode white space only: nothing to inspect.
HAS_TEXT = r"(?U)\S"


def lines_in(text: Column) -> Column:
    """Lines of a text: split on ``\\n`` only, ``\\r`` stays, a last line without
    newline counts, an empty text has none."""
    trimmed = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, "\n", -1))


def lines_of(df: DataFrame, text: str, source: Column, source_type: str = "file") -> DataFrame:
    """One unit per non-blank line of a string column, batch or streaming."""
    parts = df.select(source.alias("source"), F.posexplode(lines_in(F.col(text))).alias("at", "text"))
    return as_units(
        parts.where(F.col("text").rlike(HAS_TEXT)),
        source_type=source_type,
        source=F.col("source"),
        line=F.col("at") + 1,
        text=F.col("text"),
    )
