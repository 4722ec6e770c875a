"""Small text functions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a key of this form may be shown in a report.
UUID_TEXT = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def _text(column: Column) -> Column:
    return column.cast("string")


def location_text(line: Column, offset: Column, column_name: Column, row: Column, row_id: Column) -> Column:
    """``row 5 id=5 [email]`` or ``12:7 [card]``; ``-`` when nothing is known."""
    with_id = F.when(F.length(row_id) > 0, F.concat(F.lit(" id="), row_id)).otherwise(F.lit(""))
    at = (
        F.when(line.isNotNull() & (offset > 0), F.concat_ws(":", _text(line), _text(offset)))
        .when(line.isNotNull(), _text(line))
        .when(offset.isNotNull() & row.isNull(), F.concat(F.lit(":"), _text(offset)))
    )
    joined = F.concat_ws(
        " ",
        F.concat(F.lit("row "), _text(row), with_id),
        at,
        F.concat(F.lit("["), column_name, F.lit("]")),
    )
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("-"))


def location_long(line: Column, offset: Column, column_name: Column, row: Column, row_id: Column) -> Column:
    """``row 5 (id=5), line 3, column 'email', offset 1``; ``-`` when nothing is known."""
    with_id = F.when(F.length(row_id) > 0, F.concat(F.lit(" (id="), row_id, F.lit(")"))).otherwise(F.lit(""))
    joined = F.concat_ws(
        ", ",
        F.concat(F.lit("row "), _text(row), with_id),
        F.concat(F.lit("line "), _text(line)),
        F.concat(F.lit("column '"), column_name, F.lit("'")),
        F.concat(F.lit("offset "), _text(offset)),
    )
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("-"))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    amount = size.cast("double")

    def shown(unit: str, power: int) -> Column:
        # ties go to the even digit, as in Python and unlike in Java's format
        return F.format_string(f"%.1f {unit}", F.bround(amount / 1024**power, 1))

    return (
        F.when(amount < 1024, F.format_string("%.0f B", amount))
        .when(amount < 1024**2, shown("KB", 1))
        .when(amount < 1024**3, shown("MB", 2))
        .otherwise(shown("GB", 3))
    )


def guard_formula(cell: Column) -> Column:
    """A leading apostrophe where a spreadsheet would run the cell (K3)."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def shown_row_id(key: Column, type_name: str) -> Column:
    """Integer keys and UUIDs may be shown; any other key becomes null."""
    if type_name in ("tinyint", "smallint", "int", "bigint"):
        return key.cast("string")
    if type_name == "string" or type_name.startswith(("varchar", "char")):
        text = key.cast("string")
        return F.when(text.rlike(UUID_TEXT.replace("$", r"\z")), text)
    return F.lit(None).cast("string")
