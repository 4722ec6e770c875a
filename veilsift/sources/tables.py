"""Cells of tables as units."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import name_matches
from ..functions.spans import record
from ..functions.texts import shown_row_id
from ..operators.scan import as_units
from ..plans.ordinals import numbered, part_of, place_of, with_offsets
from ..plans.shared import written

_TEXT_TYPES = (T.StringType, T.CharType, T.VarcharType, T.VariantType)


@dataclass(frozen=True)
class TableSpec:
    """A table to scan: listed columns or all text columns, and the key whose value
    locates a row.  ``order_by`` names a unique column that defines row numbers."""

    name: str
    schema: str = "public"
    columns: Sequence[str] = ()
    id_column: str | None = None
    order_by: str | None = None

    @property
    def label(self) -> str:
        return f"{self.schema}.{self.name}"


def quoted(name: str) -> str:
    """A column or table name as an identifier, whatever characters it holds."""
    if not name or "\x00" in name:
        raise ValueError(f"{name!r} cannot name a column or table")
    return "`" + name.replace("`", "``") + "`"


def text_columns(df: DataFrame) -> list[str]:
    """Columns that hold text, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _TEXT_TYPES)]


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(quoted(name))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(column)
    return column.cast("string")


def scan_columns(df: DataFrame, spec: TableSpec, allowed: Iterable[str] = ()) -> list[str]:
    """Columns to read: allowlisted ones are never in the select list."""
    listed = list(spec.columns) or text_columns(df)
    if not listed:
        raise LookupError(f"{spec.label} has no column of text")
    missing = [c for c in listed if c not in df.columns]
    if missing:
        raise LookupError(f"{spec.label} lacks {', '.join(missing)}")
    patterns = list(allowed)
    return [c for c in listed if not name_matches(patterns, f"{spec.label}.{c}", f"{spec.name}.{c}", c)]


def table_allowed(spec: TableSpec, allowed: Iterable[str]) -> bool:
    return name_matches(allowed, spec.label, spec.name)


# ---------------------------------------------------------------- row numbers


def _fingerprint(df: DataFrame) -> Column:
    return F.xxhash64(*[_hashable(df, c) for c in df.columns])


def _hashable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.to_json(F.struct(quoted(name))) if isinstance(kind, (T.MapType, T.VariantType)) else F.col(quoted(name))


def with_row_number(df: DataFrame, key: str, into: str = "row") -> DataFrame:
    """Number rows 1, 2, ... in the order of a unique key, without one global sort.

    Rows are sorted in ranges, offsets of the ranges are a joined table.  Rows alike in the
    key (null ones, say) are ordered by a hash of the row, so that ranges can cut them.
    """
    order = "_order"
    while order in df.columns:
        order += "_"
    hashed = df.withColumn(order, _fingerprint(df))
    return numbered(hashed, F.col(quoted(key)).asc_nulls_first(), F.col(order).asc(), number=into).drop(order)


def with_scan_number(df: DataFrame, into: str = "row") -> DataFrame:
    """Number rows 1, 2, ... in scan order, without a shuffle of rows.

    ``df`` must be a plain scan, whose partitions are the same every time it runs: a
    narrow job without columns counts the rows of each partition, the sums are joined.
    """
    at = "_at"
    while at in df.columns:
        at += "_"
    rows = df.withColumn(at, F.monotonically_increasing_id()).withColumn("part", part_of(at))
    numbers = with_offsets(rows, scan_counts(df))
    return numbers.withColumn(into, F.col("before") + place_of(F.col(at)) + 1).drop(at, "part", "before")


def scan_counts(df: DataFrame) -> DataFrame:
    """``part, n``: rows of each partition of a plain scan, none of its columns read."""
    at = df.select(F.monotonically_increasing_id().alias("at"))
    return at.groupBy(part_of("at").alias("part")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------- cells


def cells_of(
    df: DataFrame, spec: TableSpec, allowed_columns: Iterable[str] = (), source_type: str = "postgres"
) -> DataFrame:
    """One unit per non-empty cell: source ``schema.table.column``, and, where it may be shown, the row's
    key (S11).  Nothing shuffles.

    ``row`` is not yet a number: it is a place in the scan or, with ``order_by``, a hash of the row;
    :func:`with_numbers` turns those of the findings into numbers.
    """
    columns = scan_columns(df, spec, allowed_columns)
    if not columns:
        return as_units(df.limit(0), text=F.lit(""))
    key = spec.id_column
    narrow = _narrow(df, spec, columns)
    row_id = F.lit(None).cast("string")
    if key:
        row_id = shown_row_id(F.col(quoted(key)), df.schema[key].dataType.simpleString())
    cells = F.array(
        *[record(name=F.lit(c), text=_as_text(df, c)) for c in columns]
    )
    at = _fingerprint(narrow) if spec.order_by else F.monotonically_increasing_id()
    # places are those of rows: they come before rows turn into cells
    rows = narrow.select(at.alias("_row"), row_id.alias("row_id"), cells.alias("cells"))
    long = rows.select("_row", "row_id", F.explode("cells").alias("cell"))
    filled = long.where("cell.text is not null and cell.text <> ''")
    return as_units(
        filled,
        source_type=source_type,
        source=F.concat(F.lit(f"{spec.label}."), F.col("cell.name")),
        column_name=F.col("cell.name"),
        row=F.col("_row"),
        row_id=F.col("row_id"),
        text=F.col("cell.text"),
    )


def _narrow(df: DataFrame, spec: TableSpec, columns: Sequence[str]) -> DataFrame:
    needed = list(dict.fromkeys([*columns, *filter(None, [spec.id_column, spec.order_by])]))
    return df.select(*[F.col(quoted(c)) for c in needed])


def with_numbers(
    found: DataFrame, df: DataFrame, spec: TableSpec, allowed_columns: Iterable[str] = ()
) -> tuple[DataFrame, int]:
    """Findings with row numbers from 1, and how many rows the table has: one narrow pass besides the scan.

    Numbers in scan order come from the counts of the partitions; with ``order_by`` the table is sorted in
    ranges and no more than hashes of its rows are written.  Rows that are alike to the last column that
    was read have the same findings, so each number of theirs gets them once.
    """
    if not spec.order_by:
        counts = written(scan_counts(df), "table-counts")
        at = with_offsets(found.withColumn("part", part_of("row")), counts)
        numbers = at.withColumn("row", F.col("before") + place_of(F.col("row")) + 1)
        return numbers.select(*found.columns), counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns = scan_columns(df, spec, allowed_columns)
    rows = _narrow(df, spec, columns)
    hashed = rows.withColumn("row hash", _fingerprint(rows))
    order = (F.col(quoted(spec.order_by)).asc_nulls_first(), F.col("`row hash`").asc())
    ranks = written(numbered(hashed, *order, number="number", keep=("row hash",)), "table-ranks")
    numbers = found.distinct().join(ranks, F.col("row") == F.col("`row hash`")).withColumn("row", F.col("number"))
    return numbers.select(*found.columns), ranks.count()


def _sql_name(*parts: str) -> str:
    return ".".join('"' + quoted(part)[1:-1].replace("``", "`").replace('"', '""') + '"' for part in parts)


def quantile_query(spec: TableSpec, key: str, parts: int) -> str:
    """Least key of each of ``parts`` runs of equal size: the bounds of the reads."""
    column, table = _sql_name(key), _sql_name(spec.schema, spec.name)
    tiles = f"select {column} as k, ntile({int(parts)}) over (order by {column}) as tile from {table} where {column} is not null"
    return f"select min(k) as k from ({tiles}) runs group by tile order by 1"


def _literal(value: object) -> str:
    if isinstance(value, bool) or value is None:
        raise ValueError("a key of that type cannot be cut into ranges")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(key: str, bounds: Sequence[object]) -> list[str]:
    """Conditions that hold for each row exactly once: null keys, keys below the second bound, and so on."""
    column = _sql_name(key)
    cuts = [_literal(b) for b in bounds[1:]]
    if not cuts:
        return []
    inner = [f"{column} >= {low} and {column} < {high}" for low, high in zip(cuts, cuts[1:])]
    return [f"{column} is null or {column} < {cuts[0]}", *inner, f"{column} >= {cuts[-1]}"]


@dataclass(frozen=True)
class Database:
    """Tables of a database through Spark's JDBC source: ``load`` and ``key_of`` for a table source.

    A table with a one-column key is read by ``parts`` tasks, whose conditions come from quantiles of the
    key, ``batch_size`` rows a fetch; one without by one task.
    """

    url: str
    options: Mapping[str, str] = field(default_factory=dict)
    parts: int = 32
    batch_size: int = 1000

    def _query(self, spark: SparkSession, sql: str) -> list:
        return spark.read.format("jdbc").option("url", self.url).option("query", sql).options(**self.options).load().collect()

    def key_of(self, spark: SparkSession, spec: TableSpec) -> str | None:
        """The one primary-key column of a table, or None."""
        names = [r[0] for r in self._query(spark, primary_key_query(spec))]
        return names[0] if len(names) == 1 else None

    def predicates(self, spark: SparkSession, spec: TableSpec) -> list[str]:
        """Conditions of the reads of a table; none without a key."""
        key = spec.order_by or spec.id_column or self.key_of(spark, spec)
        if not key:
            return []
        # at most one bound for each part
        return range_predicates(key, [r[0] for r in self._query(spark, quantile_query(spec, key, self.parts))])

    def load(self, spark: SparkSession, spec: TableSpec) -> DataFrame:
        predicates = self.predicates(spark, spec)
        table = _sql_name(spec.schema, spec.name)
        told = {**self.options, "fetchsize": str(self.batch_size)}
        if predicates:
            return spark.read.jdbc(self.url, table, predicates=predicates, properties=told)
        return spark.read.format("jdbc").option("url", self.url).option("dbtable", table).options(**told).load()


def primary_key_query(spec: TableSpec) -> str:
    """Catalogue query for the columns of a table's primary key (S13); use the answer
    as ``id_column`` only when it is a single column."""
    schema, name = (part.replace("'", "''") for part in (spec.schema, spec.name))
    return (
        "select k.column_name from information_schema.table_constraints c "
        "join information_schema.key_column_usage k "
        "on k.constraint_name = c.constraint_name and k.table_schema = c.table_schema "
        "and k.table_name = c.table_name "
        f"where c.constraint_type = 'PRIMARY KEY' and c.table_schema = '{schema}' and c.table_name = '{name}'"
    )
