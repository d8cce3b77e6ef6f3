"""Typed reading and writing of delimited files with missing-value tokens."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsurvey.functions.values import (
    parse_date,
    parse_logical,
    parse_number,
    without_tokens,
)

# Letters of a compact column specification.
LETTERS = {
    "c": T.StringType(),
    "f": T.StringType(),
    "n": T.DoubleType(),
    "l": T.BooleanType(),
    "D": T.DateType(),
}
SKIP = "-"
# Quotes inside quoted text are doubled, and a backslash is a character like any other.
QUOTING = {"quote": '"', "escape": '"'}


def snake(name: str) -> str:
    """Column name as used here: lower case, dots as underscores."""
    return name.strip().lower().replace(".", "_")


def compact_schema(spec: str, names: Sequence[str]) -> tuple[T.StructType, list[str]]:
    """Schema of all columns and the names kept, from one letter per column."""
    if len(spec) != len(names):
        raise ValueError(f"{len(spec)} letters for {len(names)} columns")
    unknown = set(spec) - set(LETTERS) - {SKIP}
    if unknown:
        raise ValueError(f"unknown letters {sorted(unknown)}")
    fields = [T.StructField(n, LETTERS.get(s, T.StringType())) for s, n in zip(spec, names)]
    return T.StructType(fields), [n for s, n in zip(spec, names) if s != SKIP]


def parse_col(c: Column | str, kind: T.DataType) -> Column:
    """Text to the given type; text that does not fit becomes NULL."""
    if isinstance(kind, T.StringType):
        return without_tokens(c)
    if isinstance(kind, T.BooleanType):
        return parse_logical(c)
    if isinstance(kind, T.DateType):
        return parse_date(c)
    if isinstance(kind, T.NumericType):
        return parse_number(c).try_cast(kind)
    raise ValueError(f"no reader for {kind}")


def file_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, line``: the first line of every file.

    One small task for each file, which stops reading after its first lines.
    """
    # A session of its own, whose settings give every file one partition.
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 40))
    session.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(batch.slice(0, 1).columns, ["file", "line"])
                return

    lines = session.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.mapInArrow(first, "file string, line string")


def _by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files of each distinct header, in order of their names."""
    found: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(file_headers(spark, path).collect(), key=lambda r: r.file):
        cells = next(csv.reader([r.line.removeprefix("\ufeff")], skipinitialspace=True))
        found.setdefault(tuple(c.strip() for c in cells), []).append(r.file)
    return found


def _raw(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], multi_line: bool, mode: str, check: bool = False, line: str | None = None
) -> DataFrame:
    """All fields as text; with ``check`` every header must have these ``names``; ``line`` keeps malformed lines."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"columnNameOfCorruptRecord": line} if line else {}
    return spark.read.options(columnPruning=mode == "PERMISSIVE" and not line, enforceSchema=not check, **options).csv(
        path,
        schema=schema.add(line, "string") if line else schema,
        header=True,
        nullValue="NA",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        multiLine=multi_line,
        mode=mode,
        **QUOTING,
    )


def _declared(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None, compact: str | None, names: Sequence[str] | None, multi_line: bool
) -> tuple[T.StructType, list[str]]:
    """Schema of all columns and the names kept."""
    if (schema is None) == (compact is None):
        raise ValueError("give either a schema or a compact specification")
    if schema is not None:
        return schema, schema.fieldNames()
    if names is None:
        names = [snake(c) for c in spark.read.csv(path, header=True, multiLine=multi_line, **QUOTING).columns]
    return compact_schema(compact, names)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    compact: str | None = None,
    names: Sequence[str] | None = None,
    multi_line: bool = False,
    lenient: bool = False,
    by_name: bool = False,
) -> DataFrame:
    """Header file with declared types, by schema or by compact specification.

    Columns are taken by position. Fields are scanned as text and converted leniently.
    With ``compact`` the names come from the header unless given. ``multi_line`` allows
    line breaks inside quotes; a file is then read by one task, so it is off by default.
    A line with more or fewer fields than the header is an error; with ``lenient``
    missing fields are NULL, surplus ones are dropped, and only the kept fields are scanned.

    With ``by_name`` columns are found by the header of each file, so that files may have
    them in any order; letters of ``compact`` belong to ``names`` or to the header of the
    first file by name. A header with other, missing or repeated columns is an error that
    names its file. Files with equal headers are one scan. Without files there is no header,
    so ``names`` or ``schema`` must be given for a folder that may be empty.
    """
    mode = "PERMISSIVE" if lenient else "FAILFAST"
    groups = _by_header(spark, path) if by_name else {}
    if groups and names is None:
        names = [snake(c) for c in next(iter(groups))]
    schema, kept = _declared(spark, path, schema, compact, names, multi_line)
    parsed = lambda raw, cells: raw.select(*[parse_col(cells[c], schema[c].dataType).alias(c) for c in kept])
    if not groups:
        return parsed(_raw(spark, path, schema.fieldNames(), multi_line, mode), {c: F.col(f"`{c}`") for c in kept})
    parts = []
    for header, files in groups.items():
        own = [snake(c) for c in header]
        if Counter(own) != Counter(schema.fieldNames()):
            raise ValueError(f"{files[0]}: columns {own} instead of {schema.fieldNames()}")
        raw = _raw(spark, files, header, multi_line, mode, check=True)
        parts.append(parsed(raw, {c: F.col(f"`{h}`") for c, h in zip(own, header)}))
    return reduce(DataFrame.unionAll, parts)


@dataclass(frozen=True)
class Checked:
    """Rows read, and what was wrong with lines and cells: ``file, column, text, reason``."""

    rows: DataFrame
    problems: DataFrame


# What a cell of a type should have been.
EXPECTED = {"double": "a number", "boolean": "a logical value", "date": "a date"}


def read_checked(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    compact: str | None = None,
    names: Sequence[str] | None = None,
) -> Checked:
    """Header file read on past bad lines, which are kept apart.

    A line with more or fewer fields than the header, or with a quote left open, gives no row;
    it is a problem without a column and with the whole line. A cell that does not fit its
    type is NULL in its row, as with :func:`read_table`, and a problem of its column with
    the text of the cell. Missing cells and skipped columns are no problems. Rows and problems are two
    reads of the files.
    """
    schema, kept = _declared(spark, path, schema, compact, names, False)
    line = "_line"
    while line in schema.fieldNames():
        line += "_"
    raw = _raw(spark, path, schema.fieldNames(), False, "PERMISSIVE", line=line)
    cell = {c: F.col(f"`{c}`") for c in kept}
    parsed = {c: parse_col(cell[c], schema[c].dataType) for c in kept}
    wrong = [
        F.when(parsed[c].isNull() & without_tokens(cell[c]).isNotNull(), _problem(F.lit(c), cell[c], F.lit(f"not {_expected(schema[c].dataType)}")))
        for c in kept if not isinstance(schema[c].dataType, T.StringType)
    ]
    # The reader refuses to be asked for lines alone, so a cell is asked for that adds nothing.
    first = F.col(f"`{schema.names[0]}`")
    bad = F.coalesce(F.col(line), F.nullif(first, first))
    whole = F.array(_problem(F.lit(None).cast("string"), bad, _malformed(bad, len(schema))))
    cells = F.array_compact(F.array(*wrong)) if wrong else F.slice(whole, 1, 0)
    found = F.explode(F.when(bad.isNotNull(), whole).otherwise(cells)).alias("p")
    problems = raw.select(F.col("_metadata.file_path").alias("file"), found).select("file", "p.*")
    return Checked(raw.filter(bad.isNull()).select(*[parsed[c].alias(c) for c in kept]), problems)


def _expected(kind: T.DataType) -> str:
    return EXPECTED.get(kind.simpleString(), "a number")


def _problem(column: Column, text: Column, reason: Column) -> Column:
    return F.struct(column.alias("column"), text.alias("text"), reason.alias("reason"))


def _malformed(line: Column, fields: int) -> Column:
    """Why a line is no row."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    found = F.char_length(bare) - F.char_length(F.regexp_replace(bare, ",", "")) + 1
    count = F.concat(F.lit(f"{fields} fields expected, "), found.cast("string"), F.lit(" found"))
    return F.when(F.contains(bare, F.lit('"')), "quote left open").otherwise(count)


def write_table(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] = (),
    fmt: str = "csv",
    na: str = "NA",
    names: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Writes ``df``, NULL as ``na``, columns renamed by ``names``.

    In delimited files whole numbers have no decimal point, whatever their type.
    ``order_by`` sorts by range over all files; leave it empty for large tables
    whose order does not matter. An existing path is an error unless ``mode`` says otherwise.
    """
    if order_by:
        df = df.orderBy(*order_by)
    if names:
        df = df.withColumnsRenamed(dict(names))
    if fmt == "csv":
        plain = [_plain_number(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes]
        df.select(*plain).write.mode(mode).csv(path, header=True, nullValue=na, emptyValue="", **QUOTING)
    else:
        df.write.format(fmt).mode(mode).save(path)


def _plain_number(c: Column, kind: str) -> Column:
    """Text of a number, without a decimal point where it is whole and exactly held."""
    if kind in ("double", "float"):
        whole = (F.abs(c) < (2**53 if kind == "double" else 2**24)) & (c == F.floor(c))
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if kind.startswith("decimal") and not kind.endswith(",0)"):
        # Zeros at the end of the digits after the point.
        return F.regexp_replace(c.cast("string"), "[.]?0+$", "")
    return c


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Code list with columns ``code`` and ``name``; any line ending."""
    return read_table(spark, path, schema=T.StructType().add("code", "string").add("name", "string"))
