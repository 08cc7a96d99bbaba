"""Tables from CSV files, CSV text and spreadsheets."""

from __future__ import annotations

import csv
import io
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.profile import col
from lumenframe.sources import grid

#: Cells that are missing in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
NUMBER = r"^\s*[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[iI]nf(?:inity)?)\s*$"
INTEGER = r"^\s*[-+]?\d{1,18}\s*$"
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")
EXCEL_SUFFIXES = (".xlsx", ".xlsm")
MAX_MB = 200


@dataclass
class LoadedTable:
    df: DataFrame
    sheet: str | None = None
    header_rows: list[int] | None = None
    warnings: list[str] = field(default_factory=list)


def column_names(header: list[str]) -> list[str]:
    """Blank names become Unnamed: N, repeated ones get .1, .2, ..."""
    out: list[str] = []
    for i, raw in enumerate(header):
        name = raw if raw.strip() else f"Unnamed: {i}"
        n, got = 0, name
        while got in out:
            n += 1
            got = f"{name}.{n}"
        out.append(got)
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns with missing tokens as null and wholly numeric or boolean columns
    typed, from one aggregation; white space alone is not missing."""
    bare = df.select(*(F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in df.columns))
    facts = []
    for i, c in enumerate(df.columns):
        v = col(c)
        facts += [F.bool_and(v.rlike(NUMBER)).alias(f"n{i}"), F.bool_and(v.rlike(INTEGER)).alias(f"i{i}"), F.bool_and(v.isin(*BOOLEAN)).alias(f"b{i}"), F.count_if(v.isNull()).alias(f"m{i}")]
    row = bare.agg(*facts).first()
    out = []
    for i, c in enumerate(df.columns):
        v = col(c)
        if row[f"b{i}"] and not row[f"m{i}"]:
            v = F.lower(v) == "true"
        elif row[f"n{i}"]:
            v = F.trim(v).cast("long") if row[f"i{i}"] and not row[f"m{i}"] else F.trim(v).cast("double")
        elif row[f"n{i}"] is None:
            v = v.cast("double")  # nothing but missing
        out.append(v.alias(c))
    return bare.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any path that Spark can read; quoted line feeds and doubled quotes are understood."""
    options = {"multiLine": True, "escape": '"', "inferSchema": False, "nullValue": "\u0000", "emptyValue": ""}
    head = spark.read.options(header=False, **options).csv(path).limit(1).collect()
    if not head:
        raise ValueError("the CSV file is empty")
    names = column_names([v or "" for v in head[0]])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return infer_types(spark.read.options(header=True, enforceSchema=True, **options).schema(schema).csv(path))


def read_csv_text(spark: SparkSession, text: str) -> DataFrame:
    """CSV given as text: parsed on the driver, where it already is."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        raise ValueError("csv_content is empty")
    names = column_names(rows[0])
    body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return infer_types(spark.createDataFrame(body, schema))


def read_cells(spark: SparkSession, cells: list[list], header_rows=None, sheet: str = "sheet") -> LoadedTable:
    """A raw sheet as a table."""
    got = grid.read_grid(cells, header_rows, sheet)
    text = [[None if v is None else ("True" if v is True else "False" if v is False else str(v)) for v in r] for r in got.rows]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in got.names])
    return LoadedTable(infer_types(spark.createDataFrame([tuple(r) for r in text], schema)), sheet, got.header_rows, got.warnings)


def read_excel(spark: SparkSession, path: str, sheet=None, header_rows=None) -> LoadedTable:
    try:
        import openpyxl
    except ImportError:
        raise ValueError("reading spreadsheets needs the optional package openpyxl") from None
    try:
        book = openpyxl.load_workbook(path, data_only=True, read_only=True)
        name = grid.resolve_sheet(book.sheetnames, sheet)
        cells = [list(r) for r in book[name].iter_rows(values_only=True)]
    except ValueError:
        raise
    except Exception:  # whatever the reader raises; its text may hold file content
        raise ValueError("could not read the spreadsheet; it may be damaged or not a spreadsheet") from None
    return read_cells(spark, cells, header_rows, name)


def load_table(spark: SparkSession, path: str, sheet=None, header_rows=None) -> LoadedTable:
    if Path(path).suffix.lower() in EXCEL_SUFFIXES:
        return read_excel(spark, path, sheet, header_rows)
    if sheet is not None or header_rows is not None:
        raise ValueError("sheet and header_rows only apply to spreadsheets")
    return LoadedTable(read_csv(spark, path))


def default_roots() -> list[Path]:
    """Home and the working directory, unless that holds home or is the root."""
    home, here = Path.home().resolve(), Path.cwd().resolve()
    return [home] if here == Path(here.anchor) or here in home.parents else list(dict.fromkeys([home, here]))


def root_warnings(roots: list[Path]) -> list[str]:
    home = Path.home().resolve()
    return [f"allowed directory {r} holds the whole home directory or file system" for r in map(Path.resolve, roots) if r == Path(r.anchor) or r in home.parents]


def guard_path(path: str, roots: list[Path], max_mb: float = MAX_MB) -> Path:
    """A regular CSV or spreadsheet file below an allowed root and of bounded size. What
    lies outside the roots gets one answer, whether it exists or not."""
    given = Path(path).expanduser()
    if given.suffix.lower() not in (".csv", *EXCEL_SUFFIXES):
        raise ValueError("only .csv, .xlsx and .xlsm files can be read")
    real = Path(os.path.realpath(given))
    if not any(real.is_relative_to(Path(os.path.realpath(r))) for r in roots):
        raise ValueError("path is outside the allowed directories")
    if not real.is_file():
        raise ValueError("path is not a regular file")
    if real.stat().st_size > max_mb * 1024 * 1024:
        raise ValueError(f"file is larger than {max_mb:g} MB")
    return real
