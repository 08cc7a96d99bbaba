"""Column profiles: a fixed, small number of aggregation jobs whatever the width."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import dates, numeric
from lumenframe.functions.categorical import strip

#: Fixed values.
MIN_ID_RANGE_FILL = 0.2
MAX_ID_MAGNITUDE = 2**62
ID_WORDS = frozenset(["id", "ids", "idx", "uuid", "guid", "key", "pk"])
ID_NAMES = frozenset(["index", "rowid", "rownum", "rownumber", "rowindex", "recordid"])
MAX_CODE_TOKENS, MAX_CODE_LENGTH, MIN_CODE_REPEATS = 5, 8, 2


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_native(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def plain_columns(df: DataFrame, names: list[str]) -> list[Column]:
    """Expressions over ``df``: NaN as null, decimals and booleans as double, zoned
    timestamps as UTC wall clock, nested and other values as text."""
    out = []
    for name in names:
        c, kind = col(name), df.schema[name].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c).cast("double")
        elif isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int").cast("double")
        elif is_nested(kind):
            c = F.to_json(c)
        elif isinstance(kind, T.TimestampType):
            c = F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz")
        elif isinstance(kind, T.DateType):
            c = c.cast("timestamp_ntz")
        elif not isinstance(kind, (T.NumericType, T.StringType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(name))
    return out


def normalised(df: DataFrame) -> DataFrame:
    return df.select(*plain_columns(df, df.columns))


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct non-null values per column.

    The frame is unpivoted to (column, value) and grouped twice, which keeps each step a
    combining aggregation; many count-distincts in one aggregation would expand every
    row once per column."""
    if not columns:
        return {}
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(columns)))
    long = df.select(F.explode(pairs).alias("p")).select("p.i", "p.v").filter("v is not null")
    rows = long.groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").count().collect()
    found = {r["i"]: r["count"] for r in rows}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def text_facts(df: DataFrame, columns: list[str], codes) -> dict[str, dict]:
    """All that the role ladder asks of text columns, in one pass."""
    if not columns:
        return {}
    parts = []
    for i, name in enumerate(columns):
        c = col(name)
        a, b = dates.field(c, 1), dates.field(c, 2)
        coded = numeric.is_code(c, codes)
        eligible = c.isNotNull() & ~coded
        facts = {
            "n": F.count(c),
            "shaped": F.count_if(dates.shaped(c)),
            "date_mdy": F.count(dates.parse_date(c, False)),
            "date_dmy": F.count(dates.parse_date(c, True)),
            "first_over": F.coalesce(F.bool_or(a > 12), F.lit(False)),
            "second_over": F.coalesce(F.bool_or(b > 12), F.lit(False)),
            "either": F.coalesce(F.bool_or((a != b) & (F.greatest(a, b) <= 12)), F.lit(False)),
            "by_number": F.count(a),
            "eu": F.coalesce(F.bool_or(numeric.european_evidence(c)), F.lit(False)),
            "us": F.coalesce(F.bool_or(numeric.american_evidence(c)), F.lit(False)),
            "eligible": F.count_if(eligible),
            "number_us": F.count(F.when(eligible, numeric.parse_number(c, codes=codes))),
            "number_eu": F.count(F.when(eligible, numeric.parse_number(c, decimal_comma=True, codes=codes))),
        }
        parts.append(F.struct(*(v.alias(k) for k, v in facts.items())).alias(f"f{i}"))
    row = df.agg(*parts).first()
    return {name: row[f"f{i}"].asDict() for i, name in enumerate(columns)}


def code_leftovers(df: DataFrame, name: str, decimal_comma: bool, codes) -> tuple[list[tuple[str, int]], float] | None:
    """Counts of the values that don't parse, by falling count, and the share of values
    that do; None unless those values are few, short and repeated."""
    c = col(name)
    number = numeric.parse_number(c, decimal_comma=decimal_comma, codes=codes)
    missing = F.lower(numeric.strip_symbols(c)).isin("", "nan", "none") | numeric.is_code(c, codes)
    tokens = df.filter(c.isNotNull() & number.isNull() & ~missing).groupBy(strip(c).alias("t")).count()
    top = tokens.orderBy(F.desc("count"), "t").limit(MAX_CODE_TOKENS + 1).collect()
    if not top or len(top) > MAX_CODE_TOKENS:
        return None
    if any(len(r["t"]) > MAX_CODE_LENGTH or r["count"] < MIN_CODE_REPEATS for r in top):
        return None
    parsed = df.agg(F.count(number)).first()[0]
    counts = [(r["t"], r["count"]) for r in top]
    return counts, parsed / (parsed + sum(n for _, n in counts))


#: A word of a column name: capitals up to the next word, or a small word with at most one.
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])[a-z0-9]*|[A-Z]?[a-z0-9]+")


def id_like_name(name: str) -> bool:
    """Whether a word of a name says that it holds identifiers."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    return not ID_WORDS.isdisjoint(words) or "".join(words) in ID_NAMES


def _gcd_of_steps(values: DataFrame, least: float) -> int:
    """The greatest common divisor of value - least: per partition, then of the parts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        g = 0
        for pdf in batches:
            if len(pdf):
                g = math.gcd(g, int(np.gcd.reduce((pdf["v"] - least).to_numpy().astype("int64"))))
        yield pd.DataFrame({"g": [g]})

    return math.gcd(*(r["g"] for r in values.mapInPandas(run, "g long").distinct().collect()))


def is_integer_id(df: DataFrame, name: str, value: Column) -> bool:
    """Distinct whole numbers that fill at least a fifth of their range in constant
    steps, or that have an ID-like name."""
    v = df.select(value.alias("v")).filter("v is not null")
    s = v.agg(
        F.count("v").alias("n"), F.count_distinct("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.bool_and(F.floor("v") == F.col("v")).alias("whole"), F.max(F.abs("v")).alias("top"),
    ).first()
    if s["n"] < 2 or s["d"] < s["n"] or not s["whole"] or s["top"] >= MAX_ID_MAGNITUDE:
        return False
    if id_like_name(name):
        return True
    step = _gcd_of_steps(v, s["lo"]) or 1
    return s["n"] / ((s["hi"] - s["lo"]) / step + 1) >= MIN_ID_RANGE_FILL


def profile_frame(df: DataFrame) -> DataFrame:
    """(column, n, n_distinct) of every column, by unpivoting; one shuffle of combined rows."""
    flat = normalised(df)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in flat.columns))
    long = flat.select(F.explode(pairs).alias("p")).select("p.column", "p.v")
    values = long.groupBy("column", "v").agg(F.count("v").alias("n"))
    return values.groupBy("column").agg(F.sum("n").alias("n"), F.count("v").alias("n_distinct"))
