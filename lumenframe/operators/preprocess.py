"""Role assignment, frozen preprocessing and input checks.

``TabularPreprocessor.fit`` runs a few aggregation jobs and returns a model that is
plain data; ``transform`` is one select of Catalyst expressions, so it works the same
on one row, on any number of rows and on a stream.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import dates, numeric
from lumenframe.functions.categorical import MISSING, clean_category, gate, is_blank
from lumenframe.operators.profile import (
    code_leftovers,
    col,
    distinct_counts,
    id_like_name,
    is_date,
    is_integer_id,
    is_native,
    normalised,
    plain_columns,
    text_facts,
)

CONTINUOUS, NOMINAL = "continuous", "nominal"
KEEP_HINT = "If it is a real measurement, round or bin it so values repeat and it is kept."
MIN_SHARE_FOR_CODE_HINT = 0.5

ISSUE = "struct<feature:string,value:string,issue:string,training_range:array<string>,parsed_as:string>"


@dataclass
class Settings:
    id_threshold: float = 0.95
    max_cardinality: int = 250
    numeric_share: float = 0.80
    min_rows_for_id: int = 50
    date_share: float = 0.80
    codes: list[str] | None = None


@dataclass
class PreprocessorModel:
    """What a fit has learned; everything is plain data."""

    settings: Settings
    native: list[str] = field(default_factory=list)
    native_dates: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    decimal_comma: list[str] = field(default_factory=list)
    dayfirst: dict[str, bool] = field(default_factory=dict)
    orders: dict[str, str | None] = field(default_factory=dict)
    date_ranges: dict[str, list[str]] = field(default_factory=dict)
    date_parts: dict[str, list[str]] = field(default_factory=dict)
    vocabulary: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, list[float]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @property
    def output_columns(self) -> list[str]:
        return self.numeric + self.categorical + [f"{c}__{p}" for c in self.dates for p in self.date_parts[c]]

    @property
    def feature_types(self) -> dict[str, str]:
        kinds = {p: NOMINAL if nominal else CONTINUOUS for p, nominal in dates.PARTS}
        out = {c: CONTINUOUS for c in self.numeric} | {c: NOMINAL for c in self.categorical}
        return out | {f"{c}__{p}": kinds[p] for c in self.dates for p in self.date_parts[c]}

    @property
    def source_columns(self) -> dict[str, str]:
        return {f"{c}__{p}": c for c in self.dates for p in self.date_parts[c]}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> PreprocessorModel:
        raw = json.loads(text)
        return cls(settings=Settings(**raw.pop("settings")), **raw)

    def _present(self, df: DataFrame, name: str, kind: str) -> Column:
        return col(name) if name in df.columns else F.lit(None).cast(kind)

    def number(self, df: DataFrame, name: str) -> Column:
        """The parsed number, infinities kept."""
        c = self._present(df, name, "string")
        native = name in df.columns and is_native(df.schema[name].dataType)
        return numeric.parse_number(c, native=native, decimal_comma=name in self.decimal_comma, codes=self.settings.codes)

    def timestamp(self, df: DataFrame, name: str) -> Column:
        if name in df.columns and is_date(df.schema[name].dataType):
            return col(name)
        return dates.parse_date(self._present(df, name, "string"), self.dayfirst[name])

    def features(self, df: DataFrame) -> list[Column]:
        """The output columns over a normalised frame."""
        out = [numeric.finite(self.number(df, c)).alias(c) for c in self.numeric]
        out += [gate(clean_category(self._present(df, c, "string")), self.vocabulary[c]).alias(c) for c in self.categorical]
        for c in self.dates:
            ts, start = self.timestamp(df, c), F.to_date(F.lit(self.date_ranges[c][0]))
            for p in self.date_parts[c]:
                value, name = dates.part(ts, p, start), f"{c}__{p}"
                if name in self.vocabulary:
                    value = gate(F.coalesce(value, F.lit(MISSING)), self.vocabulary[name])
                out.append(value.alias(name))
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns and the features, in one select. Columns that are absent are
        missing, columns beyond the training ones are ignored."""
        flat = normalised(df.select(*(col(c) for c in df.columns if c not in (keep or []))))
        if not keep:
            return flat.select(*self.features(flat))
        kept = [c for c in keep if c in df.columns]
        wide = df.select(*(col(c) for c in kept), *plain_columns(df, [c for c in df.columns if c not in kept]))
        return wide.select(*(col(c) for c in kept), *self.features(wide))

    def check_inputs(self, df: DataFrame) -> DataFrame:
        """Add input_warnings (array of ISSUE) and missing_features (array of names)."""
        flat = df.select(*plain_columns(df, df.columns))
        checks, missing = [], []

        def issue(when: Column, feature: str, value: Column, kind: Column, bounds=None, parsed: Column | None = None) -> None:
            limits = F.array(*(F.lit(str(b)) for b in bounds)) if bounds else F.lit(None).cast("array<string>")
            shape = F.struct(
                F.lit(feature).alias("feature"), value.cast("string").alias("value"), kind.alias("issue"), limits.alias("training_range"),
                (parsed if parsed is not None else F.lit(None).cast("string")).alias("parsed_as"),
            )
            checks.append(F.when(F.coalesce(when, F.lit(False)), shape))

        def gone(when: Column, feature: str) -> None:
            missing.append(F.when(F.coalesce(when, F.lit(False)), F.lit(feature)))

        for c in self.numeric:
            raw, x = self._present(flat, c, "string"), numeric.finite(self.number(flat, c))
            gone(x.isNull(), c)
            marker = is_blank(raw) | numeric.is_code(raw, self.settings.codes)
            issue(x.isNull() & ~marker, c, raw, F.lit("unparseable_number"))
            if c in self.ranges:
                low, high = self.ranges[c]
                issue((x < low) | (x > high), c, raw, F.lit("out_of_range"), (low, high))
        for c in self.categorical:
            raw = self._present(flat, c, "string")
            cleaned = clean_category(raw)
            gone(cleaned == MISSING, c)
            issue(~cleaned.isin(*self.vocabulary[c], MISSING), c, raw, F.lit("unseen_category"))
        for c in self.dates:
            raw, ts = self._present(flat, c, "string"), self.timestamp(flat, c)
            gone(ts.isNull(), c)
            issue(ts.isNull() & ~is_blank(raw), c, raw, F.lit("unparseable_date"))
            why = dates.order_issue(raw, self.orders[c])
            issue(ts.isNotNull() & why.isNotNull(), c, raw, why, None, F.to_date(ts).cast("string"))
            low, high = self.date_ranges[c]
            day = F.to_date(ts)
            issue((day < F.to_date(F.lit(low))) | (day > F.to_date(F.lit(high))), c, raw, F.lit("out_of_range"), (low, high))
            for p in self.date_parts[c]:
                name = f"{c}__{p}"
                if name in self.vocabulary:
                    issue(~dates.part(ts, p, F.to_date(F.lit(low))).isin(*self.vocabulary[name]), name, raw, F.lit("unseen_category"))
        none = F.array().cast(f"array<{ISSUE}>")
        flat = flat.select(
            "*",
            (F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else none).alias("input_warnings"),
            (F.filter(F.array(*missing), lambda x: x.isNotNull()) if missing else F.array().cast("array<string>")).alias("missing_features"),
        )
        return flat


class TabularPreprocessor:
    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def fit(self, df: DataFrame) -> PreprocessorModel:
        s = self.settings
        m = PreprocessorModel(settings=s)
        flat = normalised(df)
        kinds = {f.name: f.dataType for f in flat.schema.fields}
        unique = distinct_counts(flat, flat.columns)
        n_rows = flat.count()
        texts = [c for c in flat.columns if not is_native(kinds[c]) and not is_date(kinds[c]) and unique[c] > 1]
        facts = text_facts(flat, texts, s.codes)
        for c in flat.columns:
            if unique[c] <= 1:
                self._drop(m, c, "it is constant (at most one distinct value)")
            elif is_date(kinds[c]):
                self._date(m, flat, c, native=True)
            elif is_native(kinds[c]):
                m.native.append(c)
                if self._id_like(unique[c], n_rows) and is_integer_id(flat, c, col(c).cast("double")):
                    self._drop_id(m, c)
                else:
                    m.numeric.append(c)
            else:
                self._text(m, flat, c, facts[c], unique[c], n_rows)
        self._capture(m, flat)
        return m

    def _drop(self, m: PreprocessorModel, c: str, reason: str, hint: str = "") -> None:
        m.dropped.append(c)
        m.warnings.append(f"Dropped column '{c}': {reason}." + (f" {hint}" if hint else ""))

    def _drop_id(self, m: PreprocessorModel, c: str) -> None:
        self._drop(m, c, "it looks like a row identifier (distinct whole numbers that fill a range, or an ID-like name)", KEEP_HINT)

    def _id_like(self, n_unique: int, n_rows: int) -> bool:
        return n_rows > self.settings.min_rows_for_id and n_unique / n_rows > self.settings.id_threshold

    def _date(self, m: PreprocessorModel, flat: DataFrame, c: str, *, native: bool, dayfirst: bool = False, order: str | None = None) -> None:
        ts = col(c) if native else dates.parse_date(col(c), dayfirst)
        start = flat.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).first()
        ref = F.to_date(F.lit(str(start["lo"])))
        parts = [p for p, _ in dates.PARTS]
        row = flat.agg(*(F.count_distinct(dates.part(ts, p, ref)).alias(p) for p in parts), *(F.collect_set(dates.part(ts, p, ref)).alias(f"v_{p}") for p, nominal in dates.PARTS if nominal)).first()
        kept = [p for p in parts if row[p] > 1]
        if not kept:
            self._drop(m, c, "it is a date column whose derived parts (year, month, day of week, hour, days since start) never vary")
            return
        m.dates.append(c)
        m.dayfirst[c], m.orders[c], m.date_parts[c] = dayfirst, order, kept
        m.date_ranges[c] = [str(start["lo"]), str(start["hi"])]
        for p, nominal in dates.PARTS:
            if nominal and p in kept:
                m.vocabulary[f"{c}__{p}"] = sorted({*row[f"v_{p}"], MISSING})

    def _text(self, m: PreprocessorModel, flat: DataFrame, c: str, f: dict, n_unique: int, n_rows: int) -> None:
        s = self.settings
        dayfirst = f["first_over"] and not f["second_over"]
        parsed = f["date_dmy"] if dayfirst else f["date_mdy"]
        if f["shaped"] >= s.date_share * f["n"] and parsed >= s.date_share * f["n"]:
            if f["first_over"] and f["second_over"]:
                m.warnings.append(f"date column '{c}' mixes day/month and month/day order; month-first is assumed")
            elif not f["first_over"] and not f["second_over"] and f["either"]:
                m.warnings.append(f"date column '{c}' has ambiguous day/month order (every value could be either); month-first is assumed")
            if parsed < f["n"]:
                m.warnings.append(f"date column '{c}' has {f['n'] - parsed} value(s) that are not parseable dates; they are treated as missing")
            self._date(m, flat, c, native=False, dayfirst=dayfirst, order=("dmy" if dayfirst else "mdy") if f["by_number"] else None)
            return
        id_like = self._id_like(n_unique, n_rows)
        if f["eu"] and f["us"]:
            m.warnings.append(
                f"column '{c}' mixes US (1,234.56) and European (1,234.56 as 1.234,56) number formats; a value with both separators is "
                "read by its last one and every other comma is a thousands separator, so '12,5' becomes 125"
            )
        comma = f["eu"] and not f["us"]
        numbers = f["number_eu"] if comma else f["number_us"]
        if f["eligible"] and numbers >= s.numeric_share * f["eligible"]:
            if id_like and is_integer_id(flat, c, numeric.finite(numeric.parse_number(col(c), decimal_comma=comma, codes=s.codes))):
                self._drop_id(m, c)
                return
            if comma:
                m.decimal_comma.append(c)
            if numbers < f["eligible"]:
                self._warn_codes(m, flat, c, comma, blocking=False)
            m.numeric.append(c)
            return
        if numbers < f["eligible"] and numbers:
            self._warn_codes(m, flat, c, comma, blocking=True)
        if id_like:
            self._drop(m, c, f"it looks like an identifier (>{s.id_threshold:.0%} of rows have a unique value)")
        elif n_unique > s.max_cardinality:
            self._drop(m, c, f"it has {n_unique} distinct values, above the {s.max_cardinality} categorical limit")
        else:
            m.categorical.append(c)

    def _warn_codes(self, m: PreprocessorModel, flat: DataFrame, c: str, comma: bool, *, blocking: bool) -> None:
        found = code_leftovers(flat, c, comma, self.settings.codes)
        if found is None or (blocking and found[1] < MIN_SHARE_FOR_CODE_HINT):
            return
        counts, share = found
        given = self.settings.codes
        known = list(numeric.DEFAULT_CODES) if given is None else [given] if isinstance(given, str) else list(given)
        tokens = ", ".join(f"'{t}' x{n}" for t, n in counts)
        confirm = [*known, *(t for t, _ in counts)]
        if blocking:
            m.warnings.append(
                f"column '{c}' is {share:.0%} numbers, below the {self.settings.numeric_share:.0%} numeric threshold, because of repeated "
                f"non-numeric values ({tokens}) that look like missing-value codes; it is not used as a numeric column. If they are codes, "
                f"retrain with suppression_codes={confirm} to read it as numbers"
            )
        else:
            m.warnings.append(
                f"column '{c}' is numeric but has repeated non-numeric values ({tokens}) that look like missing-value codes; they are treated "
                f"as missing. If that is right, retrain with suppression_codes={confirm} to confirm; if they carry meaning, recode them first"
            )

    def _capture(self, m: PreprocessorModel, flat: DataFrame) -> None:
        """Ranges and vocabularies in one job; a vocabulary is bounded by the cardinality limit."""
        aggs = []
        for i, c in enumerate(m.numeric):
            x = m.number(flat, c)
            y = numeric.finite(x)
            aggs.append(F.struct(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_if(F.abs(x) == float("inf")).alias("inf")).alias(f"n{i}"))
        aggs += [F.collect_set(clean_category(col(c))).alias(f"c{i}") for i, c in enumerate(m.categorical)]
        if not aggs:
            return
        row = flat.agg(*aggs).first()
        for i, c in enumerate(m.numeric):
            lo, hi, infinite = row[f"n{i}"]
            if infinite:
                m.warnings.append(f"column '{c}' has {infinite} infinite value(s); they are treated as missing")
            if lo is not None:
                m.ranges[c] = [lo, hi]
        for i, c in enumerate(m.categorical):
            m.vocabulary[c] = sorted({*row[f"c{i}"], MISSING})


__all__ = ["CONTINUOUS", "NOMINAL", "PreprocessorModel", "Settings", "TabularPreprocessor", "id_like_name"]
