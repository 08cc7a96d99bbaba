"""The front door: train, predict, explain and the model catalog."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import additive, hyperparameters, importance, leakage, metrics, score, split, validate
from lumenframe.operators.preprocess import NOMINAL, PreprocessorModel, Settings, TabularPreprocessor
from lumenframe.operators.profile import col
from lumenframe.sources import catalog, tabular


@dataclass
class Bundle:
    model: additive.AdditiveModel
    preprocessor: PreprocessorModel
    metadata: dict
    warnings: list[str]


def train(
    df: DataFrame,
    target: str,
    *,
    model_name: str = "model",
    hyperparams: dict | None = None,
    holdout_fraction: float = 0.0,
    holdout_group_column: str | None = None,
    suppression_codes: list[str] | None = None,
) -> Bundle:
    """Validate, split, preprocess, screen for leaks, fit and evaluate. The holdout is
    taken before anything is fitted."""
    checked = validate.validate(df, target)
    if not checked.ok:
        raise ValueError("; ".join(checked.errors))
    params = hyperparameters.resolve(hyperparams)
    classes = validate.class_labels(df, target)
    rows = validate.encode_labels(df, target, classes, into="__y")
    warnings = list(checked.warnings)
    groups = None
    if holdout_group_column is not None and not holdout_fraction:
        warnings.append(f"holdout_group_column '{holdout_group_column}' was ignored because holdout_fraction is 0")
    elif holdout_group_column is not None:
        if holdout_group_column == target or holdout_group_column not in df.columns:
            raise ValueError(f"holdout_group_column '{holdout_group_column}' must be an existing column other than the target")
        split.holdout_size(rows.count(), holdout_fraction)
        groups = split.group_holdout(rows, holdout_group_column, holdout_fraction, y="__y", into="__held")
        rows, warnings = groups.rows, warnings + groups.warnings
    if groups is None:
        rows = split.random_holdout(rows, holdout_fraction, y="__y", into="__held")
    training = rows.filter(~F.col("__held"))
    held = rows.filter(F.col("__held"))
    pre = TabularPreprocessor(Settings(codes=suppression_codes)).fit(training.drop(target, "__y", "__held"))
    if not pre.output_columns:
        raise ValueError("every feature column was dropped: " + " ".join(pre.warnings))
    x = pre.transform(training.drop(target, "__held"), keep=["__y"])
    types = pre.feature_types
    nominal = {f: pre.vocabulary[f] for f, k in types.items() if k == NOMINAL}
    suspects = leakage.find_leaks(x, classes, features=pre.output_columns, categorical=list(nominal), source=pre.source_columns, y="__y")
    began = time.monotonic()
    model = additive.fit(x, classes, continuous=[f for f in pre.output_columns if f not in nominal], nominal=nominal, params=params, y="__y")
    seconds = time.monotonic() - began
    counts = {r["__y"]: r["count"] for r in x.groupBy("__y").count().collect()}
    n = sum(counts.values())
    evaluation = None
    if holdout_fraction:
        scored = score.score(model, pre.transform(held.drop(target, "__held"), keep=["__y"]))
        evaluation = metrics.evaluate(scored, [counts.get(i, 0) / n for i in range(len(classes))], y="__y")
        fitted = score.score(model, x).agg(metrics.log_loss(F.col("__y"), F.col("probability"))).first()[0]
        evaluation |= {"train_log_loss": fitted, "holdout_rows": scored.count()}
        if groups is not None:
            evaluation |= {"holdout_group_column": holdout_group_column, "holdout_groups": groups.holdout_groups, "train_groups": groups.train_groups}
    warnings += pre.warnings + leakage.leak_warnings(suspects, target)
    pairs = sum(t.is_interaction for t in model.terms)
    metadata = {
        "model_name": model_name,
        "target_column": target,
        "target_classes": classes,
        "features": {
            "numeric": pre.numeric,
            "categorical": pre.categorical,
            "date": {c: {"features": [f"{c}__{p}" for p in pre.date_parts[c]], "start_date": pre.date_ranges[c][0]} for c in pre.dates},
        },
        "dropped_columns": pre.dropped,
        "hyperparameters": params,
        "holdout_fraction": holdout_fraction,
        "holdout_group_column": holdout_group_column,
        "evaluation": evaluation,
        "training_rows": n,
        "training_seconds": round(seconds, 2),
        "terms": {"main_effects": len(model.terms) - pairs, "interactions": pairs},
        "created_at": datetime.datetime.now(datetime.UTC).isoformat(),
    }
    return Bundle(model, pre, metadata, warnings)


def explain_rows(bundle: Bundle, df: DataFrame, *, top_n: int = 10) -> DataFrame:
    """The audit of any number of rows: prediction, contributions with the raw inputs, input
    warnings and missing features, all in one plan."""
    pre = bundle.preprocessor
    checked = pre.check_inputs(df)
    raw = {c: col(c).cast("string") for c in pre.numeric + pre.categorical if c in df.columns}
    inputs = checked.select(
        F.struct(*(v.alias(c) for c, v in raw.items())).alias("__raw") if raw else F.struct(F.lit(None).alias("none")).alias("__raw"),
        *(col(c) for c in checked.columns),
    )
    x = pre.transform(inputs, keep=["__raw", "input_warnings", "missing_features"])
    values = {c: F.col("__raw")[c] for c in raw}
    out = score.explain(bundle.model, x, top_n=top_n, values=values)
    return out.withColumn("probabilities", score.probability_map(bundle.model, F.col("probability"))).select(
        "predicted_class", "base", "probabilities", "contributions", "reconstructed", "probability", "additivity_verified", "input_warnings", "missing_features"
    )


class Catalog:
    """Models in a folder, and the operations on them."""

    def __init__(self, spark: SparkSession, root: str | Path | None = None, allowed: list[str | Path] | None = None, max_mb: float = tabular.MAX_MB):
        self.spark, self.root = spark, Path(root or catalog.DEFAULT_ROOT)
        self.allowed = [Path(a) for a in allowed] if allowed else tabular.default_roots()
        self.max_mb = max_mb

    def list_models(self) -> list[dict]:
        return catalog.list_models(self.root)

    def inspect_model(self, model_name: str) -> dict:
        return catalog.load_metadata(self.root, model_name)

    def delete_model(self, model_name: str) -> dict:
        return catalog.delete(self.root, model_name)

    def list_hyperparameters(self) -> list[dict]:
        return hyperparameters.describe_all()

    def load(self, model_name: str) -> Bundle:
        meta, model, pre = catalog.load(self.root, model_name)
        return Bundle(additive.AdditiveModel.from_json(model), PreprocessorModel.from_json(pre), meta, [])

    def train_model(
        self,
        target_column: str,
        model_name: str,
        *,
        csv_path: str | None = None,
        csv_content: str | None = None,
        df: DataFrame | None = None,
        overwrite: bool = False,
        hyperparameters: dict | None = None,
        holdout_fraction: float = 0.2,
        holdout_group_column: str | None = None,
        suppression_codes: list[str] | None = None,
        sheet=None,
        header_rows=None,
    ) -> dict:
        if sum(x is not None for x in (csv_path, csv_content, df)) != 1:
            raise ValueError("give exactly one of csv_path, csv_content and df")
        path = catalog.model_dir(self.root, catalog.check_new_name(model_name))
        if (path / "metadata.json").exists() and not overwrite:
            raise ValueError(f"model '{model_name}' already exists; pass overwrite=True to replace it")
        if csv_path is not None:
            real = tabular.guard_path(csv_path, self.allowed, self.max_mb)
            loaded = tabular.load_table(self.spark, str(real), sheet, header_rows)
        elif sheet is not None or header_rows is not None:
            raise ValueError("sheet and header_rows only apply to spreadsheets")
        else:
            loaded = tabular.LoadedTable(df if df is not None else tabular.read_csv_text(self.spark, csv_content))
        bundle = train(
            loaded.df,
            target_column,
            model_name=model_name,
            hyperparams=hyperparameters,
            holdout_fraction=holdout_fraction,
            holdout_group_column=holdout_group_column,
            suppression_codes=suppression_codes,
        )
        catalog.save(self.root, model_name, bundle.metadata, bundle.model.to_json(), bundle.preprocessor.to_json(), overwrite=overwrite)
        m = bundle.metadata
        result = {k: m[k] for k in ("model_name", "target_column", "target_classes", "hyperparameters", "holdout_fraction", "holdout_group_column", "training_rows", "training_seconds", "terms", "evaluation")}
        result |= {
            "rows_read": loaded.df.count(),
            "features_kept": bundle.preprocessor.output_columns,
            "features_dropped": bundle.preprocessor.dropped,
            "date_columns": {c: d["features"] for c, d in m["features"]["date"].items()},
            "warnings": loaded.warnings + bundle.warnings,
        }
        if loaded.sheet is not None:
            result |= {"sheet": loaded.sheet, "header_rows": loaded.header_rows}
        return result

    def predict(self, model_name: str, features: dict, top_n: int = 10) -> dict:
        """One record: the batch plan over one row."""
        bundle = self.load(model_name)
        row = explain_rows(bundle, record_frame(self.spark, features), top_n=top_n).first().asDict(recursive=True)
        labels = {str(c): c for c in bundle.model.classes}
        row["predicted_class"] = labels[row["predicted_class"]]
        return row

    def predict_frame(self, model_name: str, df: DataFrame, top_n: int = 10) -> DataFrame:
        return explain_rows(self.load(model_name), df, top_n=top_n)

    def explain_model(self, model_name: str, top_n: int = 15, include_shapes: bool = True) -> dict:
        return importance.global_importance(self.load(model_name).model, top_n=top_n, include_shapes=include_shapes)


def record_frame(spark: SparkSession, features: dict) -> DataFrame:
    """A record as a frame; names have to stay unique as text."""
    names = [str(k) for k in features]
    if len(set(names)) < len(names):
        raise ValueError("column names must stay unique as text")
    plain = [v.isoformat() if hasattr(v, "isoformat") else v for v in features.values()]
    # a native number stays one, anything else is text
    values = [float(v) if isinstance(v, (int, float)) else None if v is None else str(v) for v in plain]
    kinds = ["double" if isinstance(v, float) else "string" for v in values]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)) or "`_none` string"
    return spark.createDataFrame([tuple(values) or (None,)], schema)
