"""Fitting several models on the same split, comparing them, and ablation by feature groups."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.operators.models.registry import registry, score
from latewise.operators.results import best_model, comparison, metrics_record
from latewise.plans.binary import Prepared, materialize
from latewise.sources.tables import spread, to_xy


def _failed(spark, model: str, error: Exception) -> DataFrame:
    text = f"{type(error).__name__}: {error}"
    return spark.createDataFrame([(model, "failed", text)], "model string, status string, error string")


def run_models(
    models: dict, train: DataFrame, test: DataFrame, n_classes: int, names: Iterable[str] | None = None,
    keep: tuple[str, ...] = (), on_error: str = "record",
) -> DataFrame:
    """Fit every model (or the named ones), score the test rows, and return one record per model.

    ``train_time`` covers fitting, scoring and metrics. A model that fails gives a record with its
    whole error and the others go on; ``on_error="raise"`` stops instead. The tables are read again by each model, so hand in
    written ones; estimators hold what they need in a form of their own. The scored rows of a model are written once, and
    all its metrics read them there.
    """
    names = list(models) if names is None else list(names)
    unknown = [n for n in names if n not in models]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}; known are {', '.join(models)}")
    spark = train.sparkSession
    train = spread(train)
    records = None
    for place, name in enumerate(names):
        start = time.perf_counter()
        try:
            model = models[name].fit(train)
            record = metrics_record(materialize(score(model, test, keep), "scored"), n_classes)
            # One row; collected so that the time includes the work and nothing is computed twice.
            values = record.collect()
            record = spark.createDataFrame(values, record.schema).select(
                F.lit(name).alias("model"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), "*"
            )
        except Exception as error:  # noqa: BLE001
            if on_error == "raise":
                raise
            record = _failed(spark, name, error)
        record = record.withColumns({"train_time": F.lit(time.perf_counter() - start), "place": F.lit(place)})
        records = record if records is None else records.unionByName(record, allowMissingColumns=True)
    return records


def run_ablation(
    make_model, table: DataFrame, features: list[str], groups: dict[str, list[str]], label: str,
    n_classes: int = 2, names: Iterable[str] | None = None,
) -> DataFrame:
    """Refit without the columns of each named group and with all of them ("full").

    ``table`` has a ``split`` column; ``make_model`` gives a fresh estimator. Returns one record per
    variant; ``ablation_deltas`` compares them with "full".
    """
    variants = {"full": features, **{f"no_{g}": [c for c in features if c not in set(cols)] for g, cols in groups.items()}}
    names = list(variants) if names is None else list(names)
    unknown = [n for n in names if n not in variants]
    if unknown:
        raise ValueError(f"unknown variants: {', '.join(unknown)}; known are {', '.join(variants)}")
    records = None
    for place, name in enumerate(names):
        cols = variants[name]
        parts = {p: to_xy(table.filter(F.col("split") == p), label, cols) for p in ("train", "test")}
        record = run_models({name: make_model()}, parts["train"], parts["test"], n_classes, on_error="raise")
        record = record.withColumn("place", F.lit(place)).withColumnRenamed("model", "variant")
        records = record if records is None else records.unionByName(record, allowMissingColumns=True)
    return records


def run_study(
    prepared: Prepared, label: str, n_classes: int, names: Iterable[str] | None = None, key: str = "row_key", seed: int = 42
) -> DataFrame:
    """The named models (or all) on a prepared table: its selected, scaled columns, training and test rows.

    Returns the compared metrics of each model and whether it is the best by macro F1.
    """
    parts = {p: to_xy(prepared.part(p), label, prepared.features, keep=[key]) for p in ("train", "test")}
    models = registry(parts["train"].count(), n_classes, key, seed)
    records = run_models(models, parts["train"], parts["test"], n_classes, names, (key,), "raise")
    best = best_model(records).select(F.col("model").alias("best"))
    table = comparison(records)
    return table.join(F.broadcast(best), table["model"] == best["best"], "left").withColumn("best", F.col("best").isNotNull())
