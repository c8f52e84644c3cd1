"""Result tables: one row per (dataset, method, variant, fold).

The original appended "this fold + all earlier folds" to the file it had
just read (duplicates on disk, order lost).  Here every fold is one
partition of a Parquet (or header CSV) table, written with dynamic
partition overwrite, so re-running a fold replaces exactly its own row and
folds can run in any order or in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.functions.membership import stable_round

RESULT_SCHEMA = (
    "dataset string, method string, variant string, fold int, "
    "train_acc double, test_acc double, train_avg_acc double, test_avg_acc double, "
    "train_gm double, test_gm double, n_labels int, use_rw boolean, use_fs boolean, "
    "fs_rate double, n_features_before int, n_features_after int, use_filter boolean, "
    "ths_used int, n_rules_before long, n_rules_after long, avg_rule_length double, tuning boolean")

PARTITIONS = ["dataset", "method", "variant", "fold"]


def fold_result(spark: SparkSession, dataset: str, fold: int, model, train: dict, test: dict,
                variant: str = "plain", n_features_before: int | None = None) -> DataFrame:
    """One result row from a fitted model and its train/test metrics."""
    p = model.params
    funnel = dict(model.trace.funnel)
    row = (dataset, p.inference, variant, int(fold),
           train["accuracy"], test["accuracy"], train["avg_accuracy"], test["avg_accuracy"],
           train["gm"], test["gm"], p.n_labels, p.use_rw, p.use_fs,
           float(p.fs) if p.use_fs else None,
           n_features_before if p.use_fs else None, model.d if p.use_fs else None,
           p.use_filtering, model.trace.ths_used,
           int(funnel.get("cell_rules", 0)), int(funnel.get("selected", 0)),
           model.average_rule_length(), variant == "tuned")
    return spark.createDataFrame([row], RESULT_SCHEMA)


def save_fold_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*PARTITIONS))
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def read_fold_results(spark: SparkSession, path: str, fmt: str = "parquet",
                      dataset: str | None = None, method: str | None = None) -> DataFrame:
    """All saved folds (partition pruning on dataset / method), by fold."""
    r = spark.read
    if fmt == "csv":
        r = r.option("header", "true").schema(RESULT_SCHEMA)
    df = r.format(fmt).load(path)
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    if method is not None:
        df = df.filter(F.col("method") == method)
    return df.orderBy("dataset", "method", "variant", "fold")


def short_result(df: DataFrame) -> DataFrame:
    """Dataset, fold and train/test accuracy only (baseline report)."""
    return df.select("dataset", "fold", "train_acc", "test_acc")


def describe_folds(df: DataFrame, cols: list[str]) -> DataFrame:
    """count / mean / stddev / min / max of each metric over folds, as
    doubles (one aggregate, then a 5-row unpivot)."""
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.count(x).cast("double").alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                 F.stddev_samp(x).alias(f"stddev__{c}"), F.min(x).alias(f"min__{c}"),
                 F.max(x).alias(f"max__{c}")]
    a = df.agg(*aggs)
    stats = ["count", "mean", "stddev", "min", "max"]
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), *[stable_round(F.col(f"{s}__{c}"), 6).alias(c) for c in cols])
        for s in stats])))
