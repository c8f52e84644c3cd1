"""One fold of an experiment, end to end: read the fold pair, learn, score
train and test, write the result row(s).

This is the library form of the original's per-fold job (its command line
arguments map onto ``RuleParams`` via ``params.params_from_args``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fuzzrule.operators.report import metrics_dict
from fuzzrule.params import RuleParams
from fuzzrule.plans.learner import RuleModel, learn
from fuzzrule.sources.readers import read_fold
from fuzzrule.sources.sinks import fold_result, save_fold_result


def evaluate_fold(spark: SparkSession, train: DataFrame, test: DataFrame, dataset: str,
                  fold: int, params: RuleParams, label: str | None = None,
                  features: list[str] | None = None) -> tuple[RuleModel, DataFrame]:
    """Learn on ``train``; result rows for the plain scoring and, when
    ``params.tuning``, for prototype-shifted scoring (variant 'tuned')."""
    model = learn(train, params, label, features)
    n_before = len(train.columns) - 1 if features is None else len(features)
    rows = []
    for variant, shifted in (("plain", False), ("tuned", True)):
        if variant == "tuned" and not params.tuning:
            continue
        tr = metrics_dict(model.transform(train, keep=[], shifted=shifted))
        te = metrics_dict(model.transform(test, keep=[], shifted=shifted))
        rows.append(fold_result(spark, dataset, fold, model, tr, te, variant, n_before))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return model, out


def run_fold(spark: SparkSession, base: str, directory: str, name: str, fold: int,
             params: RuleParams, ext: str = "dat", out_path: str | None = None,
             fmt: str = "parquet", k: int = 5) -> DataFrame:
    """Read ``<base>/<dir>/<name>-<k>-<fold>{tra,tst}.<ext>``, evaluate, and
    (if ``out_path``) overwrite this fold's partition of the result table."""
    train, test = read_fold(spark, base, directory, name, fold, ext, k)
    model, res = evaluate_fold(spark, train, test, name, fold, params)
    res = res.persist()
    res.count()
    model.release()
    if out_path is not None:
        save_fold_result(res, out_path, fmt)
    return res
