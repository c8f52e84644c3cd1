"""Evaluation and rule-base reports.

The confusion matrix is one global aggregate (four conditional counts, map
side partial aggregation, one row to the driver); the metrics are column
arithmetic over that row.  Rule reports are aggregates over the (bounded)
rule table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.functions.membership import round_at
from fuzzrule.operators.cells import acol
from fuzzrule.operators.prepare import Y


def confusion_counts(scored: DataFrame, label: str = Y, pred: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return scored.agg(*[F.count_if((y == float(a)) & (p == float(b))).alias(f"c{a}{b}")
                        for a in (0, 1) for b in (0, 1)])


def confusion(scored: DataFrame, label: str = Y, pred: str = "prediction") -> DataFrame:
    """Zero-filled 2x2 matrix as rows (actual, predicted, n)."""
    c = confusion_counts(scored, label, pred)
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(float(a)).alias("actual"), F.lit(float(b)).alias("predicted"),
                 F.col(f"c{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """Accuracy, geometric mean of class recalls and their average, each at
    5 decimals; an absent class makes GM and average 0.0."""
    c00, c01, c10, c11 = (F.col(x).cast("double") for x in ("c00", "c01", "c10", "c11"))
    tpr0 = F.try_divide(c00, c00 + c01)
    tpr1 = F.try_divide(c11, c10 + c11)
    acc = F.try_divide(c00 + c11, c00 + c01 + c10 + c11)
    gm = F.pow(tpr0 * tpr1, F.lit(0.5))
    avg = (tpr0 + tpr1) / F.lit(2.0)
    return c.select(round_at(acc, 5).alias("accuracy"), round_at(gm, 5).alias("gm"),
                    round_at(avg, 5).alias("avg_accuracy"))


def metrics(scored: DataFrame, label: str = Y, pred: str = "prediction") -> DataFrame:
    return metrics_from_counts(confusion_counts(scored, label, pred))


def metrics_dict(scored: DataFrame, label: str = Y, pred: str = "prediction") -> dict:
    row = metrics(scored, label, pred).first()
    return {k: float(row[k]) for k in ("accuracy", "gm", "avg_accuracy")}


def ant_key(d: int):
    """Antecedent as text 'l0|l1|...' (0 = don't care)."""
    return F.concat_ws("|", *[F.col(acol(j)).cast("string") for j in range(d)])


def rule_summary(rules: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Per class: rule count, correct wins, confidence and support range and
    average length; and the four figures (correct wins, wins, support, correct
    wins / support) of the rule with the largest support among ``before``, the
    winning rules before selection (default: ``rules``); ties: smaller id."""
    before = rules if before is None else before
    out = rules.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.sum("n_correct").alias("n_correct"),
        F.sum("n_win").alias("n_win"),
        F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"),
        F.min("sup").alias("min_sup"), F.max("sup").alias("max_sup"),
        F.avg("len").alias("avg_len"))
    top = before.groupBy("cls").agg(F.max(F.struct(
        "sup", (-F.col("rule_id")).alias("r"), "n_correct", "n_win")).alias("t"))
    top = top.select("cls", F.col("t.n_correct").alias("top_correct"), F.col("t.n_win").alias("top_win"),
                     F.col("t.sup").alias("top_sup"),
                     F.try_divide(F.col("t.n_correct").cast("double"), F.col("t.sup")).alias("top_ratio"))
    return out.join(top, "cls", "left")


def rule_funnel(spark: SparkSession, counts: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, s, int(n)) for i, (s, n) in enumerate(counts)],
                                 "step int, stage string, n long")


def rule_text(rules: DataFrame, feature_names: list[str], n_labels: int) -> DataFrame:
    """``IF f IS L2 AND g IS L1 THEN class 0.0`` per rule."""
    parts = [F.when(F.col(acol(j)) != 0,
                    F.concat(F.lit(f"{name} IS L"), F.col(acol(j)).cast("string")))
             for j, name in enumerate(feature_names)]
    text = F.concat(F.lit("IF "), F.concat_ws(" AND ", *parts),
                    F.lit(" THEN class "), F.col("cls").cast("string"))
    return rules.select("rule_id", "cls", text.alias("rule_text"))
