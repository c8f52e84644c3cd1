"""Rule pruning: win counts, removal of rules that never win, and rule
selection by precision (or by training geometric mean).

All tables here are rule tables (bounded by the rule space); the only pass
over the data is the scoring of the training rows, followed by a
``groupBy(rule_id)`` whose output has at most one row per rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzrule.operators.prepare import Y

# Fixed value (original job): relaxation step of the precision threshold.
RELAX_STEP = 0.1


def win_counts(scored: DataFrame, pred: str = "prediction") -> DataFrame:
    """(rule_id, n_win, n_correct) from rows scored with the winning rule."""
    return (scored.filter(F.col("rule_id").isNotNull())
                  .groupBy("rule_id")
                  .agg(F.count(F.lit(1)).alias("n_win"),
                       F.sum((F.col(pred) == F.col(Y)).cast("long")).alias("n_correct")))


def attach_wins(rules: DataFrame, wins: DataFrame) -> DataFrame:
    """Left join of win counts to rules (0 where a rule never wins)."""
    r = rules.drop("n_win", "n_correct")
    return (r.join(wins, "rule_id", "left")
             .withColumn("n_win", F.coalesce(F.col("n_win"), F.lit(0)).cast("long"))
             .withColumn("n_correct", F.coalesce(F.col("n_correct"), F.lit(0)).cast("long")))


def drop_unused(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("n_win") > 0)


def relaxed_threshold(max_precision: float | None, start: float) -> float | None:
    """Start threshold, lowered by 0.1 until some rule's precision exceeds it."""
    if max_precision is None:
        return None
    t = start
    if max_precision > t:
        return t
    t = start - RELAX_STEP
    while not max_precision > t:
        t = t - RELAX_STEP
    return t


def precision(rules: DataFrame):
    return F.try_divide(F.col("n_correct").cast("double"), F.col("n_win").cast("double"))


def precision_thresholds(rules: DataFrame, start: float) -> dict[float, float | None]:
    mx = {float(r["cls"]): (None if r["p"] is None else float(r["p"]))
          for r in rules.groupBy("cls").agg(F.max(precision(rules)).alias("p")).collect()}
    return {c: relaxed_threshold(mx.get(c), start) for c in (0.0, 1.0)}


def precision_select(rules: DataFrame, start: float) -> DataFrame:
    """Keep, per class, rules with n_correct / n_win above the (relaxed)
    threshold; a class without rules stays empty."""
    th = precision_thresholds(rules, start)
    cond = F.lit(False)
    for c, t in th.items():
        if t is not None:
            cond = cond | ((F.col("cls") == c) & (precision(rules) > F.lit(t)))
    return rules.filter(cond)
