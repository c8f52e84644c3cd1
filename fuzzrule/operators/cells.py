"""Cell-rule induction: one rule per occupied label vector (fuzzy grid cell).

The original builds the rules from two filtered group-bys, an inner join
(conflicting cells), two left-anti joins (pure cells) and a union.  Here it
is a single hash aggregate keyed by the label vector with class-conditional
counts and means: one shuffle, with map-side partial aggregation, whose
output is bounded by the number of occupied cells (<= min(rows, n^d)).

Output columns: ``a0..a{d-1}`` (labels, 1..n), ``cls`` (0.0/1.0),
``two_mass`` (both classes present), ``sp1`` (winner count), ``sp2`` (loser
count), ``p1_{j}`` (winner mean), ``p2_{j}`` (loser mean; the winner mean
for pure cells).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzrule.operators.prepare import Y, lcol, zcol


def acol(j: int) -> str:
    return f"a{j}"


def cell_rules(fz: DataFrame, d: int, majority: float) -> DataFrame:
    y = F.col(Y)
    is0, is1 = y == 0, y == 1
    aggs = [F.count_if(is0).alias("cp"), F.count_if(is1).alias("cn")]
    aggs += [F.avg(F.when(is0, F.col(zcol(j)))).alias(f"m0_{j}") for j in range(d)]
    aggs += [F.avg(F.when(is1, F.col(zcol(j)))).alias(f"m1_{j}") for j in range(d)]
    g = fz.groupBy(*[F.col(lcol(j)).alias(acol(j)) for j in range(d)]).agg(*aggs)

    cp, cn = F.col("cp"), F.col("cn")
    # class 0 wins on a larger count, and on a tie when it is the majority class
    win0 = (cp > cn) | ((cp == cn) & F.lit(majority == 0.0))
    pure = (cp == 0) | (cn == 0)
    cols = [F.col(acol(j)) for j in range(d)]
    cols += [
        F.when(win0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("cls"),
        (~pure).alias("two_mass"),
        F.greatest(cp, cn).cast("double").alias("sp1"),
        F.least(cp, cn).cast("double").alias("sp2"),
    ]
    for j in range(d):
        m0, m1 = F.col(f"m0_{j}"), F.col(f"m1_{j}")
        cols.append(F.when(win0, m0).otherwise(m1).alias(f"p1_{j}"))
    for j in range(d):
        m0, m1 = F.col(f"m0_{j}"), F.col(f"m1_{j}")
        cols.append(F.when(pure, F.when(win0, m0).otherwise(m1))
                    .otherwise(F.when(win0, m1).otherwise(m0)).alias(f"p2_{j}"))
    return g.select(*cols)


def support_threshold(n_rows: int, n_cells: int, ths: int) -> int:
    """-1 means automatic: floor((N - 1) / #cell rules)."""
    if ths != -1:
        return int(ths)
    return (n_rows - 1) // max(n_cells, 1)


def support_filter(cells: DataFrame, threshold: int) -> DataFrame:
    """Keep cell rules whose winner count exceeds the threshold."""
    return cells.filter(F.col("sp1") > F.lit(float(threshold)))


def class_majority(fz: DataFrame) -> DataFrame:
    """Class sizes with the majority flag (ties go to class 0.0)."""
    c = fz.agg(F.count_if(F.col(Y) == 0).alias("n0"), F.count_if(F.col(Y) == 1).alias("n1"))
    return c.select(F.inline(F.array(
        F.struct(F.lit(0.0).alias("cls"), F.col("n0").alias("n"),
                 (F.col("n0") >= F.col("n1")).alias("is_majority")),
        F.struct(F.lit(1.0).alias("cls"), F.col("n1").alias("n"),
                 (F.col("n1") > F.col("n0")).alias("is_majority")))))
