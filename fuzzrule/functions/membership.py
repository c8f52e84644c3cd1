"""Fuzzy scalar functions in two forms that give the same doubles:

* Spark ``Column`` expressions (JVM side, whole-stage codegen), used in
  DataFrame plans, and
* numpy kernels, used inside the Arrow-batched scoring UDF.

Both evaluate the triangle as the lower of its rising and falling slope, not
below 0.  Null/NaN parameters give membership 0.  Products of
memberships run in feature order, left to right, so both engines (and the
SQL oracle) multiply the same factors in the same order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fuzzrule.functions.partition import cut_points, width


# ----------------------------------------------------------------- Columns

def label_col(z: Column, n: int) -> Column:
    """Right-closed digitize of a scaled value: number of cut points < z.
    Training values get 1..n; test values outside the range get 0 or n+1."""
    bins = cut_points(n)
    expr = F.when(z <= F.lit(bins[0]), F.lit(0))
    for k, b in enumerate(bins[1:], start=1):
        expr = expr.when(z <= F.lit(b), F.lit(k))
    return expr.when(z.isNotNull(), F.lit(n + 1)).cast("int")


def trimf_col(z: Column, a: Column, b: Column, c: Column) -> Column:
    """The lower of the two slopes, not below 0; a null or NaN gives 0."""
    return F.coalesce(F.greatest(F.nanvl(F.least((z - a) / (b - a), (c - z) / (c - b)), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def triangle_cols(label: Column, n: int) -> tuple[Column, Column, Column]:
    """Triangle (a, b, c) of a 1-based label column."""
    h = F.lit(width(n))
    lab = label.cast("double")
    return ((lab - F.lit(2.0)) * h, (lab - F.lit(1.0)) * h, lab * h)


def antecedent_factor(label: Column, value: Column, n: int,
                      proto: Column | None = None) -> Column:
    """Membership of ``value`` in the label's triangle; 1 when label = 0
    (don't care).  With ``proto`` the triangle is shifted so that its centre
    sits on the prototype coordinate."""
    a, b, c = triangle_cols(label, n)
    if proto is not None:
        tu = proto - b
        a, b, c = a + tu, b + tu, c + tu
    return F.when(label == 0, F.lit(1.0)).otherwise(trimf_col(value, a, b, c))


def matching_degree(labels: list[Column], values: list[Column], n: int,
                    protos: list[Column] | None = None) -> Column:
    """Product of antecedent factors in feature order."""
    factors = [antecedent_factor(l, v, n, None if protos is None else protos[j])
               for j, (l, v) in enumerate(zip(labels, values))]
    return reduce(lambda x, y: x * y, factors)


def round_at(x: Column | str, p: int) -> Column:
    """Round half up at p decimals as floor(x * 10^p + 0.5) / 10^p (the
    original's rounding); NaN and null become 0.0."""
    s = float(10 ** p)
    v = F.nanvl(F.col(x) if isinstance(x, str) else x, F.lit(0.0))
    return F.coalesce(F.floor(v * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s), F.lit(0.0))


# Offset of the report rounding grid: keeps short decimals (means of a few
# decimal inputs) off the rounding boundary, so results that differ only by
# summation order still print the same digits in every engine.
STABLE_OFFSET = 0.5123


def stable_round(x: Column | str, p: int = 6) -> Column:
    """Report rounding, floor(x * 10^p + 0.5123) / 10^p; null stays null."""
    s = float(10 ** p)
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(s) + F.lit(STABLE_OFFSET)).cast("double") / F.lit(s)


# ------------------------------------------------------------------- numpy

def label_np(z: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(np.asarray(cut_points(n)), z, side="left").astype(np.int32)


def trimf_np(z, a, b, c):
    """Vectorised ``trimf_col``; broadcasting over all arguments."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.maximum(np.minimum((z - a) / (b - a), (c - z) / (c - b)), 0.0), nan=0.0)


def membership_table_np(z: np.ndarray, n: int) -> np.ndarray:
    """rows x d x (n+1) memberships; slot 0 is the don't-care factor 1."""
    h = width(n)
    rows, d = z.shape
    out = np.empty((rows, d, n + 1), dtype=np.float64)
    out[:, :, 0] = 1.0
    for k in range(1, n + 1):
        lab = float(k)
        out[:, :, k] = trimf_np(z, (lab - 2.0) * h, (lab - 1.0) * h, lab * h)
    return out
