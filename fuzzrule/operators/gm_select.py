"""GM-guided rule selection (the alternative to precision selection).

Per class, rules are ranked by n_correct / support.  Thresholds start at
(1 - step) x max and drop by step x max; a class whose previous threshold
was already <= 0 keeps its previous set.  The walk stops when the training
geometric mean (5 decimals) falls, or when both thresholds are negative
(keeping the better of the last two sets).

All thresholds are known up front and the selected sets are nested, so
each rule gets the first step at which it enters.  One pass over the training
rows computes every rule's degree once, keeps the best rule per first step,
and takes the running best over the steps; each batch returns only its
confusion counts per step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzrule.operators.infer import block_degrees, rule_blocks
from fuzzrule.operators.prepare import Y, zcol
from fuzzrule.params import RuleParams


def step_thresholds(max_pos: float | None, max_neg: float | None, rate: float):
    """Per step: (effective pos, effective neg, raw pos, raw neg) thresholds.
    A class whose previous raw threshold was <= 0 keeps its effective
    threshold; None = the class has no rules.  The walk ends once both raw
    thresholds are negative (at most ceil(1/rate) + 2 steps)."""
    cap = int(math.ceil(1.0 / rate)) + 2

    def first(m):
        return None if m is None else m - rate * m

    rp, rn = first(max_pos), first(max_neg)
    ep, en = rp, rn
    out = [(ep, en, rp, rn)]
    for _ in range(cap):
        if (rp is None or rp < 0) and (rn is None or rn < 0):
            break
        nrp = None if rp is None else rp - rate * max_pos
        nrn = None if rn is None else rn - rate * max_neg
        if nrp is not None and nrp + rate * max_pos > 0:
            ep = nrp
        if nrn is not None and nrn + rate * max_neg > 0:
            en = nrn
        rp, rn = nrp, nrn
        out.append((ep, en, rp, rn))
    return out


def _first_step(ratio: np.ndarray, cls: np.ndarray, steps) -> np.ndarray:
    first = np.full(len(ratio), len(steps), dtype=np.int32)
    for i in range(len(steps) - 1, -1, -1):
        tp, tn = steps[i][0], steps[i][1]
        inc = np.zeros(len(ratio), dtype=bool)
        if tp is not None:
            inc |= (cls == 0.0) & (ratio > tp)
        if tn is not None:
            inc |= (cls == 1.0) & (ratio > tn)
        first[inc] = i
    return first


def _gm(c00, c01, c10, c11) -> float:
    t0 = c00 / (c00 + c01) if c00 + c01 else float("nan")
    t1 = c11 / (c10 + c11) if c10 + c11 else float("nan")
    g = math.sqrt(t0 * t1) if not (math.isnan(t0) or math.isnan(t1)) else float("nan")
    return 0.0 if math.isnan(g) else math.floor(g * 1e5 + 0.5) / 1e5


def gm_select(fz: DataFrame, rules: DataFrame, d: int, params: RuleParams, majority: float):
    """Returns (selected rules DataFrame, [(step, gm)]) for rules with wins."""
    spark = fz.sparkSession
    rate = params.step
    ratio = F.try_divide(F.col("n_correct").cast("double"), F.col("sup"))
    mx = {float(r["cls"]): r["m"] for r in rules.groupBy("cls").agg(F.max(ratio).alias("m")).collect()}
    steps = step_thresholds(mx.get(0.0), mx.get(1.0), rate)
    # each rule's ratio goes with its block; a task finds the step it enters at
    read = rule_blocks(rules, d, params.n_labels, majority, params.use_rw, params.block_rules,
                       extra=F.coalesce(ratio, F.lit(0.0))).reader(spark)
    n_steps = len(steps)

    def count(batches):
        c = np.zeros((n_steps, 2, 2), dtype=np.int64)
        for pdf in batches:
            z = pdf[[zcol(j) for j in range(d)]].to_numpy(dtype=np.float64)
            y = pdf[Y].to_numpy().astype(np.int64)
            rows = np.arange(len(z))
            # best degree, its rule id and class, among the rules that enter at a step
            best = np.zeros((n_steps, len(z)))
            rid = np.full((n_steps, len(z)), np.iinfo(np.int64).max)
            cls = np.full((n_steps, len(z)), majority)
            for rs in read():
                first = _first_step(rs.extra, rs.cls, steps)
                for sl, acc in block_degrees(z, rs):
                    for i in np.unique(first[sl][first[sl] < n_steps]):
                        own = np.flatnonzero(first[sl] == i)
                        at = acc[:, own].argmax(axis=1)
                        val = acc[rows, own[at]]
                        up = val > best[i]
                        best[i, up] = val[up]
                        rid[i, up] = rs.rule_id[sl][own[at[up]]]
                        cls[i, up] = rs.cls[sl][own[at[up]]]
            for i in range(n_steps):
                if i:  # the sets are nested: the better of before and now, then the earlier rule
                    keep = (best[i - 1] > best[i]) | ((best[i - 1] == best[i]) & (rid[i - 1] < rid[i]))
                    best[i, keep], rid[i, keep], cls[i, keep] = best[i - 1, keep], rid[i - 1, keep], cls[i - 1, keep]
                np.add.at(c[i], (y, cls[i].astype(np.int64)), 1)
        yield pd.DataFrame({"step": np.arange(n_steps), **{f"c{a}{b}": c[:, a, b] for a in (0, 1) for b in (0, 1)}})

    parts = fz.select(Y, *[zcol(j) for j in range(d)]).mapInPandas(
        count, "step int, c00 long, c01 long, c10 long, c11 long")
    cnt = parts.groupBy("step").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")]).collect()
    gms = {r["step"]: _gm(r["c00"], r["c01"], r["c10"], r["c11"]) for r in cnt}
    chosen = n_steps - 1
    for i in range(1, n_steps):
        if gms.get(i - 1, 0.0) > gms.get(i, 0.0):
            chosen = i - 1
            break
        rp, rn = steps[i][2], steps[i][3]
        if (rp is None or rp < 0) and (rn is None or rn < 0):
            chosen = i
            break
    history = [(i, gms.get(i, 0.0)) for i in range(n_steps)]
    # the chosen step's thresholds as a filter: no table of rules comes back
    tp, tn = steps[chosen][0], steps[chosen][1]
    cond = F.lit(False)
    for c, t in ((0.0, tp), (1.0, tn)):
        if t is not None:
            cond = cond | ((F.col("cls") == c) & (F.coalesce(ratio, F.lit(0.0)) > F.lit(t)))
    sel = rules.filter(cond)
    return sel, history
