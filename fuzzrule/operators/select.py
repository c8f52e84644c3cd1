"""Feature selection: MDLP discretisation and mRMR ranking.

MDLP (Fayyad & Irani, 1993), distributed and exact:

1. one aggregate gives the class histogram per (feature, value);
2. the histogram is range-partitioned on (feature, value) and written once;
   running sums are taken inside each sorted partition, in order, and
   per-partition totals (at most partitions x features rows) give the offsets,
   so no feature is sorted in one task and nothing is shuffled again;
3. only boundary points are kept as candidates: between two neighbouring values
   that hold one and the same class alone no cut can have the lowest entropy;
4. level by level, every open interval takes the candidate cut with the
   lowest class entropy (one pass over the candidates joined to a broadcast
   interval table bounded by features x max_bins) and keeps it when the MDL
   criterion accepts; a feature stops at ``max_bins`` intervals (the best
   gains win when a level would exceed it).

mRMR (Peng, Long & Ding, 2005) on the discretised features: greedy, first
the feature with the largest I(f; class), then each step the feature that
maximises I(f; class) - mean over picked s of I(f; s).  One aggregate over
(feature, bin, feature, bin) counts, the class taken as a further feature,
gives the information of every pair; the greedy steps run on that table of at
most d (d + 1) / 2 numbers.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzrule.operators.prepare import Y, fit_preparer, zcol
from fuzzrule.params import RuleParams

def _entropy(c0, c1):
    n = c0 + c1

    def term(c):
        p = F.try_divide(c.cast("double"), n.cast("double"))
        return F.when(c > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return term(c0) + term(c1)


def value_histogram(df: DataFrame, cols: list[str], label: str = Y) -> DataFrame:
    """(j, v, c0, c1): class counts per distinct value of every feature."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v"), F.col(label).alias("y"))
        for j, c in enumerate(cols)])))
    return (long.filter(F.col("v").isNotNull())
                .groupBy("j", "v").agg(F.count_if(F.col("y") == 0).alias("c0"),
                                       F.count_if(F.col("y") == 1).alias("c1")))


CUMULATIVE = "j int, v double, nv double, cum0 long, cum1 long, boundary boolean"


def _running(offsets):
    """Inclusive prefix counts of one sorted partition, a batch at a time.  The
    last value of a batch waits for the one after it."""
    def run(batches):
        run0, run1, wait = {}, {}, None

        def closed(row, nxt):
            j, v, c0, c1, cum0, cum1 = row
            if nxt is None:
                return (j, v, None, cum0, cum1, False)
            nv, n0, n1 = nxt
            same = (c0 == 0 and n0 == 0) or (c1 == 0 and n1 == 0)
            return (j, v, nv, cum0, cum1, not same)
        pid = None
        for pdf in batches:
            out = []
            for j, v, c0, c1, p in zip(*(pdf[c].tolist() for c in ("j", "v", "c0", "c1", "pid"))):
                pid = p
                if j not in run0:
                    run0[j], run1[j] = offsets.get((pid, j), (0, 0, None))[:2]
                run0[j] += c0
                run1[j] += c1
                if wait is not None:
                    nxt = (v, c0, c1) if wait[0] == j else offsets[(pid, wait[0])][2]
                    out.append(closed(wait, nxt))
                wait = (j, v, c0, c1, run0[j], run1[j])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CUMULATIVE.split(", ")])
        if wait is not None:
            yield pd.DataFrame([closed(wait, offsets[(pid, wait[0])][2])], columns=[c.split()[0] for c in CUMULATIVE.split(", ")])
    return run


def cumulative_histogram(hist: DataFrame, parts: int | None = None) -> DataFrame:
    """(j, v, nv, cum0, cum1, boundary) of every value: inclusive prefix counts in
    value order, the next distinct value (null at a feature's last), and whether
    a cut between the two can be the best of an interval.

    Exact and balanced whatever the value distribution: the histogram is
    range-partitioned on (feature, value) (bounds from a sample, so no partition
    holds much more than its share of distinct values)."""
    spark = hist.sparkSession
    if parts is None:
        parts = max(2, spark.sparkContext.defaultParallelism * 2)
    # written once: totals and running sums see the same bounds, also after a
    # lost executor
    from fuzzrule.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    h = (hist.repartitionByRange(parts, "j", "v").sortWithinPartitions("j", "v")
             .withColumn("pid", F.spark_partition_id()).checkpoint(eager=True))
    totals = h.groupBy("pid", "j").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"),
                                       F.min(F.struct("v", "c0", "c1")).alias("least")).collect()
    offsets, after = {}, {}
    for r in sorted(totals, key=lambda r: (r["j"], -r["pid"])):
        offsets[(r["pid"], r["j"])] = [0, 0, after.get(r["j"])]
        after[r["j"]] = (r["least"]["v"], int(r["least"]["c0"]), int(r["least"]["c1"]))
    before = {}
    for r in sorted(totals, key=lambda r: (r["j"], r["pid"])):
        b0, b1 = before.get(r["j"], (0, 0))
        offsets[(r["pid"], r["j"])][:2] = b0, b1
        before[r["j"]] = (b0 + int(r["s0"]), b1 + int(r["s1"]))
    return h.mapInPandas(_running({k: tuple(v) for k, v in offsets.items()}), CUMULATIVE)


def mdlp_cuts(df: DataFrame, cols: list[str], label: str = Y, max_bins: int = 10,
              parts: int | None = None) -> dict[int, list[float]]:
    """Cut points per feature index (sorted).  The driver holds only the
    interval table (<= features x max_bins rows)."""
    from fuzzrule.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    hist = value_histogram(df, cols, label).persist()
    tot = {r["j"]: (int(r["t0"]), int(r["t1"])) for r in
           hist.groupBy("j").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1")).collect()}
    # every level re-reads the candidates (recomputable from the written
    # range-partitioned histogram)
    cand = cumulative_histogram(hist, parts).filter("boundary").drop("boundary").persist()
    spark = df.sparkSession
    # open intervals: (j, lo value or None, hi value or None, counts before lo, counts through hi)
    intervals = [(j, None, None, 0, 0, tot[j][0], tot[j][1]) for j in sorted(tot)]
    cuts: dict[int, list[float]] = {j: [] for j in range(len(cols))}
    while intervals:
        it = spark.createDataFrame(intervals, "j int, lo double, hi double, b0 long, b1 long, "
                                              "e0 long, e1 long")
        x = cand.join(F.broadcast(it), "j").filter(
            (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) &
            (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))
        l0, l1 = F.col("cum0") - F.col("b0"), F.col("cum1") - F.col("b1")
        r0, r1 = F.col("e0") - F.col("cum0"), F.col("e1") - F.col("cum1")
        n = (F.col("e0") - F.col("b0") + F.col("e1") - F.col("b1")).cast("double")
        e = ((l0 + l1) * _entropy(l0, l1) + (r0 + r1) * _entropy(r0, r1)) / n
        x = x.select("j", "lo", "v", "nv", e.alias("e"), l0.alias("l0"), l1.alias("l1"),
                     r0.alias("r0"), r1.alias("r1"))
        best = (x.groupBy("j", "lo").agg(F.min_by(F.struct("v", "nv", "l0", "l1", "r0", "r1"),
                                                  F.struct("e", "v")).alias("b"))
                 .select("j", "lo", "b.*").collect())
        by_key = {(r["j"], r["lo"]): r for r in best}
        accepted = []
        for (j, lo, hi, b0, b1, e0, e1) in intervals:
            r = by_key.get((j, lo))
            if r is None:
                continue
            gain, ok = _mdl_accepts(e0 - b0, e1 - b1, r["l0"], r["l1"], r["r0"], r["r1"])
            if ok:
                accepted.append((gain, j, lo, hi, b0, b1, e0, e1, r))
        if not accepted:
            break
        nxt = []
        for gain, j, lo, hi, b0, b1, e0, e1, r in sorted(accepted, key=lambda a: (-a[0], a[1])):
            if len(cuts[j]) + 1 >= max_bins:
                continue
            cut = (r["v"] + r["nv"]) / 2.0
            cuts[j].append(cut)
            mid0, mid1 = b0 + r["l0"], b1 + r["l1"]
            nxt.append((j, lo, r["v"], b0, b1, mid0, mid1))
            nxt.append((j, r["v"], hi, mid0, mid1, e0, e1))
        intervals = nxt
    cand.unpersist()
    hist.unpersist()
    return {j: sorted(c) for j, c in cuts.items()}


def _h(c0: int, c1: int) -> float:
    n = c0 + c1
    out = 0.0
    for c in (c0, c1):
        if c > 0:
            p = c / n
            out -= p * math.log2(p)
    return out


def _mdl_accepts(s0, s1, l0, l1, r0, r1) -> tuple[float, bool]:
    # plain ints: numpy booleans would add as logical OR in the class counts
    s0, s1, l0, l1, r0, r1 = (int(x) for x in (s0, s1, l0, l1, r0, r1))
    n = s0 + s1
    if n < 2:
        return 0.0, False
    ent = _h(s0, s1)
    e = ((l0 + l1) * _h(l0, l1) + (r0 + r1) * _h(r0, r1)) / n
    gain = ent - e
    k = (s0 > 0) + (s1 > 0)
    k1 = (l0 > 0) + (l1 > 0)
    k2 = (r0 > 0) + (r1 > 0)
    delta = math.log2(3 ** k - 2) - (k * ent - k1 * _h(l0, l1) - k2 * _h(r0, r1))
    return gain, gain > (math.log2(n - 1) + delta) / n


def discretize(df: DataFrame, cols: list[str], cuts: dict[int, list[float]],
               prefix: str = "_b") -> DataFrame:
    """bin_j = number of cut points below the value (0..len(cuts_j))."""
    out = {}
    for j, c in enumerate(cols):
        expr = F.lit(0)
        for t in cuts.get(j, []):
            expr = expr + (F.col(c) > F.lit(t)).cast("int")
        out[f"{prefix}{j}"] = expr
    return df.withColumns(out)


def mutual_information(df: DataFrame, cols: list[str], other: str) -> DataFrame:
    """(j, mi): I(col_j; other) in bits for every column, from one aggregate
    of (j, a, b) counts and window marginals on that small table."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(j).alias("j"), F.col(c).cast("string").alias("a"),
                 F.col(other).cast("string").alias("b")) for j, c in enumerate(cols)])))
    cnt = long.groupBy("j", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    wj, wa, wb = Window.partitionBy("j"), Window.partitionBy("j", "a"), Window.partitionBy("j", "b")
    n = F.col("n").cast("double")
    tot = F.sum("n").over(wj).cast("double")
    pa = F.sum("n").over(wa).cast("double") / tot
    pb = F.sum("n").over(wb).cast("double") / tot
    pab = n / tot
    return (cnt.select("j", (pab * F.log2(pab / (pa * pb))).alias("t"))
               .groupBy("j").agg(F.sum("t").alias("mi")))


def pair_information(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(j, k, mi), j < k: information in bits of every pair of columns, the
    class being number ``len(cols)``.  One pass; columns hold small integers."""
    d = len(cols)
    bins = F.array(*[F.col(c).cast("int") for c in [*cols, label]])
    pairs = F.expr(f"flatten(transform(sequence(0, {d - 1}), j -> transform(sequence(j + 1, {d}), k -> "
                   "named_struct('j', j, 'k', k, 'a', _bins[j], 'b', _bins[k]))))")
    cnt = df.select(bins.alias("_bins")).select(F.inline(pairs)).groupBy("j", "k", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    pair = Window.partitionBy("j", "k")
    n, tot = F.col("n").cast("double"), F.sum("n").over(pair).cast("double")
    pa = F.sum("n").over(Window.partitionBy("j", "k", "a")).cast("double") / tot
    pb = F.sum("n").over(Window.partitionBy("j", "k", "b")).cast("double") / tot
    pab = n / tot
    return cnt.select("j", "k", (pab * F.log2(pab / (pa * pb))).alias("t")).groupBy("j", "k").agg(F.sum("t").alias("mi"))


def mrmr(df: DataFrame, cols: list[str], label: str, k: int) -> list[int]:
    """Greedy mRMR; returns feature indices in pick order (ties -> lower index)."""
    d = len(cols)
    mi = {(r["j"], r["k"]): float(r["mi"]) for r in pair_information(df, cols, label).collect()}
    chosen: list[int] = []
    red = {j: 0.0 for j in range(d)}
    while len(chosen) < min(k, d):
        left = [j for j in range(d) if j not in chosen]
        score = {j: mi.get((j, d), 0.0) - (red[j] / len(chosen) if chosen else 0.0) for j in left}
        pick = max(left, key=lambda j: (score[j], -j))
        chosen.append(pick)
        for j in left:
            if j != pick:
                red[j] += mi.get((min(j, pick), max(j, pick)), 0.0)
    return chosen


def select_features(df: DataFrame, features: list[str], label: str,
                    params: RuleParams) -> list[str]:
    """MDLP on the scaled features, then mRMR picks ceil(d * rate) of them;
    returns the chosen feature names in their original order."""
    prep = fit_preparer(df, params.n_labels, label, features)
    z = prep.transform(df, keep=[], training=True).persist()
    zc = [zcol(j) for j in range(prep.d)]
    cuts = mdlp_cuts(z, zc, Y, params.mdlp_max_bins)
    binned = discretize(z, zc, cuts).persist()
    k = max(1, math.ceil(len(features) * params.fs))
    order = prep.numeric + prep.categorical
    picks = mrmr(binned, [f"_b{j}" for j in range(prep.d)], Y, k)
    binned.unpersist()
    z.unpersist()
    return [order[j] for j in sorted(picks)]
