"""A small decision tree, learned exactly from binned class histograms.

The baseline beside the rule base: the same prepared features, cut into
``bins`` equal parts of the scaled range.  A level costs one aggregate over
(node, feature, bin) with class counts, at most nodes x features x bins rows;
the splits found so far are an expression, so rows are neither joined nor
moved.  A node takes the split with the lowest Gini impurity (of equal ones the
first feature and bin), and stays a leaf where none lowers its own.

Defined cases: rows with a missing feature are neither learned from nor
predicted; values outside the training range belong to the outer bins; a leaf
with as many rows of both classes predicts class 0.0; an empty table raises
the preparation's error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzrule.operators.prepare import Preparer, Y, fit_preparer, zcol

LEAST_GAIN = 1e-9


def _bin(z: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(z * bins).cast("int")))


@dataclass
class SmallTree:
    """``splits``: (feature, bin) by node, rows up to the bin going to 2 node and
    the others to 2 node + 1; ``leaves``: class counts by node; the root is 1."""

    prep: Preparer
    bins: int
    splits: dict[int, tuple[int, int]]
    leaves: dict[int, tuple[int, int]]

    def node(self) -> Column:
        """The leaf of a prepared row."""
        def below(n: int) -> Column:
            if n not in self.splits:
                return F.lit(n)
            j, b = self.splits[n]
            return F.when(_bin(F.col(zcol(j)), self.bins) <= b, below(2 * n)).otherwise(below(2 * n + 1))
        return below(1)

    def transform(self, df: DataFrame, keep: list[str] | None = None, out: str = "prediction") -> DataFrame:
        rows = self.prep.transform(df, keep=keep or [])
        for j in range(self.prep.d):
            rows = rows.where(F.col(zcol(j)).isNotNull())
        cls = F.lit(0.0)
        for n, (c0, c1) in self.leaves.items():
            cls = F.when(F.col("_node") == n, 0.0 if c0 >= c1 else 1.0).otherwise(cls)
        columns = [*(keep or []), *([Y] if Y in rows.columns else [])]
        return rows.withColumn("_node", self.node()).select(*columns, cls.alias(out))


def _best(hist: dict, d: int, bins: int) -> tuple[int, int] | None:
    """The split of one node from its counts by (feature, bin)."""
    t0, t1 = (sum(hist.get((0, b), (0, 0))[c] for b in range(bins)) for c in (0, 1))
    best, found = (t0 * t0 + t1 * t1) / (t0 + t1) + LEAST_GAIN, None
    for j in range(d):
        l0 = l1 = 0
        for b in range(bins):
            c0, c1 = hist.get((j, b), (0, 0))
            l0, l1 = l0 + c0, l1 + c1
            r0, r1 = t0 - l0, t1 - l1
            if c0 + c1 and r0 + r1:
                score = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
                if score > best:
                    best, found = score, (j, b)
    return found


def fit_tree(df: DataFrame, label: str | None = None, features: list[str] | None = None, exclude: tuple[str, ...] = (),
             depth: int = 3, bins: int = 32) -> SmallTree:
    """At most ``depth`` levels; the driver holds (nodes x features x bins) counts."""
    prep = fit_preparer(df, 3, label, features, exclude)
    rows = prep.transform(df, keep=[], training=True).select(Y, *[zcol(j) for j in range(prep.d)]).persist()
    tree = SmallTree(prep, bins, {}, {})
    for level in range(depth + 1):
        each = F.inline(F.array(*[F.struct(F.lit(j).alias("j"), _bin(F.col(zcol(j)), bins).alias("b")) for j in range(prep.d)]))
        counts = (rows.select(tree.node().alias("node"), Y, each).groupBy("node", "j", "b")
                  .agg(F.count_if(F.col(Y) == 0).alias("c0"), F.count_if(F.col(Y) == 1).alias("c1")).collect())
        nodes: dict[int, dict] = {}
        for r in counts:
            nodes.setdefault(r["node"], {})[r["j"], r["b"]] = (r["c0"], r["c1"])
        tree.leaves = {n: tuple(sum(h.get((0, b), (0, 0))[c] for b in range(bins)) for c in (0, 1)) for n, h in nodes.items()}
        new = {n: s for n, h in nodes.items() if level < depth and (s := _best(h, prep.d, bins))}
        if not new:
            break
        tree.splits.update(new)
    rows.unpersist()
    return tree
