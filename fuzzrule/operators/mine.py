"""Sub-rule mining, class-conflict resolution and rank filters.

Every cell rule is expanded to all its sub-rules that keep between
``min_length`` and ``max_length`` antecedents (the others become 0 = don't
care).  The expansion is a join with a broadcast table of feature subsets (at
most sum C(d, L) rows, computed on the driver from d alone), immediately folded
by a hash aggregate, so the expanded rows never hit a shuffle: partial
aggregation runs in the same stage as the expansion and the shuffle carries
at most (#distinct sub-antecedents x partitions) rows.  The number of
distinct sub-antecedents is bounded by sum C(d, L) n^L, independent of the
number of training rows.

``resolve_rules`` fuses the per-(antecedent, class) combine and the
per-antecedent conflict resolution into a single aggregate keyed by the
antecedent alone (class-conditional sums).  A sub-rule carries its own
antecedents and their coordinates only, so its state does not grow with the
table's width; the other prototype coordinates are added by
``complete_prototypes`` for the rules that need them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.functions.membership import matching_degree
from fuzzrule.operators.cells import acol
from fuzzrule.params import RuleParams
from fuzzrule.session import ensure_checkpoint_dir


def subset_masks(d: int, min_len: int, max_len: int) -> list[tuple[int, ...]]:
    out = []
    for k in range(min_len, min(max_len, d) + 1):
        for pos in combinations(range(d), k):
            s = set(pos)
            out.append(tuple(1 if j in s else 0 for j in range(d)))
    return out


def masks_frame(spark: SparkSession, d: int, params: RuleParams) -> DataFrame:
    masks = subset_masks(d, params.min_length, params.max_length)
    schema = ", ".join(f"m{j} int" for j in range(d))
    return spark.createDataFrame(masks, schema)


def _expand(cells: DataFrame, d: int, params: RuleParams) -> DataFrame:
    masks = masks_frame(cells.sparkSession, d, params)
    x = cells.crossJoin(F.broadcast(masks))
    sp1, sp2 = F.col("sp1"), F.col("sp2")
    cols = [(F.col(acol(j)) * F.col(f"m{j}")).alias(acol(j)) for j in range(d)]
    cols += [F.col("cls"), sp1, sp2]
    cols += [(F.col(f"p1_{j}") * sp1).alias(f"w1_{j}") for j in range(d)]
    cols += [(F.col(f"p2_{j}") * sp2).alias(f"w2_{j}") for j in range(d)]
    return x.select(*cols)


def _ratio(num, den):
    return F.try_divide(num, den)


def sub_rules(cells: DataFrame, d: int, params: RuleParams) -> DataFrame:
    """Combined sub-rules per (antecedent, class), before conflict resolution:
    ``s1``/``s2`` summed supports, ``q1_j``/``q2_j`` support-weighted means,
    ``conf`` = ``rw`` = s1 / (s1 + s2), ``n_src`` contributing cells."""
    x = _expand(cells, d, params)
    aggs = [F.sum("sp1").alias("s1"), F.sum("sp2").alias("s2"), F.count(F.lit(1)).alias("n_src")]
    aggs += [F.sum(f"w1_{j}").alias(f"W1_{j}") for j in range(d)]
    aggs += [F.sum(f"w2_{j}").alias(f"W2_{j}") for j in range(d)]
    g = x.groupBy(*[acol(j) for j in range(d)], "cls").agg(*aggs)
    s1, s2 = F.col("s1"), F.col("s2")
    cols = [F.col(acol(j)) for j in range(d)] + [F.col("cls"), s1, s2, F.col("n_src")]
    cols.append(_ratio(s1, s1 + s2).alias("conf"))
    q1 = [_ratio(F.col(f"W1_{j}"), s1) for j in range(d)]
    cols += [q.alias(f"q1_{j}") for j, q in enumerate(q1)]
    cols += [F.when(s2 > 0, _ratio(F.col(f"W2_{j}"), s2))
             .when(F.col("n_src") == 1, q1[j]).alias(f"q2_{j}") for j in range(d)]
    return g.select(*cols)


def _subsets(cells: DataFrame, d: int, params: RuleParams) -> DataFrame:
    """Every cell with every feature subset: ``_feat`` (positions), ``_lab``
    (their labels), class, supports, and the prototypes as arrays."""
    rows = [([j for j in range(d) if m[j]],) for m in subset_masks(d, params.min_length, params.max_length)]
    subsets = cells.sparkSession.createDataFrame(rows, "_feat array<int>")
    x = cells.select("cls", "sp1", "sp2", F.array(*[acol(j) for j in range(d)]).alias("_a"),
                     F.array(*[f"p1_{j}" for j in range(d)]).alias("_p1"),
                     F.array(*[f"p2_{j}" for j in range(d)]).alias("_p2"))
    x = x.crossJoin(F.broadcast(subsets))  # sized by d and the lengths alone
    return x.withColumn("_lab", F.transform("_feat", lambda j: F.col("_a")[j]))


def resolve_rules(cells: DataFrame, d: int, params: RuleParams, majority: float,
                  complete: bool = True) -> DataFrame:
    """One rule per sub-antecedent.  Where both classes claim it, each
    class's prototype is matched against the antecedent; the weight of class
    0 is (m0 - m1) / (m0 + m1) and the class with the positive weight wins.
    |weight| <= tie_eps (or no match at all) is a tie: majority class, RW 0.

    Output: ``a*``, ``cls``, ``rw``, ``sup``, ``conf``, ``s1``, ``s2``,
    ``proto_{j}``, ``len`` (and ``_feat``, ``_lab``, the antecedent as lists).
    Without ``complete``, only a rule's own prototype coordinates are set."""
    n, longest = params.n_labels, min(params.max_length, d)
    x = _subsets(cells, d, params)
    own = range(longest)
    # coordinate t of the subset; null beyond its length
    at = [F.try_element_at("_feat", F.lit(t + 1)) for t in own]
    x = x.select("_feat", "_lab", "cls", "sp1", "sp2",
                 *[(F.col("_p1")[at[t]] * F.col("sp1")).alias(f"w1_{t}") for t in own],
                 *[(F.col("_p2")[at[t]] * F.col("sp2")).alias(f"w2_{t}") for t in own])
    aggs = []
    for c in (0, 1):
        isc = F.col("cls") == float(c)
        aggs += [F.sum(F.when(isc, F.col("sp1"))).alias(f"s1_{c}"),
                 F.sum(F.when(isc, F.col("sp2"))).alias(f"s2_{c}"),
                 F.count_if(isc).alias(f"nc_{c}")]
        aggs += [F.sum(F.when(isc, F.col(f"w{k}_{t}"))).alias(f"W{k}_{c}_{t}") for k in (1, 2) for t in own]
    g = x.groupBy("_feat", "_lab").agg(*aggs)
    for c in (0, 1):
        g = g.withColumns({f"q1_{c}_{t}": _ratio(F.col(f"W1_{c}_{t}"), F.col(f"s1_{c}")) for t in own})
        g = g.withColumns({f"q2_{c}_{t}": F.when(F.col(f"s2_{c}") > 0, _ratio(F.col(f"W2_{c}_{t}"), F.col(f"s2_{c}")))
                           .when(F.col(f"nc_{c}") == 1, F.col(f"q1_{c}_{t}")) for t in own})
    labels = [F.coalesce(F.try_element_at("_lab", F.lit(t + 1)), F.lit(0)) for t in own]
    g = g.withColumns({f"_m{c}": matching_degree(labels, [F.col(f"q1_{c}_{t}") for t in own], n) for c in (0, 1)})
    has0, has1 = F.col("nc_0") > 0, F.col("nc_1") > 0
    both = has0 & has1
    rw0 = _ratio(F.col("_m0") - F.col("_m1"), F.col("_m0") + F.col("_m1"))
    g = g.withColumns({"_both": both, "_rw0": rw0})
    both, rw0 = F.col("_both"), F.col("_rw0")
    g = g.withColumn("_tie", both & (rw0.isNull() | (F.abs(rw0) <= F.lit(params.tie_eps))))
    tie = F.col("_tie")
    g = g.withColumn("_win0", F.when(~both, has0).when(tie, F.lit(majority == 0.0)).otherwise(rw0 > 0))
    win0 = F.col("_win0")

    def pick(name):
        return F.when(win0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))

    s1w, s2w = pick("s1"), pick("s2")
    conf_single = _ratio(s1w, s1w + s2w)
    conf_conflict = _ratio(s1w, F.col("s1_0") + F.col("s1_1"))
    q = "q2" if params.prototype == "second" else "q1"
    proto = F.slice(F.array(*[F.when(win0, F.col(f"{q}_0_{t}")).otherwise(F.col(f"{q}_1_{t}")) for t in own]),
                    F.lit(1), F.size("_feat"))
    rules = g.select(
        "_feat", "_lab", F.map_from_arrays("_feat", "_lab").alias("_ant"), F.map_from_arrays("_feat", proto).alias("_proto"),
        F.when(win0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("cls"),
        F.when(~both, conf_single).when(tie, F.lit(0.0)).otherwise(F.abs(rw0)).alias("rw"),
        s1w.alias("sup"),
        F.when(~both, conf_single).otherwise(conf_conflict).alias("conf"),
        s1w.alias("s1"), s2w.alias("s2"),
        both.alias("conflict"), F.size("_feat").alias("len"))
    rules = rules.select(
        *[F.coalesce(F.try_element_at("_ant", F.lit(j)), F.lit(0)).alias(acol(j)) for j in range(d)],
        "cls", "rw", "sup", "conf", "s1", "s2", "conflict",
        *[F.try_element_at("_proto", F.lit(j)).alias(f"proto_{j}") for j in range(d)], "len", "_feat", "_lab")
    return complete_prototypes(rules, cells, d, params) if complete else rules


def complete_prototypes(rules: DataFrame, cells: DataFrame, d: int, params: RuleParams) -> DataFrame:
    """``rules`` with all d prototype coordinates: the cells of a rule are found
    by its first antecedent (an equi-join of the cells' labels and the given
    rules) and the others checked, then summed per (rule, coordinate)."""
    key = ["_feat", "_lab"]
    own = rules.select(*key, F.col("cls").alias("_cls"), F.try_element_at("_feat", F.lit(1)).alias("_j"),
                       F.try_element_at("_lab", F.lit(1)).alias("_l"))
    x = cells.select("cls", "sp1", "sp2", F.array(*[acol(j) for j in range(d)]).alias("_a"),
                     F.array(*[f"p1_{j}" for j in range(d)]).alias("_p1"), F.array(*[f"p2_{j}" for j in range(d)]).alias("_p2"))
    x = x.select("*", F.posexplode("_a").alias("_at", "_label"))
    x = x.join(own, (F.col("_at") == F.col("_j")) & (F.col("_label") == F.col("_l")) & (F.col("cls") == F.col("_cls")))
    x = x.where(F.forall(F.arrays_zip("_feat", "_lab"), lambda p: F.col("_a")[p["_feat"]] == p["_lab"]))
    long = x.select(*key, "sp1", "sp2", F.posexplode(F.arrays_zip("_p1", "_p2")).alias("j", "p"))
    sums = long.groupBy(*key, "j").agg(
        F.sum("sp1").alias("s1"), F.sum("sp2").alias("s2"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("p._p1") * F.col("sp1")).alias("w1"), F.sum(F.col("p._p2") * F.col("sp2")).alias("w2"))
    q1 = _ratio(F.col("w1"), F.col("s1"))
    q2 = F.when(F.col("s2") > 0, _ratio(F.col("w2"), F.col("s2"))).when(F.col("k") == 1, q1)
    # d entries per rule
    full = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(
        "j", (q2 if params.prototype == "second" else q1).alias("q")))).alias("_proto"))
    rest = [c for c in rules.columns if not c.startswith("proto_")]
    out = rules.select(*rest).join(full, key)
    first = [c for c in rules.columns if c not in key]
    return out.withColumns({f"proto_{j}": F.try_element_at("_proto", F.lit(j)) for j in range(d)}).select(*first)


def _ant_order(d: int):
    return [F.col(acol(j)) for j in range(d)]


def positions(rules: DataFrame, keys: list[str], order: list, parts: int | None = None) -> tuple[DataFrame, dict]:
    """``rules`` with ``_pos``, the 0-based position in ``order`` inside each
    group of ``keys``, and the size of each group (two classes, those and the
    rule lengths, or none: a handful).

    Rules are range-partitioned on the keys and the whole order, so neither a
    group nor rules of one confidence meet in a task; a position is the place in
    the sorted partition plus what the partitions before it hold of the group
    (a row per group and partition on the driver)."""
    spark = rules.sparkSession
    ensure_checkpoint_dir(spark)
    cols = [*[F.col(k) for k in keys], *order]
    parts = parts or max(2, spark.sparkContext.defaultParallelism)
    # written once, so that places and totals see the same bounds
    h = (rules.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
         .withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright("_at", 33).cast("int")
    seen = h.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    sizes: dict = {}
    base = []
    for r in sorted(seen, key=lambda r: r["_part"]):
        group = tuple(r[k] for k in keys)
        base.append((*group, r["_part"], sizes.get(group, 0) - r["first"]))
        sizes[group] = sizes.get(group, 0) + r["n"]
    kinds = "".join(f"{k} {dict(h.dtypes)[k]}, " for k in keys)
    table = spark.createDataFrame(base, f"{kinds}_part int, _base long")
    out = h.withColumn("_part", part).join(F.broadcast(table), [*keys, "_part"])
    return out.withColumn("_pos", F.col("_at") + F.col("_base")).drop("_at", "_part", "_base"), sizes


def _by_group(keys: list[str], values: dict):
    """The value of a row's group as an expression."""
    out = F.lit(0)
    for group, v in values.items():
        same = F.lit(True)
        for k, x in zip(keys, group):
            same = same & (F.col(k) == F.lit(x))
        out = F.when(same, F.lit(v)).otherwise(out)
    return out


def rank_filter_class(rules: DataFrame, d: int) -> DataFrame:
    """Per class, order by (conf, antecedent) ascending and drop the first
    floor(n/2) rules.  The kept rules are a contiguous tail of each class, so
    their ``rule_id`` (position in (class, conf, antecedent) order) follows
    from the same positions without a second pass."""
    ranked, sizes = positions(rules, ["cls"], [F.col("conf"), *_ant_order(d)])
    drop = _by_group(["cls"], {g: n // 2 for g, n in sizes.items()})
    n0 = sizes.get((0.0,), 0)
    rid = (F.col("_pos") - drop) + F.when(F.col("cls") == 1.0, n0 - n0 // 2).otherwise(0)
    return ranked.filter(F.col("_pos") >= drop).withColumn("rule_id", rid.cast("int")).drop("_pos")


def rank_filter_class_length(rules: DataFrame, d: int) -> DataFrame:
    """Per (class, length), order by conf descending (then antecedent) and
    keep positions 0..floor(n/2) (i.e. floor(n/2) + 1 rules, at most n)."""
    keys = ["cls", "len"]
    ranked, sizes = positions(rules, keys, [F.col("conf").desc(), *_ant_order(d)])
    return ranked.filter(F.col("_pos") <= _by_group(keys, {g: n // 2 for g, n in sizes.items()})).drop("_pos")


def rank_filter(rules: DataFrame, d: int, params: RuleParams) -> DataFrame:
    """Rank-filtered rules with ``rule_id`` in (class, conf, antecedent) order."""
    if params.rank_by == "class_length":
        return number_rules(rank_filter_class_length(rules, d), d)
    return rank_filter_class(rules, d)


def number_rules(rules: DataFrame, d: int) -> DataFrame:
    """rule_id = position in (class, conf, antecedent) order; the first rule
    in this order wins ties when scoring."""
    pos, sizes = positions(rules, ["cls"], [F.col("conf"), *_ant_order(d)])
    rid = F.col("_pos") + F.when(F.col("cls") == 1.0, sizes.get((0.0,), 0)).otherwise(0)
    return pos.withColumn("rule_id", rid.cast("int")).drop("_pos")
