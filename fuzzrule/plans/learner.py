"""The learning plan and the scoring model.

``learn`` runs prepare -> fuzzify -> cell rules -> [support filter] ->
mine + resolve -> rank filter -> score training rows -> drop rules that
never win -> selection, as one DataFrame lineage with a few explicit
persist points (the fuzzified training table, which is read twice, and the
small rule tables).  The driver only receives scalars (counts, min/max,
index maps) and a rule base of at most ``block_rules`` rules; larger ones are
written as block files that the scoring tasks read.

``RuleModel.transform`` is a projection plus pandas UDFs: no shuffle.
``fuzzrule.ml`` wraps both as ``pyspark.ml`` stages.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.functions.membership import round_at
from fuzzrule.operators.cells import acol, cell_rules, support_filter, support_threshold
from fuzzrule.operators.infer import RuleBlocks, rule_blocks, score
from fuzzrule.operators.mine import complete_prototypes, rank_filter, resolve_rules
from fuzzrule.operators.prepare import Preparer, fit_preparer, lcol, with_own_tables, zcol
from fuzzrule.operators.prune import attach_wins, drop_unused, precision_select, win_counts
from fuzzrule.operators.report import ant_key, metrics_dict, rule_text
from fuzzrule.params import RuleParams
from fuzzrule.session import ensure_checkpoint_dir

_MEM_DISK = StorageLevel.MEMORY_AND_DISK


@dataclass
class FitTrace:
    """Intermediate tables and counts of one fit (for reports and tests)."""

    cells: DataFrame | None = None
    cells_filtered: DataFrame | None = None
    resolved: DataFrame | None = None
    ranked: DataFrame | None = None
    with_wins: DataFrame | None = None
    funnel: list = field(default_factory=list)
    ths_used: int | None = None
    seconds: dict = field(default_factory=dict)
    selection_steps: list = field(default_factory=list)


class RuleModel:
    """A learned rule base plus the preparation it was learned with."""

    def __init__(self, prep: Preparer, params: RuleParams, rules: DataFrame,
                 trace: FitTrace | None = None):
        self.prep = prep
        self.params = params
        self.rules = rules
        self.trace = trace or FitTrace()
        self._blocks: RuleBlocks | None = None

    @property
    def d(self) -> int:
        return self.prep.d

    @property
    def majority(self) -> float:
        return self.prep.majority

    @property
    def n_rules(self) -> int:
        if getattr(self, "_n_rules", None) is None:
            self._n_rules = self.rules.count()
        return self._n_rules

    @property
    def blocks(self) -> RuleBlocks:
        if self._blocks is None:
            self._blocks = rule_blocks(self.rules, self.d, self.params.n_labels, self.majority,
                                       self.params.use_rw, self.params.block_rules)
        return self._blocks

    def prepare(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return self.prep.transform(df, keep=keep)

    def transform(self, df: DataFrame, keep: list[str] | None = None, method: str | None = None,
                  shifted: bool | None = None, out: str = "prediction") -> DataFrame:
        """``keep`` (default: all columns) with ``out``, ``rule_id``, ``md``, and the
        class index ``_y`` where the class column is given.  Rows with a missing
        number are kept; rows with an unseen or null category are left out."""
        method = RuleParams(inference=method).inference if method else self.params.inference
        shifted = self.params.tuning if shifted is None else shifted
        if keep is None:
            keep = [c for c in df.columns]
        prepared = self.prep.transform(df, keep=keep)
        scored = score(prepared, self.blocks, self.d, method, shifted, self.params.no_fire, out)
        return scored.drop(*[c for j in range(self.d) for c in (zcol(j), lcol(j)) if c not in keep])

    def evaluate(self, df: DataFrame, **kw) -> dict:
        return metrics_dict(self.transform(df, keep=[], **kw))

    def rules_report(self) -> DataFrame:
        """Rules with the antecedent key and readable text."""
        txt = rule_text(self.rules, self.prep.feature_names, self.params.n_labels)
        return (self.rules.join(txt.drop("cls"), "rule_id")
                .withColumn("ant_key", ant_key(self.d)).orderBy("rule_id"))

    def release(self) -> None:
        """Drop the cached intermediate tables of the fit (the rule base
        itself is checkpointed and stays usable)."""
        for name in ("cells", "cells_filtered", "resolved", "ranked", "with_wins"):
            df = getattr(self.trace, name, None)
            if df is not None:
                df.unpersist()

    def average_rule_length(self) -> float | None:
        v = self.rules.agg(round_at(F.avg("len"), 2)).first()[0] if self.rules.count() else None
        return None if v is None else float(v)

    # ---------------------------------------------------------- persistence
    def save(self, path: str) -> None:
        spark = self.rules.sparkSession
        meta = {"prep": with_own_tables(spark, self.prep.to_dict(), path), "params": self.params.to_dict()}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/metadata")
        self.rules.write.mode("overwrite").parquet(f"{path}/rules")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RuleModel":
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        prep = Preparer.from_dict(meta["prep"])
        params = RuleParams(**meta["params"])
        return cls(prep, params, spark.read.parquet(f"{path}/rules"))


def _timed(trace: FitTrace, name: str, t0: float) -> float:
    t1 = time.perf_counter()
    trace.seconds[name] = round(t1 - t0, 3)
    return t1


def learn(df: DataFrame, params: RuleParams | None = None, label: str | None = None,
          features: list[str] | None = None, exclude: tuple[str, ...] = ()) -> RuleModel:
    """Fit a rule base on a two-class table (default class = last column)."""
    params = params or RuleParams()
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    trace = FitTrace()
    t = time.perf_counter()

    # The source is read once: only the feature and class columns are kept
    # (column pruning reaches the scan) and persisted; the feature selection,
    # the indexer fit, the min/max pass and both later passes (cells, pruning)
    # reuse them.  With persist_input=False each pass re-scans the
    # (column-pruned) source instead, for sources that are cheaper to re-read
    # than to cache.
    numeric, cats, label = _roles(df, label, features, exclude)
    source = narrow = df.select(*numeric, *cats, label)
    if params.persist_input:
        source = narrow = narrow.persist(_MEM_DISK)
    if params.use_fs:
        from fuzzrule.operators.select import select_features
        chosen = select_features(narrow, numeric + cats, label, params)
        numeric, cats, label = _roles(narrow, label, chosen, ())
        narrow = narrow.select(*numeric, *cats, label)
        t = _timed(trace, "feature_selection", t)
    prep = fit_preparer(narrow, params.n_labels, label, numeric + cats)
    model = _learn(prep, prep.transform(narrow, keep=[], training=True), params, trace, t)
    source.unpersist()
    return model


def learn_prepared(prep, df: DataFrame, params: RuleParams) -> RuleModel:
    """As ``learn``, for rows that a fitted preparation ``prep`` reads as they
    are (scaled features and their labels)."""
    ensure_checkpoint_dir(df.sparkSession)
    trace, t = FitTrace(), time.perf_counter()
    narrow = df.persist(_MEM_DISK) if params.persist_input else df
    model = _learn(prep, prep.transform(narrow, keep=[], training=True), params, trace, t)
    narrow.unpersist()
    return model


def _learn(prep, fz: DataFrame, params: RuleParams, trace: FitTrace, t: float) -> RuleModel:
    d, maj = prep.d, prep.majority
    t = _timed(trace, "prepare", t)

    cells = cell_rules(fz, d, maj).persist(_MEM_DISK)
    n_cells = cells.count()
    trace.funnel.append(("cell_rules", n_cells))
    trace.cells = cells
    if params.use_filtering:
        ths = support_threshold(prep.n_rows, n_cells, params.filtering_ths)
        trace.ths_used = ths
        cells = support_filter(cells, ths)
    trace.cells_filtered = cells
    n_filtered = cells.count() if params.use_filtering else n_cells
    trace.funnel.append(("support_filtered", n_filtered))
    t = _timed(trace, "cells", t)

    resolved = resolve_rules(cells, d, params, maj, complete=False).persist(_MEM_DISK)
    trace.funnel.append(("mined", resolved.count()))
    trace.resolved = resolved
    t = _timed(trace, "mine", t)

    ranked = rank_filter(resolved, d, params).persist(_MEM_DISK)
    n_ranked = ranked.count()
    trace.funnel.append(("rank_filtered", n_ranked))
    trace.ranked = ranked
    t = _timed(trace, "rank", t)

    blocks = rule_blocks(ranked, d, params.n_labels, maj, params.use_rw, params.block_rules, n_ranked)
    scored = score(fz, blocks, d, "winning")
    wins = win_counts(scored)
    with_wins = attach_wins(ranked, wins).persist(_MEM_DISK)
    trace.with_wins = with_wins
    used = drop_unused(with_wins)
    trace.funnel.append(("winning", used.count()))
    t = _timed(trace, "match", t)

    if params.selection == "gm":
        from fuzzrule.operators.gm_select import gm_select
        selected, steps = gm_select(fz, used, d, params, maj)
        trace.selection_steps = steps
    else:
        selected = precision_select(used, params.precision)
    # selected rules keep their rank-list ids: same order, no renumbering pass
    final = complete_prototypes(selected, cells, d, params).checkpoint(eager=True)
    trace.funnel.append(("selected", final.count()))
    _timed(trace, "prune", t)
    return RuleModel(prep, params, final, trace)


def _roles(df, label, features, exclude):
    from fuzzrule.operators.prepare import split_columns
    return split_columns(df, label, features, exclude)


def tree_baseline(train: DataFrame, test: DataFrame, label: str | None = None,
                  features: list[str] | None = None, keep: list[str] | None = None,
                  seed: int = 7):
    """Decision-tree baseline on the same prepared features; returns
    (train predictions, test predictions, train accuracy, test accuracy);
    the last is None for a test table without the class.  Rows with a missing
    feature are not trained on, and not predicted."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    prep = fit_preparer(train, 3, label, features)
    va = VectorAssembler(inputCols=[zcol(j) for j in range(prep.d)], outputCol="features_vec")
    tr = va.transform(prep.transform(train, keep=keep or [], training=True))
    te = va.transform(prep.transform(test, keep=keep or [], training=True))
    dt = DecisionTreeClassifier(labelCol="_y", featuresCol="features_vec", seed=seed).fit(tr)
    ev = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction",
                                           metricName="accuracy")
    ptr, pte = dt.transform(tr), dt.transform(te)
    return ptr, pte, ev.evaluate(ptr), ev.evaluate(pte) if "_y" in pte.columns else None


# the stages are also named here; they import the functions above
from fuzzrule.ml import (CategoricalIndexer, CategoricalIndexerModel, Fuzzifier, FuzzifierModel,  # noqa: E402, F401
                         FuzzyRuleClassifier, FuzzyRuleClassifierModel, PrototypeTuning)
