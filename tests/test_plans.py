"""Physical-plan properties the design relies on (scan pruning, shuffle
counts, broadcast joins, map-only scoring)."""

import re

from fuzzrule import RuleParams
from fuzzrule.operators.cells import cell_rules
from fuzzrule.operators.mine import resolve_rules
from fuzzrule.operators.prepare import fit_preparer
from fuzzrule.plans import queries as Q

from .conftest import SF01


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _live(plan: str) -> str:
    """Plan text without the subtrees printed under cached relations."""
    out, skip_at = [], None
    for line in plan.split("\n"):
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_at is not None and indent > skip_at:
            continue
        skip_at = None
        out.append(line)
        if "InMemoryRelation" in line:
            skip_at = indent
    return "\n".join(out)


def _hash_exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(", _live(plan)))


def test_cells_scan_pruned_and_one_shuffle(spark):
    L = Q.view(spark, SF01, "L")
    prep = fit_preparer(L, 3, "l_linestatus")
    plan = _plan(cell_rules(prep.transform(L, keep=[]), prep.d, prep.majority))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == sorted(
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"])
    assert _hash_exchanges(plan) == 1
    assert "HashAggregate" in plan


def test_mining_is_one_shuffle_over_broadcast_masks(spark):
    L = Q.view(spark, SF01, "L")
    prep = fit_preparer(L, 3, "l_linestatus")
    cells = cell_rules(prep.transform(L, keep=[]), prep.d, prep.majority).persist()
    cells.count()
    plan = _plan(resolve_rules(cells, prep.d, RuleParams(), prep.majority, complete=False))
    assert "BroadcastNestedLoopJoin" in plan
    assert _hash_exchanges(plan) == 1          # cells are cached: only the resolve shuffle
    cells.unpersist()


def test_scoring_is_map_only(spark):
    m = Q.fit(spark, SF01, "D", block_rules=8)
    assert len(m.blocks) > 1
    plan = _plan(m.transform(Q.SCORE_VIEWS["D"](spark, SF01), keep=["id"]))
    assert "ArrowEvalPython" in plan
    assert "Exchange" not in _live(plan) and "Join" not in _live(plan)


def test_winner_counts_aggregate_partially(spark):
    from fuzzrule.operators.prune import win_counts
    m = Q.fit(spark, SF01, "D")
    scored = m.transform(Q.view(spark, SF01, "D"), keep=[])
    plan = _plan(win_counts(scored))
    assert "partial_count" in plan                 # map-side combine before the shuffle
    assert len(re.findall(r"Exchange hashpartitioning\(rule_id", _live(plan))) == 1


def test_confusion_is_a_global_aggregate(spark):
    from fuzzrule.operators.report import confusion_counts
    m = Q.fit(spark, SF01, "D")
    plan = _plan(confusion_counts(m.transform(Q.view(spark, SF01, "D"), keep=[])))
    assert _hash_exchanges(plan) == 0 and "SinglePartition" in plan
