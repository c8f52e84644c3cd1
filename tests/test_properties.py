
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fuzzrule import RuleParams, learn
from fuzzrule.functions.membership import label_np, membership_table_np, trimf_np
from fuzzrule.functions.partition import cut_points, triangles
from fuzzrule.operators.cells import cell_rules
from fuzzrule.operators.mine import subset_masks, sub_rules
from fuzzrule.operators.prepare import fit_preparer
from fuzzrule.plans import queries as Q

from .conftest import SF001


@settings(max_examples=200, deadline=None)
@given(st.floats(0.0, 1.0), st.integers(2, 7))
def test_memberships_partition_unity(z, n):
    m = membership_table_np(np.array([[z]]), n)[0, 0, 1:]
    assert m.sum() == pytest.approx(1.0, abs=1e-9)
    lab = int(label_np(np.array([z]), n)[0])
    assert 1 <= lab <= n
    assert m[lab - 1] >= m.max() - 1e-12


def test_partition_values():
    assert cut_points(3) == [-0.1, 0.25, 0.75, 1.1]
    assert triangles(3) == [(-0.5, 0.0, 0.5), (0.0, 0.5, 1.0), (0.5, 1.0, 1.5)]
    # right-closed digitize
    assert list(label_np(np.array([-0.1, 0.0, 0.25, 0.2500001, 0.75, 1.0, 1.2]), 3)) == [0, 1, 1, 2, 2, 3, 4]
    assert trimf_np(np.nan, 0.0, 0.5, 1.0) == 0.0
    with pytest.raises(ValueError):
        cut_points(1)


def test_mask_counts():
    for d in range(1, 7):
        masks = subset_masks(d, 1, 3)
        assert len(masks) == sum(comb(d, k) for k in range(1, min(3, d) + 1))
        assert len(set(masks)) == len(masks)


@pytest.fixture(scope="module")
def lineitem(spark):
    df = Q.view(spark, SF001, "L")
    prep = fit_preparer(df, 3, "l_linestatus")
    return df, prep, prep.transform(df, keep=[]).persist()


def test_cells_cover_all_rows(lineitem):
    df, prep, z = lineitem
    cells = cell_rules(z, prep.d, prep.majority)
    tot = cells.agg(F.sum(F.col("sp1") + F.col("sp2"))).first()[0]
    assert tot == prep.n_rows == df.count()


def test_subrule_support_identity(lineitem):
    df, prep, z = lineitem
    p = RuleParams()
    cells = cell_rules(z, prep.d, prep.majority)
    s = sub_rules(cells, prep.d, p).withColumn(
        "len", sum((F.col(f"a{j}") != 0).cast("int") for j in range(prep.d)))
    cell_sp1 = cells.agg(F.sum("sp1")).first()[0]
    per_len = {r["len"]: r["s"] for r in s.groupBy("len").agg(F.sum("s1").alias("s")).collect()}
    for k in (1, 2, 3):
        assert per_len[k] == comb(prep.d, k) * cell_sp1


def few_dims(spark):
    """Four of the dimensions: narrow enough for rules of length 3."""
    return Q.view(spark, SF001, "E").select("id", "e0", "e1", "e2", "e3", "low")


@pytest.fixture(scope="module")
def emb_model(spark):
    return learn(few_dims(spark), RuleParams(), label="low", exclude=("id",))


def test_rule_weights_and_halving(emb_model):
    res = emb_model.trace.resolved
    assert res.filter(F.abs("rw") > 1.0 + 1e-12).count() == 0
    n_res = {r.cls: r.n for r in res.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rank = {r.cls: r.n for r in emb_model.trace.ranked.groupBy("cls")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    for c, n in n_res.items():
        assert n_rank.get(c, 0) == n - n // 2


def test_wins_account_for_rows(emb_model, spark):
    w = emb_model.trace.with_wins.agg(F.sum("n_win"), F.sum("n_correct")).first()
    n = emb_model.prep.n_rows
    assert w[0] <= n and w[1] <= w[0]
    s = emb_model.transform(few_dims(spark), keep=[])
    assert s.count() == n


def test_partition_count_independent(spark):
    df = few_dims(spark)
    base = None
    for parts in (1, 3, 17):
        m = learn(df.repartition(parts), RuleParams(), label="low", exclude=("id",))
        rows = sorted((r.a0, r.a1, r.a2, r.a3, r.cls, r.n_win) for r in m.rules.collect())
        if base is None:
            base = rows
        assert rows == base


def test_confusion_sums(emb_model, spark):
    from fuzzrule.operators.report import confusion, metrics_dict
    s = emb_model.transform(few_dims(spark), keep=[])
    assert confusion(s).agg(F.sum("n")).first()[0] == emb_model.prep.n_rows
    m = metrics_dict(s)
    assert 0.0 <= m["gm"] <= 1.0 and 0.0 <= m["accuracy"] <= 1.0
