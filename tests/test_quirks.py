
import pytest
from pyspark.sql import functions as F

from fuzzrule import RuleParams, learn
from fuzzrule.operators.prepare import fit_preparer
from fuzzrule.plans.learner import RuleModel

ROWS = [(0.0, 1.0, 5.0, "a"), (0.1, 1.0, 5.0, "a"), (0.2, 1.0, 5.0, "a"), (0.9, 1.0, 5.0, "b"),
        (1.0, 1.0, 5.0, "b"), (0.8, 1.0, 5.0, "b"), (0.5, 1.0, 5.0, "a"), (0.45, 1.0, 5.0, "b")]
SCHEMA = "x double, k double, c double, y string"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_constant_feature_scales_to_half(small):
    prep = fit_preparer(small, 3)
    z = prep.transform(small, keep=[]).select("_z1", "_z2", "_l1").distinct().collect()
    assert [(r._z1, r._z2, r._l1) for r in z] == [(0.5, 0.5, 2)]


def test_whole_table_tie_majority_is_class0(small):
    prep = fit_preparer(small, 3)
    assert (prep.n_class0, prep.n_class1) == (4, 4)
    assert prep.class_labels == ["a", "b"] and prep.majority == 0.0


def test_null_class_rows_skipped(spark, small):
    extra = spark.createDataFrame([(0.3, 1.0, 5.0, None)], SCHEMA)
    prep = fit_preparer(small.unionByName(extra), 3)
    assert prep.n_rows == 8


def test_three_classes_rejected(spark, small):
    extra = spark.createDataFrame([(0.3, 1.0, 5.0, "c")], SCHEMA)
    with pytest.raises(ValueError, match="two-class"):
        learn(small.unionByName(extra), RuleParams())


def test_two_features_no_length_three(spark):
    df = spark.createDataFrame([(r[0], r[2] * r[0], r[3]) for r in ROWS], "x double, w double, y string")
    m = learn(df, RuleParams())
    assert m.trace.resolved.agg(F.max("len")).first()[0] <= 2
    assert m.rules.count() >= 1


def test_empty_rule_base_predicts_majority(spark, small):
    prep = fit_preparer(small, 3)
    m = learn(small, RuleParams())
    empty = RuleModel(prep, RuleParams(), m.rules.limit(0))
    out = empty.transform(small, keep=[]).select("prediction", "rule_id").distinct().collect()
    assert [(r.prediction, r.rule_id) for r in out] == [(0.0, None)]
    assert empty.average_rule_length() is None


def test_out_of_range_rows(spark, small):
    m = learn(small, RuleParams())
    far = spark.createDataFrame([(50.0, 1.0, 5.0, "b"), (1.3, 1.0, 5.0, "b")], SCHEMA)
    s = m.transform(far, keep=["x"]).orderBy("x").collect()
    # z = 1.3 sits inside the last triangle (support up to 1.5): a rule may fire;
    # z = 50 fires nothing -> majority class, under both inference methods
    assert s[1].rule_id is None and s[1].prediction == 0.0
    agg = m.transform(far, keep=["x"], method="aggregation").orderBy("x").collect()
    assert agg[1].prediction == 0.0
    labs = m.prep.transform(far, keep=["x"]).orderBy("x").select("_l0").collect()
    assert [r._l0 for r in labs] == [4, 4]


def test_no_fire_first_rule_option(spark, small):
    m = learn(small, RuleParams(no_fire="first_rule"))
    rs = m.blocks[0]
    far = spark.createDataFrame([(50.0, 1.0, 5.0, "b")], SCHEMA)
    got = m.transform(far, keep=[], shifted=True).first().prediction
    assert got == rs.cls[0]


def test_missing_numbers(spark, small):
    """One NaN, null or infinite value leaves the fit as it was; such rows are
    scored, with membership 0 for the missing feature."""
    inf = float("inf")
    odd = spark.createDataFrame([(float("nan"), 1.0, 5.0, "b"), (None, 1.0, 5.0, "b"), (inf, 1.0, 5.0, "b"),
                                 (-inf, 1.0, 5.0, "a"), (0.9, None, 5.0, "b")], SCHEMA)
    clean, dirty = learn(small, RuleParams()), learn(small.unionByName(odd), RuleParams())
    assert dirty.prep.mins == clean.prep.mins and dirty.prep.maxs == clean.prep.maxs
    key = lambda m: [tuple(r) for r in m.rules.select("rule_id", "a0", "a1", "a2", "cls", "rw").orderBy("rule_id").collect()]
    assert key(dirty) == key(clean)
    s = clean.transform(odd, keep=["x", "k"]).collect()
    assert len(s) == 5 and all(r.prediction in (0.0, 1.0) for r in s)
    used = {r.rule_id for r in clean.rules.where("a0 <> 0").collect()}
    assert all(r.rule_id not in used for r in s[:4])
    assert [r.x for r in s][2] == inf and not {c for c in clean.transform(odd).columns if c.startswith(("_z", "_l"))}


def test_wide_table(spark):
    """40 features at length 3: no limit on the sub-rules of a cell."""
    cols = ", ".join(f"f{j} double" for j in range(40)) + ", y string"
    df = spark.createDataFrame([tuple(float((j + i) % 3) for j in range(40)) + ("a" if i % 2 else "b",)
                                for i in range(4)], cols)
    m = learn(df, RuleParams(max_length=2))
    assert m.trace.resolved.count() > 780 and m.rules.count() >= 1
    protos = m.rules.select(*[f"proto_{j}" for j in range(40)]).first()
    assert all(v is not None for v in protos)


def test_rescan_instead_of_cache_gives_same_rules(small):
    from fuzzrule.operators.report import ant_key
    a = learn(small, RuleParams())
    b = learn(small, RuleParams(persist_input=False))
    key = [r[0] for r in a.rules.select(ant_key(a.d)).orderBy("rule_id").collect()]
    assert key == [r[0] for r in b.rules.select(ant_key(b.d)).orderBy("rule_id").collect()]
    assert a.trace.funnel == b.trace.funnel
