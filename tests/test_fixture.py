"""Golden values of the toy table (FIXTURES.md section 1)."""

import pytest
from pyspark.sql import functions as F

from fuzzrule import RuleParams, learn
from fuzzrule.operators.report import ant_key, confusion, metrics_dict


def _keys(df, d=3):
    return sorted(r[0] for r in df.select(ant_key(d)).collect())


def test_preparation(toy_model):
    p = toy_model.prep
    assert p.feature_names == ["_1", "_3", "_2_indexed"]
    assert p.cat_labels == [["3", "5", "4", "3.4"]]
    assert p.class_labels == ["N", "Y"]
    assert (p.mins, p.maxs) == ([0.0, 0.0, 0.0], [3.0, 1.0, 3.0])
    assert (p.n_class0, p.n_class1, p.majority) == (12, 8, 0.0)


def test_funnel(toy_model):
    assert toy_model.trace.funnel == [("cell_rules", 7), ("support_filtered", 7), ("mined", 29),
                                      ("rank_filtered", 15), ("winning", 5), ("selected", 5)]
    assert toy_model.average_rule_length() == 1.8


def test_cell_rules(toy_model):
    cells = toy_model.trace.cells
    rows = {r["k"]: r for r in cells.withColumn("k", ant_key(3)).collect()}
    assert sorted(rows) == ["1|3|1", "2|1|2", "2|3|1", "2|3|2", "2|3|3", "3|1|2", "3|3|2"]
    r = rows["1|3|1"]
    assert (r.cls, r.sp1, r.sp2, r.two_mass) == (0.0, 5.0, 2.0, True)
    assert [round(r[f"p1_{j}"], 4) for j in range(3)] == [0.0133, 1.0, 0.0]
    assert [round(r[f"p2_{j}"], 4) for j in range(3)] == [0.0, 1.0, 0.0]
    tie = rows["3|1|2"]
    assert (tie.cls, tie.sp1, tie.sp2) == (0.0, 1.0, 1.0)
    pure = rows["2|3|3"]
    assert (pure.cls, pure.sp2, pure.two_mass) == (0.0, 0.0, False)
    assert [pure[f"p2_{j}"] for j in range(3)] == [pure[f"p1_{j}"] for j in range(3)]


def test_support_filter(toy):
    m = learn(toy[0], RuleParams(use_filtering=True))
    assert m.trace.ths_used == 2
    assert _keys(m.trace.cells_filtered) == ["1|3|1", "2|1|2", "3|3|2"]


def test_conflicts(toy_model):
    res = {r["k"]: r for r in toy_model.trace.resolved.withColumn("k", ant_key(3)).collect()}
    assert len(res) == 29
    assert sum(1 for r in res.values() if r.cls == 0.0) == 22
    assert res["0|0|2"].cls == 1.0 and res["0|0|2"].rw == pytest.approx(0.111111, abs=1e-6)
    assert res["0|1|0"].cls == 0.0 and res["0|1|0"].rw == 0.0          # exact tie -> majority
    assert res["0|1|2"].cls == 0.0 and res["0|1|2"].rw == 0.0          # tie band (noise)
    assert res["0|3|0"].cls == 1.0 and res["0|3|0"].rw == pytest.approx(0.052632, abs=1e-6)
    assert res["2|0|0"].cls == 0.0 and res["2|0|0"].rw == pytest.approx(0.090909, abs=1e-6)
    assert res["2|3|0"].conf == pytest.approx(2 / 3)


def test_rank_filter(toy_model):
    r = toy_model.trace.ranked.withColumn("k", ant_key(3))
    kept0 = [x.k for x in r.filter("cls = 0").orderBy("rule_id").collect()]
    kept1 = [x.k for x in r.filter("cls = 1").orderBy("rule_id").collect()]
    assert kept0 == ["1|3|1", "0|0|1", "0|3|1", "3|3|0", "3|3|2", "0|0|3", "0|3|3",
                     "2|0|1", "2|0|3", "2|3|1", "2|3|3"]
    assert kept1 == ["2|1|0", "2|1|2", "2|0|2", "2|3|2"]


def test_final_rules(toy_model):
    got = [(r.k, r.cls, round(r.rw, 6), r.sup, round(r.conf, 6), r.n_win, r.n_correct)
           for r in toy_model.rules.withColumn("k", ant_key(3)).orderBy("rule_id").collect()]
    assert got == [("0|0|1", 0.0, 0.75, 6.0, 0.75, 10, 7), ("3|3|0", 0.0, 0.75, 3.0, 0.75, 4, 3),
                   ("0|0|3", 0.0, 1.0, 1.0, 1.0, 1, 1), ("2|1|0", 1.0, 0.75, 3.0, 0.75, 4, 3),
                   ("2|3|2", 1.0, 1.0, 1.0, 1.0, 1, 1)]


@pytest.mark.parametrize("which,method,matrix,acc,gm,avg", [
    ("train", "winning", [[11, 1], [4, 4]], 0.75, 0.677, 0.70833),
    ("train", "aggregation", [[11, 1], [5, 3]], 0.7, 0.5863, 0.64583),
    ("test", "winning", [[5, 0], [3, 0]], 0.625, 0.0, 0.5),
    ("test", "aggregation", [[5, 0], [3, 0]], 0.625, 0.0, 0.5),
])
def test_scoring(toy, toy_model, which, method, matrix, acc, gm, avg):
    df = toy[0] if which == "train" else toy[1]
    s = toy_model.transform(df, keep=[], method=method)
    cm = {(r.actual, r.predicted): r.n for r in confusion(s).collect()}
    assert [[cm[(0.0, 0.0)], cm[(0.0, 1.0)]], [cm[(1.0, 0.0)], cm[(1.0, 1.0)]]] == matrix
    assert metrics_dict(s) == {"accuracy": acc, "gm": gm, "avg_accuracy": avg}


def test_rule_text(toy_model):
    from fuzzrule.operators.report import rule_text
    t = [r.rule_text for r in rule_text(toy_model.rules, toy_model.prep.feature_names, 3)
         .orderBy("rule_id").collect()]
    assert t[0] == "IF _2_indexed IS L1 THEN class 0.0"
    assert t[4] == "IF _1 IS L2 AND _3 IS L3 AND _2_indexed IS L2 THEN class 1.0"


def test_degenerate_single_class(spark):
    rows = [(0.0, "3", 1.0, "N", 1.0), (1.0, "4", 0.0, "Y", 1.0)]
    df = spark.createDataFrame(rows, "_1 double, _2 string, _3 double, _4 string, _5 double")
    with pytest.raises(ValueError, match="two-class"):
        learn(df, RuleParams())


def test_unseen_category_skipped(toy, toy_model):
    extra = toy[1].sparkSession.createDataFrame([(0.0, "9", 1.0, "N"), (0.0, None, 1.0, "N")],
                                                toy[1].schema)
    s = toy_model.transform(toy[1].unionByName(extra), keep=[])
    assert s.count() == 8


def plain_scores(model, rows, method, shifted):
    """Every row against every rule, in plain Python."""
    out, h = [], 1 / (model.params.n_labels - 1)
    rules = model.rules.orderBy("rule_id").collect()
    for row in rows:
        degrees = []
        for r in rules:
            m = 1.0
            for j in range(model.d):
                lab, z = r[f"a{j}"], row[f"_z{j}"]
                if lab:
                    a, b, c = (lab - 2.0) * h, (lab - 1.0) * h, lab * h
                    move = (r[f"proto_{j}"] - b) if shifted else 0.0
                    a, b, c = a + move, b + move, c + move
                    m *= 0.0 if z <= a or z >= c else (z - a) / (b - a) if z <= b else (c - z) / (c - b)
            degrees.append(m * r.rw)
        if method == "winning":
            best = max(degrees)
            out.append(rules[degrees.index(best)].cls if best > 0 else model.majority)
        else:
            s = [sum(d for d, r in zip(degrees, rules) if r.cls == k) for k in (0.0, 1.0)]
            out.append(0.0 if s[0] - s[1] > 1e-9 else 1.0 if s[1] - s[0] > 1e-9 else model.majority)
    return out


def test_scores_equal_plain_python(toy, toy_model):
    for df in toy:
        rows = toy_model.prep.transform(df, keep=[]).collect()
        for method in ("winning", "aggregation"):
            for shifted in (False, True):
                got = [r.prediction for r in toy_model.transform(df, keep=[], method=method, shifted=shifted).collect()]
                assert got == plain_scores(toy_model, rows, method, shifted), (method, shifted)


def test_rule_blocks_of_any_size_agree(toy, toy_model):
    """Plain, tuned and GM results do not depend on the block size."""
    m2 = learn(toy[0], RuleParams(block_rules=2))
    assert m2.trace.funnel == toy_model.trace.funnel and len(m2.blocks) > 1
    gm = [learn(toy[0], RuleParams(selection="gm", block_rules=b)) for b in (50_000, 3)]
    assert gm[0].trace.selection_steps == gm[1].trace.selection_steps
    for a, b in ((toy_model, m2), gm):
        assert sorted(r[0] for r in a.rules.select(ant_key(3)).collect()) == sorted(r[0] for r in b.rules.select(ant_key(3)).collect())
        for method in ("winning", "aggregation"):
            for shifted in (False, True):
                x, y = ([(r.prediction, r.rule_id, r.md) for r in
                         m.transform(toy[1], keep=[], method=method, shifted=shifted).collect()] for m in (a, b))
                assert x == y
