"""Driver queries for feature selection, GM selection and the tree baseline.

``mi_relevance`` and ``mrmr_top_k`` use the fuzzy labels as the discrete
features.  The SQL of MDLP tries every cut of every interval, a common table
per level, and that of the rules after selection masks the other features.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fuzzrule.functions.membership import stable_round
from fuzzrule.operators.prepare import Y, lcol, zcol
from fuzzrule.operators.report import metrics
from fuzzrule.operators.select import mdlp_cuts, mrmr, mutual_information
from fuzzrule.operators.tree import fit_tree
from fuzzrule.plans import queries as Q
from fuzzrule.plans.oracle import DATASETS, SelectionChain, SqlChain, TreeChain, information_sql, mrmr_picks, r6
from fuzzrule.plans.learner import tree_baseline

MRMR_K = 3


def _name_case(names: list[str], col: str = "j") -> str:
    return "CASE " + " ".join(f"WHEN {col} = {j} THEN '{n}'" for j, n in enumerate(names)) + " END"


def _names_df(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "j int, feature string")


def q_mi_relevance(spark, sf):
    prep, z = Q.prepared(spark, sf, "D")
    mi = mutual_information(z, [lcol(j) for j in range(prep.d)], Y)
    return (mi.join(F.broadcast(_names_df(spark, Q.NAMES["D"])), "j")
              .select("feature", stable_round("mi", 6).alias("mi")))


def _mi_chain():
    c = SqlChain(DATASETS["D"])
    fz = c.fuzzified()
    long = c.add("long", " UNION ALL ".join(f"SELECT rid, {j} AS j, l{j} AS a, y FROM {fz}"
                                            for j in range(c.d)))
    cnt = c.add("relcnt", f"SELECT j, a, y AS b, count(*) AS n FROM {long} GROUP BY j, a, y")
    rel = c.add("rel", information_sql(cnt, "j"))
    return c, long, rel


def s_mi_relevance():
    c, _, rel = _mi_chain()
    return c.with_sql(f"SELECT {_name_case(Q.NAMES['D'])} AS feature, {r6('mi')} AS mi FROM {rel}")


def q_mrmr_top_k(spark, sf):
    prep, z = Q.prepared(spark, sf, "D")
    picks = mrmr(z.persist(), [lcol(j) for j in range(prep.d)], Y, MRMR_K)
    rows = [(i + 1, Q.NAMES["D"][j]) for i, j in enumerate(picks)]
    # the picks come from aggregates over the table; return them as a table
    return spark.createDataFrame(rows, "rank int, feature string")


def s_mrmr_top_k():
    c, long, rel = _mi_chain()
    pc = c.add("paircnt", f"SELECT x.j AS j, p.j AS k, x.a AS a, p.a AS b, count(*) AS n FROM {long} x "
                          f"JOIN {long} p ON x.rid = p.rid WHERE x.j <> p.j GROUP BY x.j, p.j, x.a, p.a")
    picks = mrmr_picks(c, rel, c.add("mi2", information_sql(pc, "j, k")), MRMR_K)
    return c.with_sql(f"SELECT rank, {_name_case(Q.NAMES['D'])} AS feature FROM {picks}")


def q_mdlp_cuts(spark, sf):
    prep, z = Q.prepared(spark, sf, "D")
    cuts = mdlp_cuts(z, [zcol(j) for j in range(prep.d)], Y)
    rows = [(Q.NAMES["D"][j], i, float(t)) for j, cs in cuts.items() for i, t in enumerate(cs)]
    return spark.createDataFrame(rows, "feature string, k int, cut double") \
        .withColumn("cut", stable_round("cut", 6))


def q_mdlp_first_cut(spark, sf):
    """First-level MDLP cut per feature (max_bins = 2): the accepted
    lowest-entropy boundary of the whole range."""
    prep, z = Q.prepared(spark, sf, "D")
    cuts = mdlp_cuts(z, [zcol(j) for j in range(prep.d)], Y, max_bins=2)
    rows = [(Q.NAMES["D"][j], float(t)) for j, cs in cuts.items() for t in cs]
    return spark.createDataFrame(rows, "feature string, cut double") \
        .withColumn("cut", stable_round("cut", 6))


def s_mdlp_first_cut():
    c = SelectionChain(DATASETS["D"], Q.RuleParams(mdlp_max_bins=2))
    return c.with_sql(f"SELECT {_name_case(Q.NAMES['D'])} AS feature, {r6('cut')} AS cut FROM {c.cuts()}")


def s_mdlp_cuts():
    c = SelectionChain(DATASETS["D"])
    cuts = c.cuts()
    return c.with_sql(f"SELECT {_name_case(Q.NAMES['D'])} AS feature, CAST(row_number() OVER (PARTITION BY j ORDER BY cut) - 1 AS INTEGER) AS k, "
                      f"{r6('cut')} AS cut FROM {cuts}")


def _selection():
    return SelectionChain(DATASETS["D"], Q.RuleParams(use_fs=True, rate=0.7))


def s_feature_selection():
    c = _selection()
    picks = c.picks()
    return c.with_sql(f"SELECT {_name_case(Q.NAMES['D'])} AS feature FROM {picks}")


def s_final_rules_fs():
    c = _selection()
    src = c.final()
    key = c.ant_key()
    return c.with_sql(f"SELECT rule_id, {key} AS ant_key, cls, {r6('rw')} AS rw, sup, {r6('conf')} AS conf, n_win, n_correct FROM {src}")


def q_feature_selection(spark, sf):
    m = Q.fit(spark, sf, "D", use_fs=True, rate=0.7)
    return spark.createDataFrame([(n,) for n in m.prep.feature_names], "feature string")


def q_final_rules_fs(spark, sf):
    m = Q.fit(spark, sf, "D", use_fs=True, rate=0.7)
    return Q._final_out(m)


def q_gm_select(spark, sf):
    return Q._final_out(Q.fit(spark, sf, "D", selection="gm"))


def _gm_q(key, **kw):
    return lambda spark, sf: Q._final_out(Q.fit(spark, sf, key, selection="gm", **kw))


def _gm_s(key, **kw):
    def s():
        c = SqlChain(DATASETS[key], Q.params_for(key, selection="gm", **kw))
        src = c.gm_final()
        return c.with_sql(f"SELECT rule_id, {c.ant_key()} AS ant_key, cls, {r6('rw')} AS rw, sup, "
                          f"{r6('conf')} AS conf, n_win, n_correct FROM {src}")
    return s


def s_gm_select():
    c = SqlChain(DATASETS["D"], Q.RuleParams(selection="gm"))
    src = c.gm_final()
    return c.with_sql(f"SELECT rule_id, {c.ant_key()} AS ant_key, cls, {r6('rw')} AS rw, sup, "
                      f"{r6('conf')} AS conf, n_win, n_correct FROM {src}")


def q_tree_baseline(spark, sf):
    _, pte, _, _ = tree_baseline(Q.view(spark, sf, "D"), Q.SCORE_VIEWS["D"](spark, sf), "quality",
                                 Q.NAMES["D"][:4] + ["lang"], keep=["id"])
    return pte.select("id", "prediction")


def _small_tree(spark, sf):
    return fit_tree(Q.view(spark, sf, "D"), "quality", exclude=("id",))


def q_small_tree(spark, sf):
    return _small_tree(spark, sf).transform(Q.SCORE_VIEWS["D"](spark, sf), keep=["id"]).select("id", "prediction")


def s_small_tree():
    c = TreeChain(DATASETS["D"])
    return c.with_sql(f"SELECT id, prediction FROM {c.tree_predictions('score')}")


def q_small_tree_metrics(spark, sf):
    """Confusion counts and accuracy of the baseline tree on its training rows."""
    p = _small_tree(spark, sf).transform(Q.view(spark, sf, "D"))
    return metrics(p).crossJoin(p.agg(*[F.count_if((F.col(Y) == a) & (F.col("prediction") == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]))


def s_small_tree_metrics():
    c = TreeChain(DATASETS["D"])
    cnt = c.counts(c.tree_predictions("train"))
    return c.with_sql(f"SELECT m.*, c.* FROM (SELECT {SqlChain.metrics_select(cnt)}) m CROSS JOIN {cnt} c")


def registry():
    return {
        "mi_relevance": (q_mi_relevance, s_mi_relevance),
        "mrmr_top_k": (q_mrmr_top_k, s_mrmr_top_k),
        "mdlp_cuts": (q_mdlp_cuts, s_mdlp_cuts),
        "mdlp_first_cut": (q_mdlp_first_cut, s_mdlp_first_cut),
        "feature_selection": (q_feature_selection, s_feature_selection),
        "final_rules_fs": (q_final_rules_fs, s_final_rules_fs),
        "gm_select": (q_gm_select, s_gm_select),
        "gm_select_emb_rate05": (_gm_q("E", rate=0.5), _gm_s("E", rate=0.5)),
        "tree_baseline": (q_tree_baseline, None),
        "small_tree": (q_small_tree, s_small_tree),
        "small_tree_metrics": (q_small_tree_metrics, s_small_tree_metrics),
    }
