"""Driver query set: one Spark query per operator group, each with an
equivalent SQL text for the DuckDB oracle (see ``oracle.py``).

Views: L = lineitem (4 numeric features, class l_linestatus), D =
documents joined with labels (4 text statistics + lang, class quality),
E = embeddings (all 64 dimensions, class label < 5; rules of one antecedent),
M = D with values missing, B = documents with boolean features.  Every query reads the whole view; learning
queries train on all labelled rows, scoring queries score all rows, labelled
or not (fold queries use a 5-fold split in which every row is tested once).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.functions.membership import round_at, stable_round, trimf_col
from fuzzrule.functions.partition import triangle
from fuzzrule.operators.cells import cell_rules, class_majority, support_filter, support_threshold
from fuzzrule.operators.mine import rank_filter, resolve_rules, sub_rules
from fuzzrule.operators.prepare import Y, fit_preparer, lcol, zcol
from fuzzrule.operators.report import (ant_key, confusion, metrics, rule_funnel, rule_summary,
                                       rule_text)
from fuzzrule.params import RuleParams
from fuzzrule.plans.oracle import DATASETS, SqlChain, dbl, factor_sql, r6, round_at_sql
from fuzzrule.plans.learner import RuleModel, learn
from fuzzrule.session import ensure_checkpoint_dir
from fuzzrule.sources.readers import (EMBEDDING_DIMS, LINEITEM_FEATURES, documents_features, documents_view,
                                      embeddings_view, flags_view, fold_of, lineitem_view, read_fold, with_missing,
                                      write_fold)

VIEWS = {"L": lineitem_view, "D": documents_view, "E": embeddings_view, "B": flags_view,
         "M": lambda spark, sf: with_missing(documents_view(spark, sf))}
# rows to score; M also has an unseen category
SCORE_VIEWS = {"D": documents_features, "E": embeddings_view,
               "M": lambda spark, sf: with_missing(documents_features(spark, sf)).withColumn(
                   "lang", F.when(F.col("id") % 13 == 0, F.lit("xx")).otherwise(F.col("lang")))}
LABELS = {"L": "l_linestatus", "D": "quality", "E": "low", "M": "quality", "B": "quality"}
EXCLUDE = {"L": (), "D": ("id",), "E": ("id",), "M": ("id",), "B": ("id",)}
# 64 features give C(64, 3) sub-rules a cell at length 3: E learns rules of length 1
LEARN = {"E": {"max_length": 1}}
NAMES = {"L": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
         "D": ["n_chars", "n_lines", "upper_share", "uniq_share", "lang_indexed"],
         "E": [f"e{j}" for j in range(EMBEDDING_DIMS)]}

# fitted models that the queries share; older ones are released
KEPT_MODELS = 6
_CACHE: dict = {}


def view(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return VIEWS[key](spark, sf)


def params_for(key: str, **kw) -> RuleParams:
    return RuleParams(**{**LEARN.get(key, {}), **kw})


def fit(spark: SparkSession, sf: str, key: str, **kw) -> RuleModel:
    # keyed by the running application too: a stopped and re-created session
    # must not see models bound to the old context
    ck = (spark.sparkContext.applicationId, id(spark), sf, key, tuple(sorted(kw.items())))
    if ck not in _CACHE:
        _CACHE[ck] = learn(view(spark, sf, key), params_for(key, **kw), label=LABELS[key],
                           exclude=EXCLUDE[key])
        models = [k for k, v in _CACHE.items() if isinstance(v, RuleModel)]
        for old in models[:-KEPT_MODELS]:
            _CACHE.pop(old).release()
    return _CACHE[ck]


def prepared(spark, sf, key, n_labels=3):
    df = view(spark, sf, key)
    prep = fit_preparer(df, n_labels, LABELS[key], exclude=EXCLUDE[key])
    keep = ["id"] if key != "L" else []
    return prep, prep.transform(df, keep=keep, training=True)


def _round_protos(df: DataFrame, prefixes: list[str], d: int) -> list:
    return [stable_round(F.col(f"{p}_{j}"), 6).alias(f"{p}_{j}") for p in prefixes for j in range(d)]


# ------------------------------------------------------------------ queries
def q_feature_index(spark, sf):
    df = view(spark, sf, "D")
    prep = fit_preparer(df, 3, "quality", exclude=("id",))
    idx = prep.index(df)
    a = idx.select(F.lit("lang").alias("col_name"), F.col("lang").alias("value"),
                   F.col("lang_indexed").alias("idx"))
    b = idx.select(F.lit("quality").alias("col_name"), F.col("quality").cast("string").alias("value"),
                   F.col(Y).alias("idx"))
    return a.unionByName(b).distinct()


def s_feature_index():
    c = SqlChain(DATASETS["D"])
    c.index()
    return c.with_sql(f"SELECT 'lang' AS col_name, v AS value, idx FROM {c.t('cidx0')} "
                      f"UNION ALL SELECT 'quality' AS col_name, v AS value, idx FROM {c.t('yidx')}")


def q_minmax_scale(spark, sf):
    prep, z = prepared(spark, sf, "L")
    means = z.agg(*[F.avg(zcol(j)).alias(f"m{j}") for j in range(prep.d)])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(prep.mins[j]).alias("mn"),
                 F.lit(prep.maxs[j]).alias("mx"), stable_round(F.col(f"m{j}"), 6).alias("mean_scaled"))
        for j, n in enumerate(NAMES["L"])])))


def s_minmax_scale():
    c = SqlChain(DATASETS["L"])
    fz = c.fuzzified()
    parts = [f"SELECT '{n}' AS feature, min(st.mn{j}) AS mn, min(st.mx{j}) AS mx, {r6(f"avg(f.z{j})")} "
             f"AS mean_scaled FROM {fz} f CROSS JOIN {c.t('stats')} st" for j, n in enumerate(NAMES["L"])]
    return c.with_sql(" UNION ALL ".join(parts))


def q_fuzzify_labels(spark, sf):
    prep, z = prepared(spark, sf, "L")
    u = z.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(lcol(j)).alias("label"))
                                    for j, n in enumerate(NAMES["L"])])))
    return u.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"))


def s_fuzzify_labels():
    c = SqlChain(DATASETS["L"])
    fz = c.fuzzified()
    parts = [f"SELECT '{n}' AS feature, l{j} AS label, count(*) AS n FROM {fz} GROUP BY l{j}"
             for j, n in enumerate(NAMES["L"])]
    return c.with_sql(" UNION ALL ".join(parts))


def q_membership_degrees(spark, sf):
    prep, z = prepared(spark, sf, "E")
    n = prep.n_labels
    structs = []
    for j, name in enumerate(NAMES["E"]):
        for k in range(1, n + 1):
            a, b, c = triangle(k, n)
            mu = trimf_col(F.col(zcol(j)), F.lit(a), F.lit(b), F.lit(c))
            structs.append(F.struct(F.lit(name).alias("feature"), F.lit(k).alias("label"),
                                    stable_round(mu, 6).alias("mu")))
    return z.select("id", F.inline(F.array(*structs)))


def s_membership_degrees():
    c = SqlChain(DATASETS["E"], params_for("E"))
    fz = c.fuzzified()
    parts = []
    for j, name in enumerate(NAMES["E"]):
        for k in range(1, 4):
            parts.append(f"SELECT id, '{name}' AS feature, {k} AS label, "
                         f"{r6(factor_sql(str(k), f'z{j}', 3))} AS mu FROM {fz}")
    return c.with_sql(" UNION ALL ".join(parts))


def _cells(spark, sf, key, params: RuleParams):
    prep, z = prepared(spark, sf, key, params.n_labels)
    cells = cell_rules(z, prep.d, prep.majority)
    if params.use_filtering:
        cells = cells.persist()
        ths = support_threshold(prep.n_rows, cells.count(), params.filtering_ths)
        cells = support_filter(cells, ths)
    return prep, cells


def _cells_out(cells, d):
    return cells.select(ant_key(d).alias("ant_key"), "cls", "two_mass", "sp1", "sp2",
                        *_round_protos(cells, ["p1", "p2"], d))


def _cells_sql(c: SqlChain, src: str):
    d = c.d
    cols = [f"{c.ant_key()} AS ant_key", "cls", "two_mass", "sp1", "sp2"]
    cols += [f"{r6(f'p1_{j}')} AS p1_{j}" for j in range(d)] + [f"{r6(f'p2_{j}')} AS p2_{j}" for j in range(d)]
    return c.with_sql(f"SELECT {', '.join(cols)} FROM {src}")


def q_cell_rules(spark, sf):
    prep, cells = _cells(spark, sf, "L", RuleParams())
    return _cells_out(cells, prep.d)


def s_cell_rules():
    c = SqlChain(DATASETS["L"])
    return _cells_sql(c, c.cells())


def q_cell_rules_min_support(spark, sf):
    prep, cells = _cells(spark, sf, "D", RuleParams(use_filtering=True))
    return _cells_out(cells, prep.d)


def s_cell_rules_min_support():
    c = SqlChain(DATASETS["D"], RuleParams(use_filtering=True))
    return _cells_sql(c, c.cells_filtered())


def q_class_majority(spark, sf):
    prep, z = prepared(spark, sf, "D")
    return class_majority(z)


def s_class_majority():
    c = SqlChain(DATASETS["D"])
    m = c.stats()
    return c.with_sql(f"SELECT {dbl(0.0)} AS cls, n0 AS n, n0 >= n - n0 AS is_majority FROM {m} "
                      f"UNION ALL SELECT {dbl(1.0)} AS cls, n - n0 AS n, n - n0 > n0 AS is_majority FROM {m}")


def q_sub_rules(spark, sf):
    p = RuleParams()
    prep, cells = _cells(spark, sf, "L", p)
    s = sub_rules(cells, prep.d, p)
    d = prep.d
    return s.select(ant_key(d).alias("ant_key"), "cls", "s1", "s2", "n_src",
                    stable_round("conf", 6).alias("conf"), *_round_protos(s, ["q1", "q2"], d))


def s_sub_rules():
    c = SqlChain(DATASETS["L"])
    src = c.combined()
    d = c.d
    cols = [f"{c.ant_key()} AS ant_key", "cls", "s1", "s2", "n_src", f"{r6('conf')} AS conf"]
    cols += [f"{r6(f'q1_{j}')} AS q1_{j}" for j in range(d)] + [f"{r6(f'q2_{j}')} AS q2_{j}" for j in range(d)]
    return c.with_sql(f"SELECT {', '.join(cols)} FROM {src}")


def _resolved_out(r, d):
    return r.select(ant_key(d).alias("ant_key"), "cls", stable_round("rw", 6).alias("rw"), "sup",
                    stable_round("conf", 6).alias("conf"), "len", "conflict",
                    *_round_protos(r, ["proto"], d))


def _resolved_sql(c, src):
    d = c.d
    cols = [f"{c.ant_key()} AS ant_key", "cls", f"{r6('rw')} AS rw", "sup", f"{r6('conf')} AS conf",
            "len", "conflict"] + [f"{r6(f'proto_{j}')} AS proto_{j}" for j in range(d)]
    return c.with_sql(f"SELECT {', '.join(cols)} FROM {src}")


def q_resolved_rules(spark, sf):
    p = RuleParams()
    prep, cells = _cells(spark, sf, "L", p)
    return _resolved_out(resolve_rules(cells, prep.d, p, prep.majority), prep.d)


def s_resolved_rules():
    c = SqlChain(DATASETS["L"])
    return _resolved_sql(c, c.resolved())


def q_resolved_rules_docs(spark, sf):
    p = RuleParams()
    prep, cells = _cells(spark, sf, "D", p)
    return _resolved_out(resolve_rules(cells, prep.d, p, prep.majority), prep.d)


def s_resolved_rules_docs():
    c = SqlChain(DATASETS["D"])
    return _resolved_sql(c, c.resolved())


def q_rank_filter_class(spark, sf):
    m = fit(spark, sf, "L")
    r = m.trace.ranked
    return r.select("rule_id", ant_key(m.d).alias("ant_key"), "cls", stable_round("conf", 6).alias("conf"))


def s_rank_filter_class():
    c = SqlChain(DATASETS["L"])
    src = c.ranked()
    return c.with_sql(f"SELECT rule_id, {c.ant_key()} AS ant_key, cls, {r6('conf')} AS conf FROM {src}")


def q_rank_filter_class_length(spark, sf):
    p = RuleParams(rank_by="class_length")
    prep, cells = _cells(spark, sf, "D", p)
    r = rank_filter(resolve_rules(cells, prep.d, p, prep.majority), prep.d, p)
    return r.select(ant_key(prep.d).alias("ant_key"), "cls", stable_round("conf", 6).alias("conf"), "len")


def s_rank_filter_class_length():
    c = SqlChain(DATASETS["D"], RuleParams(rank_by="class_length"))
    src = c.ranked()
    return c.with_sql(f"SELECT {c.ant_key()} AS ant_key, cls, {r6('conf')} AS conf, len FROM {src}")


def q_rule_wins(spark, sf):
    m = fit(spark, sf, "E")
    w = m.trace.with_wins.filter(F.col("n_win") > 0)
    return w.select(ant_key(m.d).alias("ant_key"), "cls", "n_win", "n_correct")


def s_rule_wins():
    c = SqlChain(DATASETS["E"], params_for("E"))
    src = c.with_wins()
    return c.with_sql(f"SELECT {c.ant_key()} AS ant_key, cls, n_win, n_correct FROM {src}")


def _final_out(m: RuleModel):
    return m.rules.select("rule_id", ant_key(m.d).alias("ant_key"), "cls", stable_round("rw", 6).alias("rw"),
                          "sup", stable_round("conf", 6).alias("conf"), "n_win", "n_correct")


def _final_sql(c: SqlChain):
    src = c.final()
    return c.with_sql(f"SELECT rule_id, {c.ant_key()} AS ant_key, cls, {r6('rw')} AS rw, sup, "
                      f"{r6('conf')} AS conf, n_win, n_correct FROM {src}")


def q_precision_select(spark, sf):
    return _final_out(fit(spark, sf, "D"))


def s_precision_select():
    return _final_sql(SqlChain(DATASETS["D"]))


def q_final_rules_lineitem(spark, sf):
    return _final_out(fit(spark, sf, "L"))


def s_final_rules_lineitem():
    return _final_sql(SqlChain(DATASETS["L"]))


def q_final_rules_filtered(spark, sf):
    return _final_out(fit(spark, sf, "E", use_filtering=True, rate=0.7))


def s_final_rules_filtered():
    return _final_sql(SqlChain(DATASETS["E"], params_for("E", use_filtering=True, rate=0.7)))


def _score_q(key, method, shifted, out, **kw):
    def q(spark, sf):
        m = fit(spark, sf, key, **kw)
        s = m.transform(SCORE_VIEWS[key](spark, sf), keep=["id"], method=method, shifted=shifted, out=out)
        return s.select("id", out)
    return q


def _score_s(key, method, shifted, out, **kw):
    def s():
        c = SqlChain(DATASETS[key], params_for(key, **kw))
        p = c.predictions("score", method, shifted)
        return c.with_sql(f"SELECT id, prediction AS {out} FROM {p}")
    return s


def _final_q(key, **kw):
    return lambda spark, sf: _final_out(fit(spark, sf, key, **kw))


def _final_s(key, **kw):
    return lambda: _final_sql(SqlChain(DATASETS[key], params_for(key, **kw)))


def q_sub_rules_len2(spark, sf):
    p = RuleParams(min_length=2, max_length=2)
    prep, cells = _cells(spark, sf, "L", p)
    r = resolve_rules(cells, prep.d, p, prep.majority)
    return _resolved_out(r, prep.d)


def s_sub_rules_len2():
    c = SqlChain(DATASETS["L"], RuleParams(min_length=2, max_length=2))
    return _resolved_sql(c, c.resolved())


def q_confusion(spark, sf):
    m = fit(spark, sf, "D")
    return confusion(m.transform(view(spark, sf, "D"), keep=[]))


def s_confusion():
    c = SqlChain(DATASETS["D"])
    p = c.predictions("all")
    cnt = c.counts(p)
    parts = [f"SELECT {dbl(a)} AS actual, {dbl(b)} AS predicted, c{a}{b} AS n FROM {cnt}"
             for a in (0, 1) for b in (0, 1)]
    return c.with_sql(" UNION ALL ".join(parts))


def q_metrics(spark, sf):
    m = fit(spark, sf, "E")
    return metrics(m.transform(view(spark, sf, "E"), keep=[]))


def s_metrics():
    c = SqlChain(DATASETS["E"], params_for("E"))
    cnt = c.counts(c.predictions("all"))
    return c.with_sql("SELECT " + SqlChain.metrics_select(cnt))


def q_rule_summary(spark, sf):
    m = fit(spark, sf, "D")
    return (rule_summary(m.rules, m.trace.with_wins.filter(F.col("n_win") > 0))
            .withColumn("top_ratio", stable_round("top_ratio", 6))
            .withColumn("min_conf", stable_round("min_conf", 6)).withColumn("max_conf", stable_round("max_conf", 6))
            .withColumn("avg_len", stable_round("avg_len", 6)))


def s_rule_summary():
    c = SqlChain(DATASETS["D"])
    f = c.final()
    return c.with_sql(f"SELECT a.*, b.n_correct AS top_correct, b.n_win AS top_win, b.sup AS top_sup, "
                      f"{r6('CAST(b.n_correct AS DOUBLE) / b.sup')} AS top_ratio FROM ("
                      f"SELECT cls, count(*) AS n_rules, sum(n_correct) AS n_correct, sum(n_win) AS n_win, "
                      f"{r6('min(conf)')} AS min_conf, {r6('max(conf)')} AS max_conf, min(sup) AS min_sup, "
                      f"max(sup) AS max_sup, {r6('avg(len)')} AS avg_len FROM {f} GROUP BY cls) a "
                      f"LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY sup DESC, rule_id) AS rn "
                      f"FROM {c.t('used')}) b ON a.cls = b.cls AND b.rn = 1")


def q_rule_funnel(spark, sf):
    m = fit(spark, sf, "D")
    return rule_funnel(spark, m.trace.funnel)


def s_rule_funnel():
    c = SqlChain(DATASETS["D"])
    f = c.final()
    stages = [("cell_rules", c.t("cells")), ("support_filtered", c.t("cells")), ("mined", c.t("resolved")),
              ("rank_filtered", c.t("ranked")), ("winning", c.t("used")), ("selected", f)]
    parts = [f"SELECT CAST({i} AS INTEGER) AS step, '{s}' AS stage, count(*) AS n FROM {t}"
             for i, (s, t) in enumerate(stages)]
    return c.with_sql(" UNION ALL ".join(parts))


def q_rule_text(spark, sf):
    m = fit(spark, sf, "D")
    return rule_text(m.rules, m.prep.feature_names, 3).select("rule_id", "rule_text")


def s_rule_text():
    c = SqlChain(DATASETS["D"])
    f = c.final()
    parts = ", ".join(f"CASE WHEN a{j} <> 0 THEN '{n} IS L' || CAST(a{j} AS VARCHAR) END"
                      for j, n in enumerate(NAMES["D"]))
    return c.with_sql(f"SELECT rule_id, 'IF ' || concat_ws(' AND ', {parts}) || ' THEN class ' || "
                      f"CAST(cls AS VARCHAR) AS rule_text FROM {f}")


def q_average_rule_length(spark, sf):
    m = fit(spark, sf, "L")
    return m.rules.agg(round_at(F.avg("len"), 2).alias("avg_rule_length"), F.count(F.lit(1)).alias("n_rules"))


def s_average_rule_length():
    c = SqlChain(DATASETS["L"])
    f = c.final()
    return c.with_sql(f"SELECT {round_at_sql('avg(len)', 2)} AS avg_rule_length, count(*) AS n_rules FROM {f}")


def q_ml_pipeline(spark, sf):
    """All stages fitted as one Pipeline, saved in the shared folder, loaded,
    and applied to all documents."""
    from pyspark.ml import Pipeline, PipelineModel

    from fuzzrule import ml
    stages = [ml.CategoricalIndexer(labelCol="quality", excludeCols=["id"]),
              ml.Fuzzifier(labelCol="quality", excludeCols=["id"]),
              ml.FuzzyRuleClassifier(labelCol="quality", featuresCol=ml.FEATURES), ml.PrototypeTuning()]
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipelines/{uuid.uuid4().hex}"
    Pipeline(stages=stages).fit(view(spark, sf, "D")).save(place)
    return PipelineModel.load(place).transform(SCORE_VIEWS["D"](spark, sf)).select("id", "prediction", "prediction_tu")


def s_ml_pipeline():
    c = SqlChain(DATASETS["D"])
    a = c.predictions("score", name="plain")
    b = c.predictions("score", "winning", True, name="tuned")
    return c.with_sql(f"SELECT a.id, a.prediction, b.prediction AS prediction_tu FROM {a} a JOIN {b} b ON a.rid = b.rid")


def q_csv_folds(spark, sf):
    """The lineitem view written as the two header-less files of a fold, read
    back with inferred types, and summed by class."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", *LINEITEM_FEATURES, "l_linestatus")
    write_fold(rows, fold_of(F.col("l_orderkey"), FOLDS) == 1, base, "lineitem", "lineitem", 1)
    out = None
    for part, df in zip(("tra", "tst"), read_fold(spark, base, "lineitem", "lineitem", 1)):
        g = df.toDF("l_orderkey", *LINEITEM_FEATURES, "l_linestatus").groupBy("l_linestatus").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
            F.max(F.col("l_discount").cast("double")).alias("most_discount"))
        g = g.select(F.lit(part).alias("part"), "*")
        out = g if out is None else out.unionAll(g)
    return out


def s_csv_folds():
    return ("SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'tst' ELSE 'tra' END AS part, l_linestatus, count(*) AS n, "
            "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(max(l_discount) AS DOUBLE) AS most_discount "
            "FROM lineitem GROUP BY ALL")


# ------------------------------------------------------------ fold results
FOLDS = 5


def fold_rows(spark, sf, key="E"):
    """The result rows of all folds, written by fold and read back."""
    from fuzzrule.operators.report import metrics_dict
    from fuzzrule.sources.sinks import fold_result, read_fold_results, save_fold_result
    ck = (spark.sparkContext.applicationId, id(spark), sf, key, "folds")
    if ck not in _CACHE:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fold-results/{uuid.uuid4().hex}"
        df = view(spark, sf, key)
        for k in range(1, FOLDS + 1):
            fcol = fold_of(F.col("id"), FOLDS)
            train, test = df.filter(fcol != k), df.filter(fcol == k)
            m = learn(train, params_for(key), label=LABELS[key], exclude=EXCLUDE[key])
            tr = metrics_dict(m.transform(train, keep=[]))
            te = metrics_dict(m.transform(test, keep=[]))
            save_fold_result(fold_result(spark, key, k, m, tr, te), path)
            m.release()
        _CACHE[ck] = path
    return read_fold_results(spark, _CACHE[ck], dataset=key)


FOLD_METRICS = ["train_acc", "test_acc", "train_avg_acc", "test_avg_acc", "train_gm", "test_gm"]


def q_fold_results(spark, sf):
    return fold_rows(spark, sf, "E")


def s_fold_results():
    parts, ctes = [], []
    for k in range(1, FOLDS + 1):
        c = SqlChain(DATASETS["E"], params_for("E"), suffix=f"_f{k}",
                     train_filter=f"(rid % {FOLDS}) + 1 <> {k}")
        ptr = c.predictions("train", name="ptr")
        pte = c.predictions("all", name="pall")
        test = c.add("pte", f"SELECT * FROM {pte} WHERE (rid % {FOLDS}) + 1 = {k}")
        ctr, cte = c.counts(ptr), c.counts(test)
        mtr = c.add("mtr", "SELECT " + SqlChain.metrics_select(ctr))
        mte = c.add("mte", "SELECT " + SqlChain.metrics_select(cte))
        fin = c.t("final")
        parts.append(f"SELECT 'E' AS dataset, 'winning' AS method, 'plain' AS variant, CAST({k} AS INTEGER) AS fold, "
                     f"a.accuracy AS train_acc, b.accuracy AS test_acc, "
                     f"a.avg_accuracy AS train_avg_acc, b.avg_accuracy AS test_avg_acc, a.gm AS train_gm, "
                     f"b.gm AS test_gm, 3::INTEGER AS n_labels, true AS use_rw, false AS use_fs, NULL::DOUBLE AS fs_rate, "
                     f"NULL::INTEGER AS n_features_before, NULL::INTEGER AS n_features_after, false AS use_filter, NULL::INTEGER AS ths_used, "
                     f"(SELECT count(*) FROM {c.t('cells')}) AS n_rules_before, (SELECT count(*) FROM {fin}) AS n_rules_after, "
                     f"(SELECT {round_at_sql('avg(len)', 2)} FROM {fin}) AS avg_rule_length, false AS tuning FROM {mtr} a CROSS JOIN {mte} b")
        ctes += c.ctes
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + " UNION ALL ".join(parts)


def q_fold_describe(spark, sf):
    from fuzzrule.sources.sinks import describe_folds
    return describe_folds(fold_rows(spark, sf, "E"), FOLD_METRICS)


def s_fold_describe():
    inner = s_fold_results()
    head, tail = inner.rsplit("\n", 1)
    folds = f"folds AS ({tail})"
    stats = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("stddev", "stddev_samp({c})"),
             ("min", "min({c})"), ("max", "max({c})")]
    parts = [f"SELECT '{s}' AS stat, " + ", ".join(f"{r6(e.format(c=c))} AS {c}" for c in FOLD_METRICS)
             + " FROM folds" for s, e in stats]
    return head + ",\n" + folds + "\n" + " UNION ALL ".join(parts)


# --------------------------------------------------------------- registry
def _registry() -> dict[str, tuple[Callable, Callable | None]]:
    reg = {
        "feature_index": (q_feature_index, s_feature_index),
        "minmax_scale": (q_minmax_scale, s_minmax_scale),
        "fuzzify_labels": (q_fuzzify_labels, s_fuzzify_labels),
        "membership_degrees": (q_membership_degrees, s_membership_degrees),
        "cell_rules": (q_cell_rules, s_cell_rules),
        "cell_rules_min_support": (q_cell_rules_min_support, s_cell_rules_min_support),
        "class_majority": (q_class_majority, s_class_majority),
        "sub_rules": (q_sub_rules, s_sub_rules),
        "resolved_rules": (q_resolved_rules, s_resolved_rules),
        "resolved_rules_docs": (q_resolved_rules_docs, s_resolved_rules_docs),
        "rank_filter_class": (q_rank_filter_class, s_rank_filter_class),
        "rank_filter_class_length": (q_rank_filter_class_length, s_rank_filter_class_length),
        "rule_wins": (q_rule_wins, s_rule_wins),
        "precision_select": (q_precision_select, s_precision_select),
        "final_rules_lineitem": (q_final_rules_lineitem, s_final_rules_lineitem),
        "final_rules_filtered": (q_final_rules_filtered, s_final_rules_filtered),
        "score_winning": (_score_q("D", "winning", False, "prediction"),
                          _score_s("D", "winning", False, "prediction")),
        "score_aggregate": (_score_q("E", "aggregation", False, "prediction"),
                            _score_s("E", "aggregation", False, "prediction")),
        "score_tuned_winning": (_score_q("E", "winning", True, "prediction_tu"),
                                _score_s("E", "winning", True, "prediction_tu")),
        "score_tuned_aggregate": (_score_q("D", "aggregation", True, "prediction_tu"),
                                  _score_s("D", "aggregation", True, "prediction_tu")),
        "score_embeddings": (_score_q("E", "winning", False, "prediction"),
                             _score_s("E", "winning", False, "prediction")),
        "score_small_blocks": (_score_q("D", "winning", False, "prediction", block_rules=8),
                               _score_s("D", "winning", False, "prediction")),
        "ml_pipeline": (q_ml_pipeline, s_ml_pipeline),
        "csv_folds": (q_csv_folds, s_csv_folds),
        "final_rules_boolean": (_final_q("B"), _final_s("B")),
        "final_rules_wide": (_final_q("E", max_length=2), _final_s("E", max_length=2)),
        "score_missing_values": (_score_q("M", "winning", False, "prediction"),
                                 _score_s("M", "winning", False, "prediction")),
        "final_rules_missing_values": (_final_q("M"), _final_s("M")),
        "score_tuned_proto_first": (_score_q("E", "winning", True, "prediction_tu", prototype="first"),
                                    _score_s("E", "winning", True, "prediction_tu", prototype="first")),
        "final_rules_5labels": (_final_q("E", n_labels=5), _final_s("E", n_labels=5)),
        "final_rules_no_rw": (_final_q("E", use_rw=False), _final_s("E", use_rw=False)),
        "final_rules_class_length": (_final_q("D", rank_by="class_length"),
                                     _final_s("D", rank_by="class_length")),
        "resolved_rules_len2": (q_sub_rules_len2, s_sub_rules_len2),
        "confusion": (q_confusion, s_confusion),
        "metrics": (q_metrics, s_metrics),
        "rule_summary": (q_rule_summary, s_rule_summary),
        "rule_funnel": (q_rule_funnel, s_rule_funnel),
        "rule_text": (q_rule_text, s_rule_text),
        "average_rule_length": (q_average_rule_length, s_average_rule_length),
        "fold_results": (q_fold_results, s_fold_results),
        "fold_describe": (q_fold_describe, s_fold_describe),
    }
    from fuzzrule.plans import queries_extra  # imports this module
    reg.update(queries_extra.registry())
    return reg


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in _registry().items() if v[1] is not None}
