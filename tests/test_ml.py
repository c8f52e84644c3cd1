"""The ml stages: parameters, schema checks, saved estimators and pipelines."""

import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel

from fuzzrule import RuleParams, learn
from fuzzrule.ml import CategoricalIndexer, Fuzzifier, FuzzyRuleClassifier, PrototypeTuning
from tests.conftest import SF001


def stages(label, params=None, exclude=None):
    return [CategoricalIndexer(labelCol=label, excludeCols=exclude), Fuzzifier(labelCol=label, excludeCols=exclude),
            FuzzyRuleClassifier(params, labelCol=label, featuresCol="features_arr"), PrototypeTuning()]


def test_one_pipeline_fitted_saved_loaded(spark):
    from fuzzrule.plans import queries as Q
    docs = Q.view(spark, SF001, "D").limit(150).persist()
    pipeline = Pipeline(stages=stages("quality", RuleParams(rate=0.5, n_labels=4), ["id"]))
    # Fuzzifier's labels are those of the learner
    pipeline.getStages()[1]._set(nLabels=4)
    top = tempfile.mkdtemp(prefix="fuzzrule-ml-")
    pipeline.write().overwrite().save(f"{top}/estimator")
    again = Pipeline.load(f"{top}/estimator")
    assert [type(s) for s in again.getStages()] == [type(s) for s in pipeline.getStages()]
    assert again.getStages()[2].rule_params() == RuleParams(rate=0.5, n_labels=4)
    model = again.fit(docs)
    model.write().overwrite().save(f"{top}/model")
    loaded = PipelineModel.load(f"{top}/model")
    rows = Q.SCORE_VIEWS["D"](spark, SF001)
    cols = ("id", "prediction", "prediction_tu")
    got = sorted(map(tuple, loaded.transform(rows).select(*cols).collect()))
    assert got == sorted(map(tuple, model.transform(rows).select(*cols).collect()))
    # the same rules and scores as by the library's own path
    own = learn(docs, RuleParams(rate=0.5, n_labels=4), label="quality", exclude=("id",))
    plain = {r.id: r.prediction for r in own.transform(rows, keep=["id"]).collect()}
    tuned = {r.id: r.prediction for r in own.transform(rows, keep=["id"], shifted=True).collect()}
    assert got == sorted((i, plain[i], tuned[i]) for i in plain)
    assert loaded.stages[2].model.prep.feature_names == own.prep.feature_names


def test_params_are_params():
    c = FuzzyRuleClassifier(RuleParams(selection="gm"), labelCol="y")
    assert c.getOrDefault("selection") == "gm" and c.getLabelCol() == "y" and "useRw" in c.explainParams()
    copy = c.copy({c.nLabels: 5})
    assert copy.rule_params().n_labels == 5 and c.rule_params().n_labels == 3
    with pytest.raises(TypeError):
        c._set(nLabels="many")


def test_schemas_are_checked(spark):
    df = spark.createDataFrame([(1.0, "a", "p"), (2.0, "b", "n"), (3.0, "a", "p")], "x double, c string, y string")
    indexer, fuzzifier, rules, tuning = stages("y")
    schema = fuzzifier.transformSchema(indexer.transformSchema(df.schema))
    assert schema.names == ["x", "y", "c_indexed", "_y", "features_arr", "labels"]
    assert tuning.transformSchema(rules.transformSchema(schema)).names[-2:] == ["prediction", "prediction_tu"]
    with pytest.raises(ValueError, match="missing"):
        rules.transformSchema(df.schema)
    with pytest.raises(ValueError, match="missing"):
        CategoricalIndexer(labelCol="z").fit(df)
    with pytest.raises(ValueError, match="exists already"):
        rules.transformSchema(tuning.transformSchema(rules.transformSchema(schema)))
    with pytest.raises(ValueError, match="rule classifier"):
        tuning.fit(df.selectExpr("*", "1.0D as prediction"))
    model = indexer.fit(df)
    with pytest.raises(TypeError):
        model.transform(df.selectExpr("x", "1 as c", "y"))


def test_arrays_of_different_sizes_and_three_classes(spark):
    rows = [([0.1, 0.2], [1, 1], "a"), ([0.1], [1], "b")]
    df = spark.createDataFrame(rows, "f array<double>, l array<int>, y string")
    with pytest.raises(ValueError, match="different sizes"):
        FuzzyRuleClassifier(featuresCol="f", labelsCol="l").fit(df)
    three = spark.createDataFrame([([0.1], [1], c) for c in "abc"], df.schema)
    with pytest.raises(ValueError, match="two-class"):
        FuzzyRuleClassifier(featuresCol="f", labelsCol="l").fit(three)
