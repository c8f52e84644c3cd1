"""``pyspark.ml`` stages: indexing, fuzzification, rule learning and prototype
tuning, as Estimators and Models with ``Params``, schema checks and writers.

They chain in one ``Pipeline``::

    Pipeline(stages=[CategoricalIndexer(labelCol="y"), Fuzzifier(labelCol="y"),
                     FuzzyRuleClassifier(labelCol="y", featuresCol="features_arr"),
                     PrototypeTuning()])

A learned rule base is written below ``spark.checkpoint.dir`` when it is fitted,
and the prediction column carries its place as column metadata, so the tuning
stage finds the rules of the stage before it in the schema alone.  Saving a
pipeline copies the rules (Parquet) into the saved stage.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, fields

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzrule.operators.prepare import Y, Preparer, fit_preparer, fuzzify, lcol, with_own_tables, zcol
from fuzzrule.params import RuleParams
from fuzzrule.plans.learner import RuleModel, learn, learn_prepared
from fuzzrule.session import ensure_checkpoint_dir

META = "rule_model"
FEATURES, LABELS = "features_arr", "labels"


# ---- parameters ------------------------------------------------------------------

_CONVERT = {"int": TypeConverters.toInt, "str": TypeConverters.toString, "bool": TypeConverters.toBoolean,
            "float": TypeConverters.toFloat, "float | None": TypeConverters.toFloat}


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


class _HasRuleParams(Params):
    """A ``Param`` for every field of :class:`RuleParams` (``nLabels``, ``useRw``, ...)."""

    def _set_rule_params(self, p: RuleParams) -> None:
        self._set(**{_camel(f.name): getattr(p, f.name) for f in fields(RuleParams) if getattr(p, f.name) is not None})

    def rule_params(self) -> RuleParams:
        have = {f.name: _camel(f.name) for f in fields(RuleParams)}
        return RuleParams(**{k: self.getOrDefault(v) for k, v in have.items() if self.isDefined(v)})


for _f in fields(RuleParams):
    setattr(_HasRuleParams, _camel(_f.name), Param(Params._dummy(), _camel(_f.name), f"see RuleParams.{_f.name}", _CONVERT[_f.type]))


class _HasFeatures(Params):
    featuresCols = Param(Params._dummy(), "featuresCols", "names of the features; unset: all columns but the class",
                         TypeConverters.toListString)
    featuresCol = Param(Params._dummy(), "featuresCol", "array of scaled features, with their labels in labelsCol",
                        TypeConverters.toString)
    labelsCol = Param(Params._dummy(), "labelsCol", "array of linguistic labels", TypeConverters.toString)


def _class_column(stage: Params, names: list[str]) -> str:
    return stage.getOrDefault("labelCol") if stage.isSet("labelCol") else names[-1]


def _need(schema: T.StructType, name: str, kinds: tuple, what: str) -> None:
    if name not in schema.names:
        raise ValueError(f"{what} {name!r} is missing; columns: {schema.names}")
    if kinds and not isinstance(schema[name].dataType, kinds):
        raise TypeError(f"{what} {name!r} has type {schema[name].dataType.simpleString()}")


def _added(schema: T.StructType, *new: T.StructField, without: tuple = ()) -> T.StructType:
    for f in new:
        if f.name in schema.names:
            raise ValueError(f"column {f.name!r} exists already")
    return T.StructType([f for f in schema.fields if f.name not in without] + list(new))


# ---- rows that come prepared ---------------------------------------------------

@dataclass
class ArrayPreparer:
    """In place of a :class:`Preparer` where features come as arrays of scaled
    values and labels, as :class:`Fuzzifier` makes them."""

    features: str
    labels: str
    label: str
    class_labels: list[str]
    n_rows: int
    n_class0: int
    n_labels: int
    names: list[str]

    @property
    def d(self) -> int:
        return len(self.names)

    @property
    def feature_names(self) -> list[str]:
        return list(self.names)

    @property
    def majority(self) -> float:
        return 0.0 if 2 * self.n_class0 >= self.n_rows else 1.0

    def transform(self, df: DataFrame, keep: list[str] | None = None, training: bool = False, **_) -> DataFrame:
        own = self.label in df.columns
        cols = [F.col(c) for c in keep or []]
        cols += [F.col(self.features)[j].alias(zcol(j)) for j in range(self.d)]
        cols += [F.col(self.labels)[j].alias(lcol(j)) for j in range(self.d)]
        if own:
            v = F.col(self.label).cast("string")
            cols.append(F.when(v == self.class_labels[0], 0.0).when(v == self.class_labels[1], 1.0).alias(Y))
        out = df.select(*cols)
        if own:
            out = out.where(F.col(Y).isNotNull())
        for j in range(self.d) if training else ():
            out = out.where(F.col(zcol(j)).isNotNull())
        return out

    def to_dict(self) -> dict:
        return {"array": True, **self.__dict__}


def fit_array_preparer(df: DataFrame, features: str, labels: str, label: str, n_labels: int) -> ArrayPreparer:
    rows = df.where(F.col(label).isNotNull() & F.forall(features, lambda x: x.isNotNull()))
    groups = rows.groupBy(F.col(label).cast("string").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("d"), F.min(F.size(features)).alias("least")).limit(3).collect()
    groups = sorted(groups, key=lambda r: (-r["n"], r["v"]))
    if len(groups) != 2:
        raise ValueError(f"two-class problems only; column {label!r} has {len(groups)} distinct value(s)")
    d = max(r["d"] for r in groups)
    if d != min(r["least"] for r in groups):
        raise ValueError(f"column {features!r} holds arrays of different sizes")
    names = (df.schema[features].metadata or {}).get("names") or [f"x{j}" for j in range(d)]
    return ArrayPreparer(features, labels, label, [r["v"] for r in groups], sum(r["n"] for r in groups), groups[0]["n"], n_labels, names)


# ---- writers ---------------------------------------------------------------------

class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_data(f"{path}/data")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out._load_data(self.sparkSession, f"{path}/data")
        return out


class _Saved(MLWritable, MLReadable):
    def write(self) -> _ModelWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> _ModelReader:
        return _ModelReader(cls)


def _write_text(spark, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


class _PreparedModel(Model, _Saved, HasLabelCol):
    """A model whose only state is a fitted preparation."""

    def __init__(self, prep: Preparer | None = None):
        super().__init__()
        self.prep = prep

    def _save_data(self, path: str) -> None:
        spark = SparkSession.active()
        _write_text(spark, f"{path}/prep", json.dumps(with_own_tables(spark, self.prep.to_dict(), path)))

    def _load_data(self, spark, path: str) -> None:
        self.prep = Preparer.from_dict(json.loads(spark.read.text(f"{path}/prep").first()[0]))


# ---- indexing and fuzzification ---------------------------------------------------

class CategoricalIndexerModel(_PreparedModel):
    """Replaces string features by ``<name>_indexed``; rows with an unseen or
    null value are left out."""

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        for c in self.prep.categorical:
            _need(schema, c, (T.StringType,), "feature")
        return _added(schema, *[T.StructField(f"{c}_indexed", T.DoubleType()) for c in self.prep.categorical],
                      without=tuple(self.prep.categorical))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        return self.prep.index(dataset).drop(*self.prep.categorical)


class CategoricalIndexer(Estimator, DefaultParamsWritable, DefaultParamsReadable, HasLabelCol):
    """Index string features (``<name>_indexed``) and the class column;
    unseen or null values are skipped.  ``excludeCols`` are passed through."""

    excludeCols = Param(Params._dummy(), "excludeCols", "columns that are no features", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, labelCol: str | None = None, excludeCols: list[str] | None = None):
        super().__init__()
        self._setDefault(excludeCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        rest = [f for f in schema.fields if f.name not in self.getOrDefault("excludeCols")]
        label = _class_column(self, [f.name for f in rest])
        _need(schema, label, (), "class column")
        strings = [f.name for f in rest if isinstance(f.dataType, T.StringType) and f.name != label]
        return _added(schema, *[T.StructField(f"{c}_indexed", T.DoubleType()) for c in strings], T.StructField(Y, T.DoubleType()),
                      without=tuple(strings))

    def _fit(self, dataset: DataFrame) -> CategoricalIndexerModel:
        self.transformSchema(dataset.schema)
        exclude = tuple(self.getOrDefault("excludeCols"))
        label = _class_column(self, [c for c in dataset.columns if c not in exclude])
        return CategoricalIndexerModel(fit_preparer(dataset, 3, label, exclude=exclude))


class FuzzifierModel(_PreparedModel):
    """Appends ``features_arr`` (scaled values, with the features' names as
    metadata) and ``labels`` (linguistic labels)."""

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        for c in self.prep.numeric:
            _need(schema, c, (T.NumericType, T.BooleanType), "feature")
        return _added(schema, T.StructField(FEATURES, T.ArrayType(T.DoubleType())), T.StructField(LABELS, T.ArrayType(T.IntegerType())))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        out = fuzzify(self.prep, dataset)
        out = out.withColumn(FEATURES, F.col(FEATURES).alias(FEATURES, metadata={"names": self.prep.feature_names}))
        return out.drop(*[c for j in range(self.prep.d) for c in (zcol(j), lcol(j))])


class Fuzzifier(Estimator, DefaultParamsWritable, DefaultParamsReadable, HasLabelCol):
    """Fits min/max scaling of all numeric columns but the class and
    ``excludeCols``."""

    nLabels = Param(Params._dummy(), "nLabels", "linguistic labels per variable", TypeConverters.toInt)
    excludeCols = Param(Params._dummy(), "excludeCols", "columns that are no features", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, nLabels: int = 3, labelCol: str | None = None, excludeCols: list[str] | None = None):
        super().__init__()
        self._setDefault(nLabels=3, excludeCols=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        exclude = [*self.getOrDefault("excludeCols"), Y]
        _need(schema, _class_column(self, [c for c in schema.names if c not in exclude]), (), "class column")
        return _added(schema, T.StructField(FEATURES, T.ArrayType(T.DoubleType())), T.StructField(LABELS, T.ArrayType(T.IntegerType())))

    def _fit(self, dataset: DataFrame) -> FuzzifierModel:
        self.transformSchema(dataset.schema)
        exclude = (*self.getOrDefault("excludeCols"), Y)
        label = _class_column(self, [c for c in dataset.columns if c not in exclude])
        return FuzzifierModel(fit_preparer(dataset, self.getOrDefault("nLabels"), label, exclude=exclude))


# ---- rules -------------------------------------------------------------------------

class FuzzyRuleClassifierModel(Model, _Saved, HasPredictionCol):
    """Appends ``predictionCol`` to the input columns.  With ``shifted`` the
    memberships are moved to the rules' prototypes."""

    shifted = Param(Params._dummy(), "shifted", "score with prototype-shifted memberships", TypeConverters.toBoolean)

    def __init__(self, model: RuleModel | None = None, predictionCol: str = "prediction", shifted: bool | None = None):
        super().__init__()
        self.model, self.place = model, None
        self._set(predictionCol=predictionCol)
        if shifted is not None:
            self._set(shifted=shifted)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        prep = self.model.prep
        if isinstance(prep, ArrayPreparer):
            _need(schema, prep.features, (T.ArrayType,), "features")
            _need(schema, prep.labels, (T.ArrayType,), "labels")
        else:
            for c in prep.numeric:
                _need(schema, c, (T.NumericType, T.BooleanType), "feature")
            for c in prep.categorical:
                _need(schema, c, (T.StringType,), "feature")
        return _added(schema, T.StructField(self.getPredictionCol(), T.DoubleType()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        name = self.getPredictionCol()
        shifted = self.getOrDefault("shifted") if self.isSet("shifted") else None
        # the class index is made anew where the class column is there
        keep = [c for c in dataset.columns if c != Y or self.model.prep.label not in dataset.columns]
        out = self.model.transform(dataset, keep=keep, shifted=shifted, out=name)
        return out.select(*[F.col(c).alias(c, metadata=dataset.schema[c].metadata) for c in dataset.columns],
                          F.col(name).alias(name, metadata={META: self._place(dataset.sparkSession)}))

    def _place(self, spark) -> str:
        """Where the rules lie below the shared folder (written once)."""
        if self.place is None:
            place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rule-models/{uuid.uuid4().hex}"
            save_rules(self.model, place)
            self.place = place
        return self.place

    def _save_data(self, path: str) -> None:
        save_rules(self.model, path)

    def _load_data(self, spark, path: str) -> None:
        self.model, self.place = load_rules(spark, path), path


def save_rules(model: RuleModel, path: str) -> None:
    model.save(path)


def load_rules(spark, path: str) -> RuleModel:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    prep = meta["prep"]
    prep = ArrayPreparer(**{k: v for k, v in prep.items() if k != "array"}) if prep.get("array") else Preparer.from_dict(prep)
    return RuleModel(prep, RuleParams(**meta["params"]), spark.read.parquet(f"{path}/rules"))


class FuzzyRuleClassifier(Estimator, DefaultParamsWritable, DefaultParamsReadable, _HasRuleParams, _HasFeatures, HasLabelCol,
                          HasPredictionCol):
    """Learns a rule base: from the columns named in ``featuresCols`` (unset: all
    but the class), or from the arrays that :class:`Fuzzifier` made, with
    ``featuresCol``.  Every field of ``RuleParams`` is a ``Param``."""

    def __init__(self, params: RuleParams | None = None, labelCol: str | None = None, featuresCols: list[str] | None = None,
                 predictionCol: str = "prediction", featuresCol: str | None = None, labelsCol: str = LABELS):
        super().__init__()
        self._setDefault(labelsCol=LABELS)
        self._set_rule_params(params or RuleParams())
        given = {"labelCol": labelCol, "featuresCols": featuresCols, "predictionCol": predictionCol, "featuresCol": featuresCol,
                 "labelsCol": labelsCol}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        _need(schema, _class_column(self, schema.names), (), "class column")
        if self.isSet("featuresCol"):
            _need(schema, self.getOrDefault("featuresCol"), (T.ArrayType,), "features")
            _need(schema, self.getOrDefault("labelsCol"), (T.ArrayType,), "labels")
        for c in self.getOrDefault("featuresCols") if self.isSet("featuresCols") else ():
            _need(schema, c, (T.NumericType, T.BooleanType, T.StringType), "feature")
        return _added(schema, T.StructField(self.getPredictionCol(), T.DoubleType()))

    def _fit(self, dataset: DataFrame) -> FuzzyRuleClassifierModel:
        self.transformSchema(dataset.schema)
        p, label = self.rule_params(), _class_column(self, dataset.columns)
        if self.isSet("featuresCol"):
            features, labels = self.getOrDefault("featuresCol"), self.getOrDefault("labelsCol")
            prep = fit_array_preparer(dataset, features, labels, label, p.n_labels)
            model = learn_prepared(prep, dataset.select(features, labels, label), p)
        else:
            model = learn(dataset, p, label, self.getOrDefault("featuresCols") if self.isSet("featuresCols") else None)
        model.release()
        return FuzzyRuleClassifierModel(model, self.getPredictionCol())


class PrototypeTuning(Estimator, DefaultParamsWritable, DefaultParamsReadable, HasPredictionCol):
    """Scores the rule base of the classifier before it with memberships that
    are shifted to the rules' prototypes (``prediction_tu``).  It finds the rules
    by the metadata of ``baseCol``, or takes a fitted classifier."""

    baseCol = Param(Params._dummy(), "baseCol", "prediction column of the classifier before", TypeConverters.toString)

    def __init__(self, base: FuzzyRuleClassifierModel | None = None, baseCol: str = "prediction", predictionCol: str = "prediction_tu"):
        super().__init__()
        self.base = base
        self._set(baseCol=baseCol, predictionCol=predictionCol)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        if self.base is None:
            _need(schema, self.getOrDefault("baseCol"), (T.DoubleType,), "prediction column")
        return _added(schema, T.StructField(self.getPredictionCol(), T.DoubleType()))

    def _fit(self, dataset: DataFrame) -> FuzzyRuleClassifierModel:
        self.transformSchema(dataset.schema)
        if self.base is not None:
            model = self.base.model
        else:
            place = (dataset.schema[self.getOrDefault("baseCol")].metadata or {}).get(META)
            if place is None:
                raise ValueError(f"column {self.getOrDefault('baseCol')!r} does not come from a rule classifier")
            model = load_rules(dataset.sparkSession, place)
        return FuzzyRuleClassifierModel(model, self.getPredictionCol(), shifted=True)
