"""Feature preparation: column roles, boolean casts, categorical and class
indexing, min-max scaling and fuzzification.

Everything is fitted with a fixed number of passes over the table:

* one pass that estimates the distinct values of all string features;
* one ``StringIndexer`` fit for those of at most ``DRIVER_VALUES`` values and the
  class column (one aggregation pass).  The index of a feature with more values
  is a table in the shared folder, numbered over range partitions and joined to
  the data (Spark broadcasts it only below its own size), so its values never
  reach the driver; and
* one global aggregate for per-feature min/max and the class counts.

The transform is a pure projection (plus the skip of unseen categories),
so it stays inside one whole-stage-codegen span and works on any input,
including a streaming DataFrame.

Internal columns: ``_z{j}`` scaled feature j, ``_l{j}`` its label, ``_y`` the
class index (0.0 / 1.0).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzrule.functions.membership import label_col
from fuzzrule.session import ensure_checkpoint_dir

Y = "_y"
# features with more distinct values are indexed by a table
DRIVER_VALUES = 100_000


def zcol(j: int) -> str:
    return f"_z{j}"


def lcol(j: int) -> str:
    return f"_l{j}"


def split_columns(df: DataFrame, label: str | None = None,
                  features: list[str] | None = None,
                  exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str], str]:
    """(numeric features, string features, class column).  Default class is
    the last column; default features are all other columns."""
    cols = [c for c in df.columns if c not in exclude]
    if label is None:
        label = cols[-1]
    if features is None:
        features = [c for c in cols if c != label]
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric, cats = [], []
    for c in features:
        t = types[c]
        if isinstance(t, T.StringType):
            cats.append(c)
        elif isinstance(t, (T.NumericType, T.BooleanType)):
            numeric.append(c)
        else:
            raise TypeError(f"feature {c!r} has unsupported type {t.simpleString()}")
    return numeric, cats, label


def finite(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Floating-point features with NaN and infinity as null (missing)."""
    floats = [c for c in numeric if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    # NaN sorts above infinity, so one comparison leaves both out
    return df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in floats}) if floats else df


INDEX = "v string, idx double"


def index_table(df: DataFrame, c: str) -> str:
    """The path of the table (v, idx) of a feature's values: by falling number
    of rows, then by value, numbered without gathering them."""
    from fuzzrule.operators.mine import positions
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    numbered, _ = positions(counts, [], [F.col("n").desc(), F.col("v")])
    place = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/category-index/{uuid.uuid4().hex}"
    numbered.select("v", F.col("_pos").cast("double").alias("idx")).write.parquet(place)
    return place


def with_own_tables(spark, prep: dict, path: str) -> dict:
    """A preparation's state with its index tables copied below ``path``."""
    labels = list(prep.get("cat_labels", ()))
    for i, place in enumerate(labels):
        if isinstance(place, str):
            labels[i] = f"{path}/categories/{i}"
            spark.read.schema(INDEX).parquet(place).write.mode("overwrite").parquet(labels[i])
    return {**prep, "cat_labels": labels} if labels else prep


@dataclass
class Preparer:
    """Fitted preparation: index maps, min/max and class facts."""

    numeric: list[str]
    categorical: list[str]
    label: str
    cat_labels: list          # per string feature its values in order, or the path of its index table
    class_labels: list[str]
    mins: list[float]
    maxs: list[float]
    n_rows: int
    n_class0: int
    n_class1: int
    n_labels: int

    @property
    def feature_names(self) -> list[str]:
        """Antecedent order: numeric features first, then indexed strings."""
        return list(self.numeric) + [f"{c}_indexed" for c in self.categorical]

    @property
    def d(self) -> int:
        return len(self.numeric) + len(self.categorical)

    @property
    def majority(self) -> float:
        """Class 0.0 unless class 1.0 has strictly more rows (ties go to 0.0)."""
        return 0.0 if self.n_class0 >= self.n_class1 else 1.0

    # ------------------------------------------------------------ transform
    def _cat_model(self) -> StringIndexerModel | None:
        few = [(c, x) for c, x in zip(self.categorical, self.cat_labels) if not isinstance(x, str)]
        if not few:
            return None
        return StringIndexerModel.from_arrays_of_labels(
            [x for _, x in few], inputCols=[c for c, _ in few],
            outputCols=[f"{c}_indexed" for c, _ in few], handleInvalid="skip")

    def _class_model(self) -> StringIndexerModel:
        return StringIndexerModel.from_arrays_of_labels(
            [self.class_labels], inputCols=[self.label], outputCols=[Y], handleInvalid="skip")

    def index(self, df: DataFrame) -> DataFrame:
        """Boolean casts + category/class indexing; rows with unseen or null
        categories (or class) are skipped, as in the fitted indexers."""
        bools = [c for c in self.numeric
                 if isinstance(df.schema[c].dataType, T.BooleanType)]
        if bools:
            df = df.withColumns({c: F.col(c).cast("int") for c in bools})
        df = finite(df, self.numeric)
        m = self._cat_model()
        if m is not None:
            df = m.transform(df)
        for c, place in zip(self.categorical, self.cat_labels):
            if isinstance(place, str):  # an inner join leaves unseen and null values out
                table = df.sparkSession.read.schema(INDEX).parquet(place)
                df = df.join(table.select(F.col("v").alias(f"__{c}"), F.col("idx").alias(f"{c}_indexed")), F.col(c) == F.col(f"__{c}")).drop(f"__{c}")
        if self.label in df.columns:
            # two known class values: a CASE (codegen) instead of an indexer
            # UDF; rows with another or a null class are skipped
            v = F.col(self.label).cast("string")
            y = (F.when(v == F.lit(self.class_labels[0]), F.lit(0.0))
                  .when(v == F.lit(self.class_labels[1]), F.lit(1.0)))
            df = df.withColumn(Y, y).filter(F.col(Y).isNotNull())
        return df

    def scaled(self, j: int, df_col: Column) -> Column:
        lo, hi = self.mins[j], self.maxs[j]
        if hi == lo:
            return F.lit(0.5)
        return (df_col.cast("double") - F.lit(lo)) / F.lit(hi - lo)

    def transform(self, df: DataFrame, keep: list[str] | None = None,
                  arrays: bool = False, training: bool = False) -> DataFrame:
        """Project to ``keep`` + ``_z*`` + ``_l*`` (+ ``_y`` when the class
        column is present).  ``arrays`` also adds ``features_arr``/``labels``.
        A missing number (null, NaN, infinite) stays null here; ``training``
        leaves such rows out, as the fit does."""
        keep = list(keep) if keep is not None else []
        # kept columns come out as they came in
        df = self.index(df.withColumns({f"__keep_{c}": F.col(c) for c in keep if c in self.numeric}))
        names = self.feature_names
        if training:
            for c in names:
                df = df.filter(F.col(c).isNotNull())
        z = [self.scaled(j, F.col(c)).alias(zcol(j)) for j, c in enumerate(names)]
        cols = [F.col(f"__keep_{c}").alias(c) if c in self.numeric else F.col(c) for c in keep] + z
        if Y in df.columns:
            cols.append(F.col(Y))
        out = df.select(*cols)
        out = out.withColumns({lcol(j): label_col(F.col(zcol(j)), self.n_labels)
                               for j in range(self.d)})
        if arrays:
            out = out.withColumns({
                "features_arr": F.array(*[F.col(zcol(j)) for j in range(self.d)]),
                "labels": F.array(*[F.col(lcol(j)) for j in range(self.d)]),
            })
        return out

    def to_dict(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def from_dict(cls, d: dict) -> "Preparer":
        return cls(**d)


def fit_preparer(df: DataFrame, n_labels: int = 3, label: str | None = None,
                 features: list[str] | None = None,
                 exclude: tuple[str, ...] = ()) -> Preparer:
    numeric, cats, label = split_columns(df, label, features, exclude)
    if not cats:
        return _fit_numeric(df, numeric, label, n_labels)
    # One StringIndexer fit for all string features and the class column.
    work = df
    tmp_label = label
    if not isinstance(df.schema[label].dataType, T.StringType):
        # the class is always indexed through its string form
        tmp_label = "__class_str"
        work = work.withColumn(tmp_label, F.col(label).cast("string"))
    estimates = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cats]).first()
    many = {c for c in cats if estimates[c] > DRIVER_VALUES}
    inputs = [c for c in cats if c not in many] + [tmp_label]
    si = StringIndexer(inputCols=inputs, outputCols=[f"__idx{i}" for i in range(len(inputs))],
                       handleInvalid="skip", stringOrderType="frequencyDesc").fit(work)
    labels_arr = [list(x) for x in si.labelsArray]
    class_labels = labels_arr.pop()
    cat_labels = [index_table(df, c) if c in many else labels_arr.pop(0) for c in cats]
    _check_two(class_labels, label)
    prep = Preparer(numeric, cats, label, cat_labels, class_labels, [], [], 0, 0, 0, n_labels)
    indexed = prep.index(df)
    for c in prep.feature_names:
        indexed = indexed.filter(F.col(c).isNotNull())
    names = prep.feature_names
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(Y) == 0).alias("n0")]
    for j, c in enumerate(names):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"mn{j}"), F.max(x).alias(f"mx{j}")]
    row = indexed.agg(*aggs).first()
    prep.n_rows = int(row["n"])
    prep.n_class0 = int(row["n0"])
    prep.n_class1 = prep.n_rows - prep.n_class0
    prep.mins = [float(row[f"mn{j}"]) for j in range(len(names))]
    prep.maxs = [float(row[f"mx{j}"]) for j in range(len(names))]
    return prep


def _check_two(class_labels: list, label: str) -> None:
    if len(class_labels) != 2:
        raise ValueError(f"two-class problems only; column {label!r} has "
                         f"{len(class_labels)} distinct value(s)")


def _fit_numeric(df: DataFrame, numeric: list[str], label: str, n_labels: int) -> Preparer:
    """No string features: class index, class counts and per-feature min/max
    from a single aggregate grouped by the class value (at most 3 groups
    reach the driver).  Same order as the indexer: count desc, then value."""
    cls = F.col(label).cast("string")
    rows = finite(df.filter(cls.isNotNull()), numeric)
    for c in numeric:
        rows = rows.filter(F.col(c).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for j, c in enumerate(numeric):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"mn{j}"), F.max(x).alias(f"mx{j}")]
    groups = rows.groupBy(cls.alias("v")).agg(*aggs).limit(3).collect()
    ordered = sorted(groups, key=lambda r: (-r["n"], r["v"]))
    class_labels = [r["v"] for r in ordered]
    _check_two(class_labels, label)
    mins = [min(float(r[f"mn{j}"]) for r in ordered) for j in range(len(numeric))]
    maxs = [max(float(r[f"mx{j}"]) for r in ordered) for j in range(len(numeric))]
    n0, n1 = int(ordered[0]["n"]), int(ordered[1]["n"])
    return Preparer(numeric, [], label, [], class_labels, mins, maxs, n0 + n1, n0, n1, n_labels)


def fuzzify(prep: Preparer, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Public fuzzify step: input columns + ``features_arr`` + ``labels``."""
    return prep.transform(df, keep=keep if keep is not None else
                          [c for c in df.columns if c != Y], arrays=True)
