"""Table sources: header-less CSV/.dat folds, Parquet, and the two-class
views built from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: StructType | str | None = None, header: bool = False) -> DataFrame:
    """CSV-like files (``.csv``/``.dat``) are read header-less with inferred
    types unless a schema is given (avoids the inference pass); Parquet and
    ORC by their own readers.  The class is the last column by convention."""
    fmt = fmt or _format_of(path)
    if fmt in ("csv", "dat", "data", "txt"):
        r = spark.read.option("header", str(header).lower())
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
        return r.csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return spark.read.format(fmt).load(path) if schema is None else \
        spark.read.format(fmt).schema(schema).load(path)


def _format_of(path: str) -> str:
    tail = path.rstrip("/").rsplit(".", 1)
    return tail[1].lower() if len(tail) == 2 and "/" not in tail[1] else "parquet"


def fold_paths(base: str, directory: str, name: str, fold: int, ext: str,
               k: int = 5) -> tuple[str, str]:
    """Precomputed k-fold files ``<base>/<dir>/<name>-<k>-<fold>{tra,tst}.<ext>``."""
    stem = f"{base.rstrip('/')}/{directory}/{name}-{k}-{fold}"
    return f"{stem}tra.{ext}", f"{stem}tst.{ext}"


def read_fold(spark: SparkSession, base: str, directory: str, name: str, fold: int,
              ext: str = "dat", k: int = 5, schema=None) -> tuple[DataFrame, DataFrame]:
    tra, tst = fold_paths(base, directory, name, fold, ext, k)
    fmt = "csv" if ext in ("dat", "csv", "data", "txt") else ext
    return (read_table(spark, tra, fmt, schema), read_table(spark, tst, fmt, schema))


def write_fold(df: DataFrame, is_test: Column, base: str, directory: str, name: str, fold: int, ext: str = "dat",
               k: int = 5) -> None:
    """Write the two header-less files of a fold (the class as last column)."""
    tra, tst = fold_paths(base, directory, name, fold, ext, k)
    marked = df.withColumn("__test", is_test)
    for path, part in ((tra, ~F.col("__test")), (tst, F.col("__test"))):
        marked.where(part).drop("__test").write.mode("overwrite").option("header", "false").csv(path)


def fold_of(id_col: Column, k: int = 5) -> Column:
    """Fold number 1..k of a row from its integer id (every row in one fold)."""
    return (F.pmod(id_col, F.lit(k)) + 1).cast("int")


# ------------------------------------------------ two-class views of the driver tables

def _pq(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: four numeric features, class ``l_linestatus`` (F/O)."""
    return _pq(spark, sf_dir, "lineitem").select(*LINEITEM_FEATURES, "l_linestatus")


def documents_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with text statistics over the whole text: id, n_chars,
    n_lines, upper_share, uniq_share, lang."""
    docs = _pq(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"\w+"), 0)
    n_words = F.size(words)
    text_len = F.length("text")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("n_chars"),
        (text_len - F.length(F.regexp_replace("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.try_divide(F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double"),
                     F.greatest(text_len, F.lit(1)).cast("double")).alias("upper_share"),
        F.try_divide(F.size(F.array_distinct(words)).cast("double"),
                     F.greatest(n_words, F.lit(1)).cast("double")).alias("uniq_share"),
        F.col("lang"))


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: the documents that have a quality label, with it (for learning;
    scoring takes all of ``documents_features``)."""
    labels = _pq(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return documents_features(spark, sf_dir).join(labels, "id")


def flags_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: documents with a quality label, described by boolean features too."""
    docs = _pq(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = _pq(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return docs.select(F.col("doc_id").alias("id"), "n_chars", F.contains("text", F.lit(" | ")).alias("has_bar"),
                       F.contains("text", F.lit("\n")).alias("has_lines"), (F.col("n_chars") > 1000).alias("is_long")).join(labels, "id")


def with_missing(docs: DataFrame) -> DataFrame:
    """M: values blanked by a rule on the id (null and NaN numbers)."""
    i = F.col("id")
    return docs.withColumns({"n_chars": F.when(i % 7 != 0, F.col("n_chars")),
                             "upper_share": F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.col("upper_share"))})


EMBEDDING_DIMS = 64


def embeddings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: all embedding dimensions as doubles, class ``label < 5``."""
    e = _pq(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    *[F.element_at("embedding", j + 1).cast("double").alias(f"e{j}")
                      for j in range(EMBEDDING_DIMS)],
                    (F.col("label") < 5).cast("int").alias("low"))
