"""Line dedup across documents (native: SQL functions only).

Lines are normalised and hashed; keys found in many documents lose their
lines everywhere but in the largest document id that holds them; the other
lines are put together again by position.

Two light tables are shuffled before the text moves: (key hash, id) pairs to
count distinct documents, and the positions of the lines to drop.  Counting
is map-side combined, so a line that a third of the documents share costs a
row per task; the join with the shared keys is left to AQE's skew split.

Defined cases: a null or empty text is one empty line (never dropped); rows
with a null id are not counted as documents and lose shared lines; rows that
repeat an id are one document for the count and are each cleaned; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import SPACE, ascii_lower, read_table, written


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(k, id, row hash, pos) of each line long enough to count."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"),
                        F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = line_key(F.col("line"))
    # the raw line bounds the key's length: most short lines go without a key
    return (lines.where(F.char_length("line") >= min_chars).select("id", "row", "pos", key.alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("k"), "id", "row", "pos"))


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(k, keep): hashes of keys in at least ``min_docs`` documents, and the
    largest id that holds each."""
    pairs = _keyed(docs, id_col, text_col, min_chars).where("id is not null").select("k", "id").distinct()
    return (pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
            .where(F.col("n") >= min_docs).select("k", "keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` with ``__lines`` (all lines), ``__dropped`` (positions, sorted)
    and ``__kept`` (the text without the dropped lines)."""
    shared = written(shared_lines(docs, id_col, text_col, min_docs, min_chars), "shared_lines")
    drops = (_keyed(docs, id_col, text_col, min_chars).join(shared, "k")
             .where(~F.col("id").eqNullSafe(F.col("keep")))
             .groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("__dropped")))
    drops = written(drops, "drops").withColumnsRenamed({"id": "__id", "row": "__row"})
    lines = docs.withColumn("__row", F.xxhash64(text_col))
    out = lines.join(drops.withColumnRenamed("__row", "__row2"),
                     F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__row2")), "left")
    # the stretches between dropped positions, in linear time
    kept = F.expr("if(__dropped is null, __lines, flatten(zip_with("
                  "concat(array(-1), __dropped), concat(__dropped, array(size(__lines))), "
                  "(a, b) -> slice(__lines, a + 2, b - a - 1))))")
    return (out.withColumn("__lines", lines_of(F.col(text_col)))
            .withColumn("__kept", F.array_join(kept, "\n")).drop("__id", "__row", "__row2"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size("__lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))
