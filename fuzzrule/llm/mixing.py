"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked until their
marginals match the targets; each document is then kept with a probability
that depends on its cell alone.  One pass over the texts counts words.  A cell
table of at most ``SMALL`` rows is fitted in memory; a larger one by the same
steps on DataFrames, written once per cycle, with map-side combined sums.

No cell can give more than its tokens.  So the rate is first lowered to
``HEADROOM`` of the largest at which every single target could be met; then a
cell that reaches its tokens is held there, and the others are raked to the
rest of each target.  Fitting ends when every marginal is within ``TOLERANCE``
of its target, looked at every ``EVERY`` cycles, or after ``CYCLES``; ``mix_report`` lists targets and what
was reached.

Targets: a share per value (a dict; values without one get 0), or an exponent
a: shares in proportion to tokens ** a, which lowers the hot values.

Defined cases: null source, language or topic form a value of their own; a
null or empty text has 0 words, so it is kept with its cell's probability
(the plain rate where the cell has no words); rows that repeat an id are kept
or dropped together; targets that contradict each other (met one by one, not
together) are missed and listed as such; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzrule.llm.common import SPACE, read_table, scratch, written

# topic by the first marker that a text holds
TOPICS = (("table", " | "), ("notice", "icense"), ("contact", "@"), ("assignment", " = "))
DIMS = ("source", "lang", "topic")


def topic_of(text: Column, topics=TOPICS, other: str = "prose") -> Column:
    out = F.lit(other)
    for name, marker in reversed(topics):
        out = F.when(F.contains(text, F.lit(marker)), name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "[ \\t-\\r]+", -1))).cast("long")


def _shares(cells: DataFrame, dim: str, target) -> DataFrame:
    """(dim, target tokens) of a marginal; they sum to all tokens."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    if isinstance(target, dict):
        pairs = [x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]
        part = F.coalesce(F.element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0))
    else:
        part = F.pow(F.col("t").cast("double"), F.lit(float(target)))
    parts = sums.select(dim, part.alias("part"))
    tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    whole = parts.agg(F.sum("part")).first()[0] or 1.0
    return parts.select(dim, (F.col("part") * (float(tokens) / whole)).alias("target"))


# the mix of the query and the pipeline
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
RATE, SEED = 0.5, "mix-1:"
CYCLES, EVERY, TOLERANCE, HEADROOM = 24, 4, 0.005, 0.95
SMALL = 1 << 16


def feasible_rate(cells: DataFrame, goals: dict, rate: float) -> float:
    """``rate``, or the share of it at which each value has tokens enough."""
    for d, goal in goals.items():
        own = cells.groupBy(d).agg(F.sum("tokens").alias("t")).join(goal.where("target > 0"), d)
        least = own.agg(F.min(F.col("t") / F.col("target"))).first()[0]
        rate = rate if least is None else min(rate, HEADROOM * least)
    return rate


def _sums(w: DataFrame, d: str, goal: DataFrame) -> DataFrame:
    """(d, target, held, free): of a value, the weight at its cells' tokens and the rest."""
    held = F.col("weight") >= F.col("most") * (1 - 1e-9)
    sums = w.groupBy(d).agg(F.sum(F.when(held, F.col("weight")).otherwise(0.0)).alias("held"),
                            F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("free"))
    return sums.join(goal, d, "left").select(d, F.coalesce("target", F.lit(0.0)).alias("target"), "held", "free")


def _raked(w: DataFrame, d: str, goal: DataFrame) -> DataFrame:
    part = F.when(F.col("held") + F.col("free") > 0, F.col("target") / (F.col("held") + F.col("free"))).otherwise(0.0)
    rest = F.when(F.col("free") > 0, F.greatest(F.col("target") - F.col("held"), F.lit(0.0)) / F.col("free")).otherwise(1.0)
    ratio = _sums(w, d, goal).select(d, part.alias("__all"), rest.alias("__free"))
    weight = (F.when(F.col("__all") < 1, F.col("weight") * F.col("__all"))
              .when(F.col("weight") >= F.col("most") * (1 - 1e-9), F.col("weight")).otherwise(F.col("weight") * F.col("__free")))
    return w.join(ratio, d).withColumn("weight", F.least("most", weight)).drop("__all", "__free")


def marginals(w: DataFrame, goals: dict) -> DataFrame:
    """(dim, value, target, reached): tokens before the rate."""
    parts = [_sums(w, d, goal).select(F.lit(d).alias("dim"), F.col(d).alias("value"), "target", (F.col("held") + F.col("free")).alias("reached"))
             for d, goal in goals.items()]
    return parts[0] if len(parts) == 1 else parts[0].unionAll(marginals(w, dict(list(goals.items())[1:])))


def rake(cells: DataFrame, goals: dict, rate: float, small: int = SMALL) -> DataFrame:
    """``cells`` (dims, tokens) with ``weight`` (raked tokens, the rate times
    which are kept) and ``most``, its bound.  ``goals``: (value, target) by dim."""
    if cells.count() <= small:
        return _rake_here(cells, goals, rate)
    w = cells.withColumn("weight", F.col("tokens").cast("double")).withColumn("most", F.col("tokens") / F.lit(float(rate)))
    for cycle in range(CYCLES):
        for d, goal in goals.items():
            w = _raked(w, d, goal)
        w = written(w.select(*cells.columns, "weight", "most").coalesce(4), "raked")
        if cycle % EVERY == EVERY - 1:
            off = marginals(w, goals).where("target > 0").agg(F.max(F.abs(F.col("reached") / F.col("target") - 1))).first()[0]
            if off is None or off <= TOLERANCE:
                break
    return w


def _rake_here(cells: DataFrame, goals: dict, rate: float) -> DataFrame:
    """The steps of ``_raked`` on a cell table of a checked size."""
    pdf = cells.toPandas()
    tokens = pdf["tokens"].to_numpy(dtype=float)
    most, w = tokens / rate, tokens.copy()
    dims = []
    for d, goal in goals.items():
        of, values = pd.factorize(pdf[d])
        target = {r[d]: r["target"] for r in goal.collect()}
        dims.append((of, np.array([target.get(v, 0.0) for v in values])))
    for cycle in range(CYCLES):
        for of, target in dims:
            at = w >= most * (1 - 1e-9)
            held, free = (np.bincount(of, np.where(at == side, w, 0.0), len(target)) for side in (True, False))
            every = np.divide(target, held + free, out=np.zeros_like(target), where=held + free > 0)
            rest = np.divide(np.maximum(target - held, 0), free, out=np.ones_like(target), where=free > 0)
            w = np.minimum(most, np.where(every[of] < 1, w * every[of], np.where(at, w, w * rest[of])))
        if cycle % EVERY == EVERY - 1:
            off = [np.abs(np.bincount(of, w, len(t))[t > 0] / t[t > 0] - 1) for of, t in dims]
            if max((x.max() for x in off if len(x)), default=0) <= TOLERANCE:
                break
    if not len(pdf):
        return cells.withColumns({"weight": F.lit(0.0), "most": F.lit(0.0)})
    schema = T.StructType([*cells.schema.fields, T.StructField("weight", T.DoubleType()), T.StructField("most", T.DoubleType())])
    return cells.sparkSession.createDataFrame(pdf.assign(weight=w, most=most), schema)


def with_probability(docs: DataFrame, cells: DataFrame, rate: float, id_col: str, seed: str) -> DataFrame:
    """``docs`` (with the dims) plus ``probability`` and ``selected``."""
    return docs.join(_probabilities(cells, rate), list(DIMS), "left").withColumn("selected", _number_of(id_col, seed) < F.col("probability"))


def _probabilities(cells: DataFrame, rate: float) -> DataFrame:
    return cells.select(*DIMS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * F.col("weight") / F.col("tokens")))
                        .otherwise(F.lit(rate)).alias("probability"))


def _number_of(id_col: str, seed: str) -> Column:
    """A number from 0 to 1 by hash of the id."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def _dims(docs: DataFrame, source: str, lang: str, text: str) -> list[Column]:
    none = F.lit("(none)")
    return [F.coalesce(F.col(source), none).alias("source"), F.coalesce(F.col(lang), none).alias("lang"),
            F.when(F.col(text).isNull(), none).otherwise(topic_of(F.col(text))).alias("topic")]


def mixed_documents(docs: DataFrame, targets=None, rate: float = RATE, id_col: str = "doc_id",
                    source: str = "source", lang: str = "lang", text: str = "text", seed: str = SEED) -> DataFrame:
    """(id, source, lang, topic, n_tokens, probability, selected) of each row."""
    with scratch(docs.sparkSession) as keep:
        return keep(_mixed(docs, targets or TARGETS, rate, id_col, source, lang, text, seed), "mixed")


def _mixed(docs, targets, rate, id_col, source, lang, text, seed) -> DataFrame:
    light = written(docs.select(F.col(id_col).alias("__id"), *_dims(docs, source, lang, text),
                                word_count(F.col(text)).alias("n_tokens")), "light")
    cells = written(light.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    w, rate, _ = _fitted(cells, targets, rate)
    return with_probability(light, w, rate, "__id", seed).withColumnRenamed("__id", id_col)


def _fitted(cells: DataFrame, targets: dict, rate: float) -> tuple[DataFrame, float, dict]:
    goals = {d: written(_shares(cells, d, t).coalesce(1), f"target_{d}") for d, t in targets.items()}
    rate = feasible_rate(cells, goals, rate)
    return rake(cells, goals, rate), rate, goals


def mix_report(docs: DataFrame, targets=None, rate: float = RATE, source: str = "source", lang: str = "lang",
               text: str = "text") -> DataFrame:
    """(dim, value, target, reached, met, rate): shares asked for and reached, of
    each value, and the rate that they are sampled at."""
    with scratch(docs.sparkSession) as keep:
        cells = written(docs.select(*_dims(docs, source, lang, text), word_count(F.col(text)).alias("n"))
                        .groupBy(*DIMS).agg(F.sum("n").alias("tokens")), "cells")
        w, rate, goals = _fitted(cells, targets or TARGETS, rate)
        tokens = float(cells.agg(F.sum("tokens")).first()[0] or 1)
        met = F.abs(F.col("reached") - F.col("target")) <= 2 * TOLERANCE * F.col("target")
        return keep(marginals(w, goals).select("dim", "value", (F.col("target") / tokens).alias("target"), (F.col("reached") / tokens).alias("reached"),
                                               met.alias("met"), F.lit(rate).alias("rate")), "report")


def sample_documents(docs: DataFrame, targets=None, rate: float = RATE, id_col: str = "doc_id", source: str = "source",
                     lang: str = "lang", text: str = "text", seed: str = SEED) -> DataFrame:
    """The selected rows of ``docs``, with its own columns.  Rows meet the cell
    table, not a table of ids, so texts are not shuffled."""
    dims = _dims(docs, source, lang, text)
    with scratch(docs.sparkSession) as keep:
        cells = written(docs.select(*dims, word_count(F.col(text)).alias("n_tokens"))
                        .groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
        w, rate, _ = _fitted(cells, targets or TARGETS, rate)
        per = keep(_probabilities(w, rate).coalesce(1), "probabilities").withColumnsRenamed({d: f"__{d}" for d in DIMS})
    marked = docs.withColumns({f"__{d}": c for d, c in zip(DIMS, dims)})
    return (marked.join(per, [f"__{d}" for d in DIMS]).where(_number_of(id_col, seed) < F.col("probability")).select(*docs.columns))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed_documents(read_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "selected")
