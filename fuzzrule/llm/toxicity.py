"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of the toxic and of the ordinary labelled texts, are
compared.  A word is read as ``^word$``; a character's context is what precedes
it in its word, at most five characters.  The longest grams are counted by
class and discounted; the discounted mass goes to one backoff distribution that
both classes share (interpolated Kneser-Ney over the number of distinct
characters before a gram, pooled), so a rare expression that neither class
explains says nothing about the class.  A document has the difference of the
two log-likelihoods per word; its strongest words and the mass above
``STRONG`` nats a word enter too.  A logistic curve over these, fitted on
labelled rows that were kept out of the counts, turns them into a score.

On Spark: words are counted map-side and summed over all labelled rows of the
corpus, every count and probability is a DataFrame, and a difference is a fixed
point integer, so sums do not depend on the order of rows.  The finished table
(gram, value) is broadcast only when it has at most ``max_grams`` rows (then
at most 12 bytes each); a larger one is joined to the distinct words, with the
same integers as a result.

Defined cases: a null or empty text, or one without letters and digits, has no
words and gets the curve's value at zero evidence; runs of letters and digits
are cut into words of at most 64 code points, so a run of any length is read
whole; null or repeated labels count once per document (the largest), null ones
not at all; without labels the score is 0.5, with labels of one class that
class's share (smoothed); rows that repeat an id are scored one by one; a null
id is scored, not learned from; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import mix, read_table, scratch, written

ORDER = 6
DISCOUNT = 0.75
UNIT = 1 << 20          # fixed point: units in a nat
STRONG = 4
WORD = re.compile(r"[^\W_]{1,64}")
RUN_CHARS = 1 << 21
KEPT_WORDS = 1 << 19
FEATURES = ("mean", "evidence", "length", "short", "strongest", "excess", "log_excess")


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


# ---- counts ------------------------------------------------------------------

def _count_words(batches):
    """(word, ordinary, toxic) of a task's rows, handed on when many words wait."""
    both = (Counter(), Counter())

    def out():
        names = list(both[0].keys() | both[1].keys())
        part = pd.DataFrame({"word": names, "ordinary": [both[0][w] for w in names], "toxic": [both[1][w] for w in names]})
        both[0].clear()
        both[1].clear()
        return part
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            both[int(label)].update(words_of(text))
            if len(both[0]) + len(both[1]) > KEPT_WORDS:
                yield out()
    if both[0] or both[1]:
        yield out()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, ordinary, toxic) over all ``rows`` (text, label 0 or 1)."""
    part = rows.mapInPandas(_count_words, "word string, ordinary long, toxic long")
    return part.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _marked(word: str) -> str:
    return f"concat('^', {word}, '$')"


def _windows(word: str, order: int) -> str:
    """SQL array of the grams of a word: each character but the first mark,
    with up to order - 1 characters before it."""
    p = _marked(word)
    return (f"transform(sequence(2, length({p})), j -> substring({p}, greatest(1, j - {order - 1}), least(j, {order})))")


def shared_backoff(grams: DataFrame, order: int) -> DataFrame:
    """(gram, p): pooled Kneser-Ney probability of a gram's last character after
    the others, for all grams of up to ``order`` - 1 characters."""
    seen = grams.select(F.explode(F.expr("transform(sequence(2, length(gram)), k -> right(gram, k))")).alias("s")).distinct()
    ext = seen.groupBy(F.expr("substring(s, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    ext = ext.withColumn("ctx", F.expr("left(gram, length(gram) - 1)"))
    ext = written(ext.selectExpr("gram", "c", "sum(c) over (partition by ctx) as total", "count(1) over (partition by ctx) as types"),
                  "continuations")
    letters = ext.where("length(gram) = 1").count() + 1
    level, levels = None, []
    for k in range(1, order):
        now = ext.where(F.length("gram") == k)
        lower = F.lit(1.0 / letters)
        if level is not None:
            now = now.join(level.select(F.col("gram").alias("__g"), F.col("p").alias("__p")), F.expr("substring(gram, 2)") == F.col("__g"))
            lower = F.col("__p")
        level = now.select("gram", (((F.col("c") - DISCOUNT) + DISCOUNT * F.col("types") * lower) / F.col("total")).alias("p"))
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return written(out, "backoff")


def gram_values(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, kind, value): what the toxic log-likelihood of a character exceeds
    the ordinary one by, in units.  kind 0: a gram seen in training; kind 1: any
    other character after this context."""
    grams = written(words.select(F.explode(F.expr(_windows("word", order))).alias("gram"), "ordinary", "toxic")
                    .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams")
    p = shared_backoff(grams, order)
    g = grams.withColumn("ctx", F.expr("left(gram, length(gram) - 1)")).selectExpr(
        "gram", "ctx", "ordinary", "toxic",
        *[f"sum({c}) over (partition by ctx) as n_{c}" for c in ("ordinary", "toxic")],
        *[f"sum(least({c}, {DISCOUNT}D)) over (partition by ctx) as rest_{c}" for c in ("ordinary", "toxic")])
    g = written(g, "class_grams")
    left = {c: F.when(F.col(f"n_{c}") > 0, F.col(f"rest_{c}") / F.col(f"n_{c}")).otherwise(1.0) for c in ("ordinary", "toxic")}
    own = {c: F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0)
           for c in ("ordinary", "toxic")}
    units = lambda a, b: F.round(F.log(a / b) * UNIT).cast("int")
    p = p.select(F.col("gram").alias("__lower"), "p")
    seen = g.join(p, F.expr("substring(gram, 2)") == F.col("__lower")).select(
        "gram", F.lit(0).alias("kind"), units(own["toxic"] + left["toxic"] * F.col("p"), own["ordinary"] + left["ordinary"] * F.col("p")).alias("value"))
    other = g.select(F.col("ctx").alias("gram"), F.lit(1).alias("kind"), units(left["toxic"], left["ordinary"]).alias("value")).distinct()
    return written(seen.unionAll(other), "gram_values")


# ---- the value of words ------------------------------------------------------

_TAG = np.uint64(0xA0761D6478BD642F)


def _letter(codes: np.ndarray, back: int) -> np.ndarray:
    return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((back + 1) * 0xE7037ED1A0B428DB % (1 << 64)))


def gram_keys(grams: list[str], kinds: np.ndarray) -> np.ndarray:
    """64-bit keys of whole grams (see WordValues.score)."""
    out = np.zeros(len(grams), dtype=np.uint64)
    text = np.array([g[::-1] for g in grams], dtype=str)
    wide = text.view(np.uint32).reshape(len(grams), -1) if text.dtype.itemsize else np.zeros((len(grams), 0), np.uint32)
    size = np.array([len(g) for g in grams])
    for back in range(wide.shape[1]):
        out += np.where(size > back, _letter(wide[:, back], back), np.uint64(0))
    return mix(out + np.where(kinds == 1, _TAG, np.uint64(0)))


class WordValues:
    """Gram values as two sorted arrays; the value of a word is their sum."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, order: int):
        self.keys, self.values, self.order = keys, values, order

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at].astype(np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(w) + 2 for w in words])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        nth = np.arange(len(codes)) - np.repeat(first, size)
        gram, ctx = np.zeros(len(codes), np.uint64), np.full(len(codes), _TAG)
        before = None
        for back in range(self.order):
            now = _letter(codes, back)
            gram[back:] += np.where(nth[back:] >= back, now[:len(codes) - back], np.uint64(0))
            if back:
                ctx[back:] += np.where(nth[back:] >= back, before[:len(codes) - back], np.uint64(0))
            before = now
        known, value = self._find(mix(gram))
        other, rest = self._find(mix(ctx))
        value = np.where(known, value, np.where(other, rest, 0))
        value[first] = 0
        return np.add.reduceat(value, first)


def _keyed(batches):
    for pdf in batches:
        keys = gram_keys(pdf["gram"].tolist(), pdf["kind"].to_numpy())
        yield pd.DataFrame({"keys": [keys.tobytes()], "numbers": [pdf["value"].to_numpy(dtype=np.int32).tobytes()]})


def _values(table: DataFrame, order: int) -> WordValues:
    parts = table.mapInPandas(_keyed, "keys binary, numbers binary").collect()  # of a checked size
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in parts)])
    values = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["numbers"], np.int32) for r in parts)])
    at = np.argsort(keys)
    return WordValues(keys[at], values[at], order)


def _evidence(model):
    """Per row: words, their values' sum, the largest, and the sum above STRONG."""
    def run(batches):
        table, known = model.value, {}
        for pdf in batches:
            texts = pdf["text"].tolist()
            at, out = 0, []
            while at < len(texts):
                bags, size = [], 0
                while at < len(texts) and size < RUN_CHARS:
                    bags.append(words_of(texts[at]))
                    size += len(texts[at] or "")
                    at += 1
                new = list({w for bag in bags for w in bag if w not in known})
                if len(known) + len(new) > KEPT_WORDS:
                    known.clear()
                    new = list({w for bag in bags for w in bag})
                known.update(zip(new, table.score(new).tolist()))
                for bag in bags:
                    total, best, excess = 0, 0, 0
                    for w, n in bag.items():
                        v = known[w]
                        total += n * v
                        if v > best:
                            best = v
                            excess += n * (v - STRONG * UNIT) if v > STRONG * UNIT else 0
                        elif v > STRONG * UNIT:
                            excess += n * (v - STRONG * UNIT)
                    out.append((bag.total(), total, best, excess))
            yield pdf.drop(columns="text").assign(**dict(zip(("words", "total", "best", "excess"), zip(*out)))) if out else \
                pd.DataFrame(columns=["id", "row", "words", "total", "best", "excess"])
    return run


def _spread(batches):
    for pdf in batches:
        for id_, row, rid, text in zip(pdf["id"], pdf["row"], pdf["rid"], pdf["text"]):
            bag = words_of(text) or {None: 0}
            yield pd.DataFrame({"id": id_, "row": row, "rid": rid, "word": list(bag), "n": list(bag.values())})


def _evidence_by_join(rows: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """As ``_evidence``, with the gram table joined to the distinct words."""
    spread = written(rows.withColumn("rid", F.monotonically_increasing_id())
                     .mapInPandas(_spread, "id string, row long, rid long, word string, n long"), "spread")
    at = spread.where("word is not null").select("word").distinct().select("word", F.explode(F.expr(_windows("word", order))).alias("gram"))
    at = at.withColumn("ctx", F.expr("left(gram, length(gram) - 1)"))
    seen = table.where("kind = 0").select("gram", F.col("value").alias("v0"))
    other = table.where("kind = 1").select(F.col("gram").alias("ctx"), F.col("value").alias("v1"))
    words = at.join(seen, "gram", "left").join(other, "ctx", "left").groupBy("word").agg(
        F.sum(F.coalesce("v0", "v1", F.lit(0)).cast("long")).alias("v"))
    v = F.coalesce("v", F.lit(0))
    return spread.join(words, "word", "left").groupBy("rid", "id", "row").agg(
        F.sum("n").alias("words"), F.sum(F.col("n") * v).alias("total"), F.greatest(F.max(v), F.lit(0)).alias("best"),
        F.sum(F.col("n") * F.greatest(v - STRONG * UNIT, F.lit(0))).alias("excess")).drop("rid")


# ---- the score -----------------------------------------------------------------

def _features() -> list[Column]:
    n = F.greatest(F.col("words"), F.lit(1)).cast("double")
    total, best, excess = (F.col(c) / float(UNIT) for c in ("total", "best", "excess"))
    return [total / n, total / F.sqrt(n), F.log(n), 1 / F.sqrt(n), best, excess / n, F.log1p(excess)]


class Curve:
    """Logistic regression, fitted by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.5):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        b = np.zeros(z.shape[1])
        weight = np.r_[np.full(x.shape[1], ridge), 1e-6]

        def loss(b):
            m = z @ b
            return np.logaddexp(0, m).sum() - m[y].sum() + (weight * b * b).sum() / 2
        now = loss(b)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(weight + 1e-9), z.T @ (p - y) + weight * b)
            size = 1.0
            while size > 1e-4 and loss(b - size * step) > now:
                size /= 2
            b, before, now = b - size * step, now, loss(b - size * step)
            if before - now < 1e-9:
                break
        self.b = b

    def column(self, features: list[Column]) -> Column:
        m = F.lit(float(self.b[-1]))
        for f, mean, scale, b in zip(features, self.mean, self.scale, self.b):
            m = m + (f - float(mean)) / float(scale) * float(b)
        return 1 / (1 + F.exp(-m))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   order: int = ORDER, max_grams: int = 1 << 22, max_known: int = 1 << 22, max_curve: int = 20000) -> DataFrame:
    """A row per row of ``docs``: id (as text), row (hash of the text), words,
    total (the log-likelihood difference in units), best, excess, score.

    A fifth of the labelled rows, by hash, is kept out of the counts; of these
    at most ``max_curve`` fit the curve.  Counts take all others.  Label ids are
    broadcast when at most ``max_known``, else joined by a shuffle.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        known = written(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
                        .groupBy(F.col(id_col).cast("string").alias("__id"))
                        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
                        .withColumn("curve", F.pmod(F.xxhash64("__id"), F.lit(5)) == 0), "known")
        side = F.broadcast(known) if known.count() <= max_known else known
        rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
        counted = rows.select("id", "text").join(side.where("not curve"), F.col("id") == F.col("__id")).select("text", "label")
        table = gram_values(written(word_counts(counted), "words"), order)
        schema = "id string, row long, words long, total long, best long, excess long"
        if table.count() <= max_grams:
            model = spark.sparkContext.broadcast(_values(table, order))
            found = keep(rows.mapInPandas(_evidence(model), schema), "evidence")
            model.destroy()
        else:
            found = keep(_evidence_by_join(rows, table, order), "evidence")
        fit = found.join(side, F.col("id") == F.col("__id"))
        names = [f.alias(n) for f, n in zip(_features(), FEATURES)]

        def sample(part: DataFrame) -> pd.DataFrame:
            return (part.select("id", "row", "label", *names).orderBy(F.xxhash64("id"), "id", "row").limit(max_curve).toPandas())
        pdf = sample(fit.where("curve"))
        if pdf["label"].nunique() < 2:  # too few labels for a part of their own
            pdf = sample(fit)
    if pdf["label"].nunique() < 2:
        return found.withColumn("score", F.lit((float(pdf["label"].sum()) + 1) / (len(pdf) + 2) if len(pdf) else 0.5))
    curve = Curve(pdf[list(FEATURES)].to_numpy(dtype=float), pdf["label"].to_numpy() == 1)
    return found.withColumn("score", curve.column(_features()))


def op12_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    doc = F.col("id").cast("long")
    return s.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                    F.col("words").alias("n_words"), (F.col("total") / float(UNIT) / F.greatest("words", F.lit(1))).alias("log_ratio"))
