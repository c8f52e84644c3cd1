"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of its whole text is encoded
(statistics of its words and bytes, then a small hidden layer); gated
attention, learned from document labels alone, weighs the passages, and the
weighted representation is scored.

Every text is encoded once and its features are written; fit and scoring read
those.  The network is fitted on all labelled documents with all their passages:
in each step of L-BFGS the tasks add up loss and gradient over their documents,
and the driver holds the 697 parameters and their sums.  Scoring is map-only:
documents are never gathered, and memory per task is one batch of texts.

Defined cases: a null or empty text is one passage without words; null or
repeated labels count once per document (the largest), null ones not at all;
with no labels the score is 0.5, with labels of one class that class's share
(smoothed); rows that repeat an id are scored one by one; a null id takes part
in scoring, not in training; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import give_back, read_table, scratch, span_hashes, word_spans, written

PASSAGE_WORDS = 64
BYTES_AT_ONCE = 2 << 20

# byte classes of the encoder
_CLASSES = np.zeros((6, 256), dtype=bool)
_CLASSES[0, 97:123] = True                                   # small letters
_CLASSES[1, 65:91] = True                                    # capitals
_CLASSES[2, 48:58] = True                                    # digits
_CLASSES[3, [ord(c) for c in ".,;:'\"()-?"]] = True          # marks of prose
_CLASSES[4, [ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~!"]] = True  # other signs
_CLASSES[5, 128:] = True                                     # beyond ASCII
N_FEATURES = 25


def _batches(texts: list[str]):
    """Runs of texts of about BYTES_AT_ONCE."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= BYTES_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the passages per text."""
    parts = [_passages([(t or "").encode("utf-8", "surrogatepass") for t in run]) for run in _batches(texts)]
    if not parts:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_spans(data)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    text_end = np.cumsum(lengths + 1)
    first = np.concatenate(([0], np.searchsorted(starts, text_end)))
    words = np.diff(first)
    bags = np.maximum(1, -(-words // PASSAGE_WORDS))
    out = np.zeros((int(bags.sum()), N_FEATURES), dtype=np.float32)
    offset = np.concatenate(([0], np.cumsum(bags)[:-1]))
    out[offset[words == 0], 0] = 1.0
    if not len(starts):
        return out, bags
    text = np.repeat(np.arange(len(texts)), words)
    nth = np.arange(len(starts)) - first[text]
    passage = offset[text] + nth // PASSAGE_WORDS
    head = np.flatnonzero(np.diff(passage, prepend=-1))
    row = passage[head]
    n = np.diff(np.append(head, len(starts))).astype(np.float64)
    mean = lambda x: np.add.reduceat(x.astype(np.float64), head) / n
    size = ends - starts
    total = np.add.reduceat(size.astype(np.float64), head)
    h = span_hashes(data, starts, ends)
    begin, last = data[starts], data[ends - 1]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])))
    two = np.concatenate(([False, False], (h[2:] == h[:-2]) & (text[2:] == text[:-2])))
    # distinct words of the passage and of the whole text
    order = np.lexsort((h, passage))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.zeros(len(h))
    distinct[order] = fresh
    whole = np.lexsort((h, text))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[whole][1:] != h[whole][:-1]) | (text[whole][1:] != text[whole][:-1])
    in_text = np.bincount(text[whole], new, minlength=len(texts)) / np.maximum(words, 1)
    # the commonest word's share of the passage
    run = np.flatnonzero(fresh)
    common = np.zeros(len(out))
    np.maximum.at(common, passage[order][run], np.diff(np.append(run, len(h))))
    columns = [np.log1p(n), np.log(mean(size) + 1), mean(size == 1), mean(size >= 12)]
    sums = np.zeros((len(_CLASSES), len(starts)))
    for k, c in enumerate(_CLASSES):
        cum = np.concatenate(([0], np.cumsum(c[data])))
        sums[k] = cum[ends] - cum[starts]
        columns.append(np.add.reduceat(sums[k], head) / total)
    columns += [mean(sums[1] + (sums[5] > 0) >= np.maximum(2, size * 0.6)), mean(sums[4] > 0), mean(sums[4] == size),
                mean((sums[4] > 0) & (_CLASSES[4][last])), mean(_CLASSES[1][begin]), mean(_CLASSES[3][last]), mean(sums[2] > 0),
                mean(same), mean(two), mean(distinct), common[row] / n, in_text[text[head]],
                np.log1p(words[text[head]]), mean(np.concatenate(([False], (data[starts[1:] - 1] == 10) & (text[1:] == text[:-1]))))]
    out[row, 1:1 + len(columns)] = np.stack(columns, axis=1)
    return out, bags


class AttentionModel:
    """tanh encoder, gated attention, and a logistic score of the weighted sum."""

    NAMES = ("w1", "b1", "v", "u", "a", "c", "c0")

    def __init__(self, mean, scale, hidden: int = 16, gate: int = 8, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {"w1": r.normal(0, 0.3, (len(mean), hidden)), "b1": np.zeros(hidden), "v": r.normal(0, 0.3, (hidden, gate)),
                  "u": r.normal(0, 0.3, (hidden, gate)), "a": r.normal(0, 0.3, gate), "c": r.normal(0, 0.3, hidden),
                  "c0": np.zeros(1)}

    def forward(self, x, bags):
        p, first = self.p, np.concatenate(([0], np.cumsum(bags)[:-1]))
        bag = np.repeat(np.arange(len(bags)), bags)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-(z @ p["c"] + p["c0"][0])))
        return score, (x, h, t, s, alpha, z, bag, first)

    def sums(self, x, bags, y):
        """Loss and gradient, summed over the bags."""
        p = self.p
        score, (x, h, t, s, alpha, z, bag, first) = self.forward(x, bags)
        d = score - y
        dz = d[:, None] * p["c"]
        dalpha = (dz[bag] * h).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        dt, ds = de[:, None] * p["a"] * s * (1 - t ** 2), de[:, None] * p["a"] * t * s * (1 - s)
        dh = alpha[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - h ** 2)
        g = {"w1": x.T @ dx, "b1": dx.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (de[:, None] * t * s).sum(0),
             "c": z.T @ d, "c0": np.array([d.sum()])}
        return -np.log(np.maximum(np.where(y, score, 1 - score), 1e-300)).sum(), g

    def gradient(self, x, bags, y, decay: float):
        g = self.sums(x, bags, y)[1]
        return {k: v / len(y) + decay * self.p[k] for k, v in g.items()}

    def flat(self, p=None) -> np.ndarray:
        """The parameters (or their gradient) as one vector."""
        p = p or self.p
        return np.concatenate([p[k].ravel() for k in self.NAMES])

    def at(self, vector: np.ndarray) -> "AttentionModel":
        """The model with the parameters of a vector."""
        parts = np.split(vector, np.cumsum([self.p[k].size for k in self.NAMES])[:-1])
        self.p = {k: v.reshape(self.p[k].shape) for k, v in zip(self.NAMES, parts)}
        return self


def minimised(loss, p: np.ndarray, steps: int, memory: int = 10, enough: float = 1e-4) -> np.ndarray:
    """The least point that L-BFGS finds; ``loss`` gives value and gradient.  It
    ends after ``steps`` steps, where no gradient is above ``enough``, or where
    no shorter step is better."""
    f, g = loss(p)
    pairs = []
    for _ in range(steps):
        if np.abs(g).max() <= enough:
            break
        d, back = -g, []
        for s, y in reversed(pairs):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else min(1.0, 1 / np.linalg.norm(g)))
        for (s, y), b in zip(pairs, reversed(back)):
            d = d + (b - (y @ d) / (s @ y)) * s
        for k in range(8):
            to = p + d * 0.4 ** k
            f2, g2 = loss(to)
            if f2 <= f + 1e-4 * (g @ (to - p)):
                break
        else:
            break
        if (to - p) @ (g2 - g) > 1e-12:
            pairs = [*pairs, (to - p, g2 - g)][-memory:]
        p, f, g = to, f2, g2
    return p


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


BAGS = "id string, row long, x binary"
RUN_PASSAGES = 4096


def _encode(batches):
    """The features of all passages of each text."""
    for pdf in batches:
        for at in range(0, len(pdf), 200):
            part = pdf.iloc[at:at + 200]
            x, bags = passages(part["text"].tolist())
            yield part.drop(columns="text").assign(x=[b.tobytes() for b in np.split(x, np.cumsum(bags)[:-1])])
    give_back()


def encoded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return written(rows.mapInPandas(_encode, BAGS), "bags")


def _runs(batches):
    """Some rows at a time, with the features of their passages and the passages per row."""
    for pdf in batches:
        bags = np.array([len(x) for x in pdf["x"]], dtype=np.int64) // (4 * N_FEATURES)
        run = (np.cumsum(bags) - bags) // RUN_PASSAGES
        for own in np.split(np.arange(len(bags)), np.flatnonzero(np.diff(run)) + 1):
            if len(own):
                part = pdf.iloc[own]
                yield part, np.frombuffer(b"".join(part["x"]), np.float32).reshape(-1, N_FEATURES).astype(np.float64), bags[own]


def _summed(train: DataFrame, add) -> np.ndarray:
    """The sum of what ``add`` gives for the runs of all rows."""
    def run(batches):
        total = None
        for part in _runs(batches):
            own = add(*part)
            total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"m": [total.tobytes()]})
        give_back()
    return np.sum([np.frombuffer(r["m"]) for r in train.mapInPandas(run, "m binary").collect()], axis=0)  # some KB a task


def _moments(part, x, bags):
    return np.concatenate(([len(x)], x.sum(0), (x ** 2).sum(0)))


def fit_quality(bags: DataFrame, labels: DataFrame, id_col: str, label_col: str, steps: int = 60, decay: float = 1e-4):
    """The model fitted on all labelled rows, or a constant score where there is
    nothing to learn."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(F.col(label_col)).cast("double").alias("label")))
    train = written(bags.join(known, "id").select("label", "x"), "train")
    of = train.agg(F.count("label").alias("n"), F.sum("label").alias("sum"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if not of["n"] or of["lo"] == of["hi"]:
        return (of["sum"] + 1) / (of["n"] + 2) if of["n"] else 0.5
    n, *sums = np.split(_summed(train, _moments), [1, 1 + N_FEATURES])
    mean = sums[0] / n
    model = AttentionModel(mean, np.sqrt(np.maximum(sums[1] / n - mean ** 2, 0)) + 1e-3)

    def loss(p):
        model.at(p)

        def add(part, x, bags):
            f, g = model.sums(x, bags, part["label"].to_numpy() >= 0.5)
            return np.concatenate(([f], model.flat(g)))
        total = _summed(train, add) / of["n"]
        return total[0] + decay / 2 * (p @ p), total[1:] + decay * p
    return model.at(minimised(loss, model.flat(), steps))


def _score(model):
    def run(batches):
        m = model.value
        for part, x, bags in _runs(batches):
            yield part.drop(columns="x").assign(__score=m if isinstance(m, float) else m.forward(x, bags)[0])
        give_back()
    return run


SCORES = "id string, row long, __score double"


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", **how) -> DataFrame:
    """(row, score) for each row of ``docs``: its id, text hash and score."""
    with scratch(docs.sparkSession) as keep:
        scores, model = _scored(docs, labels, id_col, text_col, label_col, **how)
        scores = keep(scores, "scores")
        model.destroy()
    return scores


def _scored(docs, labels, id_col, text_col, label_col="quality", **how):
    bags = encoded(docs, id_col, text_col)
    m = fit_quality(bags, labels, id_col, label_col, **how)
    model = docs.sparkSession.sparkContext.broadcast(m if isinstance(m, AttentionModel) else float(m))
    return bags.mapInPandas(_score(model), SCORES), model


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5,
              **how) -> DataFrame:
    """``docs`` without the documents that score below ``least``."""
    with scratch(docs.sparkSession) as keep:
        scores, model = _scored(docs, labels, id_col, text_col, **how)
        bad = scores.where(F.col("__score") < least).select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
        bad = keep(bad, "rejected")
        model.destroy()
    same = F.col(id_col).cast("string").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__row"))
    return docs.join(bad, same, "left_anti")


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    doc = F.col("id").cast("long")
    return s.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), F.col("__score").alias("score"),
                    F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"))
