"""Hard-negative mining over rotated one-bit codes.

Every vector is floored to integers (``floor(scale * x)``), turned by one fixed
random rotation, and kept as the signs of the turned components: a code vector
c of unit length.  Stored with it are its alignment a = <x, c> and the length r
of the residual x - a c.  A query q is turned too and rounded to ``PLANES`` bits
a component, so its product with any code is a few popcounts over bit planes;
the rounding error is known.  Then

    <q, x> = a <q, c> + <q, x - a c>

where the residual is orthogonal to c, so by Cauchy-Schwarz the second term is
at most r times the length of the part of q orthogonal to c.  That is an
interval that holds the score with certainty.  Only candidates whose interval
can still matter (against the bounds proved by others) are scored, in integers.

Two searches use it: the first ``positives`` rows of the anchor's label, and for
each of them the first ``negatives`` rows of other labels with
low * positive <= 100 * negative <= high * positive.

On Spark: equal vectors of one label are collapsed with their smallest ids (no
more can be among the results), and dealt by hash into blocks; queries are dealt
into blocks too, and every pair of blocks is a group of its own, of bounded
size, on its own key.  Each returns what it has best, and a window over at most
``results x blocks`` rows a query merges them.

Defined cases: rows with a null id or label, a null or non-finite component, or
a vector of another length than ``dim`` take no part; so do rows with a
component of 2^24 or more after scaling, whose scores may not fit; rows that
repeat an id count once (the smallest label, then vector); the score of an
all-zero vector is 0; fewer rows give fewer results; a positive without
negatives in its range gives none; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import Deal, read_table, scratch, written

PLANES = 6
SEED = 11
LIMIT = 1 << 24


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


# ---- codes and intervals -------------------------------------------------------

class Codes:
    """One-bit codes of rotated integer vectors, with alignments and residuals."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        x = vectors.astype(np.float64) @ turn.T
        self.dim = x.shape[1]
        bits = x >= 0
        self.words = pack(bits)
        self.ones = bits.sum(1).astype(np.float64)
        self.align = np.abs(x).sum(1) / np.sqrt(self.dim)
        norm2 = (vectors.astype(np.float64) ** 2).sum(1)
        self.residual = np.sqrt(np.maximum(norm2 - self.align ** 2, 0))
        self.norm = np.sqrt(norm2)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words: (words, rows)."""
    n, dim = bits.shape
    wide = np.zeros((n, -(-dim // 64) * 64), dtype=np.uint8)
    wide[:, :dim] = bits
    return np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little").view(np.uint64).T)


def intervals(query: np.ndarray, turn: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Per code the least and the largest score that the query can have."""
    q = turn @ query.astype(np.float64)
    low, step = float(q.min()), float(q.max() - q.min()) / ((1 << PLANES) - 1)
    level = np.rint((q - low) / step).astype(np.int64) if step > 0 else np.zeros(len(q), np.int64)
    planes = pack(np.stack([(level >> j) & 1 for j in range(PLANES)]).astype(bool))
    counts = np.zeros(codes.words.shape[1])
    for j in range(PLANES):
        hits = np.zeros(codes.words.shape[1], dtype=np.int64)
        for w in range(len(planes)):
            hits += np.bitwise_count(codes.words[w] & planes[w, j])
        counts += hits * float(1 << j)
    # <rounded q, signs> = sum over set bits minus sum over the others
    rough = (low * (2 * codes.ones - codes.dim) + step * (2 * counts - float(level.sum()))) / np.sqrt(codes.dim)
    off = float(np.abs(q - (low + step * level)).sum()) / np.sqrt(codes.dim)
    length2 = float((q ** 2).sum())
    across = np.sqrt(np.maximum(length2 - np.maximum(np.abs(rough) - off, 0) ** 2, 0))
    half = codes.align * off + codes.residual * across
    half += 1e-9 * np.sqrt(length2) * codes.norm + 1e-6   # rounding of the arithmetic itself
    middle = codes.align * rough
    return middle - half, middle + half


# ---- one pair of blocks ----------------------------------------------------------

class Block:
    """Collapsed rows of one block, ordered by label."""

    def __init__(self, left: pd.DataFrame, turn: np.ndarray):
        left = left.sort_values("label", kind="stable")
        self.label = left["label"].to_numpy()
        self.vectors = np.array(left["vec"].tolist(), dtype=np.int64)
        self.ids = left["ids"].to_numpy()
        self.codes = Codes(self.vectors, turn)

    def part(self, lo: int, hi: int) -> Codes:
        out = object.__new__(Codes)
        out.dim, out.words = self.codes.dim, self.codes.words[:, lo:hi]
        for c in ("ones", "align", "residual", "norm"):
            setattr(out, c, getattr(self.codes, c)[lo:hi])
        return out

    def of_label(self, label) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))

    def listed(self, rows: np.ndarray, scores: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``few`` (scores, ids) of these rows.  A row has one id at
        least, so only rows that reach the few-th score (with its ties) count."""
        if len(rows) > few:
            top = scores >= np.partition(scores, len(scores) - few)[len(scores) - few]
            rows, scores = rows[top], scores[top]
        ids = [np.asarray(self.ids[r][:few], dtype=np.int64) for r in rows]
        many = [len(x) for x in ids]
        flat, s = (np.concatenate(ids), np.repeat(scores, many)) if ids else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((flat, -s))[:few]
        return s[order], flat[order]


def first_positives(block: Block, query: np.ndarray, label, anchor: int, k: int, turn: np.ndarray):
    lo, hi = block.of_label(label)
    if lo == hi:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, most = intervals(query, turn, block.part(lo, hi))
    need = k + 1  # the anchor may be among them
    bound = np.partition(least, len(least) - need)[len(least) - need] if len(least) > need else -np.inf
    rows = lo + np.flatnonzero(most >= bound)
    scores, ids = block.listed(rows, block.vectors[rows] @ query, need)
    keep = ids != anchor
    return scores[keep][:k], ids[keep][:k]


def within(positive: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def first_negatives(block: Block, query: np.ndarray, label, ranges: list[tuple[int, int]], k: int, turn: np.ndarray):
    """Per range (least, most) the first k rows of other labels: (scores, ids)."""
    least, most = intervals(query, turn, block.codes)
    lo, hi = block.of_label(label)
    other = np.ones(len(least), dtype=bool)
    other[lo:hi] = False
    wanted = np.zeros(len(least), dtype=bool)
    for a, b in ranges:
        can = other & (most >= a) & (least <= b)
        sure = least[can & (least >= a) & (most <= b)]
        if len(sure) >= k:  # these alone reach so far down
            can &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
        wanted |= can
    rows = np.flatnonzero(wanted)
    scores = block.vectors[rows] @ query
    out = []
    for a, b in ranges:
        inside = (scores >= a) & (scores <= b)
        out.append(block.listed(rows[inside], scores[inside], k))
    return out


def _positive_groups(dim: int, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            turn = rotation(dim)
            block = Block(left, turn)
            for anchor, label, vec in zip(right["anchor"], right["label"], right["vec"]):
                s, ids = first_positives(block, np.asarray(vec, dtype=np.int64), label, anchor, k, turn)
                out += [(anchor, i, x) for i, x in zip(ids.tolist(), s.tolist())]
        return pd.DataFrame(out, columns=["anchor", "id", "score"]).astype("int64")
    return run


def _negative_groups(dim: int, k: int, low: int, high: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            turn = rotation(dim)
            block = Block(left, turn)
            for anchor, label, vec, positives in zip(right["anchor"], right["label"], right["vec"], right["scores"]):
                caps = [int(p) for p in positives]
                ranges = [within(p, low, high) for p in caps]
                live = [(p, r) for p, r in zip(caps, ranges) if r[0] <= r[1]]
                if live:
                    found = first_negatives(block, np.asarray(vec, dtype=np.int64), label, [r for _, r in live], k, turn)
                    for (p, _), (s, ids) in zip(live, found):
                        out += [(anchor, p, i, x) for i, x in zip(ids.tolist(), s.tolist())]
        return pd.DataFrame(out, columns=["anchor", "positive_score", "id", "score"]).astype("int64")
    return run


# ---- the searches ------------------------------------------------------------------

def integer_vectors(rows: DataFrame, id_col: str, label: Column, vec_col: str, dim: int = 64, scale: int = 256) -> DataFrame:
    """(id, label, vec) of the rows that take part; vec is an array of integers."""
    x = "cast(x as double)"
    ok = (F.col(id_col).isNotNull() & label.isNotNull() & (F.size(vec_col) == dim)
          & F.expr(f"forall({vec_col}, x -> x is not null and not isnan({x}) and abs({x}) < {LIMIT / scale}D)"))
    return (rows.where(F.coalesce(ok, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                    F.expr(f"transform({vec_col}, x -> cast(floor({scale} * {x}) as int))").alias("vec"))
            .groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v")).select("id", "v.label", "v.vec"))


def mine(vectors: DataFrame, anchors: DataFrame, dim: int = 64, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         block_rows: int = 1 << 15, query_rows: int = 1 << 12, min_blocks: int = 24) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors``: (id, label, vec).  ``block_rows`` and
    ``query_rows`` bound a pair of blocks; ``min_blocks`` spreads small tables.
    """
    if not 0 < low <= high:
        raise ValueError("percentages must be positive and in order")
    spark = vectors.sparkSession
    few = max(positives + 1, negatives)
    with scratch(spark) as keep:
        # a partial limit runs before the shuffle, so a hot vector is cut map-side
        least = (vectors.withColumn("__n", F.expr("row_number() over (partition by label, vec order by id)")).where(F.col("__n") <= few)
                 .groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        index = written(least, "index")
        asked = written(anchors.select(F.col("id").alias("anchor"), "label", "vec"), "anchors")
        n_blocks = max(min_blocks, -(-index.count() // block_rows))
        n_asked = max(1, -(-asked.count() // query_rows))
        deal = Deal(spark, n_blocks * n_asked)
        pair = deal.key(F.col("__b") * n_asked + F.col("__q"))
        data = index.withColumn("__b", F.pmod(F.xxhash64("vec", "label"), F.lit(n_blocks))).withColumn(
            "__q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        data = data.withColumn("pair", pair).select("pair", "label", "vec", "ids")

        def dealt(q: DataFrame) -> DataFrame:
            q = q.withColumn("__q", F.pmod(F.xxhash64("anchor"), F.lit(n_asked))).withColumn(
                "__b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
            return q.withColumn("pair", pair).drop("__q", "__b")

        def search(q: DataFrame, function, schema: str) -> DataFrame:
            return (data.repartition(deal.tasks, "pair").groupBy("pair").cogroup(dealt(q).repartition(deal.tasks, "pair").groupBy("pair"))
                    .applyInPandas(function, schema))
        best = search(asked, _positive_groups(dim, positives), "anchor long, id long, score long")
        rank = F.expr("row_number() over (partition by anchor order by score desc, id)")
        best = written(best.withColumn("rank", rank).where(F.col("rank") <= positives).select(
            "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        caps = best.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
        found = search(asked.join(caps, "anchor"), _negative_groups(dim, negatives, low, high),
                       "anchor long, positive_score long, id long, score long")
        rank = F.expr("row_number() over (partition by anchor, positive_score order by score desc, id)")
        found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
        out = best.join(found, ["anchor", "positive_score"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        return keep(out, "negatives")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every vector whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    with scratch(spark) as keep:
        rows = written(rows, "vectors")
        return keep(mine(rows, rows.where("id % 50 = 0")), "hard_negatives")
