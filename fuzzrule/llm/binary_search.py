"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, each with a table from segment value to rows.
By the pigeonhole principle, a code within Hamming distance d of the query
has a segment within floor(d / segments).  For each query the search radius
of the segments grows one segment at a time; all rows found are verified, and
the query ends when its k-th verified distance is provably covered.

On Spark: equal codes are collapsed first (with their k smallest ids, found
by a partial top-k before the shuffle), and the distinct codes are dealt by
hash into blocks; every block is searched for every query.  Queries meet the
blocks in two rounds.  Each query's own block gives an upper bound of its
k-th distance; the other blocks then return only rows within that bound.

Defined cases: rows with a null id, a null vector or a vector of another
length than ``dim`` are neither queries nor found; NaN and null elements count
as not positive; ties go to the smaller id; a query does not find itself (its
id), but finds other rows of the same code; fewer than k rows give fewer
results; rows that repeat an id count once, with the smallest code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import Deal, read_table, written


def sign_codes(vectors: DataFrame, id_col: str, vec_col: str, dim: int = 64) -> DataFrame:
    """(id, code): bit i of the 64-bit code is set where element i is positive."""
    if dim > 64:
        raise ValueError("codes hold up to 64 bits")
    bit = F.expr(f"aggregate(sequence(0, {dim - 1}), 0L, (c, i) -> c | shiftleft("
                 f"if(`{vec_col}`[i] > 0 and not isnan(`{vec_col}`[i]), 1L, 0L), i))")
    ok = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim))
    return ok.select(F.col(id_col).cast("long").alias("id"), bit.alias("code")).groupBy("id").agg(F.min("code").alias("code"))


class SegmentIndex:
    """Segment tables over one block of distinct codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = codes
        width = max(1, min(16, int(np.log2(max(2, len(codes))))))
        self.m = -(-bits // width)
        self.widths = [bits // self.m + (i < bits % self.m) for i in range(self.m)]
        at = np.concatenate(([0], np.cumsum(self.widths)))
        self.shift = at[:-1].astype(np.uint64)
        self.tables, self.masks = [], {}
        for i, w in enumerate(self.widths):
            value = self.segment(codes, i)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << w) + 1))))
            if w not in self.masks:
                every = np.arange(1 << w)
                ones = np.bitwise_count(every)
                self.masks[w] = [every[ones == r] for r in range(w + 1)]

    def segment(self, codes: np.ndarray, i: int) -> np.ndarray:
        return ((codes >> self.shift[i]) & np.uint64((1 << self.widths[i]) - 1)).astype(np.int64)

    def near(self, query: np.uint64, enough) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances, grown until ``enough(sorted distances, covered)``:
        every row within ``covered`` of the query has been verified by then."""
        seen = np.zeros(len(self.codes), dtype=bool)
        rows, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(max(self.widths) + 1):
            for i, w in enumerate(self.widths):
                if r > w:
                    continue
                order, first = self.tables[i]
                probe = self.masks[w][r] ^ int(self.segment(query, i))
                lo, n = first[probe], first[probe + 1] - first[probe]
                lo, n = lo[n > 0], n[n > 0]
                if len(n):
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    new = order[at]
                    new = new[~seen[new]]
                    seen[new] = True
                    rows = np.concatenate((rows, new))
                    dist = np.concatenate((dist, np.bitwise_count(self.codes[new] ^ query).astype(np.int64)))
                # segments 0..i are searched to r, the others to r - 1
                if enough(dist, self.m * r + i):
                    return rows, dist
        return rows, dist


def _search(bits: int, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: codes of one block (code, ids); right: queries (q, qcode, bound)."""
        out = {"q": [], "id": [], "d": []}
        if len(left) and len(right):
            codes = left["code"].to_numpy(dtype=np.int64).view(np.uint64)
            ids = left["ids"].to_numpy()
            index = SegmentIndex(codes, bits)
            many = np.array([len(x) for x in ids])
            for q, code, bound in zip(right["q"], right["qcode"].to_numpy(dtype=np.int64).view(np.uint64), right["bound"]):
                need = k + 1  # the query itself may be among them

                def enough(dist, covered, bound=bound, need=need):
                    if covered >= bound:
                        return True
                    return len(dist) >= need and int((dist <= covered).sum()) >= need

                rows, dist = index.near(code, enough)
                near = dist <= bound
                rows, dist = rows[near], dist[near]
                if not len(rows):
                    continue
                # only the nearest codes can hold the k best ids: each holds one at least
                if len(dist) > need:
                    cut = np.partition(dist, need - 1)[need - 1]
                    rows, dist = rows[dist <= cut], dist[dist <= cut]
                flat = np.concatenate([ids[x] for x in rows]).astype(np.int64)
                far = np.repeat(dist, many[rows])
                flat, far = flat[flat != q], far[flat != q]
                best = np.lexsort((flat, far))[:k]
                out["q"] += [q] * len(best)
                out["id"] += flat[best].tolist()
                out["d"] += far[best].tolist()
        return pd.DataFrame(out).astype({"q": "int64", "id": "int64", "d": "int32"})
    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, block_rows: int = 1 << 17,
          min_blocks: int = 24) -> DataFrame:
    """(query_id, rank, neighbour_id, distance) of each query's ``k`` nearest
    codes by (Hamming distance, id).

    ``codes`` and ``queries``: (id, code).  ``block_rows`` bounds a block's
    memory; ``min_blocks`` only spreads small tables over more tasks.
    """
    # the k + 1 smallest ids of a code: no other can be among the k best
    # (one may be the query).  The rank limit is also applied before the shuffle.
    few = codes.withColumn("__n", F.expr("row_number() over (partition by code order by id)")).where(F.col("__n") <= k + 1)
    distinct = written(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    blocks = max(min_blocks, -(-distinct.count() // block_rows))
    deal = Deal(distinct.sparkSession, blocks)
    key_of = lambda code: deal.key(F.pmod(F.xxhash64(code), F.lit(blocks)))
    index = distinct.withColumn("block", key_of("code")).repartition(deal.tasks, "block")
    q = written(queries.select(F.col("id").alias("q"), F.col("code").alias("qcode")), "queries")
    found = "q long, id long, d int"
    own = q.select(key_of("qcode").alias("block"), "q", "qcode", F.lit(bits).alias("bound"))
    search = lambda w: (index.groupBy("block").cogroup(w.repartition(deal.tasks, "block").groupBy("block"))
                        .applyInPandas(_search(bits, k), found))
    first = written(search(own), "first")
    bound = first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).select(
        "q", F.when(F.col("n") >= k, F.col("d")).otherwise(bits).alias("bound"))
    rest = (q.join(bound, "q", "left").select(
        "q", "qcode", F.coalesce("bound", F.lit(bits)).alias("bound"),
        key_of("qcode").alias("__own"), F.explode(deal.every()).alias("block"))
        .where("block <> __own").drop("__own"))
    both = first.unionAll(search(rest))
    rank = F.expr("row_number() over (partition by q order by d, id)")
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias("neighbour_id"), F.col("d").alias("distance"))


K = 10


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every vector whose id is divisible by 50."""
    codes = written(sign_codes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "sign_codes")
    return top_k(codes, codes.where("id % 50 = 0"), K)
