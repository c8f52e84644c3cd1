"""Helpers of the training-data operators: shared folder, written tables,
table reading, word tokens and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the white space of the word and line contracts
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_OWN: dict[str, str] = {}
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder of our
    own only where that is unset on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        path = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[sc.applicationId] = path
    return "file://" + _OWN[sc.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    top = _SCRATCH[-1] if _SCRATCH else f"{shared_dir(spark)}/llm"
    return f"{top}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts
    the lineage, survives lost executors, and gives the planner a size."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so when
    their plans are collected as garbage, which an idle driver puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """A folder for the tables written inside, deleted at the end.  Yields a
    function that writes the result outside of it and reads it back."""
    outer = _SCRATCH[-1] if _SCRATCH else f"{shared_dir(spark)}/llm"
    folder = f"{outer}/{uuid.uuid4().hex}"
    _SCRATCH.append(folder)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{outer}/{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    try:
        yield keep
    finally:
        _SCRATCH.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        tidy(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Deal:
    """Deals ``n`` numbered groups to tasks: up to ``FEW`` groups get keys that
    hash partitioning puts into different partitions, so no two share a task;
    more of them go by their numbers, several to a task."""

    FEW, TASKS = 2048, 20_000

    def __init__(self, spark: SparkSession, n: int):
        self.n, self.tasks, first, span = n, min(n, self.TASKS), {}, 4 * n + 64
        while n <= self.FEW and len(first) < n:
            rows = (spark.range(span, numPartitions=1).select(F.col("id").alias("k"))
                    .groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect())
            first, span = {r.p: r.k for r in rows}, span * 4
        self.keys = [first[p] for p in range(n)] if first else None

    def key(self, number):
        """The key of a group's number (from 0)."""
        if self.keys is None:
            return number.cast("long")
        return F.element_at(F.array(*[F.lit(k).cast("long") for k in self.keys]), (number + 1).cast("int"))

    def every(self):
        """The keys of all groups, as an array."""
        if self.keys is None:
            return F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long"))
        return F.array(*[F.lit(k).cast("long") for k in self.keys])


def ascii_lower(col):
    """A-Z lower-cased, every other character kept (``lower`` would also
    change other scripts; it is used where the text is plain ASCII)."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def give_back() -> None:
    """At the end of a Python task: memory that it freed goes back to the system,
    as Spark keeps the worker process (where the C library can do that)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- words as 64-bit numbers (numpy, for use inside tasks) ------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse: kept for a usual piece, made anew
    for the rare longer one."""
    if n > 2 * _PIECE:
        return _powers(_BASE, n), _powers(_INV, n)
    if "p" not in _POW or len(_POW["p"]) < n:
        _POW["p"], _POW["i"] = _powers(_BASE, max(n, 1 << 16)), _powers(_INV, max(n, 1 << 16))
    return _POW["p"], _POW["i"]


_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[[32, 9, 10, 11, 12, 13]] = True
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~_SPACE_TABLE[data], [False])).view(np.int8)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values,
    from prefix sums, so a text costs a few vector passes.  Spans must not
    overlap a piece border; texts are cut into pieces at word ends."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        # words that start within one piece; a longer word makes a longer piece
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _PIECE)))
        piece = data[base:int(ends[to - 1])]
        n = len(piece) + 1
        power, inverse = _tables(n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[piece] * power[:n - 1])))
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _M1)
        at = to
    return out


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """The text's words as 64-bit hashes, A-Z lower-cased; null: no words."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if lower:
        data = _LOWER_TABLE[data]
    return span_hashes(data, *word_spans(data))


def word_runs(texts, spans=word_spans, run_bytes: int = 1 << 20):
    """The words of many texts, some at a time: (number of the first text, word
    hashes, first[i]:first[i + 1] being those of the run's i-th text)."""
    run, size, at = [], 0, 0
    for i, text in enumerate(texts):
        run.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1])
        if size >= run_bytes or i == len(texts) - 1:
            data = _LOWER_TABLE[np.frombuffer(b"\n".join(run) + b"\n", dtype=np.uint8)]
            starts, ends = spans(data)
            bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in run]))
            yield at, span_hashes(data, starts, ends), np.concatenate(([0], bounds))
            run, size, at = [], 0, i + 1


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in sequence."""
    h = np.full(max(0, len(words) - n + 1), np.uint64(n), dtype=np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k:k + len(h)])
    return h


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles as sorted 64-bit hashes; fewer than n words:
    the whole sequence as one; no words: none."""
    return np.unique(ngram_hashes(words, min(n, len(words)))) if len(words) else words


def shingle_sets(texts, n: int):
    """(number of the text, its shingle set) of each text, texts read in runs."""
    for at, words, first in word_runs(texts):
        grams = ngram_hashes(words, n)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            yield at + i, np.unique(grams[a:b - n + 1]) if b - a >= n else shingle_hashes(words[a:b], n)


# ---- connected components ----------------------------------------------------

def _content(edges: DataFrame) -> tuple:
    """Row count and order-free 128-bit content hash of a (u, v) table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v).

    Alternating large-star and small-star steps on DataFrames, each step
    written to the shared folder; nothing but a changed-row count reaches the
    driver.  Hub nodes are reduced by partial aggregation (a minimum).
    Nodes without an edge do not appear; an empty edge table gives none.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                             F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour is linked to the smallest one
        large = (both.join(written(low, "low"), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # small star: each smaller neighbour, and the node, to the smallest
        j = large.join(low, "u")
        small = (j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        small = written(small, "small")
        same = _content(small) == _content(e)
        e = small
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        own.select("node", F.col("node").alias("component")))
