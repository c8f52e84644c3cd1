"""Inference: assign each row its winning rule or its class by aggregation.

The rule base is cut into blocks of ``block_rules`` rules in ``rule_id``
order.  A single block is broadcast; more of them are written as files below
``spark.checkpoint.dir`` by Spark tasks, and scoring tasks read them one at a
time with a running best, so neither the driver nor a task ever holds more
than one block.  Scoring is one map-only pass (an iterator pandas UDF): no
shuffle, no row id, streaming-safe, and the same result for any block size.

Within a block the rules are an index, not a list.  Plain memberships: rules
that share all antecedents but the last form one posting under that prefix; a
prefix is evaluated on the rows that it fires on, and only where its degree
can still beat the row's best.  Shifted memberships: rules are posted under
their first (feature, label), and a posting meets the rows within reach of its
prototypes.  So the work follows the rules that fire, not all rules.

Semantics: degree = product of memberships over the rule's antecedents
(x rule weight if ``use_rw``).  Winning rule: the largest degree above 0, the
first rule (by ``rule_id``) of equal ones; nothing fires -> majority class.
Aggregation: per-class sums of degrees, in fixed point (so any order gives the
same sum); the larger sum wins, a tie (within ``SUM_TIE``) or nothing ->
majority class.  With ``shifted`` memberships each triangle is moved so its
centre lies on the rule's prototype coordinate.  A missing value has
membership 0.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzrule.functions.membership import membership_table_np, trimf_np
from fuzzrule.functions.partition import width
from fuzzrule.operators.cells import acol
from fuzzrule.operators.prepare import zcol
from fuzzrule.session import ensure_checkpoint_dir

STATE = T.StructType([
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("cls", T.DoubleType()),
    T.StructField("md", T.DoubleType()),
    T.StructField("s0", T.DoubleType()),
    T.StructField("s1", T.DoubleType()),
])
# class sums closer than this are a tie, as for rule conflicts
SUM_TIE = 1e-9
# rules whose degrees are computed together
GROUP = 256
# class sums are kept in units of 2^-42
SUM_UNIT = float(1 << 42)
# rows that are scored together
ROWS = 1 << 13


@dataclass
class RuleSet:
    """One block of a rule base, in rule_id order."""

    ant: np.ndarray      # R x d int32
    cls: np.ndarray      # R float64
    rw: np.ndarray       # R float64
    proto: np.ndarray    # R x d float64 (NaN = missing)
    rule_id: np.ndarray  # R int32
    n_labels: int
    majority: float
    use_rw: bool = True
    extra: np.ndarray | None = None  # R float64, a further number per rule

    @property
    def size(self) -> int:
        return int(self.ant.shape[0])

    @classmethod
    def from_pandas(cls, pdf: pd.DataFrame, d: int, n_labels: int, majority: float,
                    use_rw: bool) -> "RuleSet":
        pdf = pdf.sort_values("rule_id")
        ant = pdf[[acol(j) for j in range(d)]].to_numpy(dtype=np.int32).reshape(len(pdf), d)
        proto = pdf[[f"proto_{j}" for j in range(d)]].astype("float64").to_numpy().reshape(len(pdf), d)
        extra = pdf["extra"].astype("float64").to_numpy() if "extra" in pdf else None
        return cls(ant=ant, cls=pdf["cls"].to_numpy(dtype=np.float64),
                   rw=pdf["rw"].astype("float64").fillna(0.0).to_numpy(),
                   proto=proto, rule_id=pdf["rule_id"].to_numpy(dtype=np.int32),
                   n_labels=n_labels, majority=float(majority), use_rw=use_rw, extra=extra)


class RuleBlocks:
    """The blocks of a rule base: one held here, or files that are read one at
    a time (``blocks[i]`` reads one)."""

    def __init__(self, one: RuleSet | None, folder: str | None, files: list[str], majority: float, n_labels: int, use_rw: bool):
        self.one, self.folder, self.files = one, folder, files
        self.majority, self.n_labels, self.use_rw = float(majority), n_labels, use_rw

    def __len__(self) -> int:
        return 1 if self.one is not None else len(self.files)

    def __getitem__(self, i: int) -> RuleSet:
        return self.one if self.one is not None else _read_block(self.folder, self.files[i], self.n_labels, self.majority, self.use_rw)

    def reader(self, spark):
        """A function that yields the blocks in a task, one after the other."""
        if self.one is not None:
            shared = spark.sparkContext.broadcast(dict(self.one.__dict__))
            return lambda: iter([RuleSet(**shared.value)])
        folder, files, rest = self.folder, self.files, (self.n_labels, self.majority, self.use_rw)
        return lambda: (_read_block(folder, f, *rest) for f in files)


def rule_blocks(rules: DataFrame, d: int, n_labels: int, majority: float, use_rw: bool, block_rules: int,
                known_count: int | None = None, extra=None) -> RuleBlocks:
    """The rule base in blocks of at most ``block_rules`` rules (at least one,
    possibly empty), by ranges of rule_id; ``extra``: a column to go with them."""
    cols = ["rule_id", "cls", "rw"] + [acol(j) for j in range(d)] + [f"proto_{j}" for j in range(d)]
    table = rules.select(*cols) if extra is None else rules.select(*cols, extra.cast("double").alias("extra"))
    n = rules.count() if known_count is None else known_count
    if n <= block_rules:
        one = RuleSet.from_pandas(table.toPandas(), d, n_labels, majority, use_rw)
        return RuleBlocks(one, None, [], majority, n_labels, use_rw)
    spark = rules.sparkSession
    folder = f"{_uri(ensure_checkpoint_dir(spark))}/rule-blocks/{uuid.uuid4().hex}"
    top_fs, top = pafs.FileSystem.from_uri(folder)
    top_fs.create_dir(top, recursive=True)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rs = RuleSet.from_pandas(pdf, d, n_labels, majority, use_rw)
        arrays = {k: v for k, v in rs.__dict__.items() if isinstance(v, np.ndarray)}
        data = io.BytesIO()
        np.savez(data, **arrays)
        name = f"block-{int(pdf['block'].iloc[0]):08d}.npz"
        fs, root = pafs.FileSystem.from_uri(folder)
        temp = f"{root}/_tmp-{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as f:
            f.write(data.getvalue())
        fs.move(temp, f"{root}/{name}")  # a repeated task writes the same file again
        return pd.DataFrame({"name": [name]})
    named = table.withColumn("block", F.floor(F.col("rule_id") / block_rules)).groupBy("block").applyInPandas(write, "name string")
    return RuleBlocks(None, folder, sorted(r["name"] for r in named.collect()), majority, n_labels, use_rw)


def _uri(path: str) -> str:
    return (path if "://" in path else "file://" + path.removeprefix("file:")).rstrip("/")


def _read_block(folder: str, name: str, n_labels: int, majority: float, use_rw: bool) -> RuleSet:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        arrays = np.load(io.BytesIO(f.read()))
        return RuleSet(**{k: arrays[k] for k in arrays.files}, n_labels=n_labels, majority=majority, use_rw=use_rw)


def _plain_degrees(mflat: np.ndarray, ant: np.ndarray, n: int) -> np.ndarray:
    """Product over each rule's non-zero antecedents only, in feature order.
    Skipping the don't-care factors (exactly 1.0) leaves the bits unchanged,
    and the work is rows x rules x rule length instead of x d."""
    rows, r = mflat.shape[0], ant.shape[0]
    acc = np.empty((rows, r), dtype=np.float64)
    nz = ant != 0
    lengths = nz.sum(axis=1)
    for length in np.unique(lengths):
        sel = np.nonzero(lengths == length)[0]
        if length == 0:
            acc[:, sel] = 1.0
            continue
        pos = np.nonzero(nz[sel])[1].reshape(len(sel), length)      # ascending features
        lab = np.take_along_axis(ant[sel], pos, axis=1)
        idx = pos * (n + 1) + lab
        part = mflat[:, idx[:, 0]].copy()
        for t in range(1, length):
            part *= mflat[:, idx[:, t]]
        acc[:, sel] = part
    return acc


def block_degrees(z: np.ndarray, rs: RuleSet):
    """(slice, rows x rules degrees) of the block, GROUP rules at a time."""
    flat = membership_table_np(z, rs.n_labels).reshape(len(z), -1)
    for start in range(0, rs.size, GROUP):
        sl = slice(start, min(rs.size, start + GROUP))
        acc = _plain_degrees(flat, rs.ant[sl], rs.n_labels)
        if rs.use_rw:
            acc *= rs.rw[sl]
        yield sl, np.where(np.isnan(acc), 0.0, acc)


class RuleIndex:
    """Postings of one block (see the module's docstring)."""

    def __init__(self, rs: RuleSet, shifted: bool):
        self.rs, self.rw = rs, rs.rw if rs.use_rw else np.ones(rs.size)
        length = (rs.ant != 0).sum(axis=1)
        self.postings = []
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            feat = np.nonzero(rs.ant[own])[1].reshape(len(own), k)           # ascending features
            label = np.take_along_axis(rs.ant[own], feat, axis=1)
            if shifted:
                self._shifted(own, feat, label)
            else:
                self._plain(own, feat * (rs.n_labels + 1) + label)

    def _plain(self, own: np.ndarray, column: np.ndarray) -> None:
        """(prefix columns, last columns, rules, largest weight); a rule without
        antecedents has the column of feature 0 that is always 1."""
        if not column.shape[1]:
            column = np.zeros((len(own), 1), dtype=np.int64)
        order = np.lexsort((own, *column[:, :-1].T[::-1]))
        own, column = own[order], column[order]
        cut = np.flatnonzero((column[1:, :-1] != column[:-1, :-1]).any(axis=1)) + 1
        for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(own)]))):
            rules = own[lo:hi]
            self.postings.append((column[lo, :-1].tolist(), column[lo:hi, -1], rules, float(np.max(self.rw[rules], initial=0.0))))

    def _shifted(self, own: np.ndarray, feat: np.ndarray, label: np.ndarray) -> None:
        """(first feature, reach, [(feature, a, b, c) of each place], rules)."""
        if not feat.shape[1]:
            self.postings.append((0, -np.inf, np.inf, [], own))
            return
        h = width(self.rs.n_labels)
        proto = np.take_along_axis(self.rs.proto[own], feat, axis=1)
        left, mid, right = (label - 2.0) * h, (label - 1.0) * h, label.astype(np.float64) * h
        move = proto - mid
        left, mid, right = left + move, mid + move, right + move
        # by first feature, then along it: rules of a posting lie beside each other
        order = np.lexsort((proto[:, 0], feat[:, 0]))
        cut = np.flatnonzero(np.diff(feat[order, 0])) + 1
        for part in np.split(order, cut):
            for lo in range(0, len(part), GROUP // 8):
                at = np.sort(part[lo:lo + GROUP // 8])
                places = [(feat[at, t], left[at, t][:, None], mid[at, t][:, None], right[at, t][:, None]) for t in range(feat.shape[1])]
                with np.errstate(invalid="ignore"):
                    self.postings.append((int(feat[at[0], 0]), np.nanmin(left[at, 0], initial=np.inf),
                                          np.nanmax(right[at, 0], initial=-np.inf), places, own[at]))

    def plain(self, z: np.ndarray, state: "State") -> None:
        n = len(z)
        table = np.ascontiguousarray(np.nan_to_num(membership_table_np(z, self.rs.n_labels).reshape(n, -1), nan=0.0).T)
        fires = {}
        for prefix, last, rules, most in self.postings:
            rows, degree = np.arange(n), np.ones(n)
            for t, c in enumerate(prefix):
                if t == 0:
                    if c not in fires:
                        fires[c] = np.flatnonzero(table[c] > 0)
                    rows = fires[c]
                    degree = table[c, rows]
                else:
                    degree = degree * table[c, rows]
                live = state.live(rows, degree, most)
                if live is not None:
                    rows, degree = rows[live], degree[live]
            if prefix and len(rows):
                self._take(state, rows, table[np.ix_(last, rows)] * degree, rules)
            elif len(rows):
                self._take(state, rows, table[last], rules)

    def shifted(self, z: np.ndarray, state: "State") -> None:
        zt = np.ascontiguousarray(z.T)
        for feature, lo, hi, places, rules in self.postings:
            rows = np.flatnonzero((zt[feature] > lo) & (zt[feature] < hi)) if places else np.arange(len(z))
            if not len(rows):
                continue
            degree = np.ones((len(rules), len(rows)))
            for feat, a, b, c in places:
                degree *= trimf_np(zt[np.ix_(feat, rows)], a, b, c)
            self._take(state, rows, degree, rules)

    def _take(self, state: "State", rows: np.ndarray, degree: np.ndarray, rules: np.ndarray) -> None:
        if self.rs.use_rw:
            degree = degree * self.rw[rules][:, None]
        state.take(rows, degree, rules, self.rs)


class State:
    """What some rows have found so far."""

    def __init__(self, n: int, method: str):
        self.winning = method == "winning"
        self.rid, self.cls, self.md = np.full(n, -1, dtype=np.int32), np.zeros(n), np.zeros(n)
        self.sums = np.zeros((2, n), dtype=np.int64)

    def live(self, rows: np.ndarray, degree: np.ndarray, most: float):
        """Of a posting's rows, those where its rules can still matter."""
        return np.flatnonzero((degree > 0) & (degree * most >= self.md[rows])) if self.winning else np.flatnonzero(degree > 0)

    def take(self, rows: np.ndarray, degree: np.ndarray, rules: np.ndarray, rs: RuleSet) -> None:
        if not self.winning:
            units = np.rint(degree * SUM_UNIT).astype(np.int64)
            for c in (0, 1):
                self.sums[c, rows] += units[rs.cls[rules] == c].sum(axis=0)
            return
        best = degree.argmax(axis=0)  # rules of a posting lie in order of their ids
        value, rule = degree[best, np.arange(len(rows))], rules[best]
        rid = rs.rule_id[rule]
        up = (value > self.md[rows]) | ((value == self.md[rows]) & (value > 0) & (rid < self.rid[rows]))
        at = rows[up]
        self.md[at], self.rid[at], self.cls[at] = value[up], rid[up], rs.cls[rule[up]]

    def frame(self, lo: int, hi: int) -> pd.DataFrame:
        s = self.sums[:, lo:hi] / SUM_UNIT
        return pd.DataFrame({"rule_id": self.rid[lo:hi], "cls": self.cls[lo:hi], "md": self.md[lo:hi], "s0": s[0], "s1": s[1]})


def _score_udf(read, many: bool, method: str, shifted: bool):
    @F.pandas_udf(STATE)
    def best(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        kept = [] if many else [RuleIndex(rs, shifted) for rs in read()]
        waiting = 1 << 16 if many else 1  # rows that share one reading of the block files

        def scored(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            parts = [x[lo:lo + ROWS] for x in held for lo in range(0, len(x), ROWS)]
            states = [State(len(x), method) for x in parts]
            for index in kept if not many else (RuleIndex(rs, shifted) for rs in read()):
                for x, state in zip(parts, states):
                    (index.shifted if shifted else index.plain)(x, state)
            done = iter(states)
            for x in held:
                own = [next(done) for _ in range(0, len(x), ROWS)] or [State(0, method)]
                yield pd.concat([s.frame(0, len(s.rid)) for s in own], ignore_index=True) if len(own) > 1 else own[0].frame(0, len(x))
        held, rows = [], 0
        for cols in batches:
            held.append(np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in cols]))
            rows += len(held[-1])
            if rows >= waiting:
                yield from scored(held)
                held, rows = [], 0
        yield from scored(held)
    return best


def score(df: DataFrame, blocks: RuleBlocks, d: int, method: str = "winning", shifted: bool = False,
          no_fire: str = "majority", out: str = "prediction") -> DataFrame:
    """Append ``out`` (class 0.0/1.0), ``rule_id`` (winning rule, null when
    none) and ``md`` (its degree, or the winning class sum) to a prepared
    table (``_z*`` columns)."""
    udf = _score_udf(blocks.reader(df.sparkSession), len(blocks) > 1, method, shifted)
    maj = F.lit(blocks.majority)
    df = df.withColumn("_s", udf(*[F.col(zcol(j)) for j in range(d)]))
    if method == "winning":
        other = maj
        if shifted and no_fire == "first_rule" and blocks[0].size:
            other = F.lit(float(blocks[0].cls[0]))
        fired = F.col("_s.rule_id") >= 0
        df = (df.withColumn(out, F.when(fired, F.col("_s.cls")).otherwise(other))
                .withColumn("rule_id", F.when(fired, F.col("_s.rule_id"))).withColumn("md", F.col("_s.md")))
    else:
        gap = F.col("_s.s0") - F.col("_s.s1")
        df = (df.withColumn(out, F.when(gap > SUM_TIE, F.lit(0.0)).when(gap < -SUM_TIE, F.lit(1.0)).otherwise(maj))
                .withColumn("rule_id", F.lit(None).cast("int")).withColumn("md", F.greatest("_s.s0", "_s.s1")))
    return df.drop("_s")
