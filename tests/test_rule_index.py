"""The rule index against dense degrees, and rule bases kept as block files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzrule.functions.membership import trimf_np
from fuzzrule.functions.partition import width
from fuzzrule.operators.infer import RuleIndex, RuleSet, State, block_degrees, rule_blocks, score


def random_rules(rng, r, d, n, use_rw=True):
    ant = np.zeros((r, d), dtype=np.int32)
    for i in range(r):
        for j in rng.choice(d, rng.integers(0 if i == 3 else 1, 4), replace=False):
            ant[i, j] = rng.integers(1, n + 1)
    proto = np.where(rng.random((r, d)) < 0.05, np.nan, (ant - 1) * width(n) + rng.normal(0, 0.2, (r, d)))
    # few different weights, so that ties are common
    return RuleSet(ant, rng.integers(0, 2, r).astype(float), rng.integers(0, 4, r) / 4.0, proto, np.arange(r, dtype=np.int32) * 2, n, 1.0, use_rw)


def dense(z, rs, shifted):
    if not shifted:
        return np.concatenate([acc for _, acc in block_degrees(z, rs)], axis=1)
    h, out = width(rs.n_labels), np.ones((len(z), rs.size))
    for i in range(rs.size):
        for j in np.flatnonzero(rs.ant[i]):
            mid = (rs.ant[i, j] - 1.0) * h
            move = rs.proto[i, j] - mid
            out[:, i] *= trimf_np(z[:, j], (rs.ant[i, j] - 2.0) * h + move, mid + move, rs.ant[i, j] * h + move)
    return out * rs.rw if rs.use_rw else out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("shifted", [False, True])
def test_index_equals_dense_degrees(seed, shifted):
    rng = np.random.default_rng(seed)
    rs = random_rules(rng, 300, 7, 2 + seed % 4, use_rw=seed % 2 == 0)
    z = rng.random((500, 7)) * 1.4 - 0.2
    z[rng.random(z.shape) < 0.05] = np.nan
    z[:20] = np.round(z[:20] * 4) / 4  # on the centres and feet
    want = dense(z, rs, shifted)
    for method in ("winning", "aggregation"):
        state = State(len(z), method)
        index = RuleIndex(rs, shifted)
        (index.shifted if shifted else index.plain)(z, state)
        if method == "winning":
            best = want.argmax(axis=1)
            value = want[np.arange(len(z)), best]
            assert (state.md == value).all()
            assert (state.rid == np.where(value > 0, rs.rule_id[best], -1)).all()
            assert (state.cls[value > 0] == rs.cls[best[value > 0]]).all()
        else:
            sums = np.stack([want[:, rs.cls == c].sum(axis=1) for c in (0, 1)])
            np.testing.assert_allclose(state.sums / float(1 << 42), sums, atol=1e-9)


def test_work_follows_the_rules_that_fire():
    """Rules far from a row are not evaluated for it."""
    rng = np.random.default_rng(4)
    n, rows, seen = 21, np.full((50, 2), 0.5), 0

    class Counting(State):
        def take(self, rows, degree, rules, rs):
            nonlocal seen
            seen += degree.size
            super().take(rows, degree, rules, rs)
    ant = np.array([(a, b) for a in range(1, n + 1) for b in range(1, n + 1)], dtype=np.int32)
    rs = RuleSet(ant, np.zeros(len(ant)), rng.random(len(ant)), (ant - 1) * width(n), np.arange(len(ant), dtype=np.int32), n, 0.0)
    for shifted in (False, True):
        seen, index = 0, RuleIndex(rs, shifted)
        (index.shifted if shifted else index.plain)(rows, Counting(50, "aggregation"))
        assert 0 < seen < 0.25 * len(rows) * rs.size


def test_block_files_hold_one_block_at_a_time(spark):
    """A rule base of 100 blocks: nothing but file names reaches the driver."""
    d, n, r = 5, 4, 20000
    rules = spark.range(r).select(
        F.col("id").cast("int").alias("rule_id"), (F.col("id") % 2).cast("double").alias("cls"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("rw"),
        *[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(2 * n)) % (n + 1)).cast("int").alias(f"a{j}") for j in range(d)],
        *[(F.pmod(F.xxhash64("id", F.lit(-j)), F.lit(100)) / 100.0).alias(f"proto_{j}") for j in range(d)])
    many = rule_blocks(rules, d, n, 0.0, True, 200, r)
    assert many.one is None and len(many) == 100 and max(many[i].size for i in range(3)) == 200
    assert [many[k].rule_id[0] for k in (0, 1, 99)] == [0, 200, 19800]
    single = rule_blocks(rules, d, n, 0.0, True, r, r)
    rows = spark.range(300).select("id", *[(F.pmod(F.xxhash64("id", F.lit(7 * j)), F.lit(1000)) / 1000.0).alias(f"_z{j}") for j in range(d)])
    for method in ("winning", "aggregation"):
        for shifted in (False, True):
            a, b = (sorted(map(tuple, score(rows, x, d, method, shifted).select("id", "prediction", "rule_id", "md").collect()))
                    for x in (many, single))
            assert a == b and len(a) == 300
