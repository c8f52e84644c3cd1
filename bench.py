"""Bench: learn and score rule bases on the driver tables.

Prints one JSON line: total seconds, per-query seconds, per-stage seconds of
the flagship fit (lineitem), rows/s scored, and the rule-count funnel.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fuzzrule import RuleParams, learn  # noqa: E402
from fuzzrule.operators.report import metrics_dict  # noqa: E402
from fuzzrule.plans import queries as Q  # noqa: E402
from fuzzrule.session import local_session  # noqa: E402


def _force(df, col="prediction"):
    """Evaluate every row (the aggregate keeps the scoring column alive)."""
    return df.agg(F.count(F.lit(1)), F.sum(col)).first()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) * 2 if cpus.isdigit() else 16)
    times: dict[str, float] = {}
    extra: dict = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # warm-up on the smallest tables (JIT, codegen cache, Python workers,
    # Arrow); not counted, so the numbers are steady-state per query
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for key, lab, ex in (("E", "low", ("id",)), ("L", "l_linestatus", ()), ("D", "quality", ("id",))):
            wm = learn(Q.view(spark, warm, key), Q.params_for(key), label=lab, exclude=ex)
            _force(wm.transform(Q.view(spark, warm, key), keep=[]))

    L = Q.view(spark, sf, "L")
    m = timed("fit_lineitem", lambda: learn(L, RuleParams(), label="l_linestatus"))
    extra["fit_lineitem_stages"] = m.trace.seconds
    extra["funnel_lineitem"] = m.trace.funnel
    n_rows = timed("score_lineitem_winning",
                   lambda: _force(m.transform(L, keep=[], method="winning")))[0]
    extra["rows_per_sec_winning"] = round(n_rows / max(times["score_lineitem_winning"], 1e-9))
    timed("score_lineitem_aggregation", lambda: _force(m.transform(L, keep=[], method="aggregation")))
    timed("score_lineitem_tuned", lambda: _force(m.transform(L, keep=[], shifted=True)))
    extra["metrics_lineitem"] = timed("metrics_lineitem", lambda: metrics_dict(m.transform(L, keep=[])))

    mf = timed("fit_lineitem_filtered_rate07",
               lambda: learn(L, RuleParams(use_filtering=True, rate=0.7), label="l_linestatus"))
    extra["funnel_lineitem_filtered"] = mf.trace.funnel

    D = Q.view(spark, sf, "D")
    md = timed("fit_documents", lambda: learn(D, RuleParams(), label="quality", exclude=("id",)))
    timed("score_documents", lambda: _force(md.transform(D, keep=["id"])))
    timed("fit_documents_gm_selection",
          lambda: learn(D, RuleParams(selection="gm"), label="quality", exclude=("id",)))
    timed("fit_documents_feature_selection",
          lambda: learn(D, RuleParams(use_fs=True, rate=0.7), label="quality", exclude=("id",)))
    E = Q.view(spark, sf, "E")
    me = timed("fit_embeddings", lambda: learn(E, Q.params_for("E"), label="low", exclude=("id",)))
    timed("score_embeddings", lambda: _force(me.transform(E, keep=["id"])))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "details": extra}))


if __name__ == "__main__":
    main()
