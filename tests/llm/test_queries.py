"""Every query with SQL against DuckDB on the given tables."""

import os
import sys

import pytest

from tests.conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
TABLES = "documents embeddings pages benchmark labels conversations".split()


def names():
    from fuzzrule.llm import queries
    return sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from check_oracle import rows_of

    from fuzzrule.llm import queries
    df = queries.queries()[name](spark, SF001)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(want.fetchall(), columns)


def test_every_operator_has_its_query():
    import re

    from fuzzrule.llm import queries
    found = [re.match(r"op(\d+)_\w+$", n) for n in queries.queries()]
    assert sorted(int(m[1]) for m in found if m) == list(range(1, 14)) and "pipeline" in queries.queries()


def test_pipeline_equals_its_parts(spark):
    """Each stage against a plain version on the rows that it was given."""
    import corpus_pipeline as P

    from fuzzrule.llm import decontaminate as D
    from fuzzrule.llm import mixing, packing, quality
    from fuzzrule.llm.common import written
    from tests.llm.test_text_models import brute_components
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        after = written(stage(spark, docs, SF001), "stage")
        if i < len(P.STAGES) - 1:
            assert after.columns == columns
        seen.append((docs, after))
        docs = after
    ids = [({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for a, b in seen]
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    s = quality.score_quality(seen[0][0], labels).collect()
    assert ids[0][1] == {int(r.id) for r in s if r["__score"] >= 0.5}
    rows = [(r.doc_id, r.text) for r in seen[1][0].select("doc_id", "text").collect()]
    assert ids[1][1] == {c for _, _, c in brute_components(rows, 5, 80)}
    bench = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in seen[2][0].select("doc_id", "text").collect()]
    exact = {i for i, t in rows if any(b in t for b in bench)}
    assert ids[2][1] <= ids[2][0] - exact
    gone = {i: t for i, t in rows if i not in ids[2][1]}
    items = [D.plain_words(b) for b in bench]
    assert all(max(D.lcs_length(b, D.plain_words(t)) / len(b) for b in items) >= 0.6 for t in gone.values())
    m = mixing.mixed_documents(seen[3][0]).where("selected")
    assert ids[3][1] == {r.doc_id for r in m.collect()}
    enc = packing.encoder(open(packing.VOCABULARY, "rb").read())
    total = {r.doc_id: r.n for r in seen[4][1].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert total == {r.doc_id: len(enc.encode_ordinary(r.text)) for r in seen[4][0].collect()}
