"""Near copies, quality, decontamination and mixing."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n=3):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n=3, percent=90):
    """By testing every pair; rows of one id are one document."""
    nodes, parent = [(i, shingles(t, n)) for i, t in rows], {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(nodes):
        for j, u in nodes[:a]:
            if i is None or j is None:
                continue
            if (s and u and 100 * len(s & u) >= percent * len(s | u)) or (i == j and s and u):
                parent[find(i)] = find(j)
    least = {}
    for i, _ in nodes:
        if i is not None:
            least[find(i)] = min(least.get(find(i), i), i)
    return [(i, len(s), None if i is None else least[find(i)]) for i, s in nodes]


def by_null(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(["zorn", "blik", "frum", "quax"]) + str(rng.randrange(10 ** 6))
    return " ".join(w)


def test_jaccard_components_equal_brute_force(spark):
    from fuzzrule.llm.ngram_join import drop_near_copies, jaccard_components
    rng = random.Random(9)
    rows = odd_rows()
    for family in range(4):
        base = prose(rng, rng.randint(40, 200))
        for k in range(25):
            rows.append((100 + family * 100 + k, edited(rng, base, rng.randint(0, 6))))
    chain = prose(rng, 150)
    for k in range(12):  # a chain: the ends do not link with each other
        chain = edited(rng, chain, 2)
        rows.append((900 - k, chain))
    passage = prose(rng, 60)
    rows += [(1000 + k, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for k in range(30)]
    # equal size and prefix but other sets: one word differs among the commonest shingles
    got = jaccard_components(docs_frame(spark, rows).repartition(5))
    assert by_null([tuple(r) for r in got.collect()]) == by_null(brute_components(rows))
    kept = drop_near_copies(docs_frame(spark, rows))
    first = {c for _, _, c in brute_components(rows)}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == first
    assert kept.columns == docs_frame(spark, rows).columns
    assert jaccard_components(docs_frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    from fuzzrule.llm.common import components
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_hashes_do_not_depend_on_place():
    from fuzzrule.llm import common as C
    rng = random.Random(3)
    text = " ".join(prose(rng, 50) for _ in range(40)) + "\tÉÉ ñ\x0b🙂 " + "y" * 5000
    h = C.word_hashes(text)
    words = WORD.findall(text.translate(ASCII_LOWER))
    assert h.tolist() == [int(C.word_hashes(w)[0]) for w in words]
    assert len(set(h.tolist())) == len(set(words))
    piece, C._PIECE = C._PIECE, 64
    try:
        assert C.word_hashes(text).tolist() == h.tolist()
    finally:
        C._PIECE = piece


def quality_tables(spark, n=240):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = "\n".join(prose(rng, rng.randint(3, 60)).capitalize() + "." for _ in range(rng.randint(1, 6)))
        if not good:
            kind = rng.randrange(3)
            text = (" ".join(w + rng.choice(["###", "%%%", "***"]) for w in text.split()) if kind == 0 else
                    " ".join(w.upper() + "!!" for w in text.split()) if kind == 1 else " ".join([text.split()[0]] * 60))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    from fuzzrule.llm.quality import held_out, keep_good, score_quality
    rows, labels = quality_tables(spark)
    docs = docs_frame(spark, rows + odd_rows(2)[3:9] + [(None, "some text"), (5, None)])
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    s = score_quality(docs, lab).select(F.col("id").cast("long").alias("doc_id"), "__score").collect()
    assert len(s) == docs.count() and all(0 <= r["__score"] <= 1 for r in s)
    truth = {i: q for i, q, _ in labels}
    held = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").collect()}
    ours = [(r["__score"] >= 0.5) == bool(truth[r.doc_id]) for r in s if r.doc_id in held and r.doc_id in truth and r.doc_id > 11]
    assert len(ours) > 50 and np.mean(ours) > 0.9
    kept = keep_good(docs, lab)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in s if r["__score"] < 0.5 and r.doc_id is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} >= {i for i, _ in rows} - bad
    # no label, one class, no rows
    none = lab.limit(0)
    assert {r["__score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert all(r["__score"] > 0.5 for r in score_quality(docs, lab.where("quality = 1")).collect())
    assert score_quality(docs.limit(0), lab).count() == 0


def test_quality_is_fitted_on_all_labelled_documents(spark):
    """More of them than a sample would take; the bad ones come last by hash."""
    from fuzzrule.llm.quality import held_out, score_quality
    ids = spark.range(10000).where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").select("id").collect()
    bad = {r.id for r in ids[6200:]}
    rng = random.Random(8)
    rows = [(i, prose(rng, 12) if i not in bad else " ".join(w + "###" for w in prose(rng, 12).split())) for i in range(10000)]
    lab = spark.createDataFrame([(i, int(i not in bad)) for i, _ in rows], "doc_id long, quality int")
    odd = [(20000, "kara### tonel### mira### suquin###"), (20001, "kara tonel mira suquin")]
    s = {int(r.id): r["__score"] for r in score_quality(docs_frame(spark, rows + odd), lab).collect()}
    assert len(s) == 10002 and s[20000] < 0.1 and s[20001] > 0.9
    assert all((s[i] < 0.5) == (i in bad) for i, _ in rows)


def test_quality_learns_from_long_documents(spark):
    """All bad documents have more than 400 passages."""
    from fuzzrule.llm.quality import score_quality
    rng = random.Random(9)
    rows = [(i, prose(rng, 40)) for i in range(60)]
    rows += [(100 + i, " ".join(w + "###" for w in prose(rng, 700).split() * 40)) for i in range(12)]
    lab = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, quality int")
    s = score_quality(docs_frame(spark, rows), lab).collect()
    assert len(s) == 72 and all((r["__score"] >= 0.5) == (int(r.id) < 60) for r in s)


def test_quality_sums_over_runs_and_tasks(spark, monkeypatch):
    """The fit does not depend on how the documents are dealt."""
    from fuzzrule.llm import quality as Q
    rows, labels = quality_tables(spark, 80)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs, got = docs_frame(spark, rows), []
    for tasks, run in ((1, 4096), (5, 3)):
        monkeypatch.setattr(Q, "RUN_PASSAGES", run)
        with Q.scratch(spark):
            bags = Q.encoded(docs.repartition(tasks), "doc_id", "text")
            got.append(Q.fit_quality(bags, lab, "doc_id", "quality", steps=5).flat())
    assert np.allclose(*got, rtol=1e-6, atol=1e-8)


def test_minimised():
    from fuzzrule.llm.quality import minimised

    def rosenbrock(p):
        x, y = p
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([2 * (x - 1) - 400 * x * (y - x * x), 200 * (y - x * x)])
    assert np.allclose(minimised(rosenbrock, np.array([-1.2, 1.0]), 200), 1, atol=1e-3)


def test_attention_gradient_is_right():
    from fuzzrule.llm.quality import AttentionModel
    rng = np.random.default_rng(1)
    bags = np.array([1, 4, 2, 7])
    x, y = rng.standard_normal((bags.sum(), 5)), np.array([1.0, 0, 1, 0])
    m = AttentionModel(np.zeros(5), np.ones(5), hidden=4, gate=3)
    g = m.gradient(x, bags, y, 0.0)

    def loss():
        s = m.forward(x, bags)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()
    for k, v in m.p.items():
        for at in np.ndindex(v.shape):
            old, e = v[at], 1e-6
            v[at] = old + e
            up = loss()
            v[at] = old - e
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-6


def test_decontamination(spark):
    from fuzzrule.llm import decontaminate as D
    rng = random.Random(12)
    items = [(i, ". ".join(edited(rng, prose(rng, 14), 7) for _ in range(3)) + ".") for i in range(12)]
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "...")], "item_id long, text string")
    rows = odd_rows(4)
    truth = set()
    for d in range(100, 160):
        text = prose(rng, rng.randint(20, 400))
        if d % 3 == 0:
            i, item = items[d % 12]
            w = item.split()
            if d % 2:  # a paraphrase: some words left out or replaced, the last sentence kept
                for k in rng.sample(range(len(w) - 14), 6):
                    w[k] = rng.choice(["kara", "tonel"])
            text = prose(rng, rng.randint(0, 90)) + " " + " ".join(w).upper() + " " + text
            truth.add((d, i))
        elif d % 3 == 1:  # only a few words of an item
            text = text + " " + " ".join(items[d % 12][1].split()[:8])
        rows.append((d, text))
    docs = docs_frame(spark, rows)
    got = D.contaminated(docs, bench, config=D.Config(block=5)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert all(0.6 <= r.lcs_share <= 1 and r.cosine >= 0.4 for r in got)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - len({d for d, _ in truth})
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_lcs_equals_dynamic_programming():
    from fuzzrule.llm.decontaminate import lcs_length
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert lcs_length(a, b) == t[-1, -1]


def test_gram_product_equals_dense():
    from fuzzrule.llm.decontaminate import _gram_product
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 900, 20000))
    rows = np.unique(rows, return_inverse=True)[1]
    feats, w, x = rng.integers(0, 50, 20000), rng.random(20000), rng.standard_normal((50, 7))
    a = np.zeros((rows.max() + 1, 50))
    np.add.at(a, (rows, feats), w)
    out = np.zeros((50, 7))
    _gram_product(rows, feats, w, x, out)
    assert np.allclose(out, a.T @ (a @ x))


def test_mixing_meets_the_targets(spark):
    from fuzzrule.llm import mixing as M
    from fuzzrule.llm.mixing import mixed_documents, rake, sample_documents
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 80)) + rng.choice(["", " | x", " = 3", " a@b"]), rng.choice(["en", "en", "de", None]),
             rng.choice(["big", "big", "big", "small", None])) for i in range(600)]
    rows += [(900, None, "en", "big"), (901, "", None, None), (902, " \t\n", "xx", "big"), (None, "a b", "en", "big"), rows[0]]
    docs = docs_frame(spark, rows)
    m = mixed_documents(docs, rate=0.4)
    got = m.collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    counts = {(d, t): len(WORD.findall(t or "")) for d, t, *_ in rows}
    assert sorted(r.n_tokens for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in rows) and counts
    # the raked weights meet given marginals, fitted in memory or on DataFrames
    cells = m.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    cells = cells.where("lang <> 'xx' and topic <> '(none)'").persist()
    goal = {"source": {"big": 0.5, "small": 0.3, "(none)": 0.2}, "lang": {"en": 0.2, "de": 0.5, "(none)": 0.3}}
    goals = {d: M._shares(cells, d, t).persist() for d, t in goal.items()}
    for rate in (0.01, M.feasible_rate(cells, goals, 0.9)):
        w = rake(cells, goals, rate).toPandas()
        assert (w.weight <= w.most * (1 + 1e-9)).all()
        for dim, shares in goal.items():
            for k, v in (w.groupby(dim).weight.sum() / w.weight.sum()).items():
                assert v == pytest.approx(shares[k], rel=0.011)
        slow = {(r.source, r.lang, r.topic): r.weight for r in rake(cells, goals, rate, small=0).collect()}
        assert slow == {(r.source, r.lang, r.topic): pytest.approx(r.weight, rel=1e-9) for r in w.itertuples()}
    report = M.mix_report(docs, rate=0.9).collect()
    assert {r.rate for r in report} == {M.feasible_rate(m.groupBy(*M.DIMS).agg(F.sum("n_tokens").alias("tokens")), {
        d: M._shares(m.groupBy(*M.DIMS).agg(F.sum("n_tokens").alias("tokens")), d, t) for d, t in M.TARGETS.items()}, 0.9)}
    assert all(abs(r.reached - r.target) <= 0.011 * r.target for r in report if r.met) and sum(r.met for r in report) >= len(report) - 2
    assert sum(r.target for r in report if r.dim == "lang") == pytest.approx(1)
    kept = sample_documents(docs, rate=0.4)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in got if r.selected}
    assert {r.doc_id for r in kept.collect()} == ids
    assert mixed_documents(docs_frame(spark, [])).count() == 0
