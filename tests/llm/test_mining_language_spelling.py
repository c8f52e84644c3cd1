"""Hard negatives, toxicity and spelling variants against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, odd_rows, prose

# ---- hard negatives ------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, id int, vec int, ids int, pair int, anchor int, score int, rank int"


def vectors(rng, n, dim):
    base = rng.normal(0, 0.13, (6, dim))
    rows = [(i, (base[i % 6] + rng.normal(0, 0.08, dim)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]
    hot = base[0].astype(np.float32).tolist()
    rows += [(1000 + i, hot, i % 2) for i in range(60)]               # one vector, two labels
    rows += [(2000, None, 1), (2050, hot, None), (None, hot, 1), (2100, [0.0] * dim, 3), (2101, [float("nan")] + hot[1:], 1),
             (2102, [float("inf")] + hot[1:], 1), (2103, [None] + hot[1:], 1), (2104, hot[1:], 1), (2150, [], 1), (2106, [1e30] + hot[1:], 1),
             (1000, hot, 0), (2107, [-0.5 / 256] * dim, 2)]
    return rows


def brute_negatives(rows, dim):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or len(v) != dim or any(x is None or not math.isfinite(x) or abs(x) >= 2 ** 16 for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        x = (label, tuple(math.floor(256 * float(np.float32(c))) for c in v))
        seen[i] = min(seen.get(i, x), x)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (label, v) in seen.items():
        if a % 50:
            continue
        scores = sorted((-dot(v, w), i, own) for i, (own, w) in seen.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            wrong = [(i, -t) for t, i, own in scores if own != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(wrong, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [64, 13, 70])
def test_hard_negatives_equal_brute_force(spark, dim):
    from fuzzrule.llm import hard_negatives as H
    rows = vectors(np.random.default_rng(dim), 300, dim)
    df = spark.createDataFrame([(*r, *[7] * 7) for r in rows], VEC)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = H.integer_vectors(df, "vec_id", label, "embedding", dim).persist()
    asked = v.where("id % 50 = 0")
    want = brute_negatives(rows, dim)
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    for how in ({}, {"block_rows": 40, "query_rows": 3, "min_blocks": 2}):
        got = H.mine(v, asked, dim, **how)
        assert sorted(map(tuple, got.select(*cols).collect())) == want and len(want) > 20
    assert H.mine(v.limit(0), asked.limit(0), dim).collect() == []
    assert H.mine(v, asked.limit(0), dim).collect() == []


def test_groups_are_dealt_to_tasks_of_their_own(spark, monkeypatch):
    from fuzzrule.llm.common import Deal
    rows = spark.range(240).select((F.col("id") % 24).alias("g"))
    deal = Deal(spark, 24)
    sizes = rows.select(deal.key(F.col("g")).alias("k")).repartition(deal.tasks, "k").rdd.glom().map(len).collect()
    assert sizes == [10] * 24 and spark.range(1).select(F.size(deal.every())).first()[0] == 24
    monkeypatch.setattr(Deal, "FEW", 5)
    many = Deal(spark, 24)
    assert [r[0] for r in rows.select(many.key(F.col("g"))).distinct().orderBy(1).collect()] == list(range(24))
    assert spark.range(1).select(F.explode(many.every())).count() == 24


def test_intervals_hold_every_score():
    from fuzzrule.llm import hard_negatives as H
    rng = np.random.default_rng(3)
    for dim in (1, 8, 64, 100):
        x = rng.integers(-300, 300, (200, dim))
        x[:3] = 0
        turn = H.rotation(dim)
        codes = H.Codes(x, turn)
        tight = []
        for q in (*x[::20], np.full(dim, 5), rng.integers(-(1 << 24), 1 << 24, dim)):
            lo, hi = H.intervals(q, turn, codes)
            score = x @ q
            assert (lo <= score).all() and (score <= hi).all()
            tight.append(float(np.median((hi - lo) / (1e-9 + 2 * np.linalg.norm(q) * codes.norm.clip(1)))))
        # narrower than Cauchy-Schwarz on the whole vectors
        assert np.median(tight) < (0.75 if dim > 1 else 1.01)


# ---- toxicity ---------------------------------------------------------------------

def plain_values(words, order, d=0.75):
    """Gram values by recursion over dictionaries."""
    by, seen = defaultdict(lambda: [0, 0]), set()
    for w, o, t in words:
        p = f"^{w}$"
        for j in range(1, len(p)):
            g = p[max(0, j - order + 1):j + 1]
            by[g][0] += o
            by[g][1] += t
            seen |= {g[-k:] for k in range(2, len(g) + 1)}
    cont, ctx = Counter(s[1:] for s in seen), defaultdict(list)
    for g, c in cont.items():
        ctx[g[:-1]].append(c)
    letters = sum(len(g) == 1 for g in cont) + 1

    def shared(g):
        if not g:
            return 1 / letters
        if g[:-1] not in ctx:
            return shared(g[1:])
        own = ctx[g[:-1]]
        return (max(cont.get(g, 0) - d, 0) + d * len(own) * shared(g[1:])) / sum(own)
    total = defaultdict(lambda: [0, 0, 0, 0])
    for g, (o, t) in by.items():
        c = total[g[:-1]]
        for k, x in ((0, o), (1, t)):
            c[2 * k] += x
            c[2 * k + 1] += x > 0
    left = lambda c, k: d * c[2 * k + 1] / c[2 * k] if c[2 * k] else 1.0
    out = {}
    for g, x in by.items():
        c, b = total[g[:-1]], shared(g[1:])
        p = [(max(x[k] - d, 0) / c[2 * k] if c[2 * k] else 0) + left(c, k) * b for k in (0, 1)]
        out[g, 0] = math.log(p[1] / p[0])
    out.update({(g, 1): math.log(left(c, 1) / left(c, 0)) for g, c in total.items()})
    return out


def test_gram_values_equal_plain_kneser_ney(spark):
    from fuzzrule.llm import toxicity as T
    rng = random.Random(2)
    words = [(w, rng.randint(0, 4), rng.randint(0, 2)) for w in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(80)}]
    words = [w for w in words if w[1] + w[2]] + [("naïve", 2, 0), ("漢字", 0, 3), ("x" * 64, 1, 1)]
    df = spark.createDataFrame(words, "word string, ordinary long, toxic long")
    for order in (2, 4, 6):
        got = {(r.gram, r.kind): r.value for r in T.gram_values(df, order).collect()}
        want = plain_values(words, order)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k] * T.UNIT) <= 1 for k in want)
        # the arrays of a task give the same sums
        keys = sorted(got)
        hashes = T.gram_keys([g for g, _ in keys], np.array([k for _, k in keys]))
        at = np.argsort(hashes)
        table = T.WordValues(hashes[at], np.array([got[k] for k in keys], dtype=np.int32)[at], order)
        ask = [w for w, _, _ in words] + ["abcabd", "zz", "q"]

        def value(w):
            p = f"^{w}$"
            grams = [p[max(0, j - order + 1):j + 1] for j in range(1, len(p))]
            return sum(got.get((g, 0), got.get((g[:-1], 1), 0)) for g in grams)
        assert table.score(ask).tolist() == [value(w) for w in ask]


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 120)).split()
        bad = rng.random() < 0.3
        if bad:  # a stem with endings that differ: most of them are seen once
            for _ in range(max(1, len(words) // 40)):
                words.insert(rng.randrange(len(words)), "grulp" + rng.choice("aeiou") + rng.choice("rstn") + rng.choice("aeiou"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    return rows, labels


LABELS = "doc_id long, toxic int, quality int"


def test_toxicity_finds_rare_expressions(spark):
    from fuzzrule.llm import toxicity as T
    rows, labels = toxic_rows(random.Random(6), 700)
    odd = [(None if d is None else 5000 + d, t) for d, t in odd_rows()]
    docs, lab = docs_frame(spark, rows + odd), spark.createDataFrame(labels + [(3, None, 1), (None, 1, 1), (4, 0, 0)], LABELS)
    s = T.score_toxicity(docs, lab).collect()
    assert len(s) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in s)
    said = {int(r.id): r.score >= 0.5 for r in s if r.id is not None and int(r.id) < 700}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(said[i] == bool(labels[i][1]) for i in held) / len(held) > 0.97
    # the same evidence where the table is joined instead of broadcast
    joined = T.score_toxicity(docs, lab, max_grams=0, max_known=0).collect()
    key = lambda r: (r.id or "", r["row"], r.words, r.total, r.best, r.excess)
    assert sorted(map(key, s)) == sorted(map(key, joined))
    # held-out labels, language, source and id are no inputs
    other = lab.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs_frame(spark, [(d, t, "xx", "yy") for d, t in rows + odd])
    assert sorted(map(key, T.score_toxicity(moved, other).collect())) == sorted(map(key, s))


def test_toxicity_without_labels_or_rows(spark):
    from fuzzrule.llm import toxicity as T
    docs = docs_frame(spark, odd_rows()[:6] + [(20, "a1 b2 " * 3)])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in T.score_toxicity(docs, none).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 0, 1) for i in range(30)], LABELS)
    scores = {r.score for r in T.score_toxicity(docs, clean).collect()}
    assert len(scores) == 1 and 0 < min(scores) < 0.5
    assert T.score_toxicity(docs.limit(0), clean).collect() == []


# ---- spelling -----------------------------------------------------------------------

def brute_words(rows):
    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words, ratio=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if words[f] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_forms_equal_brute_force(spark):
    from fuzzrule.llm import spelling as S
    rng = random.Random(8)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abéÿ") for _ in range(rng.randint(1, 9)))
        words[base] = rng.choice((1, 5, 25, 125, 3000))
        for _ in range(6):
            i, c = rng.randrange(len(base) + 1), rng.choice("abéÿ")
            words.setdefault(rng.choice((base[:i] + c + base[i:], base[:i] + base[i + 1:], base[:i] + c + base[i + 1:])) or "a", rng.choice((1, 2, 5, 25)))
    # one word has a neighbour for each letter of the alphabet; runs of one letter
    words |= {f"{c}same": 3 for c in "abcdefghijklmnopqrstuvwxyz"} | {"same": 200} | {"a" * k: 10 ** (k % 4) for k in range(1, 14)}
    long = "ab" * 20000
    words |= {long: 50, long[:-1]: 5, long + "b": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_forms({w: n for w, n in words.items() if len(w) < 1000})
    want = sorted(want + [(long, None, long, 50, 2, None), (long[:-1], long, long, 5, 1, 50), (long + "b", long, long, 1, 1, 50)])
    for parts in (1, 7):
        assert rows_of(S.spelling_forms(df, partitions=parts)) == want
    assert rows_of(S.spelling_forms(df.limit(0))) == []


def test_words_are_damaged_by_rule(spark):
    from fuzzrule.llm import spelling as S
    rng = random.Random(4)
    rows = odd_rows() + [(i, prose(rng, 60).title() + " Éa×÷ÿ ÀÀ a1b " + "z" * 40000) for i in range(40, 60)]
    got = {r.word: r.n for r in S.damaged_words(docs_frame(spark, rows), "doc_id", "text").collect()}
    assert got == brute_words(rows)
    assert any(w for w in got if len(w) > 30000) and S.damaged_words(docs_frame(spark, []), "doc_id", "text").collect() == []


def test_keys_tell_rotations_apart():
    """Equal keys exactly where rotations (without the skipped place) are equal."""
    from fuzzrule.llm import spelling as S
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    e = S.rotation_keys(words)
    text, at = {}, Counter()
    for owner, kind, k1, k2 in zip(*(e[c].tolist() for c in ("owner", "kind", "k1", "k2"))):
        w = words[owner]
        i = at[owner, kind > 0]
        at[owner, kind > 0] += 1
        own = w[i + 1:] + "$" + w[:i] if kind else w[i:] + "$" + w[:i]
        assert kind == 0 or (kind == 2) == (i > 0 and w[i] == w[i - 1])
        assert text.setdefault((k1, k2), own) == own
    assert len(set(text.values())) == len(text)
    assert len(e["kind"]) == sum(2 * len(w) + 1 for w in words)
