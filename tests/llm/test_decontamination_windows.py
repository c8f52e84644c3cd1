"""Decontamination against brute force over all windows."""

import random

import numpy as np

from tests.llm.helpers import docs_frame, odd_rows, prose
from tests.llm.test_text_models import edited


def frequencies(rows, items, c):
    """Passages that hold each word (a dict), and all passages."""
    from fuzzrule.llm import decontaminate as D
    width = D.Benchmark([{"item_id": k, "text": t} for k, t in items], c).width
    df, n = {}, 0
    for _, doc in rows:
        words = D.plain_words(doc).tolist()
        for at in range(0, len(words), width):
            n += 1
            for w in set(words[at:at + width]):
                df[w] = df.get(w, 0) + 1
    return df, n


def brute_force(rows, items, c, df, n):
    """(number of the row, item) of each match, by testing every window."""
    from fuzzrule.llm import decontaminate as D
    found = set()
    idf2 = lambda words: sum((np.log((n + 1) / (df.get(w, 0) + 1)) + 0.01) ** 2 for w in words)
    for k, text in items:
        item, answer = D.plain_words(text), D.plain_words(D.answer_of(text))
        width, stride = c.window(len(item))
        for i, (_, doc) in enumerate(rows):
            words = D.plain_words(doc)
            for start in range(0, max(1, len(words) - width + stride), stride):
                window = words[start:start + width]
                share = D.lcs_length(item, window) / len(item)
                whole = D.lcs_length(answer, window) >= c.answer * len(answer)
                held = [w for w in item.tolist() if w in set(window.tolist())]
                sure = share >= c.lcs_plain or idf2(held) >= c.weight * idf2(item.tolist())
                if share >= (c.lcs if len(item) >= c.min_words else 1) or (
                        len(item) >= c.min_words and share >= c.lcs_answer and whole and sure):
                    found.add((i, k))
    return found


def planted(rng):
    """Items of all lengths and rows that hold them, whole or edited, in
    repeats of one word, beside each other, or in prose."""
    items = [(k, ". ".join(edited(rng, prose(rng, n), n // 2) for n in (m, m)) + ".")
             for k, m in enumerate([1, 2, 3, 5, 8, 8, 10, 14, 20, 20, 25, 31, 32, 33, 60, 90])]
    rows = [r for r in odd_rows(8) if r[0] != 9]
    for k, text in items:
        words = text.split()
        rows.append((100 + k, " ".join([words[0]] * 80 + words + [words[0]] * 80)))
        rows.append((200 + k, prose(rng, rng.randint(0, 90)) + " " + text + " " + prose(rng, 150)))
        some = sorted(rng.sample(range(len(words)), len(words) - len(words) // 3))
        rows.append((300 + k, prose(rng, 40) + " " + " ".join(words[j] for j in some) + " " + prose(rng, 40)))
    rows.append((400, " ".join(t for _, t in items)))
    rows.append((401, "\n".join(t for k, t in reversed(items) if k < 8)))
    return items, rows


def test_finder_equals_brute_force():
    from fuzzrule.llm import decontaminate as D
    from fuzzrule.llm.common import word_runs
    for seed in range(3):
        rng = random.Random(seed)
        items, rows = planted(rng)
        c = D.Config()
        b = D.Benchmark([{"item_id": k, "text": t} for k, t in items], c)
        df = np.random.default_rng(seed).integers(0, 50, b.features)  # exact for any order of the words
        finder, got = D.Finder(b, df, 50, c), set()
        finder.WINDOWS = 7
        for at, words, first in word_runs([t for _, t in rows], D.plain_spans, 5000):
            got |= {(at + i, b.items[k][0]) for i, k in finder.matches(*b.words_of(words), first)}
        assert got == brute_force(rows, items, c, dict(zip(b.words.tolist(), df.tolist())), 50)
        assert {(i, k) for i, (d, _) in enumerate(rows) for k, _ in items if d in (100 + k, 200 + k, 400)} <= got


def test_repeats_and_long_neighbours_hide_no_item(spark):
    from fuzzrule.llm import decontaminate as D
    rng = random.Random(31)
    items, rows = planted(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_frame(spark, rows), bench).collect()}
    want = brute_force(rows, items, D.Config(), *frequencies(rows, items, D.Config()))
    assert got == {(rows[i][0], k) for i, k in want}
    assert {(d + k, k) for d in (100, 200) for k, _ in items} | {(400, k) for k, _ in items} <= got


def test_paraphrases_with_rare_words_replaced(spark):
    from fuzzrule.llm import decontaminate as D
    rng = random.Random(17)
    items = [(k, edited(rng, prose(rng, 30), 16) + ". " + edited(rng, prose(rng, 12), 6) + ".") for k in range(10)]
    items.append((50, edited(rng, prose(rng, 9), 20) + ". of it was that the the of it was."))  # its answer is in any text
    rows = [(k, prose(rng, 300)) for k in range(1000, 1030)]
    for k, text in items[:10]:
        words = text.split()
        rare = [j for j, w in enumerate(words) if w[-1].isdigit() and j < 29][:10]  # 10 of the 42 words, rarest
        rows.append((100 + k, prose(rng, 50) + " " + " ".join("kara" if j in rare else w for j, w in enumerate(words)) + " " + prose(rng, 50)))
        other = rng.sample(range(30), 18 + k % 3)  # 52 to 57 % are left, the answer among them
        rows.append((200 + k, prose(rng, 50) + " " + " ".join("zzz" if j in other else w for j, w in enumerate(words)) + " " + prose(rng, 50)))
    rows += [(k, prose(rng, 20) + " of it was that the the of it was " + prose(rng, 20)) for k in range(300, 320)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(docs_frame(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = brute_force(rows, items, D.Config(), *frequencies(rows, items, D.Config()))
    assert found == {(rows[i][0], k) for i, k in want}
    assert {(d + k, k) for d in (100, 200) for k in range(10)} == found
    assert any(0.5 <= r.lcs_share < 0.6 for r in got)


def test_rows_that_share_an_id_are_dropped_one_by_one(spark):
    from fuzzrule.llm import decontaminate as D
    rng = random.Random(5)
    items = [(k, edited(rng, prose(rng, 30), 16)) for k in range(3)]
    clean = [(None, prose(rng, 60)) for _ in range(20)] + [(7, prose(rng, 60)), (8, None), (None, None), (None, "")]
    rows = clean + [(None, prose(rng, 20) + " " + items[0][1]), (7, items[1][1] + " " + prose(rng, 20)), (9, items[2][1])]
    docs, bench = docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == {(None, 0), (7, 1), (9, 2)}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, clean))


def test_space_is_fitted_on_all_documents(spark, monkeypatch):
    from fuzzrule.llm import decontaminate as D
    rng = random.Random(41)
    items = [(k, edited(rng, prose(rng, 30), 12)) for k in range(4)]
    rows = [(k, prose(rng, 12)) for k in range(6000)] + [(9000 + k, t) for k, t in items] + [(9100, ""), (9101, None)]
    bench, fit, fitted = spark.createDataFrame(items, "item_id long, text string"), D.fit_space, []

    def counted(hits, *rest):
        fitted.append(hits.count())
        return fit(hits, *rest)
    monkeypatch.setattr(D, "fit_space", counted)
    got = D.contaminated(docs_frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(9000 + k, k) for k, _ in items}
    assert fitted == [6004]


def test_both_ways_to_fit_the_space_agree(spark, monkeypatch):
    from fuzzrule.llm import decontaminate as D
    rng = random.Random(43)
    items, rows = planted(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most, head in ((1 << 12, 512), (1 << 12, 7), (0, 512)):
        monkeypatch.setattr(D, "GRAM_FEATURES", most)
        monkeypatch.setattr(D, "HEAD", head)
        got = D.contaminated(docs_frame(spark, rows), bench).collect()
        found.append({(r.doc_id, r.item_id): (r.lcs_share, r.answer_found, r.cosine) for r in got})
    assert len(found[0]) > 30
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[k][:2] == v[:2] and abs(other[k][2] - v[2]) < 1e-2 for k, v in found[0].items())


def test_gram_equals_dense():
    from fuzzrule.llm import decontaminate as D
    rng = np.random.default_rng(4)
    rows = np.unique(np.sort(rng.integers(0, 300, 4000)), return_inverse=True)[1]
    feats, w = rng.integers(0, 40, 4000), rng.random(4000)
    a = np.zeros((rows.max() + 1, 40))
    np.add.at(a, (rows, feats), w)
    for head in (1, 9, 40):
        out = np.zeros((40, 40))
        D._add_gram(rows, feats, w, head, out)
        out[:head, head:] = out[head:, :head].T
        assert np.allclose(out, a.T @ a, rtol=1e-5)
