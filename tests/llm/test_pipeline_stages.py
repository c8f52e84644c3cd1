"""Stages of the pipeline on planted rows."""

import random

from tests.llm.helpers import docs_frame, odd_rows, prose
from tests.llm.test_text_models import edited, shingles


def kept_ids(rows, n, percent):
    """The least id of each component, by testing every pair of distinct ids."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(shingles(t, n))
    near = lambda a, b: any(s and u and 100 * len(s & u) >= percent * len(s | u) for s in texts[a] for u in texts[b])
    kept, left = set(), sorted(texts)
    while left:
        todo, group = [left[0]], {left[0]}
        while todo:
            a = todo.pop()
            new = {b for b in left if b not in group and near(a, b)}
            group |= new
            todo += new
        kept.add(left[0])
        left = [i for i in left if i not in group]
    return kept


def test_near_copy_stage_takes_five_words_at_80_percent(spark):
    import corpus_pipeline as P
    rng = random.Random(21)
    rows, planted = [r for r in odd_rows() if r[0] is not None], set()
    for family in range(12):
        base, at = prose(rng, 200), 100 + 10 * family
        more = " " + prose(rng, rng.randint(26, 44))  # 13 to 22 % appended
        rows += [(at, base), (at + 1, base + more), (at + 2, edited(rng, base, 4)), (at + 3, edited(rng, base, 20))]
        planted |= {at + 1, at + 2}
    docs = docs_frame(spark, rows)
    got = P.ngram_jaccard_join(spark, docs, "")
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    assert ids == kept_ids(rows, 5, 80)
    # copies between the two thresholds, which 3 words at 90 % would keep
    assert not planted & ids and len(planted & kept_ids(rows, 3, 90)) >= 12
