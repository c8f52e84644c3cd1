"""The small baseline tree against plain recursion."""

import random

from fuzzrule.operators.tree import fit_tree


def plain_tree(rows, d, bins, depth, node=1, out=None):
    """{leaf: class counts} of rows (bins..., y)."""
    out = {} if out is None else out
    count = lambda part: [sum(r[-1] == c for r in part) for c in (0, 1)]
    half = lambda c: (c[0] ** 2 + c[1] ** 2) / sum(c)
    best, split = half(count(rows)) + 1e-9, None
    for j in range(d) if depth else ():
        for b in sorted({r[j] for r in rows}):
            left, right = [r for r in rows if r[j] <= b], [r for r in rows if r[j] > b]
            if right and half(count(left)) + half(count(right)) > best:
                best, split = half(count(left)) + half(count(right)), (left, right)
    if split is None:
        out[node] = tuple(count(rows))
    else:
        for k, part in enumerate(split):
            plain_tree(part, d, bins, depth - 1, 2 * node + k, out)
    return out


def test_tree_equals_plain_recursion(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        x = [rng.random() for _ in range(3)]
        rows.append((*x, "p" if (x[0] > 0.4) != (x[1] > 0.7) or rng.random() < 0.05 else "n"))
    rows += [(0.0, 0.0, 0.0, "p"), (1.0, 1.0, 1.0, "n"), (None, 0.5, 0.5, "p"), (float("nan"), 0.5, 0.5, "n"), (0.5, 0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y string")
    for depth, bins in ((0, 8), (1, 8), (3, 32)):
        tree = fit_tree(df, depth=depth, bins=bins)
        whole = [r for r in rows if r[-1] and all(x is not None and x == x for x in r[:3])]
        cls = {v: k for k, v in enumerate(tree.prep.class_labels)}
        binned = [(*(min(bins - 1, int(x * bins)) for x in r[:3]), cls[r[3]]) for r in whole]
        assert tree.leaves == plain_tree(binned, 3, bins, depth)
    got = tree.transform(df.drop("y"), keep=["a"]).collect()
    assert len(got) == 403 and {r.prediction for r in got} == {0.0, 1.0}  # 400 + 2, and the row without a class
    far = spark.createDataFrame([(9.0, -9.0, 0.5)], "a double, b double, c double")
    assert tree.transform(far).count() == 1
