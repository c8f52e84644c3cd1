"""Small tables for the operator tests: nulls, empty and long texts, ties,
repeated rows, and extra columns whose names clash with inner ones."""

import random

WORDS = [a + b for a in ("ka", "to", "mi", "re", "su", "lon", "par", "ven") for b in ("ra", "nel", "dis", "ma", "to", "quin", "ber", "s")]
EXTRA = ("id", "row", "n", "k", "key", "pos", "line", "size", "shard", "block", "code", "rep", "tok", "u", "v", "path", "label", "score",
         "tokens", "weight", "topic", "missing", "grp", "h", "x", "word")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], (r + ("en", "s1"))[2] if len(r) < 3 else r[2], "s1" if len(r) < 4 else r[3], len(r[1] or ""), *[i] * len(EXTRA))
            for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(full, schema)


def odd_rows(seed=1):
    """Documents with everything that can be missing, empty, long or repeated."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    return [(1, base), (2, base), (3, base.replace("kara", "zzz", 1)), (4, None), (5, ""), (6, " \t\r\n\x0b\x0c "), (7, "one"), (7, "one"),
            (8, "one two"), (9, prose(rng, 30000)), (None, base), (None, None), (10, "É ñ ß 漢字 🙂 " * 20), (11, "\n" * 50),
            (12, base.upper()), (13, base + " tail"), (13, "other text of the same id"), (14, "x" * 5000)]
