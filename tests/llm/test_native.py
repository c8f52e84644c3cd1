"""Line dedup, sharding and the secret scan."""

import hashlib
import re
import zlib

from tests.llm.helpers import docs_frame, odd_rows, prose

SPACE = " \t\n\x0b\f\r"


def brute_line_dedup(rows, min_docs=5, min_chars=40):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars and d is not None:
                held.setdefault(k, set()).add(d)
    keep = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in keep and keep[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def lines_found(spark, rows):
    from pyspark.sql import functions as F

    from fuzzrule.llm.line_dedup import dedup_lines
    d = dedup_lines(docs_frame(spark, rows))
    return [tuple(r) for r in d.select("doc_id", F.size("__lines"), F.coalesce(F.size("__dropped"), F.lit(0)),
                                       F.sha2(F.col("__kept").cast("binary"), 256)).collect()]


def test_line_dedup_equals_brute_force(spark):
    import random
    rng = random.Random(3)
    shared = [prose(rng, 12) for _ in range(4)] + ["É" + "é" * 45, "short line"]
    rows = odd_rows()
    for d in range(20, 40):
        lines = [rng.choice(shared) if rng.random() < 0.5 else prose(rng, rng.randint(1, 14)) for _ in range(rng.randint(1, 12))]
        lines = [rng.choice([x, x.upper() if x.isascii() else x, "  " + x + "\t\r"]) for x in lines]
        rows.append((d, "\n".join(lines)))
    rows += [rows[-1], (21, shared[0]), (None, shared[0] + "\nown")]
    assert order(lines_found(spark, rows)) == order(brute_line_dedup(rows))


def test_line_dedup_empty_table(spark):
    assert lines_found(spark, []) == []


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding_is_jump_hashing_and_grows_into_the_new_shard(spark):
    from fuzzrule.llm.sharding import jump_shard, shard_table
    rows = odd_rows() + [(i, f"text {i}") for i in range(100, 700)]
    got = shard_table(docs_frame(spark, rows), "doc_id", "text", 40, rows_per_bucket=5).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        h = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(h, 40), jump(h, 41))
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = order([(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows])
    assert order([(r.doc_id, r["size"], r.text_crc32) for r in got]) == want
    # more shards than the quick chain covers
    for n in (1, 2, 300):
        for r in jump_shard(spark.range(40), "id", n).collect():
            h = int(hashlib.md5(str(r.id).encode()).hexdigest()[:16], 16)
            assert (r.shard, r.grown_shard) == (jump(h, n), jump(h, n + 1))
    assert shard_table(docs_frame(spark, []), "doc_id", "text", 40).collect() == []


def test_secret_scan(spark):
    from fuzzrule.llm import secrets as S
    rows = odd_rows() + [(50, f'a token = "{hashlib.sha1(b"1").hexdigest()}" b'), (51, "card 4929123412341234 and"),
                         (52, "commit " + hashlib.sha1(b"2").hexdigest() + "\nsecret: " + hashlib.sha256(b"3").hexdigest()),
                         (53, "see https://www.example.org/a/page-number-12345-of-things"), (53, "see https://www.example.org/a/page-number-12345-of-things")]
    got = S.scan_secrets(docs_frame(spark, rows), S.template_findings(spark, 20), trees=20).collect()
    texts = {d: t for d, t in rows}
    want = order([(d, i, m.start(), m.group(0)) for d, t in rows for i, m in enumerate(re.finditer(S.CANDIDATE, t or ""))])
    assert order([(r.id, r.nth, r.start, r.secret) for r in got]) == want
    assert all(texts[r.id][r.start:r.start + len(r.secret)] == r.secret for r in got)
    said = {(r.id, r.nth): r.probability >= 0.5 for r in got}
    assert said[50, 0] and said[52, 1]
    assert not said[51, 0] and not said[52, 0] and not said[53, 0]
    one = S.template_findings(spark, 2).where("label = 1")
    assert {r.probability for r in S.scan_secrets(docs_frame(spark, rows), one).collect()} == {1.0}
    assert S.scan_secrets(docs_frame(spark, []), S.template_findings(spark, 2), trees=2).collect() == []


def test_secret_forest_on_held_out_templates(spark):
    """Findings with other numbers than those it was trained on."""
    from pyspark.sql import functions as F

    from fuzzrule.llm import secrets as S
    all_findings = S.template_findings(spark, 30)
    held = F.col("id") % 1000 >= 20
    r = S.scan_secrets(all_findings.where(held), all_findings.where(~held), "id", "text")
    hit = [(x.id // 1000, x.probability >= 0.5) for x in r.collect()]
    right = [said == bool(S.TEMPLATES[t][0]) for t, said in hit]
    assert len(hit) >= 200 and sum(right) / len(right) > 0.95
