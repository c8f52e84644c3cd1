"""Exact top-k search, WARC archives and packed token shards."""

import hashlib
import io
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, odd_rows, prose


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, code int, id int")


def test_topk_equals_brute_force(spark):
    from fuzzrule.llm.binary_search import sign_codes, top_k
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 64))
    rows = [(i, (base[i % 12] + rng.standard_normal(64) * rng.choice([0.2, 2.0])).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (None, rows[1][1]), (501, [1.0, 2.0]), (502, [float("nan")] * 64),
                                                          (503, [None] * 64), rows[7], rows[7]]
    codes = sign_codes(vectors(spark, rows), "vec_id", "embedding")
    got = {}
    for r in top_k(codes, codes.where("id % 50 = 0"), 10, min_blocks=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbour_id))
    bits = {i: [bool(x is not None and x > 0) for x in v] for i, v in rows if i is not None and v is not None and len(v) == 64}
    for q in [i for i in bits if i % 50 == 0]:
        want = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits if i != q)[:10]
        assert got[q] == want
    assert set(got) == {i for i in bits if i % 50 == 0}
    few = sign_codes(vectors(spark, rows[:4]), "vec_id", "embedding")
    assert top_k(few, few, 10).count() == 12
    none = sign_codes(vectors(spark, []), "vec_id", "embedding")
    assert top_k(none, none, 10).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "page_id long, url string, html string, digest int, shard int, n int")


def test_warc_round_trip_and_determinism(spark, tmp_path):
    from fuzzrule.llm.warc import read_warc, write_warc
    rng = random.Random(2)
    big, small = prose(rng, 60), "tiny"
    rows = [(i, f"http://x.example/{i}", prose(rng, rng.randint(1, 400))) for i in range(60)]
    rows += [(100 + i, "http://copy", big) for i in range(20)] + [(200, "u", small), (201, "u", small), (202, None, None), (203, "u", ""),
                                                                  (None, "u", big), (None, None, None), (204, "a\r\nb", "É漢🙂\r\n\r\n" * 30),
                                                                  (105, "again", big), (205, "u", "x" * 300000)]
    names = []
    for run, parts in (("a", 3), ("b", 7)):
        folder = f"file://{tmp_path}/{run}"
        rng.shuffle(rows)
        m = write_warc(pages(spark, rows).repartition(parts), folder, shard_bytes=40000, roll_bytes=9000)
        got = read_warc(m, folder).collect()
        assert sorted(os.listdir(tmp_path / run)) == sorted(r.path for r in m.collect())
        names.append({r.path: (r.sha256, r.records) for r in m.collect()})
        for r in m.collect():
            data = (tmp_path / run / r.path).read_bytes()
            assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
            assert r.bytes <= 9000 or r.records == 1
        by = lambda t: tuple((x is None, x) for x in t)
        want = []
        first = {}
        for i, _, h in rows:
            if i is not None and len((h or "").encode()) >= 100:
                first[h] = min(first.get(h, i), i)
        seen = set()
        for i, u, h in sorted(rows, key=by):
            to = first.get(h) if i is not None else None
            if to == i and (i, h) not in seen:
                to = None
                seen.add((i, h))
            want.append((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "response" if to is None else "revisit", to))
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=by) == sorted(want, key=by)
    assert names[0] == names[1] and len(names[0]) > 6
    m = write_warc(pages(spark, []), f"file://{tmp_path}/none")
    assert m.count() == 0 and read_warc(m, f"file://{tmp_path}/none").count() == 0


def test_a_lost_task_leaves_nothing_in_the_archive(spark, tmp_path):
    """Files that no manifest row names keep their temporary names."""
    from fuzzrule.llm.warc import read_warc, write_warc
    folder = f"file://{tmp_path}/w"
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "_tmp-dead-part-000000-0000.warc.gz").write_bytes(b"half a file")
    m = write_warc(pages(spark, [(1, "u", "x" * 200)]), folder)
    assert read_warc(m, folder).count() == 1
    assert "_tmp-dead-part-000000-0000.warc.gz" in os.listdir(tmp_path / "w")


def best_fit_plain(lengths, width):
    rooms = []
    for n in lengths:
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(width - n)
    return len(rooms), sorted(rooms)


def test_best_fit_decreasing_equals_plain_search():
    from fuzzrule.llm.packing import best_fit_decreasing
    rng = random.Random(4)
    for _ in range(200):
        width = rng.choice([1, 7, 64, 100])
        lengths = sorted((rng.randint(1, width) for _ in range(rng.randint(0, 60))), reverse=True)
        rows, offsets, n = best_fit_decreasing(lengths, width)
        used = {}
        for r, o, x in zip(rows, offsets, lengths):
            assert used.get(r, 0) == o
            used[r] = o + x
        assert max(used.values(), default=0) <= width
        assert (n, sorted(width - u for u in used.values())) == best_fit_plain(lengths, width)


def test_packing_round_trip(spark, tmp_path):
    from fuzzrule.llm import packing as P
    rows = odd_rows() + [(60, "<|endoftext|> is text"), (61, "word " * 4000)]
    folder = f"file://{tmp_path}/p"
    m = P.pack_documents(docs_frame(spark, rows), "doc_id", "text", folder, width=128, group_bytes=60000)
    enc = P.encoder(open(P.VOCABULARY, "rb").read())
    got = {}
    for r in m.collect():
        z = np.load(io.BytesIO((tmp_path / "p" / r.path).read_bytes()))
        ids, pos = z["ids"], P.position_ids(z)
        assert ids.shape == (r.rows, 128) and pos.shape == ids.shape
        assert set(np.flatnonzero(pos.reshape(-1) == 0)) >= set(z["position_resets"].tolist())
        assert z["row_segments"].sum() == len(z["segment"]) == r.segments
        length = np.diff(z["cu_seqlens"])
        for a, n, d, null, seg in zip(z["position_resets"], length, z["doc_id"], z["doc_null"], z["segment"]):
            assert pos.reshape(-1)[a:a + n].tolist() == list(range(n))
            got.setdefault(None if null else int(d), {}).setdefault(int(seg), []).append(ids.reshape(-1)[a:a + n].tolist())
    texts = {}
    for d, t in rows:
        if t:
            texts.setdefault(d, []).append(t)
    assert set(got) == set(texts)
    for d, t in texts.items():
        if len(t) == 1:
            whole = [x for k in sorted(got[d]) for x in got[d][k][0]]
            assert whole == enc.encode_ordinary(t[0]) and enc.decode(whole) == t[0]
        else:
            assert sum(len(x) for k in got[d].values() for x in k) == sum(len(enc.encode_ordinary(x)) for x in t)
    s = P.packed_segments(docs_frame(spark, rows), width=128)
    assert s.where("n_segments = 0").count() == sum(not t for _, t in rows)
    assert s.where("n_segments > 0").count() == sum(r.segments for r in m.collect())
    assert P.packed_segments(docs_frame(spark, [])).count() == 0


def test_very_long_texts_are_cut_between_words():
    from fuzzrule.llm import packing as P
    enc = P.encoder(open(P.VOCABULARY, "rb").read())
    text = prose(random.Random(1), 3000) + "  \n " + "x" * 3000 + " end"
    blocks = P.text_blocks(text, 1000)
    assert "".join(blocks) == text and max(map(len, blocks)) <= 1000
    plain = prose(random.Random(1), 3000)
    assert [t for b in P.text_blocks(plain, 1000) for t in enc.encode_ordinary(b)] == enc.encode_ordinary(plain)
