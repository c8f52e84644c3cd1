"""N-gram Jaccard self-join by grouped prefixes: exact links and components.

A document is its set of distinct n-word shingles (64-bit hashes).  Shingles
are ordered by the (approximate, hashed) number of documents that hold them,
rare ones first; two sets with a Jaccard of at least t share a shingle among
the first n - ceil(t n) + 1 of each.  Any fixed order keeps that exact, so the
counts may be approximate; they have a fixed size.

Steps:

1. Equal sets are one class, whose smallest document id stands for it.
2. Classes with the same size and prefix are one group.  Prefix shingles of
   groups are posted once per group.
3. Filter, star: each posted shingle links its groups to its smallest group.
   Candidates within the size bound and the bitmap bound (below) are verified
   on the whole sets; so are the members of a group against its first.
4. Filter, rest: shingles whose members are not all in one component yet are
   expanded to members, and pairs of different components are joined on the
   shingle under size, position and bitmap bounds, then verified.  Every link
   thus joins two documents of one component, or was tested itself.

A set's bitmap holds the parity of its hashes per cell, so two bitmaps differ
in at most as many cells as the sets differ in shingles: near copies that are
not near enough are turned down inside the join and make no row.  A copy group
of any size adds rows in proportion to its size, not to its pairs.

Defined cases: null or empty texts (or white space alone) have the empty set,
which links with nothing; rows with a null id get their set size and a null
component; rows that repeat an id are one document that holds all their texts;
fewer words than n give one shingle; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import components, give_back, mix, ngram_hashes, read_table, scratch, shingle_sets, tidy, word_runs, written

CELL_BITS = 18
BITMAP = 512
WORDS64 = BITMAP // 64
# sets over LARGE shingles also have a bitmap of this many cells, kept apart
LARGE, LARGE_BITMAP = 1000, 8192
VERIFY_HASHES, VERIFY_PARTNERS = 1 << 18, 64
BITS = [f"b{i}" for i in range(WORDS64)]


def _count_cells(n: int):
    def run(batches):
        """Shingles per cell of their hashes, summed per task."""
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for pdf in batches:
            for _, words, _ in word_runs(pdf["text"]):
                cell = (ngram_hashes(words, n) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                total += np.bincount(cell, minlength=len(total))
        full = np.flatnonzero(total)
        yield pd.DataFrame({"cell": full.astype(np.int32), "n": total[full]})
        give_back()
    return run


def _cell_ranks(texts: DataFrame, n: int) -> np.ndarray:
    """Rank of each cell by its count: a table of fixed size."""
    rows = texts.mapInPandas(_count_cells(n), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    counts[rows["cell"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return np.unique(counts, return_inverse=True)[1].astype(np.int32)


def _signature(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    a, b = mix(h ^ np.uint64(0xA24BAED4963EE407)), mix(h ^ np.uint64(0x9FB21C651E98DF25))
    return tuple(int(x) for x in np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)]).view(np.int64))


def _parity(h: np.ndarray, cells: int) -> np.ndarray:
    """Packed bits: whether an odd number of hashes falls into each cell."""
    return np.packbits((np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8))


SET = ("id long, n long, h1 long, h2 long, g1 long, g2 long, prefix array<long>, "
       + ", ".join(f"{b} long" for b in BITS) + ", large binary")


def _describe(n: int, percent: int, ranks):
    def run(batches):
        rank = ranks.value
        for pdf in batches:
            out = []
            missing_ids, ids = pdf["missing"].tolist(), pdf["id"].tolist()
            for i, h in shingle_sets(pdf["text"], n):
                missing, doc, size = missing_ids[i], ids[i], len(h)
                if missing or not size:
                    out.append((None if missing else doc, size, 0, 0, 0, 0, [], *[0] * WORDS64, None))
                    continue
                first = np.lexsort((h, rank[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
                prefix = h[first[:size - -(-percent * size // 100) + 1]]
                bits = _parity(h, BITMAP).view(np.int64)
                large = _parity(h, LARGE_BITMAP).tobytes() if size > LARGE else None
                out.append((doc, size, *_signature(h), *_signature(prefix), prefix.view(np.int64), *bits.tolist(), large))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SET.split(", ")])
            yield frame.astype({"id": "Int64"})
        give_back()
    return run


def _wanted_bits(ids: DataFrame) -> tuple[bytes, int]:
    """A bitmap of hashed ids of at most 8 MB: an early filter, made exact later."""
    n = ids.count()
    bits = 1 << min(26, max(16, (64 * n).bit_length()))
    rows = (ids.select(F.expr(f"bitmap_bucket_number(pmod(xxhash64(id), {bits}L) + 1)").alias("k"),
                       F.expr(f"bitmap_bit_position(pmod(xxhash64(id), {bits}L) + 1)").alias("p"))
            .groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("m")).collect())
    whole = bytearray(max(bits, 32768) // 8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        whole[at:at + len(r["m"])] = r["m"]
    return bytes(whole[:max(bits, 32768) // 8]), bits


def _sets(n: int, wanted, bits: int):
    def run(batches):
        mask = np.frombuffer(wanted.value, dtype=np.uint8)
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            pdf = pdf[(mask[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
            out = []
            ids = pdf["id"].tolist()
            for i, h in shingle_sets(pdf["text"].tolist(), n):
                if len(h):
                    out.append((ids[i], *_signature(h), h.tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["id", "h1", "h2", "s"])
        give_back()
    return run


def _verify(percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: (v, set) of the partners of u; right: the sets of u."""
        near = []
        for s in right["sw"]:
            x = np.frombuffer(s, np.uint64)
            for v, t in zip(left["v"], left["sv"]):
                y = np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    near.append(v)
        return pd.DataFrame({"u": [int(left["u"].iloc[0])] * len(near), "v": near}, dtype="int64")
    return run


def _large_ok(percent: int):
    def run(batches):
        for pdf in batches:
            keep = []
            for na, nb, a, b in zip(pdf["na"], pdf["nb"], pdf["la"], pdf["lb"]):
                differ = 0
                if a is not None and b is not None:
                    differ = int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
                keep.append(differ <= na + nb - 2 * -(-percent * (na + nb) // (100 + percent)))
            yield pdf.loc[keep, ["u", "v"]]
    return run


def _bitmap_ok(a: str, b: str, percent: int) -> Column:
    """The bitmaps leave room for the overlap that a link needs."""
    differ = " + ".join(f"bit_count({a}.{x} ^ {b}.{x})" for x in BITS)
    need = f"cast(ceil({percent}D * ({a}.n + {b}.n) / {100 + percent}D - 1e-9) as long)"
    return F.expr(f"({differ}) <= {a}.n + {b}.n - 2 * {need}")


def _size_ok(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)")


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) of class ids whose whole sets are near enough."""
    spark = pairs.sparkSession
    pairs = written(pairs, "pairs")
    # pairs of large sets: their wider bitmaps, at about a tenth of the sets' size
    large = reps.where("large is not null").select("rep", "n", "large")
    a, b = large.toDF("u", "na", "la"), large.toDF("v", "nb", "lb")
    wide = pairs.join(a, "u").join(b, "v").mapInPandas(_large_ok(percent), "u long, v long")
    is_large = reps.where("large is not null").select(F.col("rep").alias("u")).distinct()
    small = pairs.join(is_large, "u", "left_anti").unionAll(
        pairs.join(is_large, "u", "left_semi").join(is_large.toDF("v"), "v", "left_anti").select("u", "v"))
    pairs = written(small.unionAll(wide).distinct(), "pairs_left")
    ids = written(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct(), "ids")
    mask, bits = _wanted_bits(ids)
    wanted = spark.sparkContext.broadcast(mask)
    sets = (texts.where("not missing").withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(bits)))
            .mapInPandas(_sets(n, wanted, bits), "id long, h1 long, h2 long, s binary"))
    own = reps.join(ids, reps.rep == ids.id, "left_semi").select(F.col("rep").alias("id"), "h1", "h2")
    # an id that holds several texts has a set for each
    sets = written(sets.join(own, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"]).select("id", "s"), "sets")
    wanted.destroy()
    tidy(spark)
    # the set of u meets those of its partners in groups of about VERIFY_HASHES, VERIFY_PARTNERS at most
    sizes = reps.select(F.col("rep").alias("v"), "n")
    parts = pairs.join(sizes, "v").groupBy("u").agg(F.greatest(F.ceil(F.sum("n") / VERIFY_HASHES), F.ceil(F.count(F.lit(1)) / VERIFY_PARTNERS)).alias("parts"))
    parts = written(parts, "parts")
    left = (pairs.join(parts, "u").join(sets.toDF("v", "sv"), "v")
            .select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v", "sv"))
    right = (parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
             .join(sets.toDF("u", "su"), "u").toDF("w", "of", "sw"))
    near = left.groupBy("u", "part").cogroup(right.groupBy("w", "of")).applyInPandas(_verify(percent), "u long, v long")
    links = written(near.distinct(), "links")
    del near, left, right
    tidy(spark)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
                       percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, id_col, text_col, n, percent), "components")


def _components(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(doc_id.isNull().alias("missing"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(_cell_ranks(texts, n))
    t = written(texts.mapInPandas(_describe(n, percent, ranks), SET), "sets")
    ranks.destroy()

    # 1. classes of equal sets; 2. groups of equal size and prefix
    live = t.where("id is not null and n > 0")
    same = ["h1", "h2", "n"]
    classes = written(live.groupBy(*same).agg(F.min("id").alias("rep"), F.min("g1").alias("g1"), F.min("g2").alias("g2")), "classes")
    tidy(spark)
    groups = written(classes.groupBy("n", "g1", "g2").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members")), "groups")
    placed = classes.join(groups, ["n", "g1", "g2"]).select(F.col("rep").alias("id"), *same, "gid", "members")
    r = written(live.drop("g1", "g2").join(placed, ["id", *same]).dropDuplicates(["id", *same]).withColumnRenamed("id", "rep"), "reps")
    light = r.select("rep", "gid", "members", "n", *BITS)
    entries = r.where("rep = gid").select("gid", "n", F.posexplode("prefix").alias("pos", "tok"))
    stars = written(entries.groupBy("tok").agg(F.min("gid").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1")
                    .drop("m"), "stars")
    tidy(spark)
    posted = written(entries.join(stars, "tok"), "posted")
    del entries
    tidy(spark)

    # 3. each group against the first of its shingles, each member against its group's first
    to_center = (posted.where("gid <> center").select(F.col("center").alias("u"), F.col("gid").alias("v"))
                 .unionAll(light.where("rep <> gid").select(F.col("gid").alias("u"), F.col("rep").alias("v"))).distinct())
    to_center = written(to_center, "to_center")
    a, b = light.alias("a"), light.alias("b")
    near = (to_center.join(a, F.col("u") == F.col("a.rep")).join(b, F.col("v") == F.col("b.rep"))
            .where(_size_ok("a", "b", percent) & _bitmap_ok("a", "b", percent)).select("u", "v").distinct())
    links = _verified(near, texts, r, n, percent)
    comp = written(components(links), "components")

    # 4. members of shingles (and groups) that are still in several components
    placed = written(light.join(comp, light.rep == comp.node, "left").select(
        *light.columns, F.coalesce("component", "rep").alias("comp")), "placed")
    at = posted.select("tok", "pos", "gid").join(placed, "gid").select("tok", "pos", "rep", "comp", "n", *BITS)
    inside = placed.where("members > 1").select(F.xxhash64(F.lit("group"), "gid").alias("tok"), F.lit(0).alias("pos"),
                                                "rep", "comp", "n", *BITS)
    at = written(at.unionAll(inside), "members")
    mixed = written(at.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok"), "mixed")
    at = written(at.join(mixed, "tok"), "mixed_members")
    need = f"cast(ceil({percent}D * (a.n + b.n) / {100 + percent}D - 1e-9) as long)"
    cross = (at.alias("a").join(at.alias("b"), (F.col("a.tok") == F.col("b.tok")) & F.expr("a.rep < b.rep and a.comp <> b.comp")
                                & _size_ok("a", "b", percent)
                                & F.expr(f"1 + least(a.n - a.pos - 1, b.n - b.pos - 1) >= {need}")
                                & _bitmap_ok("a", "b", percent))
             .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct())
    links2 = _verified(cross, texts, r, n, percent)
    # ids that hold several texts join the classes of them all
    several = live.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    joined = (live.join(several, "id").join(classes, same).select(F.col("id").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct())
    comp = written(components(links.unionAll(links2).unionAll(joined)), "components2")
    label = classes.join(comp, classes.rep == comp.node, "left").select(*same, F.coalesce("component", "rep").alias("label"))
    label = written(label, "labels")
    return t.select("id", *same).join(label, same, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("label", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that are not the first of their component."""
    c = jaccard_components(docs, id_col, text_col, **how)
    gone = written(c.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__id")).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
