"""Grouping of spelling variants by permuterm rotations.

A word w is marked with a terminator, and all rotations of ``w$`` are formed.
Words that agree but for the character at one place share a rotation that ends
with it: ``b$a`` + x for a word ``axb``.  All of them lie in the prefix range of
``b$a``, and the range also holds ``b$a`` itself where ``ab`` is a word.  So each
rotation is entered with its last character (the edited one) skipped, and each
whole rotation as it is; the entries are sorted, and every group of equal ones
is scanned: two skipping entries are a replacement, a skipping and a whole one
an insertion or deletion.  A pair meets in one group only: replacements by
their place, insertions because a character that repeats the one before it
(whose deletion gives the same word) is not matched with whole rotations.

Words of a group differ in one character, so a group holds at most one entry
per character of the alphabet and one whole one; nothing is capped.  Rotations
are never written out: an entry is the rotation's 124-bit hash, from prefix
sums modulo two primes, so a word of L characters costs O(L) time and 2 L + 1
entries.  Per word the partition only hands on a sum and a maximum.  Forms are
then followed by pointer doubling over DataFrames.

Defined cases: null and empty texts have no words; equal words of any number of
rows are one word with their number; rows that repeat an id count each; a null
id is read as an empty text before the colon; of near words with the same
number the smallest in code-point order is the form; a word without a form is
its own root; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import LOWER, UPPER, read_table, scratch, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
NOISE = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
ENTRIES = "k1 long, k2 long, id long, n long, kind byte"


# ---- words of the corpus -----------------------------------------------------

def damaged_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, counted.  Where
    NOISE divides the checksum of id and run, a character is dropped."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"),
                       F.explode(F.expr(f"regexp_extract_all({text_col}, '{RUN}', 0)")).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "d", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
    return (runs.select("run", at.alias("at"), (h % NOISE == 0).alias("cut"))
            .select(F.when(F.col("cut"), cut).otherwise(F.col("run")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


# ---- rotations -----------------------------------------------------------------

# fixed values: the two largest primes below 2^31
_PRIMES = (2147483647, 2147483629)
_BASES = np.random.default_rng(13).integers(1 << 20, 1 << 30, (2, 2)).tolist()
_MARK = 1 << 21


def _powers(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(step) % np.uint64(p)))
        step = step * step % p
    return out[:n]


def _prefix(codes: np.ndarray, first: np.ndarray, size: np.ndarray, base: int, p: int):
    """For words laid end to end, without marks: per place of a word (size + 1
    places each) the hash of the characters before it, and the powers."""
    power = _powers(base, p, int(size.max()) + 2)
    nth = np.arange(len(codes)) - np.repeat(first, size)
    # a word's hash is sum of code * base^(its place); sums restart at each word
    term = (codes.astype(np.uint64) + np.uint64(1)) * power[nth] % np.uint64(p)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term)))
    place = np.repeat(first, size + 1) + _places(size)
    return (total[place] - total[np.repeat(first, size + 1)]) % np.uint64(p), power


def _places(size: np.ndarray) -> np.ndarray:
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    return np.arange(int((size + 1).sum())) - np.repeat(start, size + 1)


def rotation_keys(words: list[str]) -> dict[str, np.ndarray]:
    """Entries of all words: word (its number), kind and two 62-bit hashes.
    kind 0: the whole rotation that starts at a place; 1: a rotation without its
    last character; 2: the same, where that character repeats the one before."""
    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place, length = _places(size), np.repeat(size, size + 1)
    end = np.repeat(np.cumsum(size + 1) - 1, size + 1)
    owner = np.repeat(np.arange(len(words)), size + 1)
    skips = np.flatnonzero(place < length)          # the character at this place is skipped
    keys = []
    for pair in _BASES:
        word = np.zeros((2, len(place) + len(skips)), dtype=np.uint64)
        for half, (base, prime) in enumerate(zip(pair, _PRIMES)):
            p = np.uint64(prime)
            before, power = _prefix(codes, first, size, base, prime)
            # hashes are compared at a common scale: multiplied up to the longest word's power
            top = int(size.max()) + 1
            inverse = _powers(pow(base, -1, prime), prime, top + 1)
            mark = np.uint64(_MARK)

            def ring(tail_from, head_to):
                """hash of (characters from a place) $ (characters before a place)"""
                tail = (before[end] + p - before[tail_from]) * inverse[place[tail_from]] % p
                n = (length[head_to] - place[tail_from]).astype(np.int64)
                return (tail + (mark + before[head_to] * np.uint64(base)) % p * power[n]) % p
            every = np.arange(len(place))
            whole = ring(every, every)
            # start one after the skipped place: the next entry of the same word
            tail = (before[end[skips]] + p - before[skips + 1]) * inverse[place[skips + 1]] % p
            n = length[skips] - place[skips + 1]
            skip = (tail + (mark + before[skips] * np.uint64(base)) % p * power[n]) % p
            word[half] = np.concatenate((whole, skip))
        keys.append((word[0] << np.uint64(31)) | word[1])
    at = np.repeat(first, size + 1)[skips] + place[skips]
    repeats = (place[skips] > 0) & (codes[at] == codes[np.maximum(at - 1, 0)])
    kind = np.concatenate((np.zeros(len(place), np.int8), np.where(repeats, 2, 1).astype(np.int8)))
    # the length tells "b$a" of words of different lengths apart
    span = np.concatenate((length, length[skips] - 1)).astype(np.uint64)
    return {"owner": np.concatenate((owner, owner[skips])), "kind": kind, "k1": keys[0].view(np.int64),
            "k2": (keys[1] ^ (span << np.uint64(1))).view(np.int64)}


AT_ONCE = 1 << 18


def _entries(batches):
    for pdf in batches:
        words, ids, n = pdf["word"].tolist(), pdf["id"].to_numpy(), pdf["n"].to_numpy()
        at = 0
        while at < len(words):
            to, size = at, 0
            while to < len(words) and size < AT_ONCE:
                size += len(words[to]) + 1
                to += 1
            e = rotation_keys(words[at:to])
            for lo in range(0, len(e["kind"]), AT_ONCE):
                part = {k: v[lo:lo + AT_ONCE] for k, v in e.items()}
                yield pd.DataFrame({"k1": part["k1"], "k2": part["k2"], "id": ids[at:to][part["owner"]],
                                    "n": n[at:to][part["owner"]], "kind": part["kind"]})
            at = to


def scan_groups(k1, k2, ids, n, kind):
    """Near words within the groups of equal keys: (id, near, n and id of the
    best).  Rows come sorted by (k1, k2)."""
    new = np.ones(len(k1), dtype=bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    out = [np.zeros(0, np.int64)] * 4
    if many.any():
        group, ids, n, kind = group[many], ids[many], n[many], kind[many]
        order = np.lexsort((ids, -n, group))
        group, ids, n, kind = group[order], ids[order], n[order], kind[order]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(group))))
        skip, lead, whole = kind > 0, kind == 1, kind == 0
        far = len(group)

        def nth(mask, k):
            """index of the k-th best entry of the mask in each group, or far"""
            at = np.flatnonzero(mask)
            rank = np.arange(len(at)) - np.searchsorted(row[at], row[at])
            best = np.full(len(head), far)
            best[row[at[rank == k]]] = at[rank == k]
            return best
        first, second, leader, one = nth(skip, 0), nth(skip, 1), nth(lead, 0), nth(whole, 0)
        every = np.arange(len(group))
        total = lambda m: np.bincount(row, m, len(head)).astype(np.int64)[row]
        near = np.where(skip, total(skip) - 1 + np.where(lead, total(whole), 0), total(lead))
        a = np.where(skip, np.where(first[row] == every, second[row], first[row]), leader[row])
        b = np.where(lead, one[row], far)
        best = np.minimum(a, b)  # entries of a group lie best first
        got = best < far
        out = [ids[got], near[got], n[best[got]], ids[best[got]]]
    return dict(zip(("id", "near", "best_n", "best_id"), out))


def _scan(batches):
    """Groups may cross batches: the last group waits for the next batch."""
    rest = None
    for pdf in batches:
        now = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        a, b = now["k1"].to_numpy(), now["k2"].to_numpy()
        if not len(a):
            continue
        whole = len(a) - int(np.argmax(~((a == a[-1]) & (b == b[-1]))[::-1])) if not ((a == a[-1]) & (b == b[-1])).all() else 0
        rest, now = now.iloc[whole:], now.iloc[:whole]
        yield pd.DataFrame(scan_groups(*(now[c].to_numpy() for c in ("k1", "k2", "id", "n", "kind"))))
    if rest is not None:
        yield pd.DataFrame(scan_groups(*(rest[c].to_numpy() for c in ("k1", "k2", "id", "n", "kind"))))


# ---- forms and roots -----------------------------------------------------------

def spelling_forms(words: DataFrame, ratio: int = RATIO, partitions: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): distinct words
    and their numbers.  ``partitions`` of the sorted rotations: by default one for
    each million or so, at least the session's."""
    spark = words.sparkSession
    with scratch(spark) as keep:
        # numbered in code-point order, so that the smallest number is the smallest word
        vocabulary = written(words.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
        if partitions is None:
            chars = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
            partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * chars // 1_000_000)
        entries = vocabulary.select("word", "id", "n").mapInPandas(_entries, ENTRIES)
        entries = entries.repartition(partitions, "k1", "k2").sortWithinPartitions("k1", "k2")
        pairs = entries.mapInPandas(_scan, "id long, near long, best_n long, best_id long")
        best = pairs.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", -F.col("best_id"))).alias("b")).select(
            "id", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.col2")).alias("best_id"))
        known = written(vocabulary.join(best, "id", "left").withColumn(
            "form_id", F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best_id"))), "known")
        roots = _roots(known.where("form_id is not null").select("id", F.col("form_id").alias("root_id")))
        name = vocabulary.select(F.col("id").alias("__id"), F.col("word").alias("__word"))
        named = (known.join(name.withColumnsRenamed({"__id": "form_id", "__word": "form"}), "form_id", "left")
                 .join(roots, "id", "left").join(name.withColumnsRenamed({"__id": "root_id", "__word": "root"}), "root_id", "left"))
        return keep(named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(F.col("form_id").isNotNull(), F.col("best_n")).alias("form_n")), "forms")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root_id): forms followed to the last by doubling the steps.  A form is
    ratio times as frequent as its word, so chains are short and have no cycle."""
    now = written(forms, "roots")
    while True:
        step = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("__next"))
        after = now.join(step, "root_id", "left").select("id", F.coalesce("__next", "root_id").alias("root_id"), F.col("__next").isNotNull().alias("moved"))
        after = written(after, "roots")
        if not after.where("moved").limit(1).count():
            return now
        now = after.drop("moved")


def op13_spelling_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = damaged_words(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    words = words.where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))
    return spelling_forms(words)
