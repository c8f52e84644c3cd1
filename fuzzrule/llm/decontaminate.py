"""Benchmark decontamination by latent semantic retrieval.

1. The places of the benchmark's words in every document are written once; all
   later steps read them.  The document frequency of the words is counted over
   passages of all documents.
2. Randomised SVD (subspace iteration) of the TF-IDF matrix A of the passages of
   all documents, with the benchmark items as further rows, gives the latent
   space.  Up to ``GRAM_FEATURES`` features, each task adds up its part of A'A,
   which is summed and written once, and the iteration multiplies that; beyond,
   each task multiplies its passages and returns its part of A'(A X).  Parts are
   summed in two steps, so the driver only holds (features x rank) matrices.
3. Every window of every document is projected and held against every item.
   A window is a candidate where its cosine with the item, times the ratio of
   their lengths, reaches ``near``: the share of the item's latent vector that
   the window contains.  So neither neighbouring items nor repeated words in the
   same window hide an item.  Items of like length share the width and stride
   of their windows.
4. Candidates are checked on the words: longest common subsequence of item and
   window, and the item's answer (its last sentence) for paraphrases.

``Config(exact=True)`` takes candidates by a bound on the words in common that
loses no match, in place of step 3; it is the yardstick of the search's recall.

The benchmark's distinct texts are taken in blocks of ``block`` items, several
a pass, so that rank and model stay bounded whatever its size.

Defined cases: null or empty texts and items without words match nothing;
items of fewer than ``min_words`` words must be found whole; rows that repeat
an id are checked one by one and reported once per id and item; a null id is
reported as null; equal items are searched once and reported each; empty tables
give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import give_back, read_table, scratch, word_runs, written

# word bytes: letters, digits and everything beyond ASCII
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def plain_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words without case and punctuation."""
    edge = np.diff(np.concatenate(([False], _WORD_BYTE[data], [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the text's words."""
    return next(word_runs([text], plain_spans))[1]


def answer_of(text: str) -> str:
    """The last sentence of at least 3 words, else the last quarter of the words."""
    parts = [p for p in re.split(r"[.!?\n]+", text) if len(p.split()) >= 3]
    words = text.split()
    return parts[-1] if len(parts) > 1 else " ".join(words[-max(1, len(words) // 4):])


def lcs_of(where: dict[int, int], length: int, window: list[int]) -> int:
    """Longest common subsequence of an item, given as the bits of its places
    of each word, and a window (bit-parallel)."""
    full = (1 << length) - 1
    v = full
    for w in window:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def places_of(item: np.ndarray) -> dict[int, int]:
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    return where


def lcs_length(item: np.ndarray, window: np.ndarray) -> int:
    """Longest common subsequence of two word sequences."""
    return lcs_of(places_of(item), len(item), window.tolist())


class Config:
    """Items of up to ``min_width`` words, twice that, and so on have windows
    5/4 as wide, every quarter of that; rank of the SVD; the least share of an
    item's latent vector (``near``); shares of the common subsequence that are a match alone (``lcs``) or with
    the answer (``lcs_answer``).  Below ``lcs_plain`` the words in common must
    also hold a ``weight`` share of the item's squared inverse frequencies: any
    long text has half of a short item whose answer is made of the commonest
    words."""

    def __init__(self, min_width=64, rank=256, oversample=16, block=256, blocks_at_once=4, max_features=1 << 15,
                 near=0.35, exact=False, lcs=0.75, lcs_answer=0.5, lcs_plain=0.6, weight=0.35, answer=0.8, min_words=5, seed=7, passes=2):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def window(self, words: int) -> tuple[int, int]:
        """Width and stride of the windows for an item of that many words."""
        most = self.min_width
        while most < words:
            most *= 2
        width = -(-5 * most // 4)
        return width, max(1, width // 4)

    def least(self, words: int) -> int:
        """Words of an item that any match has in common with its window."""
        share = min(self.lcs, self.lcs_answer) if words >= self.min_words else 1.0
        return max(1, int(np.ceil(share * words - 1e-9)))

    def match(self, words: int, share: float, answer_found: bool, weight: float) -> bool:
        return share >= (1.0 if words < self.min_words else self.lcs) or (
            words >= self.min_words and share >= self.lcs_answer and answer_found
            and (share >= self.lcs_plain or weight >= self.weight))


class Benchmark:
    """A block of items: features (hashed words), words and answers."""

    def __init__(self, rows, c: Config):
        self.items = [(r["item_id"], plain_words(r["text"])) for r in rows]
        self.answers = [plain_words(answer_of(r["text"])) for r, (_, w) in zip(rows, self.items) if len(w)]
        self.items = [(i, w) for i, w in self.items if len(w)]
        vocabulary = np.unique(np.concatenate([w for _, w in self.items])) if self.items else np.zeros(0, np.uint64)
        # hashed features: no more than max_features whatever the vocabulary
        self.words = vocabulary
        cells, self.feature = np.unique(vocabulary % np.uint64(c.max_features), return_inverse=True) if len(
            vocabulary) > c.max_features else (vocabulary, np.arange(len(vocabulary)))
        self.features = len(cells)
        longest = max((len(w) for _, w in self.items), default=0)
        self.width = max(c.min_width, -(-5 * longest // 4))

    def words_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the words that the benchmark uses."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        pos = np.flatnonzero(self.words[at] == words)
        return pos, at[pos]

    def features_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and features of the words that the benchmark uses."""
        pos, word = self.words_of(words)
        return pos, self.feature[word]


class Finder:
    """Windows of a run of texts that match items; without a space, candidates
    come from the exact bound.

    A match has at least k of an item's m words in common with its window, and
    so at least t of its m - k + t rarest.  Windows that hold fewer (a word of
    the window counts as often as in the item) are turned down together; any t
    and any order of the words keep that exact."""

    WINDOWS = 4096

    def __init__(self, b: Benchmark, df: np.ndarray, passages: int, c: Config, space: "Space | None" = None):
        self.c, self.b, self.space = c, b, space
        self.idf2 = (np.log((passages + 1) / (df + 1)) + 0.01)[b.feature] ** 2
        self.known, classes = [], {}
        for k, ((_, w), answer) in enumerate(zip(b.items, b.answers)):
            own, answer = b.words_of(w)[1], b.words_of(answer)[1]
            self.known.append((own, places_of(own), len(answer), places_of(answer)))
            least = c.least(len(own))
            t = max(1, least // 2)
            rare = own[np.argsort(df[b.feature[own]], kind="stable")[:len(own) - least + t]]
            classes.setdefault(c.window(len(own)), []).append((k, t, *np.unique(rare, return_counts=True)))
        self.classes = []
        for (width, stride), items in classes.items():
            word = np.concatenate([x[2] for x in items])
            order = np.argsort(word, kind="stable")
            self.classes.append((width, stride, np.array([x[0] for x in items]), np.array([x[1] for x in items]),
                                 np.searchsorted(word[order], np.arange(len(b.words) + 1)),
                                 np.concatenate([np.full(len(x[2]), i) for i, x in enumerate(items)])[order],
                                 np.concatenate([x[3] for x in items])[order]))

    def candidates(self, pos, word, first, width, stride, need, ptr, item, often):
        """(text, first word, item of the class) of the pairs that the bound leaves."""
        keep = ptr[word + 1] > ptr[word]
        pos, word = pos[keep], word[keep]
        text = np.searchsorted(first, pos, side="right") - 1
        windows = -(-np.maximum(1, np.diff(first) - width + stride) // stride)
        base = np.concatenate(([0], np.cumsum(windows)))
        at = pos - first[text]
        lo = base[text] + np.maximum(0, (at - width) // stride + 1)
        hi = base[text] + np.minimum(at // stride, windows[text] - 1)
        for w0 in range(0, int(base[-1]), self.WINDOWS):
            a, z = np.searchsorted(hi, w0), np.searchsorted(lo, w0 + self.WINDOWS)
            keys = []
            for k in range(-(-width // stride)):
                w = lo[a:z] + k
                ok = (w <= hi[a:z]) & (w >= w0) & (w < w0 + self.WINDOWS)
                keys.append((w[ok] - w0) * len(ptr) + word[a:z][ok])
            keys = np.unique(np.concatenate(keys))
            window, own = keys // len(ptr), keys % len(ptr)
            n = ptr[own + 1] - ptr[own]
            at_item = np.repeat(ptr[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held = np.bincount(np.repeat(window, n) * len(need) + item[at_item], often[at_item], self.WINDOWS * len(need))
            window, own = np.divmod(np.flatnonzero(held.reshape(-1, len(need)) >= need), len(need))
            window += w0
            text_of = np.searchsorted(base, window, side="right") - 1
            yield from zip(text_of.tolist(), ((window - base[text_of]) * stride + first[text_of]).tolist(), own.tolist())

    def weight(self, item: np.ndarray, window: np.ndarray) -> float:
        """Share of the item's weight in the words that the window holds."""
        return self.idf2[item[np.isin(item, window)]].sum() / self.idf2[item].sum()

    def matches(self, pos, word, first):
        """{(text, item): (share, answer found, [(from, to) of the hits])} with
        the best windows of each."""
        c, best = self.c, {}
        for width, stride, numbers, need, *postings in self.classes:
            found = list(self.candidates(pos, word, first, width, stride, need, *postings) if self.space is None
                         else self.space.candidates(pos, self.b.feature[word], first, width, stride, numbers))
            if not found:
                continue
            text, start, own = (np.array(x) for x in zip(*found))
            lo = np.searchsorted(pos, start).tolist()
            hi = np.searchsorted(pos, np.minimum(start + width, first[text + 1])).tolist()
            for i, k, a, z in zip(text.tolist(), numbers[own].tolist(), lo, hi):
                item, where, m_answer, where_answer = self.known[k]
                m, window = len(item), word[a:z].tolist()
                if sum(w in where for w in window) < c.least(m):
                    continue
                share = lcs_of(where, m, window) / m
                answer = lcs_of(where_answer, m_answer, window) >= c.answer * m_answer
                if c.match(m, share, answer, 1.0) and c.match(m, share, answer, self.weight(item, word[a:z])):
                    old = best.get((i, k))
                    if old is None or (share, answer) > old[:2]:
                        best[i, k] = (share, answer, [(a, z)])
                    elif (share, answer) == old[:2]:
                        old[2].append((a, z))
        return best


class Space:
    """The latent space with its items: what each feature adds to the share of
    each item's latent vector, as the projections are linear."""

    ROWS = 4096

    def __init__(self, b: Benchmark, weight: np.ndarray, vectors: np.ndarray, c: Config):
        self.weight, self.vectors, self.near = weight, vectors.astype(np.float32), c.near
        own = [np.unique(b.features_of(w)[1]) for _, w in b.items]
        self.items = np.stack([weight[f] @ vectors[f] for f in own])
        length2 = np.maximum((self.items ** 2).sum(1), 1e-12)
        self.adds = ((weight[:, None] * vectors) @ (self.items / length2[:, None]).T).astype(np.float32)

    def candidates(self, pos, feat, first, width, stride, numbers):
        """(text, first word, item of the class) of windows and items.  A window
        is the sum of its pieces of ``stride`` words; a word counts once a piece."""
        adds = np.ascontiguousarray(self.adds[:, numbers])
        per = -(-width // stride)
        words = np.diff(first)
        # empty pieces after each text keep windows within it
        pieces = -(-words // stride) + per
        base = np.concatenate(([0], np.cumsum(pieces)))
        text = np.searchsorted(first, pos, side="right") - 1
        key = np.unique((base[text] + (pos - first[text]) // stride) * len(adds) + feat)
        piece, feat = key // len(adds), key % len(adds)
        windows = -(-np.maximum(1, words - width + stride) // stride)
        for lo in range(0, int(base[-1]), self.ROWS):
            hi = min(lo + self.ROWS, int(base[-1]))
            a, z = np.searchsorted(piece, (lo, hi + per))
            if a == z:
                continue
            own, words_of = piece[a:z], feat[a:z]
            head = np.flatnonzero(np.diff(own, prepend=-1))
            # pieces with most words first: the k-th words are added to a prefix of them
            many = np.diff(np.append(head, z - a))
            order = np.argsort(-many, kind="stable")
            start, many = head[order], many[order]
            total = np.take(adds, words_of[start], axis=0)
            for k in range(1, int(many[0])):
                m = int(np.searchsorted(-many, -k, side="left"))
                total[:m] += np.take(adds, words_of[start[:m] + k], axis=0)
            share = np.zeros((hi - lo + per, len(numbers)), dtype=np.float32)
            share[own[start] - lo] = total
            total = share[:hi - lo].copy()
            for k in range(1, per):
                total += share[k:k + hi - lo]
            at, item = np.divmod(np.flatnonzero(total >= self.near), len(numbers))
            at += lo
            of = np.searchsorted(base, at, side="right") - 1
            ok = at - base[of] < windows[of]
            yield from zip(of[ok].tolist(), ((at - base[of]) * stride + first[of])[ok].tolist(), item[ok].tolist())

    def cosine(self, feat: np.ndarray, k: int) -> float:
        """Cosine of a window (its features, each once) and an item."""
        w = self.weight[feat] @ self.vectors[feat]
        return float(w @ self.items[k] / max(np.linalg.norm(w) * np.linalg.norm(self.items[k]), 1e-9))


HITS = "doc_id long, row long, n_words long, held binary, word binary"
RUN_WORDS = 1 << 18


def _word_hits(vocabulary):
    """Of each text: a bit per word, set where the items use it, and the numbers
    of those words."""
    def run(batches):
        known = vocabulary.value
        kind = np.min_scalar_type(len(known))
        for pdf in batches:
            out = []
            docs, rows = pdf["doc_id"].tolist(), pdf["row"].tolist()
            for at, words, first in word_runs(pdf["text"], plain_spans):
                word = np.minimum(np.searchsorted(known, words), len(known) - 1)
                held = known[word] == words
                word = word.astype(kind)
                for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    out.append((docs[at + i], rows[at + i], z - a, np.packbits(held[a:z]).tobytes(), word[a:z][held[a:z]].tobytes()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in HITS.split(", ")]).astype({"doc_id": "Int64"})
        give_back()
    return run


def _runs(pdf, n_known: int):
    """The batch's texts, some at a time: (number of the first text, positions and
    numbers of the known words, first[i]:first[i + 1] being the positions of the
    run's i-th text)."""
    kind, size = np.min_scalar_type(n_known), pdf["n_words"].to_numpy()
    run = (np.cumsum(size) - size) // RUN_WORDS
    for own in np.split(np.arange(len(size)), np.flatnonzero(np.diff(run)) + 1):
        if len(own):
            held = [np.unpackbits(np.frombuffer(pdf["held"].iat[i], np.uint8), count=int(size[i])) for i in own]
            word = np.frombuffer(b"".join(pdf["word"].iloc[own]), kind).astype(np.int64)
            yield int(own[0]), np.flatnonzero(np.concatenate(held)), word, np.concatenate(([0], np.cumsum(size[own])))


class Numbers:
    """A block with what the numbers of the pass's words are in it (-1: not held)."""

    def __init__(self, b: Benchmark, known: np.ndarray):
        self.b, self.n_known = b, len(known)
        at = np.minimum(np.searchsorted(b.words, known), len(b.words) - 1)
        self.word = np.where(b.words[at] == known, at, -1)

    def of(self, pos: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and the block's numbers of the words that it uses."""
        word = self.word[word]
        keep = word >= 0
        return pos[keep], word[keep]


MATCHES = "doc_id long, row long, item long, cosine double, lcs_share double, answer_found boolean"


def _find_matches(model):
    def run(batches):
        finders = model.value
        for pdf in batches:
            out = []
            docs, rows = pdf["doc_id"].tolist(), pdf["row"].tolist()
            for at, *hits, first in _runs(pdf, finders[0][0].n_known):
                for own, f, space in finders:
                    pos, word = own.of(*hits)
                    for (i, k), (share, answer, windows) in f.matches(pos, word, first).items():
                        cosine = max(space.cosine(np.unique(f.b.feature[word[lo:hi]]), k) for lo, hi in windows)
                        out.append((docs[at + i], rows[at + i], f.b.items[k][0], cosine, share, answer))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in MATCHES.split(", ")])
            yield frame.astype({"doc_id": "Int64"})
        give_back()
    return run


def _passages(hits: DataFrame, shared) -> DataFrame:
    """Rows (block, feature, number) of the passages (of ``width`` words, side by
    side) that hold each feature, and the number of all passages (feature -1)."""
    def run(batches):
        blocks = shared.value
        df, n = [np.zeros(own.b.features, np.int64) for own in blocks], [0] * len(blocks)
        for pdf in batches:
            for _, *hits, first in _runs(pdf, blocks[0].n_known):
                for k, own in enumerate(blocks):
                    b = own.b
                    some = -(-np.diff(first) // b.width)
                    n[k] += int(some.sum())
                    pos, word = own.of(*hits)
                    text = np.searchsorted(first, pos, side="right") - 1
                    before = np.concatenate(([0], np.cumsum(some)))[text]
                    in_passage = np.unique((before + (pos - first[text]) // b.width) * b.features + b.feature[word])
                    df[k] += np.bincount(in_passage % b.features, minlength=b.features)
        for k in range(len(blocks)):
            full = np.flatnonzero(df[k])
            yield pd.DataFrame({"block": k, "feat": np.append(full, -1), "n": np.append(df[k][full], n[k])})
    return (hits.select("n_words", "held", "word").mapInPandas(run, "block int, feat long, n long")
            .groupBy("block", "feat").agg(F.sum("n").alias("n")))


def _rows_of(pdf, own: Numbers, idf: np.ndarray):
    """The batch's passages as sparse matrices: row numbers, features, weights
    (rows of length 1, so that long or odd passages don't outweigh others)."""
    for _, *hits, first in _runs(pdf, own.n_known):
        pos, word = own.of(*hits)
        if not len(pos):
            continue
        text = np.searchsorted(first, pos, side="right") - 1
        before = np.concatenate(([0], np.cumsum(-(-np.diff(first) // own.b.width))))[text]
        rows = before + (pos - first[text]) // own.b.width
        rows = np.cumsum(np.diff(rows, prepend=rows[0]) != 0)
        feats = own.b.feature[word]
        norm = np.sqrt(np.bincount(rows, idf[feats] ** 2))
        yield rows, feats, idf[feats] / norm[rows]


GRAM_FEATURES = 1 << 12
HEAD = 512
PAIRS = 1 << 17  # pairs that are added at once


def _add_gram(rows, feats, weight, head: int, out: np.ndarray) -> None:
    """out += A'A for the sparse rows (sorted by row number), without the part above
    the diagonal block of the first ``head`` features: those are multiplied as a dense
    matrix, each other one with its row's."""
    size = len(out)
    key, at = np.unique(rows * size + feats, return_inverse=True)
    rows, feats, weight = key // size, key % size, np.bincount(at, weight)
    dense = np.zeros((int(rows[-1]) + 1, head), dtype=np.float32)
    often = feats < head
    dense[rows[often], feats[often]] = weight[often]
    out[:head, :head] += dense.T @ dense
    starts = np.searchsorted(rows, np.arange(len(dense) + 1))
    tail = np.flatnonzero(~often)
    many = np.diff(starts)[rows[tail]]
    for at in np.split(np.arange(len(tail)), np.flatnonzero(np.diff((np.cumsum(many) - many) // PAIRS)) + 1):
        own, n = tail[at], many[at]
        other = np.repeat(starts[rows[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(out.reshape(-1), np.repeat(feats[own] * size, n) + feats[other], np.repeat(weight[own], n) * weight[other])


def _gram_product(rows, feats, weight, x: np.ndarray, out: np.ndarray) -> None:
    """out += A'(A x) for the sparse rows (sorted by row number), some at a time."""
    starts = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 8192, side="right")) - 1)
        part = slice(starts[at], starts[to])
        f, w = feats[part], weight[part, None].astype(x.dtype)
        y = np.add.reduceat(x[f] * w, starts[at:to] - starts[at], axis=0)
        order = np.argsort(f, kind="stable")
        first = np.flatnonzero(np.diff(f[order], prepend=-1))
        out[f[order][first]] += np.add.reduceat((y[rows[part] - rows[starts[at]]] * w)[order], first, axis=0)
        at = to


CHUNK = 64
PARTS = "chunk long, salt long, m binary"


def _parts(out: np.ndarray):
    """A task's part of a sum, in chunks of rows; 32 tasks share a salt."""
    salt = TaskContext.get().partitionId() // 32
    for k in range(0, len(out), CHUNK):
        if out[k:k + CHUNK].any():
            yield pd.DataFrame({"chunk": [k // CHUNK], "salt": [salt], "m": [out[k:k + CHUNK].astype(np.float32).tobytes()]})


def _summed(parts: DataFrame) -> DataFrame:
    """Parts summed in two steps, so that no task sums all parts of a chunk."""
    def add(pdf):
        total = np.zeros(0)
        for m in pdf["m"]:
            m = np.frombuffer(m, np.float32)
            total = m.astype(np.float64) if not len(total) else total + m
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "salt": [0], "m": [total.astype(np.float32).tobytes()]})
    return parts.groupBy("chunk", "salt").applyInPandas(add, PARTS).groupBy("chunk").applyInPandas(add, PARTS)


def _collected(sums: DataFrame, x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    for r in sums.collect():  # features x rank numbers, bounded by parameters
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["m"], np.float32).reshape(-1, x.shape[1])
    return out


def _multiply(hits: DataFrame, model) -> np.ndarray:
    """A'(A X) over all passages."""
    x = model.value[2]

    def part(batches):
        own, idf, x = model.value
        out = np.zeros(x.shape)
        for pdf in batches:
            for m in _rows_of(pdf, own, idf):
                _gram_product(*m, x, out)
        yield from _parts(out)
        give_back()
    return _collected(_summed(hits.select("n_words", "held", "word").mapInPandas(part, PARTS)), x)


def _gram(hits: DataFrame, model) -> DataFrame:
    """A'A over all passages, in chunks of rows: (chunk, m); the features are
    numbered by ``order``.  A task holds features x features numbers, whatever its
    passages, so there are few tasks."""
    def part(batches):
        own, idf, order = model.value
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        out, head = np.zeros((len(order), len(order))), min(HEAD, len(order))
        for pdf in batches:
            for rows, feats, weight in _rows_of(pdf, own, idf):
                _add_gram(rows, number[feats], weight, head, out)
        out[:head, head:] = out[head:, :head].T
        yield from _parts(out)
        del out
        give_back()
    few = 2 * hits.sparkSession.sparkContext.defaultParallelism
    return written(_summed(hits.select("n_words", "held", "word").coalesce(few).mapInPandas(part, PARTS)), "gram")


def _gram_times(gram: DataFrame, model) -> np.ndarray:
    """A'A X from the chunks of A'A."""
    x = model.value

    def part(batches):
        x = model.value
        for pdf in batches:
            yield pd.DataFrame({"chunk": pdf["chunk"], "salt": 0, "m": [
                (np.frombuffer(m, np.float32).reshape(-1, len(x)) @ x).tobytes() for m in pdf["m"]]})
    return _collected(gram.mapInPandas(part, PARTS), x)


def fit_space(hits: DataFrame, own: Numbers, passages: int, df: np.ndarray, idf: np.ndarray, c: Config) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF passages and items."""
    sc, b = hits.sparkSession.sparkContext, own.b
    rows = np.concatenate([np.full(len(w), k) for k, (_, w) in enumerate(b.items)])
    feats = np.concatenate([b.features_of(w)[1] for _, w in b.items]).astype(np.int64)
    keep = idf[feats] > 0
    rows, feats = np.unique(rows[keep], return_inverse=True)[1], feats[keep]
    if not len(rows):
        return np.zeros((b.features, 1))
    weight = idf[feats] / np.sqrt(np.bincount(rows, idf[feats] ** 2))[rows]
    # the items count like one in a hundred passages each, so the space has them
    weight = weight * np.sqrt(max(1.0, passages / 100))
    wide = min(b.features, c.rank + c.oversample)
    q = np.random.default_rng(c.seed).standard_normal((b.features, wide))
    q[idf == 0] = 0
    order, gram = np.argsort(-df, kind="stable"), None
    if b.features <= GRAM_FEATURES:
        model = sc.broadcast((own, idf, order))
        gram = _gram(hits, model)
        model.destroy()
    for step in range(c.passes):
        x = q.astype(np.float32)
        model = sc.broadcast((own, idf, x) if gram is None else x[order])
        if gram is None:
            g = _multiply(hits, model)
        else:
            g = np.empty(q.shape)
            g[order] = _gram_times(gram, model)
        model.destroy()
        _gram_product(rows, feats, weight, q, g)
        if step < c.passes - 1:
            q = np.linalg.qr(g)[0]
    # q spans the range found; A'A restricted to it gives the vectors in order
    small = q.T @ g
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, ::-1][:, :c.rank]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", config: Config | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found), a row per document
    and item found in it."""
    with scratch(docs.sparkSession) as keep:
        items = benchmark.select(F.xxhash64(item_text_col).alias("item"), F.col(item_col).cast("long").alias("item_id")).distinct()
        found = _contaminated(docs, benchmark, id_col, text_col, item_text_col, config or Config()).join(items, "item")
        best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "answer_found", "cosine")).alias("m"))
        return keep(best.select("doc_id", "item_id", "m.cosine", "m.lcs_share", "m.answer_found"), "contaminated")


def _contaminated(docs, benchmark, id_col, text_col, item_text_col, c: Config) -> DataFrame:
    """(doc_id, row, item, cosine, lcs_share, answer_found), ``row`` and ``item``
    being the hashes of the texts."""
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col) != "").select(F.col(id_col).cast("long").alias("doc_id"),
                                                     F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    items = written(benchmark.where(F.col(item_text_col) != "").select(F.xxhash64(item_text_col).alias("item_id"),
                                                                       F.col(item_text_col).alias("text")).distinct(), "items")
    # blocks in order of hashes, of about `block` items, several of them a pass
    blocks = max(1, -(-items.count() // c.block))
    found = []
    for k in range(0, blocks, c.blocks_at_once):
        own = F.pmod(F.col("item_id"), F.lit(blocks))
        rows = items.select("*", own.alias("block")).where(own.between(k, k + c.blocks_at_once - 1)).collect()
        some = [Benchmark([r for r in rows if r["block"] == j], c) for j in range(k, k + c.blocks_at_once)]
        if some := [b for b in some if b.items]:
            found.append(_matches(texts, some, c))
    out = spark.createDataFrame([], MATCHES)
    for one in found:
        out = out.unionAll(one)
    return out


def _matches(texts: DataFrame, blocks: list[Benchmark], c: Config) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    known = np.unique(np.concatenate([b.words for b in blocks]))
    vocabulary = sc.broadcast(known)
    hits = written(texts.mapInPandas(_word_hits(vocabulary), HITS), "hits")
    vocabulary.destroy()
    numbers = [Numbers(b, known) for b in blocks]
    shared = sc.broadcast(numbers)
    counts = {(r["block"], r["feat"]): r["n"] for r in _passages(hits, shared).collect()}  # a row per feature
    shared.destroy()
    finders = []
    for k, own in enumerate(numbers):
        b, n = own.b, max(1, counts.get((k, -1), 0))
        df = np.array([counts.get((k, f), 0) for f in range(b.features)])
        # damped inverse frequencies: an item is more than its rarest words
        weight = np.sqrt(np.log((n + 1) / (df + 1)) + 0.01)
        space = Space(b, weight, fit_space(hits, own, n, df, weight, c), c)
        finders.append((own, Finder(b, df, n, c, None if c.exact else space), space))
    model = sc.broadcast(finders)
    out = written(hits.mapInPandas(_find_matches(model), MATCHES), "matches")
    model.destroy()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_text_col: str = "text", config: Config | None = None) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; of rows that
    share an id (or have none), those that hold one."""
    with scratch(docs.sparkSession) as keep:
        hit = _contaminated(docs, benchmark, id_col, text_col, item_text_col, config or Config())
        hit = keep(hit.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct(), "contaminated")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__row"))
    return docs.join(hit, same, "left_anti")


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), F.round("lcs_share", 6).alias("lcs_share"),
                        "answer_found")
