"""Token-ID / binary output: documents as fixed-length rows of token ids.

Documents are dealt by hash into groups of about ``group_bytes`` of text; a
group is tokenised and packed in one task by best-fit-decreasing: segments in
falling length go to the open row with the least room that still holds them,
found in a segment tree over capacities.  Documents longer than a row are cut
into segments without losing a token.  A group becomes one binary shard
(``.npz``): the id matrix, cumulative segment lengths, position resets, and
the id and number of each segment's document.  Shards are written under
temporary names and renamed, so a repeated task leaves the same files; a
manifest table lists them.

Defined cases: a null or empty text has no tokens and gives no segment (the
query lists such a document with ``n_segments`` 0); rows that repeat an id
are packed one by one; null ids are kept (flagged in the shard); ties in
length go by id, then text; special-token strings in a text are plain text;
an empty table gives no shard.
"""

from __future__ import annotations

import base64
import io
import uuid
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import new_folder, read_table, written

# fixed value: the public split pattern that goes with the byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_TEXT = 1 << 18


class CapacityTree:
    """Segment tree over capacities 0..n: how many open rows have each."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least_from(self, need: int) -> int:
        """The smallest capacity >= need that some row has, or -1."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(lengths: list[int], width: int) -> tuple[list[int], list[int], int]:
    """Row and offset of each segment (given in falling length), and the row count."""
    tree, rows_by_room, rows, offsets, n = CapacityTree(width), {}, [], [], 0
    for length in lengths:
        room = tree.least_from(length)
        if room < 0:
            row, room, n = n, width, n + 1
        else:
            row = rows_by_room[room].pop()
            tree.add(room, -1)
        rows.append(row)
        offsets.append(width - room)
        if room > length:
            rows_by_room.setdefault(room - length, []).append(row)
            tree.add(room - length, 1)
    return rows, offsets, n


def text_blocks(text: str, at_most: int = LONG_TEXT) -> list[str]:
    """The text cut before single spaces between words (where tokens never
    join) when it is very long; a stretch without one is cut as it comes."""
    out, start = [], 0
    while len(text) - start > at_most:
        cut = text.rfind(" ", start + 1, start + at_most)
        while cut > start and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", start + 1, cut)
        cut = cut if cut > start else start + at_most
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def encoder(ranks_file: bytes):
    """The tokenizer of a rank file's content."""
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(enc, text: str, kind) -> np.ndarray:
    return np.concatenate([np.array(enc.encode_ordinary(x), dtype=kind) for x in text_blocks(text)])


def _pack(ranks, pad_id: int, width: int, folder: str, kind):
    own = {}  # the tokenizer lives as long as its task

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = own.get("enc") or own.setdefault("enc", encoder(ranks.value))
        pdf = pdf.sort_values(["missing", "id", "text"], kind="stable")
        pieces, owner, number = [], [], []
        missing, ids = pdf["missing"].to_numpy(dtype=bool), pdf["id"].to_numpy(dtype=np.int64)
        for at, text in enumerate(pdf["text"]):
            t = tokens(enc, text, kind)
            for k in range(0, len(t), width):
                pieces.append(t[k:k + width])
                owner.append(at)
                number.append(k // width)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        rows, offsets, n = best_fit_decreasing([len(pieces[i]) for i in order], width)
        # segments in reading order: by row, then offset
        by_place = sorted(range(len(order)), key=lambda j: (rows[j], offsets[j]))
        matrix = np.full((n, width), pad_id, dtype=kind)
        lengths, resets, docs, numbers, in_row = [], [], [], [], np.zeros(n, np.int32)
        for j in by_place:
            p, r, o = pieces[order[j]], rows[j], offsets[j]
            matrix[r, o:o + len(p)] = p
            lengths.append(len(p))
            resets.append(r * width + o)
            docs.append(owner[order[j]])
            numbers.append(number[order[j]])
            in_row[r] += 1
        docs = np.array(docs, dtype=np.int64)
        # per row 0, l1, l1 + l2, ...: the first of a row is its count of segments ago
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        data = io.BytesIO()
        np.savez(data, ids=matrix, cu_seqlens=ends, row_segments=in_row, position_resets=np.array(resets, np.int64),
                 doc_id=ids[docs], doc_null=missing[docs], segment=np.array(numbers, np.int32),
                 n_segments=np.bincount(docs, minlength=len(ids))[docs].astype(np.int32))
        data = data.getvalue()
        group = int(pdf["grp"].iloc[0])
        fs, root = pafs.FileSystem.from_uri(folder)
        final = f"{root}/shard-{group:06d}.npz"
        temp = f"{root}/_tmp-{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as f:
            f.write(data)
        fs.move(temp, final)
        return pd.DataFrame({"shard": [group], "path": [f"shard-{group:06d}.npz"], "rows": [n], "segments": [len(pieces)],
                             "tokens": [int(ends[-1])], "bytes": [len(data)], "crc32": [zlib.crc32(data)]})
    return run


MANIFEST = "shard long, path string, rows long, segments long, tokens long, bytes long, crc32 long"
SEGMENTS = "doc_id long, segment int, shard long, row long, offset int, length int, ids_crc32 long, n_segments int"


def pack_documents(docs: DataFrame, id_col: str, text_col: str, folder: str, width: int = 2048,
                   group_bytes: int = 2 << 20, vocabulary: str = VOCABULARY, pad_id: int = 50256) -> DataFrame:
    """Write ``docs`` as packed shards below ``folder``; returns the manifest."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:  # a vocabulary file has a fixed size
        ranks = spark.sparkContext.broadcast(f.read())
    kind = np.uint16 if pad_id < 1 << 16 else np.uint32
    id_of = F.col(id_col).cast("long")
    full = docs.where(F.col(text_col) != "").select(F.coalesce(id_of, F.lit(0)).alias("id"), id_of.isNull().alias("missing"),
                                                    F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    root_fs, root = pafs.FileSystem.from_uri(folder)
    root_fs.create_dir(root, recursive=True)
    dealt = full.withColumn("grp", F.pmod(F.xxhash64("id", "missing", "text"), F.lit(groups)))
    done = written(dealt.groupBy("grp").applyInPandas(_pack(ranks, pad_id, width, folder, kind), MANIFEST), "manifest")
    ranks.destroy()
    return done


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """The segments found in the shards that the manifest lists, each with the
    CRC-32 of its ids (little-endian); a damaged shard raises an error."""
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for shard, path, crc in zip(pdf["shard"], pdf["path"], pdf["crc32"]):
                with fs.open_input_stream(f"{root}/{path}") as f:
                    data = f.read()
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{path} is damaged")
                z = np.load(io.BytesIO(data))
                ids, width = z["ids"].reshape(-1), z["ids"].shape[1]
                length, at = np.diff(z["cu_seqlens"]), z["position_resets"]
                yield pd.DataFrame({
                    "doc_id": pd.Series(z["doc_id"]).astype("Int64").mask(z["doc_null"]), "segment": z["segment"], "shard": shard,
                    "row": at // width, "offset": at % width, "length": length,
                    "ids_crc32": [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(at, length)],
                    "n_segments": z["n_segments"]})
    return manifest.select("shard", "path", "crc32").mapInPandas(run, SEGMENTS)


def position_ids(shard: dict) -> np.ndarray:
    """The position matrix of a loaded shard: counts up from 0 at each reset;
    padding counts on from 0 as a segment of its own."""
    ids = shard["ids"]
    starts = np.unique(np.concatenate((shard["position_resets"], np.arange(ids.shape[0]) * ids.shape[1],
                                       shard["position_resets"] + np.diff(shard["cu_seqlens"]))))
    starts = starts[starts < ids.size]
    out = np.arange(ids.size) - np.repeat(starts, np.diff(np.append(starts, ids.size)))
    return out.reshape(ids.shape)


def packed_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write shards to the shared folder, read them back: one row per segment,
    and one with ``n_segments`` 0 per document without tokens."""
    folder = new_folder(docs.sparkSession, "packed")
    manifest = pack_documents(docs, id_col, text_col, folder, **how)
    found = read_packed(manifest, folder)
    kinds = dict(x.split() for x in SEGMENTS.split(", "))
    none = docs.where(~F.coalesce(F.col(text_col) != "", F.lit(False))).select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.lit(0 if c == "n_segments" else None).cast(k).alias(c) for c, k in kinds.items() if c != "doc_id"])
    return found.unionAll(none)


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_segments(read_table(spark, sf_dir, "documents"))
