"""Deterministic sharded WARC writer, and its reader.

Records are sorted by page id and cut into shards of about ``shard_bytes`` of
payload: exact running sums over the ids give the cuts, so shards depend on
the rows alone, not on Spark's partitions.  One task writes a shard: headers
and digests are made anew, each record is a gzip member, and a file is rolled
when its compressed size would pass ``roll_bytes``.  Files are written under
temporary names; the manifest table of the finished tasks decides which of
them are renamed, so lost or repeated tasks leave nothing in the archive.
The same rows give byte-equal files.

Equal payloads of ``min_revisit`` bytes or more are kept once: the smallest
page id is the response, the others are revisit records.

Only page ids, sizes and digests take part in finding repeats and cuts (a
digest that a third of the pages share is reduced map-side, and its join is
split by AQE); payloads are shuffled once, into their shards.

Defined cases: a null payload is an empty one; a null url gives an empty
target URI; rows with a null id are written first, always as responses, and
nothing refers to them; rows that repeat an id keep their number, the first
being the response among equal payloads; an empty table gives an archive
without files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import new_folder, read_table, written

# fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
MANIFEST = "shard long, seq int, temp string, path string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string"


def record_id(page_id: str, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{nth}')}>"


def record(page_id, nth: int, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; ``refers_to`` is the response's page id, or None."""
    one_line = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = "" if page_id is None else str(page_id)
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(own, digest, nth)}", f"WARC-Date: {date}", f"WARC-Target-URI: {one_line}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            f"X-Page-ID: {own}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to), digest, 0)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _write(folder: str, roll_bytes: int, date: str, run_id: str):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: a shard's pages; right: its pages that repeat a payload."""
        fs, root = pafs.FileSystem.from_uri(folder)
        out, files = {c.split()[0]: [] for c in MANIFEST.split(", ")}, []
        refers = {(p, d): r for p, d, r in zip(right["page_id"], right["digest"], right["refers_to"])}
        # equal ids in order of url and payload, so that ties do not depend on arrival
        pages = left.sort_values(["has_id", "page_id", "url", "html"], na_position="first", kind="stable")
        shard, seen, responded = int(left["shard"].iloc[0]) if len(left) else -1, {}, set()

        def start():
            name = f"part-{shard:06d}-{len(files):04d}.warc.gz"
            temp = f"_tmp-{run_id}-{uuid.uuid4().hex}-{name}"
            files.append({"stream": fs.open_output_stream(f"{root}/{temp}", compression=None), "sha": hashlib.sha256(), "name": name,
                          "temp": temp, "ids": [], "size": 0})

        def close():
            own = files[-1]
            own["stream"].close()
            ids = [x for x in own["ids"] if x is not None]
            for c, v in (("shard", shard), ("seq", len(files) - 1), ("temp", own["temp"]), ("path", own["name"]), ("records", len(own["ids"])),
                         ("bytes", own["size"]), ("sha256", own["sha"].hexdigest()),
                         ("first_id", min(ids, default=None)), ("last_id", max(ids, default=None))):
                out[c].append(v)

        for has, page, url, html in zip(pages["has_id"], pages["page_id"], pages["url"], pages["html"]):
            page = int(page) if has else None
            payload = (html or "").encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(payload).hexdigest()
            nth = seen[(page, digest)] = seen.get((page, digest), -1) + 1
            to = refers.get((page, digest)) if has else None
            if to == page and (page, digest) not in responded:
                responded.add((page, digest))
                to = None
            member = gzip.compress(record(page, nth, url, payload, digest, None if to is None else int(to), date), 6, mtime=0)
            if not files or files[-1]["size"] + len(member) > roll_bytes:
                if files:
                    close()
                start()
            files[-1]["stream"].write(member)
            files[-1]["sha"].update(member)
            files[-1]["ids"].append(page)
            files[-1]["size"] += len(member)
        if files:
            close()
        frame = pd.DataFrame(out)
        return frame.astype({"first_id": "Int64", "last_id": "Int64"})
    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               shard_bytes: int = 256 << 20, roll_bytes: int = 1 << 30, min_revisit: int = 100,
               date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as WARC files below ``folder``; returns the manifest."""
    spark = pages.sparkSession
    # rows without an id come first, in order of a hash of their own
    p = pages.select(F.col(id_col).isNotNull().alias("has_id"),
                     F.coalesce(F.col(id_col).cast("long"), F.xxhash64(url_col, html_col)).alias("page_id"),
                     F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    light = written(p.select("has_id", "page_id", F.octet_length("html").cast("long").alias("n"),
                             F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
                    .repartitionByRange(F.col("has_id"), F.col("page_id"))
                    .withColumn("pid", F.spark_partition_id()), "light")
    # exact running sums over the sorted ids: per partition, plus the sums before it
    # (one row per partition on the driver); equal ids stay together
    step = F.lit(512)  # headers of a record
    sums = sorted(light.groupBy("pid").agg(F.sum(F.col("n") + step).alias("s")).collect())
    before = dict(zip([r["pid"] for r in sums], np.concatenate(([0], np.cumsum([r["s"] for r in sums])[:-1])).tolist() if sums else []))
    start = spark.createDataFrame(list(before.items()) or [(-1, 0)], "pid int, before long")
    run = F.expr("sum(n + 512) over (partition by pid order by has_id, page_id range unbounded preceding) - n - 512")
    cuts = (light.join(start, "pid").select("has_id", "page_id", ((run + F.col("before")) / shard_bytes).cast("long").alias("shard"))
            .groupBy("shard").agg(F.min(F.struct("has_id", "page_id")).alias("first")).orderBy("shard").collect())
    # one cut per shard, so their number is the payload over shard_bytes
    firsts = sorted((bool(r["first"]["has_id"]), r["first"]["page_id"]) for r in cuts)
    without, keys = (np.array([k for h, k in firsts if h == has], dtype=np.int64) for has in (False, True))

    @F.pandas_udf("long")
    def shard_of(has: pd.Series, page: pd.Series) -> pd.Series:
        page = page.to_numpy()
        return pd.Series(np.where(has, len(without) + np.searchsorted(keys, page, side="right"),
                                  np.searchsorted(without, page, side="right")) - 1)

    # payloads that repeat: the smallest id of each is the response
    repeats = written(light.where(F.col("has_id") & (F.col("n") >= min_revisit)).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "repeats")
    again = written(light.where("has_id").join(repeats, "digest").select("has_id", "page_id", "digest", "refers_to").distinct(), "again")
    root_fs, root = pafs.FileSystem.from_uri(folder)
    root_fs.create_dir(root, recursive=True)
    left = p.withColumn("shard", shard_of("has_id", "page_id"))
    right = again.withColumn("shard", shard_of("has_id", "page_id"))
    # an explicit count, which AQE does not merge: shards are large enough for tasks of their own
    parts, run_id = max(1, len(firsts)), uuid.uuid4().hex
    done = written(left.repartition(parts, "shard").groupBy("shard").cogroup(right.repartition(parts, "shard").groupBy("shard"))
                   .applyInPandas(_write(folder, roll_bytes, date, run_id), MANIFEST), "done")

    def commit(batches):
        """Give the finished files their names (again, where a task is repeated)."""
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for temp, path in zip(pdf["temp"], pdf["path"]):
                if fs.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{path}")
                elif fs.get_file_info(f"{root}/{path}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(path)
            yield pdf.drop(columns="temp")
    columns = ", ".join(c for c in MANIFEST.split(", ") if not c.startswith("temp"))
    manifest = written(done.mapInPandas(commit, columns), "manifest")
    for left_over in root_fs.get_file_info(pafs.FileSelector(root)):  # of own tasks that were lost or repeated
        if left_over.base_name.startswith(f"_tmp-{run_id}-"):
            root_fs.delete_file(left_over.path)
    return manifest


def records_of(stream) -> tuple:
    """(headers, block) of each record of an open, unzipped archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"{head['warc-record-id']}: the block does not match its digest")
        yield head, block


def read_warc(manifest: DataFrame, folder: str, task_bytes: int = 256 << 20) -> DataFrame:
    """A row per record of the files that the manifest lists; block and
    payload digests are verified on the way."""
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                with fs.open_input_file(f"{root}/{path}") as f, gzip.GzipFile(fileobj=f) as g:
                    for head, block in records_of(io.BufferedReader(g)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload does not match its digest")
                        page, to = head["x-page-id"], head.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, head["warc-target-uri"], int(said[b"Content-Length"]), digest,
                                     head["warc-type"], int(to) if to else None, path))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
    # a task for about `task_bytes` of archive, but no more tasks than files
    files, size = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(files, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // task_bytes))))
    return manifest.select("path").repartition(tasks, "path").mapInPandas(run, RECORDS)


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back.  Files are small here,
    as the tables are: 4 MB of payload a shard, files of 1 MB."""
    folder = new_folder(spark, "warc")
    manifest = write_warc(read_table(spark, sf_dir, "pages"), folder, shard_bytes=4 << 20, roll_bytes=1 << 20)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
