"""WARC: a deterministic sharded writer, and a reader.

Pages are range-partitioned by page_id at bounds taken from a hash-chosen sample (so the same rows give the same
shards on every run), sorted, and written as one gzip member per record. A shard rolls to its next file once
``roll_bytes`` of compressed data are in one. Record ids, dates and headers are functions of the record alone, digests
are regenerated from the payload. A task writes under a temporary name of its own and renames a file when it is
complete, so a repeated or lost task leaves the same files; the manifest, written last, names every file with its
size and digest, and readers open only what it names.

Of records with equal payloads of ``least`` bytes or more, the one with the smallest page_id is a response and the others are
revisits of it, which hold no payload. A group's revisits find their response through a narrow join on the digest
(adaptive execution splits hot ones); payloads are shuffled once.

A null html is an empty payload. Rows that repeat a page_id are records of their own: of equal payloads under one
page_id the first by url is the response where that page_id is the group's smallest. A null page_id comes last as a
candidate and revisits are then told by a null refers_to. A null url becomes a urn.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.session import delete_at_end

from .common import Scratch

DATE, ROLL, SHARD_ROWS, SAMPLE = "2024-01-01T00:00:00Z", 16 << 20, 4000, 100_000
NAMESPACE = uuid.UUID("6f1d3c58-9a54-4f0e-8a39-0d6a4f4b7c11")
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{payload_digest}/{copy}')}>"


def uri(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page_id, url: str | None, payload: bytes, copy: int, refers: tuple | None) -> bytes:
    """One WARC record; ``refers``: (page_id,) of the response that it revisits."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, own, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers[0], own, 0)}"]
        head += [f"X-Refers-To-Page-Id: {refers[0]}"] if refers[0] is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Files of one shard: written under temporary names, renamed when complete."""

    def __init__(self, root: str, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.roll, self.shard, self.out, self.done = roll, None, None, []
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"pages-{self.shard:06d}-{self.number:04d}.warc.gz"
        target = f"{self.root}/{name}"
        if self.fs.get_file_info(target).type == pafs.FileType.File:  # of an earlier attempt at this task: the same records
            self.fs.delete_file(target)
        self.fs.move(self.temporary, target)
        self.done.append((self.shard, name, self.records, self.size, self.sha.hexdigest()))
        self.out, self.number = None, self.number + 1


def shard_bounds(ids: DataFrame, n: int, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Ascending page_ids at which shards begin, from a hash-chosen sample of bounded size."""
    shards = max(1, -(-n // shard_rows))
    share = min(1.0, SAMPLE / max(1, n))
    got = ids.where("page_id is not null").where(F.pmod(F.xxhash64(F.lit(23), "page_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("page_id").toPandas()
    values = np.sort(got["page_id"].to_numpy(np.int64))
    return sorted({int(values[len(values) * k // shards]) for k in range(1, shards)}) if len(values) else []


def write(spark: SparkSession, pages: DataFrame, root: str, roll_bytes: int = ROLL, least: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``root``; returns the manifest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n"))
    scratch = Scratch(spark, "warc")
    ids = scratch.keep(ids, "ids")
    bounds = shard_bounds(ids, ids.count(), shard_rows)

    def shard(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(np.searchsorted(np.array(bounds, np.int64), x.fillna(-(1 << 63)).to_numpy(np.int64), "right"))

        return frame.withColumn("shard", F.pandas_udf(run, "long")("page_id"))

    groups = ids.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1")
    notes = ids.join(groups.select("sha", "first"), "sha").select("page_id", "sha", "first").distinct()
    text = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first"))
    both = text.union(notes.select("page_id", "sha", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "first"))
    order = ["shard", "page_id", "sha", "kind", "url"]
    # a shard is in one range; tasks are of a shard or a few neighbours, whatever the input
    stream = shard(both).repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Roller(root, roll_bytes)
        now, copy, group = None, 0, None
        for x in batches:
            for at, page, sha, kind, url, html, first in x.astype({"page_id": "Int64", "first": "Int64"}).itertuples(index=False, name=None):
                page, first = None if page is pd.NA else int(page), None if first is pd.NA else int(first)
                if (page, sha) != now:
                    now, copy, group = (page, sha), 0, None
                if kind == 0:
                    group = (first,)
                    continue
                leader = group is None or (page == group[0] and copy == 0)
                files.add(int(at), record(page, url, html.encode("utf-8", "surrogatepass"), copy, None if leader else group))
                copy += 1
        files.close()
        yield pd.DataFrame(files.done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    made = stream.select("shard", "page_id", "sha", "kind", "url", "html", "first").mapInPandas(run, MANIFEST)
    made.write.mode("overwrite").parquet(f"{root}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            out.append(z.decompress(rest))
            rest = z.unused_data if z.eof else stream.read(size)
            if not z.eof and not rest:
                raise EOFError("a record is cut off")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def read(spark: SparkSession, root: str, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives that the manifest names; digests are checked. html only with ``payload``, for responses."""
    files = manifest.select("file", "sha256")
    parts = max(1, min(10_000, manifest.count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        for x in batches:
            for name in x["file"]:
                out = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for data in members(f):
                        h, block = parse(data)
                        if f"sha1:{digest(block)}" != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block's digest is wrong")
                        kind, html = h["WARC-Type"], None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if f"sha1:{digest(body)}" != h["WARC-Payload-Digest"] or len(body) != int(h["X-Payload-Length"]):
                                raise ValueError(f"{name}: a payload's digest is wrong")
                            html = body.decode("utf-8", "surrogatepass") if payload else None
                        page, first = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                        out.append((page and int(page), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], kind, first and int(first), h["WARC-Target-URI"], html))
                        if len(out) >= (256 if payload else 20_000):
                            yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.repartition(parts, "file").mapInPandas(run, READ)


def round_trip(spark: SparkSession, pages: DataFrame, roll_bytes: int = ROLL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write ``pages`` to the shared scratch folder and read the archives back."""
    root = Scratch(spark, "archives").root
    manifest = write(spark, pages, root, roll_bytes, shard_rows=shard_rows)
    delete_at_end(spark, root)
    return read(spark, root, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
