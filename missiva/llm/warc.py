"""Operator 7, WARC: a deterministic sharded writer, and its reader.

* Payload digests (SHA-1) are taken where the pages are read; the smallest facts (digest, page_id) are grouped, the
  largest page_id of each digest of at least ``min_revisit_bytes`` is its response, the others revisit it.
* Shard borders are quantiles, by bytes, of a hash sample of page_ids (SAMPLE rows, or PER_SHARD a shard if that is more),
  so that reruns cut alike and shards are even. Each shard is a range of page_ids and one partition; rows without a
  page_id have shards of their own, by digest. The pages and the facts on them travel in one stream, sorted within the
  shard, so that each page's facts arrive just before it: html is shuffled once and nothing is joined to it.
* A task writes each shard's records as gzip members of their own, with headers and digests made anew, and rolls to a
  new file at ``roll_bytes`` compressed bytes. A file is written under a temporary name of its task attempt and renamed
  when whole; the manifest, a table with a row per file, is committed by Spark and names the files that count. A lost
  executor's task writes the same bytes again.

Archives are written through pyarrow's file systems (file, hdfs, s3, gs) and read by Spark's binaryFile source.

Defined results: a null html is an empty payload; a null url is written as ``urn:none``; rows without a page_id come
last, and can't be referred to; rows with equal page_id and payload are each written, one response and the others
revisits of it where the digest's largest page_id is theirs; extra columns are not read; an empty table writes none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.llm.common import drop, scratch_path, written

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
SAMPLE = 20_000
PER_SHARD = 4
NAMESPACE = uuid.UUID("6f1f6b0e-53a5-4d52-9d0c-6d3a0c1b7a11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """One WARC/1.1 record, a gzip member of its own. refers_to: the response's page_id if this is a revisit."""
    digest, revisit = _b32(payload), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{_b32(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head = "\r\n".join([*headers, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file of gzip members; block digests are checked."""
    at = 0
    while at < len(data):
        one = zlib.decompressobj(31)
        whole = one.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + (1 << 16)])
        used = at + (1 << 16)
        while not one.eof:
            if used >= len(data):
                raise ValueError("truncated archive")
            whole += one.decompress(data[used : used + (1 << 16)])
            used += 1 << 16
        at = min(used, len(data)) - len(one.unused_data)
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != f"sha1:{_b32(block)}":
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        yield headers, block


def _borders(pages: DataFrame, shard_bytes: int) -> tuple[list[int], int]:
    """The page_ids that begin a shard, for shards of about shard_bytes, and the number of shards of rows without page_id."""
    size = F.octet_length("html").cast("long")
    named = F.col("page_id").isNotNull()
    rows, total, rest = pages.agg(F.count_if(named), F.coalesce(F.sum(F.when(named, size)), F.lit(0)), F.coalesce(F.sum(F.when(~named, size + 1)), F.lit(0))).first()
    shards = max(1, -(-int(total) // shard_bytes))
    share = min(1.0, max(SAMPLE, PER_SHARD * shards) / max(1, rows))
    drawn = pages.filter(named & (F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("page_id", (size + 1).alias("n")).toPandas()
    drawn = drawn.sort_values(["page_id", "n"])
    ends = drawn["n"].cumsum().to_numpy()
    at = np.searchsorted(ends, [ends[-1] * i / shards for i in range(1, shards)]) if len(drawn) else []
    return sorted({int(drawn["page_id"].iloc[i]) for i in at}), -(-int(rest) // shard_bytes)


def write_archives(pages: DataFrame, path: str, *, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives under path; returns the manifest (also written, to path/manifest): a row per file."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1("html")))
    facts = base.select("page_id", "digest", F.octet_length("html").alias("n"))
    firsts = facts.filter(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = written(firsts.select("digest", "response"), "firsts")  # a table, so that Spark can split the join on a digest of very many pages
    refs = facts.join(firsts, "digest").groupBy("page_id", "digest").agg(F.first("response").alias("response")).filter("response is not null")
    borders, nameless = _borders(base, shard_bytes)
    stream = (
        base.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("response"))
        .unionByName(refs.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "response"))
        .withColumn("shard", F.when(F.col("page_id").isNotNull(), _shard_of("page_id", borders)).otherwise(len(borders) + 1 + F.pmod(F.xxhash64("digest"), F.lit(max(1, nameless)))))
    )
    sort = ["shard", "page_id", "digest", "kind", "url"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(f"{root}/tmp", recursive=True)
        out: list[dict] = []
        sink, size, now, roll, seen, sha = None, 0, None, 0, 0, None
        first = last = None
        facts_of, response, before, copy = None, None, None, 0

        def close() -> None:
            nonlocal sink
            if sink is None:
                return
            sink.close()
            name = f"shard-{now:06d}-{roll:05d}.warc.gz"
            try:
                store.move(f"{root}/tmp/{name}.{attempt}", f"{root}/{name}")
            except OSError:  # some stores don't rename onto a file; another attempt's has the same bytes
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise
                store.delete_file(f"{root}/tmp/{name}.{attempt}")
            out.append({"file": name, "shard": now, "roll": roll, "records": seen, "bytes": size, "sha1": sha.hexdigest(), "first_page": first, "last_page": last})
            sink = None

        for batch in batches:
            for shard, page_id, digest, kind, url, html, ref in zip(*(batch.column(i) for i in range(7)), strict=True):
                shard, page_id, digest = shard.as_py(), page_id.as_py(), digest.as_py()
                if kind.as_py() == 0:
                    facts_of, response = (page_id, digest), ref.as_py()
                    continue
                mine = (page_id, digest)
                copy = copy + 1 if mine == before else 0
                before = mine
                refers = response if facts_of == mine and (response != page_id or copy) else None
                if sink is not None and (shard != now or size >= roll_bytes):
                    close()
                    roll = roll + 1 if shard == now else 0
                elif sink is None:
                    roll = 0
                if sink is None:
                    now, size, seen, sha, first = shard, 0, 0, hashlib.sha1(), page_id
                    sink = store.open_output_stream(f"{root}/tmp/shard-{now:06d}-{roll:05d}.warc.gz.{attempt}", compression=None)
                data = record(page_id, url.as_py(), html.as_py(), refers, copy)
                sink.write(data)
                sha.update(data)
                size, seen, last = size + len(data), seen + 1, page_id
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), *((x, pa.int64()) for x in ("shard", "roll", "records", "bytes")), ("sha1", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())]))

    manifest = (
        stream.select("shard", "page_id", "digest", "kind", "url", "html", "response")
        .repartitionById(len(borders) + 1 + nameless, F.col("shard").cast("int"))
        .sortWithinPartitions(*sort)
        .mapInArrow(write, "file string, shard long, roll long, records long, bytes long, sha1 string, first_page long, last_page long")
    )
    manifest.write.parquet(f"{path}/manifest")
    drop(firsts)
    return pages.sparkSession.read.parquet(f"{path}/manifest")


def _shard_of(column: str, borders: list[int]):
    starts = np.array(borders, np.int64)

    @F.arrow_udf("long")
    def shard(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(starts, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right").astype(np.int64))

    return shard(F.col(column))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files that the manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    named = spark.read.parquet(f"{path}/manifest").select("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(named, "file", "left_semi").select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = [[] for _ in names]
                for headers, block in records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and _b32(payload) != digest:
                        raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    values = (int(page) if page else None, size, digest, headers["WARC-Type"], int(refers) if refers else None, payload if headers["WARC-Type"] == "response" else None)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    if len(rows[0]) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)
                        rows = [[] for _ in names]
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)


#: Base32 by groups of five hex digits, which are four base32 digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> b) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM m
"""
