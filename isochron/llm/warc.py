"""WARC archives with an index written first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, remove

INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit has the response's HTTP header but no body."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page:unknown"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {sha} {kind}')}>",
            "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Uri: 1")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _parse(member: bytes) -> dict:
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"record of {fields['WARC-Target-URI']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": sha, "record_type": kind,
            "refers_to": number("X-Refers-To-Page-Id"), "url": None if "X-No-Uri" in fields else fields["WARC-Target-URI"],
            "payload": payload if kind == "response" else None}


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 64 << 20, broadcast_rows: int = 500_000) -> DataFrame:
    """Write one record per page under ``path``; returns the index, a table on disk.

    Of pages with equal payloads of ``least_bytes`` or more, that with the largest
    page_id becomes the response and the others revisits that name it; a repeated row of
    that page is a response again.  Null html is an empty payload, a null page_id is less
    than any other (pages that all lack one are responses).

    Every task writes files of its own under new names, and the index lists only those
    of attempts that ended well: a lost executor leaves at most files that no index names.
    The choice of the response is a partial aggregate over digests, so a payload with a
    third of all pages costs one row per task there.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        body.alias("html"), F.sha1(body.cast("binary")).alias("_sha"))
    repeated = materialize(
        rows.where(F.octet_length("html") >= least_bytes).groupBy("_sha")
        .agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_response").isNotNull()).select("_sha", "_response"), "warc-repeated")
    # digests of 40 characters with an id: payloads stay where they lie up to this number of repeated ones
    few = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    rows = rows.join(few, "_sha", "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response")).alias("refers_to"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        out, name, at = None, "", 0
        for part in parts:
            index = []
            for page_id, url, html, refers_to in zip(part["page_id"], part["url"], part["html"], part["refers_to"], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                payload = html.encode()
                sha = digest(payload)
                member = _record(page_id, url, payload, sha, refers_to)
                out.write(member)
                index.append((name, at, len(member), url, sha, page_id, "response" if refers_to is None else "revisit"))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            made = pd.DataFrame(index, columns=["file", "offset", "length", "url", "payload_digest", "page_id", "record_type"])
            yield made.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
    # ids as text: pandas would turn a column with nulls into floats
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    index = materialize(rows.mapInPandas(write, INDEX), "warc-index")
    remove(repeated)
    return index


def read_archive(index: DataFrame, path: str, gap: int = 64 << 10, span: int = 8 << 20, held_bytes: int = 16 << 20) -> DataFrame:
    """Records that ``index`` lists (select rows of it first), payloads checked by digest.

    Within a file (bounded when written) ranges are sorted by offset; neighbours no more
    than ``gap`` bytes apart join one read of at most about ``span`` bytes.  The index is
    small beside the archives, so ranges are dealt anew by file and place: a task for every
    ``span`` bytes of records that are asked for, however few partitions the index has.
    Records leave a task as soon as ``held_bytes`` of them are unpacked, however well they
    compress; a larger one leaves alone.
    """
    asked = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    near = Window.partitionBy("file").orderBy("offset")
    start = (F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(near) > gap)
    ranges = (
        index.select("file", "offset", "length")
        .withColumn("_new", F.coalesce(start.cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_piece", F.floor(F.col("offset") / span))
        .groupBy("file", "_run", "_piece")
        .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"),
             F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .select("file", "start", "end", "records")
    )

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        for part in parts:
            for file, start, end, records in zip(part["file"], part["start"], part["end"], part["records"], strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    data = f.read_at(end - start, start)
                found, held = [], 0
                for r in records:
                    found.append(_parse(data[r["offset"] - start : r["offset"] - start + r["length"]]))
                    held += len(found[-1]["payload"] or b"")
                    if held >= held_bytes:
                        yield pd.DataFrame(found).astype({"page_id": "Int64", "refers_to": "Int64"})
                        found, held = [], 0
                if found:
                    yield pd.DataFrame(found).astype({"page_id": "Int64", "refers_to": "Int64"})

    return ranges.repartition(max(1, -(-asked // span)), "file", "start").mapInPandas(read, RECORD)


def archive_path(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
