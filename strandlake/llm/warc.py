"""WARC: archives are written with an index first, and read by coalesced byte ranges.

A writing task streams its pages into archive files of the shared folder, each record a gzip
member of its own, and gives file, offset, length, URL and digest of each record; these rows
are the index, a Parquet table beside the archives. A task that is run again writes files of
other names, and the index names those of the attempt that counted. Readers select records by
the index; what they selected is sorted by file and offset, ranges that (nearly) touch are read
at once, and members are cut out of what was read.

Of equal payloads only one is stored: the others are revisit records, which name it. Payloads
are compared by digests; pages travel once, with the digests that they share, but for pages of
very frequent payloads, which meet a broadcast of bounded size where they are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import checkpointed, chunks, shared_folder, table, tidy

#: Bytes of an archive file, about; compression level.
FILE_BYTES, LEVEL = 1 << 30, 1
#: Payloads that may be so frequent that they are broadcast: of n pages those of more than n / HOT.
HOT = 10_000
#: Stretches of a file that a task reads whole, most bytes that are read at once (unless one record is longer), and bytes between ranges that are read along.
STRETCH, AT_ONCE, GAP = 64 << 20, 4 << 20, 64 << 10
INDEX = "page_id long, url string, digest string, type string, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, to_page, to_url) of pages(page_id, url, html): of records that revisit another, the page of that one."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    shared = checkpointed(p.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("to"), F.count("*").alias("n")).where("n > 1 and to.page_id is not null"))
    often = F.col("n") > pages.count() // HOT
    hot, cold = F.broadcast(shared.where(often).drop("n")), shared.where(~often).drop("n")
    # the few pages of a payload meet where they are hashed to; its digests are held, the pages stream by
    rest = p.join(hot.select("sha"), "sha", "left_anti").join(cold.hint("shuffle_hash"), "sha", "left")
    every = p.join(hot, "sha").unionByName(rest)
    again = F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to.page_id"))
    return every.select("page_id", "url", "payload", F.when(again, F.col("to.page_id")).alias("to_page"), F.when(again, F.col("to.url")).alias("to_url"))


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}').urn}>"


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """A WARC record; fields that are None are left out."""
    head = {"WARC-Type": kind, **fields, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, to_page: int | None, to_url: str | None, date: str) -> tuple[str, str, bytes]:
    """Type, digest and record of a page. A revisit has the headers of the response that it stands for, and no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    # spaces and controls would end a header's line or value
    fields: dict[str, object] = {"WARC-Date": date, "WARC-Target-URI": None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~"), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Page-ID": page_id, "Content-Type": "application/http;msgtype=response"}
    if to_page is None:
        return "response", digest, record("response", {"WARC-Record-ID": record_id(page_id, url, digest)} | fields, http + payload)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(to_page, to_url, digest), "WARC-Refers-To-Page-ID": to_page}
    return "revisit", digest, record("revisit", {"WARC-Record-ID": f"<{uuid.uuid4().urn}>"} | fields, http)


def packed(data: bytes) -> bytes:
    return zlib.compress(data, LEVEL, wbits=31)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder, as Hadoop writes it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for b in chunks(batch, "payload"):
                    rows = []
                    for r in b.to_pylist():
                        if out is None or at >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                            info = packed(record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                            out.write(info)
                            at += len(info)
                        kind, digest, text = page_record(**r, date=date)
                        member = packed(text)
                        out.write(member)
                        rows.append((r["page_id"], r["url"], digest, kind, name, at, len(member)))
                        at += len(member)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return write


def write(pages: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes a record for each of pages(page_id, url, html) to archives in the folder, and gives their index, which is stored there as well.

    The index is (page_id, url, digest, type, file, offset, length). A null html is an empty
    payload. Of equal payloads the page with the largest page_id is the response, and the
    others revisit it; rows that repeat that page_id are responses too. Null page_ids are smaller than
    any, and if all of a payload are null all are responses. Null urls are left out of a record's head.
    Other columns are left out, whatever their names; no pages give an empty index.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    marked(pages).mapInArrow(tidy(_write(folder, date)), INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record's head and of the HTTP head in its block, and what follows that."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at the given place: {version[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def runs(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Rows of (file, offset, length), in order, in runs that are read at once."""
    held: list[dict] = []
    for r in rows:
        if held:
            end = held[-1]["offset"] + held[-1]["length"]
            if r["file"] != held[-1]["file"] or r["offset"] > end + GAP or r["offset"] + r["length"] - held[0]["offset"] > AT_ONCE:
                yield held
                held = []
        held.append(r)
    if held:
        yield held


def _read(folder: str, payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name, source = "", None
        for run in runs(r for b in batches for r in b.to_pylist()):
            if run[0]["file"] != name:
                if source is not None:
                    source.close()
                name = run[0]["file"]
                source = store.open_input_file(f"{path}/{name}")
            first = run[0]["offset"]
            data = source.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
            rows = []
            for r in run:
                fields, http, body = parsed(data[r["offset"] - first : r["offset"] - first + r["length"]])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                size = int(http["Content-Length"])
                if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
                    raise ValueError(f"a payload in {name} at {r['offset']} isn't what its record says")
                ids = [int(fields[k]) if k in fields else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
                rows.append((ids[0], r["url"], size, digest, kind, ids[1], body if payload and kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)
        if source is not None:
            source.close()

    return read


def read(selected: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records that rows of an index name, each once a row.

    Size and digest are the full payload's, of a revisit those that its record states; its payload is null.
    Payloads are checked against their digests.
    """
    places = selected.select("url", "file", "offset", "length")
    # by bytes of archive, not of index: adaptive execution would gather these few rows in few tasks
    tasks = max(16, (places.agg(F.sum("length")).first()[0] or 0) // STRETCH)
    ordered = places.repartition(tasks, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(tidy(_read(folder, payload)), RECORD)


def op13_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> str:
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
 d AS (SELECT *, array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(sha1(html), CAST(5 * i + 1 AS INT), 5) AS INT)), lambda v: {letters}), '') AS digest FROM p)
 SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""
