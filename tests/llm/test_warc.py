"""Archives read back whole, by selection, and as other tools would read them."""

import base64
import gzip
import hashlib
import uuid
from urllib.parse import unquote

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.llm import warc

from .conftest import SF

PAGES = [(1, "http://a/x y?é=%20", "<p>é\r\n\r\nx</p>"), (2, None, None), (3, "http://a/", ""), (4, "http://b/", "<p>one</p>"), (9, "http://b/2", "<p>one</p>"), (7, "http://c/\r\nevil: 1", "<p>one</p>")]
PAGES += [(None, "http://n/", "<p>one</p>"), (None, "http://n/", "alone"), (None, "http://n/2", "alone"), (9, "http://b/2", "<p>one</p>"), (12, "u", "long " * 400_000), (11, "u", "long " * 400_000), (13, "u", "WARC/1.1\r\n\r\n")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(pages):
    rows = []
    for i, _, html in pages:
        ids = [k for k, _, h in pages if (h or "") == (html or "") and k is not None]
        top = max(ids, default=None)
        again = top is not None and i != top
        rows.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", top if again else None))
    return sorted(rows, key=str)


@pytest.fixture
def folder(tmp_path):
    return f"file:{tmp_path}/archive"


@pytest.mark.parametrize("hot", [1, 10_000])
def test_round_trip(spark, folder, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    df = spark.createDataFrame([(*p, "s", 1, "t", 2) for p in PAGES], "page_id long, url string, html string, sha string, n int, to string, `a.b` int").repartition(3)
    index = warc.write(df, folder)
    got = warc.read(index, folder).collect()
    assert sorted([tuple(r)[0:1] + tuple(r)[2:6] for r in got], key=str) == brute(PAGES)
    assert sorted(str((r.page_id, r.url)) for r in got) == sorted(str(p[:2]) for p in PAGES)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert digest(r.payload.decode()) == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {(r.page_id, r.digest, r.type) for r in index.collect()} == {(r.page_id, r.payload_digest, r.record_type) for r in got}


def test_selected_records_and_coalesced_ranges(spark, folder, monkeypatch):
    pages = [(k, f"http://h{k % 7}/{k}", f"<p>{k}</p>" * 50) for k in range(400)]
    index = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    some = index.where(F.col("url").startswith("http://h3/"))
    assert sorted((r.page_id, r.payload.decode()) for r in warc.read(some, folder).collect()) == [(k, h) for k, _, h in pages if k % 7 == 3]
    rows = [r.asDict() for r in index.orderBy("file", "offset").collect()]
    whole = list(warc.runs(iter(rows)))
    assert len(whole) == len({r["file"] for r in rows}) and [r for run in whole for r in run] == rows
    monkeypatch.setattr(warc, "GAP", 0)
    assert len(list(warc.runs(iter(rows[::2])))) == len(rows[::2])
    monkeypatch.setattr(warc, "AT_ONCE", 1)
    assert len(list(warc.runs(iter(rows)))) == len(rows)


def test_files_are_standard(spark, folder, monkeypatch):
    """A file is gzip as a whole; its records follow each other by Content-Length; files are cut by size."""
    monkeypatch.setattr(warc, "FILE_BYTES", 700)  # this process's value doesn't reach workers of a running session
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    index = warc.write(pages, folder)
    names = {r.file for r in index.select("file").distinct().collect()}
    seen = []
    for name in names:
        data = gzip.open(f"{folder.removeprefix('file:')}/{name}").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            uuid.UUID(fields["WARC-Record-ID"].strip("<>").removeprefix("urn:uuid:"))
            seen.append((fields["WARC-Type"], fields))
            data = rest[n + 4 :]
    ids = {f["WARC-Record-ID"] for kind, f in seen if kind == "response"}
    assert all(f["WARC-Refers-To"] in ids for kind, f in seen if kind == "revisit")
    assert sum(kind == "warcinfo" for kind, _ in seen) == len(names) and len(seen) == len(PAGES) + len(names)
    assert {unquote(f["WARC-Target-URI"]) for _, f in seen if "WARC-Target-URI" in f} == {unquote(u) for _, u, _ in PAGES if u}


def test_changed_bytes_are_found(spark, folder):
    index = warc.write(spark.createDataFrame([(1, "u", "text " * 100)], "page_id long, url string, html string"), folder)
    r = index.first()
    path = f"{folder.removeprefix('file:')}/{r.file}"
    data = open(path, "rb").read()
    member = warc.packed(warc.page_record(1, "u", b"other" * 100, None, None, "2020-01-01T00:00:00Z")[2].replace(warc.base32_sha1(b"other" * 100).encode(), r.digest.encode()))
    with open(path, "wb") as f:
        f.write(data[: r.offset] + member)
    with pytest.raises(Exception, match="isn't what its record says"):
        warc.read(index.withColumn("length", F.lit(len(member)).cast("long")), folder).collect()


def test_empty(spark, folder):
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(index, folder).count() == 0


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    theirs = con.sql(warc.oracle_sql()).df().sort_values("page_id").reset_index(drop=True)
    ours = warc.op13_warc_index_first(spark, SF).toPandas().sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(ours, theirs[ours.columns], check_dtype=False)
