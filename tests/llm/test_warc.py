import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tableweave.llm import warc
from tableweave.llm.files import opened


def expected(rows, least=0):
    """(id, bytes, digest, type, refers_to) of each row."""
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in raw:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in raw:
        lead = first.get(p)
        again = len(p) >= least and lead is not None and i != lead
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (5, "http://www.a.example.com/x?q=1#f", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"), (3, "https://a.example.com:8080/x", "same"),
    (9, "HTTP://B.example.org", "same"), (1, None, "same"), (2, "http://b.example.org/a b\nc", None), (7, "", ""), (8, "u", "long " * 200_000),
    (None, "http://n.example", "same"), (-4, "http://a.example.com/x", "minus"), (2**62, "http://a.example.com/x", "big"),
] + [(100 + i, "http://hot.example.net/page", f"html {i % 7}") for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, number int")


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 9)
    df = frame(spark, ROWS)
    archives = warc.write(df)
    assert rows_of(warc.read(df, archives)) == expected(ROWS)
    assert rows_of(warc.read(df, warc.write(df, least_bytes=5))) == expected(ROWS, 5)
    hits = warc.lookup(spark, archives, "http://hot.example.net/page")
    assert len(hits) == 300 and {f["WARC-Target-URI"] for f, _ in hits} == {"http://hot.example.net/page"}
    assert {f["WARC-Record-ID"] for f, _ in warc.lookup(spark, archives, "https://A.example.com/x")} == {"<urn:page:-4>", f"<urn:page:{2**62}>"}
    assert warc.lookup(spark, archives, "http://zzz.example") == [] and warc.lookup(spark, archives, "http://0.aaa") == []


def test_archives_are_plain_warc(spark):
    df = frame(spark, ROWS[:8])
    archives = warc.write(df)
    fs, path = opened(archives.folder)
    names = [x.path for x in fs.get_file_info(__import__("pyarrow.fs").fs.FileSelector(path)) if x.path.endswith("warc.gz")]
    seen = 0
    for name in names:
        with fs.open_input_file(name) as f:
            data = gzip.decompress(f.read())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            data, seen = rest[n + 4 :], seen + 1
    assert seen == 8


def test_url_keys(spark):
    urls = {
        "http://www.Blog.Example.com:80/a/B?x=1#top": "com,example,blog)/a/b?x=1", "https://user@a.b.c:8443": "c,b,a:8443)/",
        "a.b": "b,a)/", "http://a.b?q": "b,a)/?q", None: "", "http://a.b/x y": "b,a)/x%20y",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", warc.url_key(F.col("u")).alias("k")).collect()} == urls


def test_whole_table_repeats_and_no_rows(spark):
    data = Path("/root/testdata/sf0.001/pages.parquet")
    if not data.exists():
        pytest.skip("no test data")
    pages = spark.read.parquet(str(data))
    assert rows_of(warc.page_records(pages)) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    twice = ROWS[:3] + ROWS[1:3]
    assert rows_of(warc.page_records(frame(spark, twice))) == expected(twice)
    assert warc.page_records(pages.limit(0)).count() == 0
