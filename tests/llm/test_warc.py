"""Archives: exact round trip, revisits, ranges and selections."""

import gzip
import pathlib

import pytest

from docloom.llm import warc
from docloom.runtime import shared_dir

PAGES = [
    (1, "http://a/1", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (9, "http://a/9", "<p>same</p>", "x"), (3, None, None, "x"), (4, "http://a/é \r\nX: y", "", "x"), (5, "u", "é🙂\r\n\r\nWARC/1.1", "x"),
    (6, "u", "long " * 200_000, "x"), (7, "u", "<p>other</p>", "x"), (None, "u", "<p>same</p>", "x"), (7, "u", "<p>other</p>", "x"), (-3, "u", "z", "x"),
]


def expected(pages):
    last = {}
    for i, _, html, *_ in pages:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html, *_ in pages:
        payload = (html or "").encode()
        again = i is not None and i < last[html or ""]
        out.append((i, len(payload), warc.digest32(payload), "revisit" if again else "response", last[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("gap,size", [(0, 1), (65_536, 8_000_000), (10**9, 10**9)])
def test_round_trip(spark, tmp_path, monkeypatch, gap, size):
    monkeypatch.setattr(warc, "GAP_BYTES", gap)
    monkeypatch.setattr(warc, "RANGE_BYTES", size)
    spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op1_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)


def test_payloads_files_and_selection(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 400)
    folder = shared_dir(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    index = warc.write_archives(warc.classify(pages), folder)
    assert index.count() == len(PAGES)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(index.where("record_type = 'response' AND page_id IS NOT NULL"), folder).collect()}
    assert back == {i: html or "" for i, _, html, _ in PAGES if i in (9, 4, 5, 6, 7, -3)}
    files = list(pathlib.Path(folder.removeprefix("file://")).glob("*.warc.gz"))
    assert len(files) > 1
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC-Type: ") == len(PAGES)
    for r in index.collect():
        f = pathlib.Path(folder.removeprefix("file://")) / r.archive
        headers, _ = warc.parse(f.read_bytes()[r.offset : r.offset + r.length])
        assert headers["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}"


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    kinds = {r.page_id: r.record_type for r in warc.classify(pages, least_bytes=12).collect()}
    assert kinds[1] == "response" and kinds[7] == "response"
    folder = shared_dir(spark)
    assert warc.read_records(warc.write_archives(warc.classify(pages.limit(0)), folder), folder).count() == 0


def test_given_pages(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = warc.op1_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(pages)
