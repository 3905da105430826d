import hashlib

import pytest

from lanegraph.llm import warc
from lanegraph.stage import fresh_path


def fake(payload: str) -> str:
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"


def pages():
    inside = "start " + fake("evil") + fake("evil twin") + " middle WARC/1.1\r\nno header" + " end"
    return [
        (1, "http://a/1", "<html>" + "x" * 200), (2, "http://a/2\r\nX: y", "<html>" + "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (7, "u", inside), (8, "u", fake("y" * 150)), (9, "u", "é日本" * 60), (10, "u", "WARC/1.1\r\n"), (11, "u", "WARC/1.1\r\n" * 30), (12, "u", "\r\n\r\n" + "z" * 120), (13, "u", "é日本" * 60),
    ]


@pytest.mark.parametrize("compression,split", [("gzip", None), ("none", None), ("none", 700)])
def test_round_trip(spark, compression, split):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = fresh_path(spark, "warc-test")
    warc.write(warc.plan_records(df), path, compression=compression)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = warc.read(spark, path, payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda t: int(t.removeprefix("<urn:x-page:").removesuffix(">"))
    by = {key(r["record_id"]): r for r in got}
    assert len(got) == len(rows) and set(by) == {r[0] for r in rows}
    first = {}
    for k, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and data in first
        first.setdefault(data, k)
        r = by[k]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert r["record_type"] == ("revisit" if again else "response")
        assert (key(r["refers_to"]) if again else r["refers_to"]) == (first[data] if again else None)
        if not again:
            assert bytes(r["payload"]) == data


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-none")
    warc.write(warc.plan_records(df), path)
    assert warc.read(spark, path).count() == 0


def test_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", "q" * 300), (1, "a", "q" * 300), (None, "b", "q" * 300), (2, "c", "q" * 300)], "page_id long, url string, html string")
    kinds = sorted((r["key"] or 0, r["record_type"], r["refers_to"]) for r in warc.plan_records(df).collect())
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_other_columns_are_not_archived(spark):
    """Columns named as those of a plan or of a piece do no harm."""
    df = spark.createDataFrame([(1, "a", "q" * 300, "x", 7, None), (2, "b", "q" * 300, "y", 8, 1.5)], "page_id long, url string, html string, payload string, key long, refers_to double")
    path = fresh_path(spark, "warc-extra")
    warc.write(warc.plan_records(df.select("page_id", "url", "html", "payload", "key", "refers_to")), path)
    got = sorted((r["record_type"], r["payload_bytes"], r["url"]) for r in warc.read(spark, path).collect())
    assert got == [("response", 300, "a"), ("revisit", 300, "b")]
