from __future__ import annotations

import datetime as dt

import pytest

from repseq.llm import warc as R

SCHEMA = "record_id long, kind string, uri string, at timestamp, status int, headers map<string, string>, digest string, url string"


def day(n: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#f", "example.com/a?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com:443/x?ref=1", "example.com/x"),
        (" no url ", "no url"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(R.canonical_url("u")).first()[0] == want


def test_resolution(spark):
    u, v = "http://a.org/x", "https://www.a.org/x/#top"
    rows = [
        (1, "response", u, day(0), 200, {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "old"}, "d1", "x"),
        (2, "response", u, day(3), 200, {"ETag": '"2"', "Last-Modified": "m"}, "d2", "x"),
        (3, "response", u, day(5), 404, {"ETag": '"9"'}, "d3", "x"),
        (10, "revisit", v, day(0), 304, {"ETag": '"1"'}, None, "x"),  # nothing is strictly earlier
        (11, "revisit", v, day(2), 304, {"etag": 'W/"1"', "Cache-Control": "new", "Content-Type": "no"}, None, "x"),
        (12, "revisit", v, day(4), 304, {"ETag": '"1"'}, None, "x"),  # of an older version
        (13, "revisit", v, day(40), 304, {"last-modified": "m"}, None, "x"),
        (13, "revisit", v, day(40), 304, {"last-modified": "m"}, None, "x"),
        (14, "revisit", v, day(40), 304, {}, None, "x"),
        (15, "revisit", v, day(40), 304, None, None, "x"),
        (16, "revisit", None, day(40), 304, {"ETag": '"2"'}, None, "x"),
        (17, "revisit", v, None, 304, {"ETag": '"2"'}, None, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = R.resolve_revisits(df).collect()
    got = {r.record_id: (r.outcome, r.response_id) for r in out}
    assert len(out) == 9 and got == {10: ("no_response", None), 11: ("resolved", 1), 12: ("mismatch", None), 13: ("resolved", 2), 14: ("unvalidated", None), 15: ("unvalidated", None), 16: ("no_response", None), 17: ("no_response", None)}
    merged = next(r.headers for r in out if r.record_id == 11)
    assert merged == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "new"}
    bodies = spark.createDataFrame([(1, "one"), (2, "two")], "record_id long, body string")
    assert {r.record_id: r.body for r in R.resolve_revisits(df, bodies=bodies).collect()}[13] == "two"
    assert R.resolve_revisits(df.limit(0)).count() == 0
    for span in (60, 10**9):
        assert {(r.record_id, r.outcome) for r in R.resolve_revisits(df, span=span).collect()} == {(r.record_id, r.outcome) for r in out}
