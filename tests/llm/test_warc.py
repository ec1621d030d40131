import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tables import SF
from parley.llm import warc as W


@given(st.binary(max_size=3000), st.integers(1, 700))
def test_framing_round_trips(body, size):
    assert W.unframe(W.frame(body, size)) == body


@pytest.mark.parametrize("bad", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n\r\n", b"3\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"0\r\n", b"0\r\n\r\nmore", b"-3\r\nabc\r\n0\r\n\r\n"])
def test_broken_framing(bad):
    assert W.unframe(bad) is None


def test_extensions_and_trailers():
    assert W.unframe(b"3;name=v\r\nabc\r\n2\r\nde\r\n0\r\nX-Sum: 1\r\n\r\n") == b"abcde"


def test_pages_round_trip_in_any_order(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = W.records(pages, 200).repartition(7, "segment_number").orderBy("payload")
    got = {(r["page_id"], r["url"], r["status"], r["html"]) for r in W.pages_from_records(rows).collect()}
    assert got == {(r["page_id"], r["url"], "ok", r["html"]) for r in pages.collect()}


def record(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], W.RECORD_SQL + ", status string")


def cut(body, n, origin="<a:1>", uri="http://a"):
    parts = [body[i * len(body) // n : (i + 1) * len(body) // n] for i in range(n)]
    return [(f"<a:{k + 1}>" if k else origin, "continuation" if k else "response", uri, origin if k else None, k + 1, len(body) if k == n - 1 else None, p) for k, p in enumerate(parts)]


def status(spark, rows):
    return {r["record_id"]: (r["status"], r["body"], r["segments"]) for r in W.reassemble(record(spark, rows)).collect()}


def test_states(spark):
    body = W.HEAD + W.frame("grüße ".encode() * 50, 64)
    good = cut(body, 5)
    random.Random(1).shuffle(good)
    assert status(spark, good)["<a:1>"] == ("ok", "grüße " * 50, 5)
    assert status(spark, good + good[:2])["<a:1>"][0] == "ok"  # repeated equal segments
    parts = cut(body, 5)
    assert status(spark, parts[:2] + parts[3:])["<a:1>"] == ("missing_segment", None, 4)
    assert status(spark, parts[:4])["<a:1>"][0] == "missing_segment"  # without the last there is no total
    assert status(spark, parts[1:])["<a:1>"][0] == "missing_segment"
    wrong = [*parts[:4], (*parts[4][:5], len(body) + 1, parts[4][6])]
    assert status(spark, wrong)["<a:1>"][0] == "length_mismatch"
    other = [*parts, (*parts[2][:6], b"something else")]
    assert status(spark, other)["<a:1>"][0] == "conflict"
    assert status(spark, cut(b"no http at all", 2))["<a:1>"][0] == "bad_http"
    assert status(spark, cut(W.HEAD + b"5\r\nab", 2))["<a:1>"][0] == "bad_framing"
    assert status(spark, cut(W.HEAD + W.frame(b"\xff\xfe", 9), 2))["<a:1>"][0] == "bad_text"
    assert status(spark, cut(b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nplain", 2))["<a:1>"][:2] == ("ok", "plain")


def test_odd_rows(spark):
    assert W.reassemble(record(spark, [])).collect() == []
    whole = ("<w>", "response", None, None, None, None, b"HTTP/1.1 200 OK\r\n\r\n")
    got = status(spark, [whole, (None, "response", "u", None, None, None, b"x"), ("<n>", "response", "u", None, None, None, None)])
    assert got == {"<w>": ("ok", "", 1), "<n>": ("bad_http", None, 1)}
    pages = spark.createDataFrame([(1, None, None, 0), (2, "u", "", 0), (None, "u", "x", 0), (3, "u", "y" * 300_000, 0), (4, "u", "z", 0), (4, "u", "z", 0)], "page_id bigint, url string, html string, record_id int")
    back = sorted(((r["page_id"], r["html"], r["status"]) for r in W.pages_from_records(W.records(pages)).collect()))
    assert back == [(1, "", "ok"), (2, "", "ok"), (3, "y" * 300_000, "ok"), (4, "z", "ok"), (4, "z", "ok")]
    twice = spark.createDataFrame([(2, "u", "one"), (2, "v", "two"), (2, "u", None), (3, "w", "x")], "page_id int, url string, html string")
    got = sorted(map(tuple, W.pages_from_records(W.records(twice, 20)).collect()))
    assert got == [(2, "u", "ok", ""), (2, "u", "ok", "one"), (2, "v", "ok", "two"), (3, "w", "ok", "x")]
    assert W.pages_from_records(W.records(twice.limit(0))).collect() == []
    foreign = W.pages_from_records(record(spark, [whole])).collect()
    assert [(r["page_id"], r["status"]) for r in foreign] == [(None, "ok")]


def test_files(spark, tmp_path):
    """Records survive being written to files, segments of one record in several of them."""
    body = W.HEAD + W.frame("grüße ".encode() * 500, 64)
    parts = cut(body, 5) + [("<i>", "warcinfo", None, None, None, None, b"software: x\r\n")]
    for compress in (False, True):
        assert W.read_bytes(W.write_bytes(parts, compress)) == parts
    assert W.read_bytes(b"") == [] and W.read_bytes(b"no warc") == []
    assert W.read_bytes(W.write_bytes(parts)[:-700]) == parts[: len(W.read_bytes(W.write_bytes(parts)[:-700]))] != parts  # a file that was cut off
    folded = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <f>\r\nWARC-Target-URI: http://a\r\n /b\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    assert W.read_bytes(folded) == [("<f>", "response", "http://a /b", None, None, None, b"abc")]
    (tmp_path / "a.warc").write_bytes(W.write_bytes(parts[3:] + parts[:1]))
    (tmp_path / "b.warc.gz").write_bytes(W.write_bytes(parts[1:3], True))
    got = {r["record_id"]: (r["status"], r["body"]) for r in W.reassemble(W.read_files(spark, str(tmp_path)).where("warc_type <> 'warcinfo'")).collect()}
    assert got == {"<a:1>": ("ok", "grüße " * 500)}
