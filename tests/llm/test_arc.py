"""Archive conversion: both ARC versions, damaged files, revisits."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from rillflow.llm import arc

HTTP = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n"


def archive(version, bodies, about=True):
    head = arc.arc_record(version, "filedesc://x", "0.0.0.0", "20200101000000", "text/plain",
                          f"{version} 0 me\n{arc.FIELDS[version]}\n".encode(), 0)
    parts = [head] * about + [arc.arc_record(version, "http://a.b/c d", "1.2.3.4", "20010203040506", "text/html", b, i)
                              for i, b in enumerate(bodies)]
    return b"".join(p + b"\n" for p in parts)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("about", [True, False])
def test_lengths_are_trusted_not_contents(version, about):
    bodies = [HTTP + b"http://x 1.1.1.1 20200101000000 text/html 3\nabc\n", b"", b"\n\n", HTTP + bytes(range(256))]
    for data in (archive(version, bodies, about), gzip.compress(archive(version, bodies, about))):
        got = list(arc.parse_arc(data))
        assert [x[3] for x in got] == bodies
        assert all(x[0] == version and not x[4] for x in got)
        assert got[0][2][0] == "http://a.b/c%20d"


def test_damaged_archives():
    data = archive(1, [b"first", b"second"])
    assert [(x[3], x[4]) for x in arc.parse_arc(data[:-4])] == [(b"first", False), (b"sec", True)]
    noisy = archive(1, [b"first"]) + b"what is this\n" + archive(1, [b"second"], about=False)
    assert [x[3] for x in arc.parse_arc(noisy)] == [b"first", b"second"]
    assert list(arc.parse_arc(b"")) == []


def test_dates_are_padded():
    assert arc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert arc.iso_date("200102030405") == "2001-02-03T04:05:00Z"
    assert arc.iso_date("20010203") == "2001-02-03T00:00:00Z"


def convert(spark, tmp_path, pages):
    arcs, warcs = f"file:{tmp_path}/arc", f"file:{tmp_path}/warc"
    arc.write_arc(arc.page_captures(pages), arcs)
    arc.convert(spark, arcs, warcs)
    return arc.read_warc(spark, warcs, "X-Page-Id")


def test_revisits_and_odd_rows(spark, tmp_path):
    long, html = "x" * 1000, "é" * 600
    rows = [(1, "http://a b\n", long), (2, None, long), (3, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
            (None, "u", long), (3, "u", long), (8, "u", html), (9, "u", html), (10, "u", "WARC/1.0\r\n\r\nx" * 200)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, "
                                  "record_id string, digest int").repartition(3)
    got = convert(spark, tmp_path, pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.rank, []).append(r)
    for page, _, body in rows:
        data = (body or "").encode()
        assert all((r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest()) for r in by[page])
    kinds = {k: sorted(r.record_type for r in v) for k, v in by.items()}
    assert kinds == {1: ["revisit"], 2: ["revisit"], 3: ["response", "revisit"], 4: ["response"], 5: ["response"],
                     6: ["response"], None: ["revisit"], 8: ["revisit"], 9: ["response"], 10: ["response"]}
    names = {r.record_id: r.rank for r in got}
    assert len(names) == len(rows)
    assert {names[r.refers_to_id] for r in got if r.rank in (None, 1, 2)} == {3}


def test_same_file_gives_same_identifiers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.arc").write_bytes(archive(2, [HTTP + b"one", b"no http"]))
    for out in "ab":
        arc.convert(spark, f"file:{tmp_path}/in", f"file:{tmp_path}/{out}")
    a, b = (sorted(arc.read_warc(spark, f"file:{tmp_path}/{out}", "X-Page-Id").collect()) for out in "ab")
    assert a == b and {r.record_type for r in a} == {"response", "resource"}
    assert {r.date for r in a} == {"2001-02-03T04:05:06Z"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert convert(spark, tmp_path, pages).count() == 0


def test_query_names_the_page_that_stands_for_others(spark, tmp_path):
    spark.createDataFrame([(i, "u", "y" * 2000) for i in range(50)], "page_id long, url string, html string") \
        .write.parquet(f"{tmp_path}/pages.parquet")
    got = arc.arc_to_warc(spark, f"file:{tmp_path}")
    assert got.where("record_type = 'revisit' and refers_to = 49").count() == 49
    assert got.where(F.col("refers_to").isNull()).select("page_id").first()[0] == 49
