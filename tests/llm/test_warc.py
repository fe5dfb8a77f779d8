from __future__ import annotations

import hashlib
from datetime import UTC, datetime

import pytest

from lakeloom.llm import archives, warc
from lakeloom.llm.q_warc import OP7_SQL, op7_warc

STAMP = datetime(2001, 2, 3, 4, 5, 6, tzinfo=UTC)


def test_query_agrees_with_sql(same):
    same(op7_warc, OP7_SQL)


@pytest.mark.parametrize("version", [1, 2])
def test_conversion_of_a_record(version):
    fields = warc.arc_fields(warc.arc_version_block(version, "f.arc.gz"))
    assert len(fields) == {1: 5, 2: 10}[version]
    content = warc.arc_record(version, "7", "http://é x/?q=a b", b"<p>\r\n\r\nhi\n", STAMP, "f.arc.gz", 99)
    head, body = warc.parse_arc(content, fields)
    assert head["Archive-date"] == "20010203040506" and " " not in head["URL"]
    record, block = warc.parse_warc(warc.convert_record(head, body, None))
    assert block == body and record["WARC-Type"] == "response" and record["WARC-Date"] == "2001-02-03T04:05:06Z" and record["WARC-Record-ID"] == warc.record_id("7")
    assert record["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>\r\n\r\nhi\n").hexdigest()
    visit, block = warc.parse_warc(warc.convert_record(head, body, "3"))
    assert visit["WARC-Type"] == "revisit" and visit["WARC-Refers-To"] == warc.record_id("3") and b"hi" not in block


@pytest.mark.parametrize("version", [1, 2])
def test_damage_is_noticed(version):
    fields = warc.FIELDS[version].split(" ")
    content = warc.arc_record(version, "7", "http://x/", b"payload", STAMP, "f", 0)
    with pytest.raises(ValueError, match="declares"):
        warc.parse_arc(content[:-5], fields)
    with pytest.raises(ValueError, match="fields"):
        warc.parse_arc(content, warc.FIELDS[3 - version].split(" "))
    if version == 2:
        with pytest.raises(ValueError, match="checksum"):
            warc.parse_arc(content.replace(b"payload", b"pAyload"), fields)
    head, body = warc.parse_arc(content, fields)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_warc(warc.convert_record(head, body, None).replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(warc._member(b"abc")[:-3]))


def test_revisits_and_odd_rows(spark):
    long, short = "x" * 100, "y" * 99
    rows = [(5, "http://a/", long), (3, "http://b/", long), (9, None, long), (4, "http://c/", short), (6, "http://c/", short), (7, "", None), (8, "http://d/", ""), (3, "http://b/", long), (10, "u", "é🙂" * 40_000), (None, "http://e/", long)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read_warcs(spark, warc.archive(docs.repartition(3), "page_id", "url", "html")).collect()
    got = sorted((r["name"] or "", r["size"], r["digest"], r["kind"], r["refers_to"], r["payload"]) for r in out)
    want = []
    for key, _, html in rows:
        data = (html or "").encode()
        again = html == long and key != 3
        want.append(("" if key is None else str(key), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", "3" if again else None, None if again else data))
    assert got == sorted(want, key=lambda r: r[:5] if r[4] is None else r)
    urls = {r["name"]: r["url"] for r in out}
    assert urls["9"] is None and urls["7"] is None and urls["5"] == "http://a/"


def test_files_roll_and_empty_table(spark):
    docs = spark.range(40).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id AS string), 500) AS html").coalesce(1)
    folder = warc.scratch(spark, "arc")
    index = warc.write_arcs(docs, folder, "page_id", "url", "html", most_bytes=5000).collect()
    assert len({r["file"] for r in index}) > 4 and len(archives.list_files(folder, ".arc.gz")) == len({r["file"] for r in index})
    blank = spark.range(100).selectExpr("id AS page_id", "'' AS url", "'' AS html").coalesce(1)
    assert len({r["file"] for r in warc.write_arcs(blank, warc.scratch(spark, "arc"), "page_id", "url", "html", most_bytes=5000).collect()}) > 3
    empty = docs.limit(0)
    assert warc.read_warcs(spark, warc.archive(empty, "page_id", "url", "html")).count() == 0
