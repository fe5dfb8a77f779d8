from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import archives, media
from lakeloom.llm.q_media import op10_media_columns
from lakeloom.llm.q_urls import OP9_SQL, RULES, op9_url_filter
from lakeloom.llm.urlfilter import judge_urls

URLS = [
    None, "", "no scheme", "http://", "https://Shop.EXAMPLE.net/en/x?a=1", "https://example.net/e", "http://net/", "http://net", "http://xnet/", "http://a.b.org/fr/casino", "http://a.org/de/casino-win",
    "http://ok.com/x#://y/z", "HTTP://A.example.com/de/", "http://example.com/de", "http://u:p@h.com:80/free/?win=1", "http://h.com/freely/winner", "http://h.com/a?next=http://adult.net/", "://x/y", "http://é.com/xxx", "http://h.com/free-free",
]


def test_query_agrees_with_sql(same):
    same(op9_url_filter, OP9_SQL)


def test_odd_urls_agree_with_sql(spark, con):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    con.execute("CREATE TEMP TABLE pages AS SELECT * FROM (VALUES " + ", ".join(f"({'NULL' if i is None else i}, {'NULL' if u is None else chr(39) + u + chr(39)})" for i, u in rows) + ") t(page_id, url)")
    want = sorted(map(repr, con.execute(OP9_SQL).fetchall()))
    con.execute("DROP TABLE temp.pages")
    out = judge_urls(df, RULES)
    assert sorted(repr(tuple(r)) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    by_id = {r["page_id"]: r for r in out.collect()}
    assert by_id[4]["rule"] == "example.net/en/" and by_id[4]["verdict"] == "allow" and by_id[6]["verdict"] == "block" and by_id[7]["rule"] is None and by_id[8]["rule"] is None
    assert by_id[14]["verdict"] == "block" and by_id[15]["verdict"] == "allow" and by_id[19]["verdict"] == "allow" and by_id[18]["verdict"] == "block"


def test_clashing_columns_empty_table_and_no_terms(spark):
    df = spark.createDataFrame([(1, "http://casino.com/", "mine")], "page_id long, url string, host string")
    assert judge_urls(df, ()).collect()[0]["host"] == "casino.com"
    assert judge_urls(df, (), strict=(), soft=()).collect()[0]["verdict"] == "allow"
    assert judge_urls(df.limit(0), RULES).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=500))
def test_png_keeps_every_byte(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and payload[: len(data)] == data and not any(payload[len(data) :])
    assert media.decode_png(media.encode_png(payload)) == (payload, 64, len(payload) // 64)


def test_zip_is_readable_by_others(tmp_path):
    import zipfile

    z = media.ZipBuilder()
    for i in range(3):
        z.add(f"é{i}.png", bytes([i]) * 100)
    (tmp_path / "a.zip").write_bytes(z.close())
    with zipfile.ZipFile(tmp_path / "a.zip") as f:
        assert f.testzip() is None and f.namelist() == ["é0.png", "é1.png", "é2.png"]


def test_query_against_brute_force(spark, sf_dir):
    out = {r["doc_id"]: r for r in op10_media_columns(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        data = (d["text"] or "").encode()
        payload = media.padded(data)
        stored, r = media.encode_png(payload), out[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))


@pytest.mark.parametrize("range_bytes", [100, 10**7])
def test_ranges_cover_each_member_once_with_odd_rows(spark, range_bytes):
    rows = [(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, "é" * 100_000), *((i, f"text {i}") for i in range(10, 40))]
    folder = media.store_payloads(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id", "text")
    out = media.read_archives(spark, folder, rangeBytes=str(range_bytes)).collect()
    assert sorted((r["name"] or "", bytes(r["payload"])) for r in out) == sorted(("" if i is None else str(i), media.padded((t or "").encode())) for i, t in rows)
    empty = media.store_payloads(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert media.read_archives(spark, empty).count() == 0


def test_a_damaged_member_is_reported_alone(spark):
    folder = media.store_payloads(spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1), "doc_id", "text")
    (uri, size), = archives.list_files(folder, ".zip")
    name, offset, length, _ = media.directory(uri, size)[2]
    data = bytearray(archives.fetch(uri))
    data[offset + 60] ^= 1
    archives.put(uri, bytes(data))
    out = media.read_archives(spark, folder, onError="row", retries="1").collect()
    assert [r["name"] for r in out if r["error"]] == [name.split(".")[0]] and sum(r["payload"] is not None for r in out) == 4
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder, retries="0").collect()


def test_a_member_is_tried_again(monkeypatch):
    reader, calls = media.ArchiveReader({"path": "/nowhere", "retries": "3"}), []

    def flaky(uri, offset, size, crc, name):
        calls.append(offset)
        if len(calls) < 3:
            raise OSError("lost")
        return media.encode_png(media.padded(b"ok"))

    monkeypatch.setattr(media, "read_member", flaky)
    assert reader._decoded("u", ("7.2.png", 5, 1, 1), memoryview(b"not a member"))["payload"] == media.padded(b"ok") and calls == [5, 5, 5]
