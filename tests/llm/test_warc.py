import base64
import hashlib
import struct
import time

import pytest

from tidewater.llm.warc import (DICT_MAGIC, archive_frames, archive_path, build_dictionary, make_record, parse_record,
                                read_archive, read_archives, write_archives)


def test_frames_round_trip():
    records = [make_record(i, f"http://h/{i}", (f"<html>{i} é " * (i % 40)).encode(), None) for i in range(300)]
    data = b"".join(archive_frames(records))
    assert struct.unpack("<I", data[:4])[0] == DICT_MAGIC
    assert list(read_archive(data)) == records
    with pytest.raises(ValueError):
        list(read_archive(data[:-3]))


def test_small_archive_has_a_dictionary_too():
    records = [make_record(1, None, b"", None)]
    assert build_dictionary(records)
    assert list(read_archive(b"".join(archive_frames(records)))) == records


def test_dictionary_is_trained_from_records():
    records = [make_record(i, "u", (f"<p>{i * 7919 % 1000} common words of the page {i}</p>" * 20).encode(), None) for i in range(400)]
    assert build_dictionary(records)[:4] == struct.pack("<I", 0xEC30A437)


def test_damaged_payload_is_refused():
    raw = make_record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        parse_record(raw.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"))


def test_write_and_read(spark):
    big = "é<b>" * 200_000
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "u\r\nX: y", ""), (8, "u", None), (7, "u", big),
            (6, "u", big), (10, "u", "alone"), (11, "u", "twice"), (11, "u", "twice"), (None, "u", "same"), (12, "u", "a"), (13, "u", "a")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    path = archive_path(spark)
    write_archives(df.repartition(3), path)
    got = read_archives(spark, path).collect()
    assert len(got) == len(rows)
    smallest = {}
    for i, _, h in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    for i, u, h in rows:
        p = (h or "").encode()
        r = [x for x in got if x["page_id"] == i][0]
        assert r["payload_bytes"] == len(p)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = i if i is None else smallest[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == p
        assert (r["url"] is None) == (u is None)


def test_frame_may_hold_the_separator(spark):
    """An archive with one small page that holds the bytes of the separator stores them as they are."""
    text = "P*M\x18\x00\x00\x00\x00"
    df = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string").coalesce(1)
    path = archive_path(spark)
    write_archives(df, path)
    assert [bytes(r["payload"]) for r in read_archives(spark, path).collect()] == [text.encode()]


def test_reading_is_linear():
    records = [make_record(i, "u", b"x" * 200, None) for i in range(60_000)]
    t = time.time()
    assert sum(1 for _ in read_archive(b"".join(archive_frames(records)))) == 60_000 and time.time() - t < 20


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = archive_path(spark)
    write_archives(df, path)
    assert read_archives(spark, path).collect() == []


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = archive_path(spark)
    write_archives(df, path, least_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in read_archives(spark, path).collect()} == {
        1: "response", 2: "response", 3: "response", 4: "revisit"}
