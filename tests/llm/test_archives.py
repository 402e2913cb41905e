"""WARC archives against a plain reading of their bytes, and ranges of every size."""

import gzip
import hashlib
import io
import os
import random
import zlib

import pytest

from trackloom.llm import warc
from trackloom.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, digest string, n long"


def pages():
    r = random.Random(3)
    texts = ["", None, "é" * 49, "x" * 99, "x" * 100, "ab" * 60, "".join(chr(r.randint(32, 3000)) for _ in range(5000))]
    rows = [(k, f"http://h/{k}?q=a b\r\nWARC-Type: x" if k % 3 else None, r.choice(texts), "clash", 7) for k in range(120)]
    rows += [(130, "u", "only one of its kind " * 20, None, None), (None, None, "x" * 100, None, 1), (None, "u", "without a number " * 9, None, 1), (None, "v", "without a number " * 9, None, 1)]
    return rows + [rows[4], rows[5]]


def expected(rows):
    least = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            key = html or ""
            least[key] = min(least.get(key, page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        first = least.get(html or "") if len(raw) >= 100 else None
        again = first is not None and page_id != first
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def result(spark, path, **options):
    back = warc.read(spark, path, **options)
    return sorted(map(tuple, back.select(warc.page_number("record_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to")).collect()), key=repr)


def test_pages_come_back_whatever_the_ranges(spark):
    work = Scratch(spark, "test-warc")
    rows = pages()
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), work.path("a"), work)
    for size in (1 << 26, 5000, 700, 61):
        assert result(spark, work.path("a"), with_payload=False, range_bytes=size) == expected(rows)
    by = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, work.path("a")).where("record_type = 'response'").collect()}
    assert by["urn:page:130"] == b"only one of its kind " * 20


def test_many_repeated_payloads_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("trackloom.llm.scratch.BROADCAST_ROWS", 0)
    work = Scratch(spark, "test-warc-many")
    warc.write(spark.createDataFrame(pages(), SCHEMA), work.path("a"), work)
    assert result(spark, work.path("a"), with_payload=False) == expected(pages())


def test_files_are_gzip_streams_of_plain_records(spark, tmp_path):
    work = Scratch(spark, "test-warc-plain")
    warc.write(spark.createDataFrame([(1, "http://a/", "hello", "", 0)], SCHEMA), f"file://{tmp_path}/a", work)
    raw = b"".join(gzip.decompress((tmp_path / "a" / f).read_bytes()) for f in sorted(os.listdir(tmp_path / "a")) if f.startswith("part"))
    head, block = raw.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a/" in head
    assert block == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_empty_tables(spark):
    work = Scratch(spark, "test-warc-empty")
    warc.write(spark.createDataFrame([], SCHEMA), work.path("a"), work)
    assert result(spark, work.path("a")) == []


def test_a_record_over_16_mib(spark):
    long = "0123456789abcdef" * (1 << 20) + "end"
    rows = [(1, "u", long, "", 0), (2, "u", "short", "", 0), (3, "u", long, "", 0)]
    work = Scratch(spark, "test-warc-long")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), work.path("a"), work)
    assert result(spark, work.path("a"), range_bytes=4096) == expected(rows)


class File(io.BytesIO):
    pass


def owned(raw, size):
    return [block for start in range(0, len(raw), size) for _, block in warc.scan(File(raw), len(raw), start, min(start + size, len(raw)))]


def member(block, level=6):
    return warc._member(["WARC-Type: resource"], block, level) + b"\0"


def test_magic_numbers_inside_members_begin_no_record():
    r = random.Random(5)
    blocks = []
    for k in range(40):
        noise = r.randbytes(r.randint(0, 400))
        # Stored as they are: magic numbers, whole members that hold no record, and beginnings of members that break off.
        blocks.append(noise + r.choice([warc.MAGIC, gzip.compress(b"no record"), member(b"x")[:12], b""]) + noise[:50])
    raw = b"".join(member(b, level=0) for b in blocks)
    for size in (len(raw), 4096, 500, 97, 13):
        assert owned(raw, size) == blocks


def test_several_records_in_a_member_and_padding_between_members():
    one = gzip.compress(b"".join(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"a", b"", b"ccc")))
    raw = one + b"\0" * 7 + member(b"last")
    for size in (len(raw), 40, 5):
        assert owned(raw, size) == [b"a", b"", b"ccc", b"last"]


def test_damage_is_told():
    good = member(b"abc" * 100)
    with pytest.raises(warc.Damaged):
        owned(good + member(b"def" * 50)[:-9], 1 << 20)
    with pytest.raises(warc.Damaged):
        owned(good + b"rubbish" + good, 1 << 20)
    wrong = warc.record(1, "u", "x" * 200, hashlib.sha256(b"y").hexdigest()) + b"\0"
    with pytest.raises(warc.Damaged):
        [warc._row(f, b, True) for f, b in warc.scan(File(wrong), len(wrong), 0, len(wrong))]
    assert zlib.decompress(wrong, 31).startswith(b"WARC/1.1")
