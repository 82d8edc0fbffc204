"""Web archives: round trips, and what a plain reader makes of the frames."""

import base64
import hashlib
import io
import os
import struct

import pytest
import zstandard
from conftest import DATA

from codeloom.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string, row string, sha string, n string, first string, first_page string, rows string, _first string, _sought string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def expected(rows, min_bytes=0):
    out, first = [], {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in order:
        page, _, html = rows[k]
        raw = (html or "").encode()
        response = len(raw) < min_bytes or raw not in first
        refers = None if response else first[raw]
        first.setdefault(raw, page)
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", refers))
    return sorted(out, key=repr)


def result(archives):
    return sorted((tuple(r)[:5] for r in warc.read_archives(archives).collect()), key=repr)


ROWS = [(9, "http://a/1", "<p>one</p>"), (3, "http://a/2\r\nX: y", "<p>one</p>"), (3, "http://a/2\r\nX: y", "<p>one</p>"), (5, None, None), (4, "http://a/é", ""), (None, "u", "<p>one</p>"), (None, "u", "only here"), (None, None, "only here"), (7, "http://b", "été \r\n\r\n x" * 9000)]


@pytest.mark.parametrize("min_bytes, hot", [(0, 1000), (5, 1000), (0, 1), (20, 2)])
def test_odd_rows(spark, min_bytes, hot):
    got = result(warc.write_archives(frame_of(spark, ROWS).coalesce(1), min_bytes=min_bytes, hot=hot))
    assert got == expected(ROWS, min_bytes)
    assert result(warc.write_archives(frame_of(spark, []))) == []


def many(spark):
    rows = [(k, f"http://host/{k}", f"<html><body class='page'><p>{hashlib.md5(b'%d' % (k % 700)).hexdigest()}</p>" + "<li>menu</li>" * 30 + "</body></html>") for k in range(1500)]
    return rows, frame_of(spark, rows).repartition(3)


def test_archives_as_a_plain_reader_sees_them(spark, tmp_path):
    rows, pages = many(spark)
    archives = warc.write_archives(pages, archive_bytes=20_000, dictionary_bytes=4096)
    assert result(archives) == expected(rows)
    warc.save_archives(archives, str(tmp_path))
    names = sorted(os.listdir(tmp_path))
    assert len(names) == archives.count() > 5
    records, stored = 0, 0
    for name in names:
        data = open(tmp_path / name, "rb").read()
        assert data[:4] == warc.DICTIONARY_FRAME
        size = struct.unpack("<I", data[4:8])[0]
        raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        assert 0 < len(raw) <= 4096 and raw[:4] == b"\x37\xa4\x30\xec"
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        text = reader.stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") == 1
        records += text.count(b"WARC/1.1\r\n") - 1
        places = [(a, b) for a, b, *_ in warc.read_records(data)]
        assert len(places) == text.count(b"WARC/1.1\r\n") and places[-1][0] + places[-1][1] == len(data)
        a, n = places[1]  # one record alone
        assert reader.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\nWARC-Type: re")
        stored += len(data) - 8 - size
    assert records == len(rows)
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(h.encode())) for _, _, h in rows)
    assert stored < plain * 2  # headers included, which a dictionary makes small


def test_dictionary_is_the_same_every_time(spark):
    _, pages = many(spark)
    one, two = (warc.page_dictionary(warc._payloads(p), 300, 1 << 15, 4096, "") for p in (pages, pages.repartition(7)))
    assert one and len(one) == len(two)
    assert warc.train_dictionary([b"short"] * 3, 4096) is None


def test_broken_archives_are_told():
    packer = zstandard.ZstdCompressor(write_checksum=True)
    data = packer.compress(warc.record("response", {"WARC-Record-ID": "<urn:uuid:1>"}, b"x" * 300_000)) + packer.compress(b"")
    assert [e for _, e in warc.frames(data)][-1] == len(data)
    for broken in (data[:-1], b"junk" + data, data[:30]):
        with pytest.raises(ValueError):
            list(warc.frames(broken))
    with pytest.raises(ValueError):
        warc.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")


def test_query(spark, duck):
    from conftest import same

    same(queries.op11_warc(spark, DATA), duck.execute(queries.oracle_sql()["op11_warc"]))
