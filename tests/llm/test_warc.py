import gzip
import zlib

from runsight.llm import warc


def _member(i: int, payload: bytes, refers: int | None = None) -> bytes:
    return warc.member(warc.page_record(i, f"http://h/{i}", payload, warc.digest(payload), refers))


def _split(data: bytes):
    found = list(warc.salvage(data))
    assert found == [] or [f["offset"] for f in found] == sorted(f["offset"] for f in found)
    return [f for f in found if "reason" not in f], [f for f in found if "reason" in f]


def test_round_trip_of_plain_and_packed_records():
    plain = warc.record([("WARC-Type", "metadata"), ("Content-Type", "text/plain")], b"note")
    good, gaps = _split(_member(1, b"one") + plain + _member(2, b"") + _member(3, b"one", 1))
    assert [g["payload"] for g in good] == [b"one", b"note", b"", None]
    assert [g["payload_bytes"] for g in good] == [3, 4, 0, 3]
    assert gaps == []


def test_salvage_after_each_kind_of_damage():
    first, second, third = _member(1, b"a" * 500), bytearray(_member(2, bytes(range(256)) * 20)), _member(3, b"c")
    for cut in (second[: len(second) // 2], b"garbage between records", bytes(second[:40]) + b"\0" * 20 + bytes(second[60:])):
        data = first + bytes(cut) + third
        good, gaps = _split(data)
        assert [g["payload"] for g in good] == [b"a" * 500, b"c"]
        assert [(g["offset"], g["length"]) for g in gaps] == [(len(first), len(cut))]
    wrong = gzip.compress(warc.record([("WARC-Type", "resource"), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"x"))], b"y"), mtime=0)
    good, gaps = _split(wrong + third)
    assert len(good) == 1 and gaps[0]["reason"] == "payload digest"


def test_salvage_of_plain_records():
    one, two = warc.record([("WARC-Type", "resource")], b"one"), warc.record([("WARC-Type", "resource")], b"two")
    good, gaps = _split(one[:-10] + two)
    assert [g["payload"] for g in good] == [b"two"] and gaps[0]["length"] == len(one) - 10
    good, gaps = _split(two + one[:-10])
    assert [g["payload"] for g in good] == [b"two"] and gaps[0]["reason"] == "headers do not end"
    assert _split(b"") == ([], [])


def test_header_values_stay_on_their_line():
    data = warc.page_record(1, "http://h/\r\nWARC-Type: evil", b"x", warc.digest(b"x"), None)
    good, gaps = _split(data)
    assert good[0]["record_type"] == "response" and not gaps


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string")


def test_pages(spark, tmp_path):
    rows = [(1, "u", "same", "x"), (5, None, "same", "x"), (3, "u", "same", None), (2, "u", None, "x"), (4, "u", "", "x"), (6, "u", "é" * 30_000, "x"), (7, "u", "own", "x"), (None, "u", "own", "x"), (8, "u", "b", "x"), (8, "u", "b", "x")]
    files = warc.write_archives(_pages(spark, rows), str(tmp_path), archive_bytes=300)
    out = {}
    for r in warc.page_rows(warc.records(files.select("path"))).collect():
        out.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    same = warc.digest(b"same")
    assert out[1] == [(4, same, "revisit", 5)] and out[3] == [(4, same, "revisit", 5)] and out[5] == [(4, same, "response", None)]
    assert out[2][0][2:] == ("revisit", 4) and out[4][0][2:] == ("response", None)
    assert out[6][0][0] == 60_000 and out[7][0][2] == "response" and len(out[None]) == 1 and out[None][0][2] == "response"
    assert [x[2] for x in out[8]] == ["response", "response"]
    small = warc.with_originals(_pages(spark, rows), least_bytes=5)
    assert small.where("refers_to IS NOT NULL").count() == 0
    assert warc.records(warc.archives(spark, str(tmp_path))).count() == len(rows)
    assert warc.quarantine(warc.archives(spark, str(tmp_path))).count() == 0
    assert warc.write_archives(_pages(spark, []), str(tmp_path)).count() == 0


def test_quarantine_of_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(_member(1, b"x") + b"junk" + _member(2, b"y"))
    (tmp_path / "b.warc").write_bytes(b"")
    files = warc.archives(spark, str(tmp_path))
    assert sorted(r.payload.decode() for r in warc.records(files).collect()) == ["x", "y"]
    assert [r.length for r in warc.quarantine(files).collect()] == [4]


def test_files_on_disk_are_archives(spark, tmp_path):
    """Each member of a written file, unpacked alone, is one WARC record, and readers of bytes and of names find the same records at the same places."""
    rows = [(i, f"http://h/{i}", "x" * (i % 7) * 100, "") for i in range(40)]
    files = warc.write_archives(_pages(spark, rows), str(tmp_path), archive_bytes=2000)
    by_path = sorted((r.path.rsplit("/", 1)[1], r.offset, r.length, r.record_id) for r in warc.records(files.select("path")).collect())
    by_bytes = sorted((r.path.rsplit("/", 1)[1], r.offset, r.length, r.record_id) for r in warc.records(warc.archives(spark, str(tmp_path))).collect())
    assert by_path == by_bytes and len(by_path) == 40 and len({r[0] for r in by_path}) > 1
    for name, offset, length, _ in by_path:
        data = (tmp_path / name).read_bytes()[offset : offset + length]
        plain = zlib.decompressobj(31)
        assert plain.decompress(data).startswith(b"WARC/1.1\r\n") and plain.eof and not plain.unused_data
    for file in files.collect():
        assert (tmp_path / file.path.rsplit("/", 1)[1]).stat().st_size == file.n_bytes
