"""ZIP packages of WARC records: round trips, ZIP64 and plain directories, damage."""

import gzip
import hashlib
import io
import zipfile

import pytest

from gapfeed.llm import warc_zip as W


class Buffer(io.BytesIO):
    def close(self):
        self.held = self.getvalue()
        super().close()


def package(records, zip64=True):
    out = Buffer()
    w = W.PackageWriter(out, zip64)
    for key, payload in records:
        w.add(key, W.warc_record("response", f"urn:row:{key}", "http://x", payload, hashlib.sha256(payload).hexdigest(), len(payload), None))
    w.close()
    return out.held


@pytest.mark.parametrize("zip64", [True, False])
def test_directory_agrees_with_the_standard_library(zip64):
    raw = package([(str(i), b"p" * i) for i in range(50)], zip64)
    f = io.BytesIO(raw)
    members = W.directory(f, len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == [m.name for m in members] == [W.ARCHIVE, W.INDEX]
        for m in members:
            assert m.method == zipfile.ZIP_STORED and W.read_at(f, W.data_start(f, m), m.size) == z.read(m.name)
        index = z.read(W.INDEX)
    runs = W.split_index(index, 1000)
    assert sum(map(len, runs)) == 50 and len(runs) > 1
    offset, length = runs[-1][-1]
    head, payload = W.parse_record(gzip.decompress(W.read_at(f, W.data_start(f, members[0]) + offset, length)))
    assert payload == b"p" * 49 and head["warc-type"] == "response"


def test_reads_zips_of_others(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment PK"
        z.writestr("x/y.bin", b"12345")
        z.writestr("c.txt", b"z" * 100, compress_type=zipfile.ZIP_DEFLATED)
    with open(path, "rb") as f:
        a, c = W.directory(f, path.stat().st_size)
        assert W.read_at(f, W.data_start(f, a), a.size) == b"12345"
        with pytest.raises(ValueError, match="compressed"):
            W.data_start(f, c)


def test_damaged_files():
    raw = package([("1", b"x")])
    for broken in (b"", b"nothing", raw[:-30] + b"\0" * 30):
        with pytest.raises(ValueError):
            W.directory(io.BytesIO(broken), len(broken))


def test_round_trip(spark, tmp_path):
    long = "é" * 60
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "http://c", "short"), (5, "http://d", None), (None, "http://e", long), (6, "http://f\r\nX: y", "x" * 300_000), (7, "u", ""), (2, "http://b", long)]
    pages = spark.createDataFrame([(*r, "id") for r in rows], "page_id long, url string, html string, id string").repartition(3)
    got = W.round_trip(spark, pages).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((p or "").encode() for i, _, p in rows if i == r.page_id)
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        again = r.page_id in (2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))


def test_several_packages_and_payloads(spark):
    pages = spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 500) as html").coalesce(1)
    manifest = W.write_packages(pages, W.scratch_path(spark, "warc"), package_bytes=4000)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == 200
    got = W.read_packages(manifest, with_payload=True, range_bytes=500, split_bytes=700).collect()
    assert sorted((r.id, r.payload.decode()) for r in got) == [(i, str(i) * 500) for i in range(200)]


def test_empty(spark):
    assert W.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
