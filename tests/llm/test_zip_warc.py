"""Archives against the payloads that went in, and the directory reader against the zipfile module."""

import gzip
import hashlib
import zipfile

import pytest

from plumbline.llm import registry, zip_warc

SCHEMA = "page_id long, url string, html string, id long, digest string"


def brute(rows):
    """rows: (page_id, html). Sorted (page_id, bytes, digest, type, refers_to)."""
    low = {}
    for i, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        if i is not None:
            low[d] = min(low.get(d, i), i)
    out = []
    for i, h in rows:
        body = (h or "").encode()
        d = hashlib.sha256(body).hexdigest()
        again = i is not None and len(body) >= 100 and low[d] != i
        out.append((i, len(body), d, "revisit" if again else "response", low[d] if again else None))
    return sorted(out, key=str)


def test_round_trip_of_edges(spark):
    long, wide = "x" * 3_000_000, "é" * 60
    texts = [None, "", "a" * 99, "a" * 99, "b" * 100, "b" * 100, wide, wide, wide, long, long, "line\r\n\r\nWARC/1.1\r\n" * 20]
    rows = [(i * 7 % 12, f"http://h/{i}\n x" if i else None, t, 1, "d") for i, t in enumerate(texts)]
    rows += [rows[5], (None, None, "b" * 100, 1, "d")]
    records = zip_warc.read(zip_warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    got = records.collect()
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute([(r[0], r[2]) for r in rows])
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == text[r["id"]] for r in got if r["record_type"] == "response" and r["id"] is not None)


def test_op2_on_driver_rows(spark, sf_dir):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = registry.op2_zip_warc(spark, sf_dir).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert zip_warc.read(zip_warc.write(spark.createDataFrame([], SCHEMA))).count() == 0


def package(path, index, n=2500):
    bodies = [f"payload {i} ".encode() * 5 for i in range(n)]
    packed = [gzip.compress(zip_warc.record(i, f"http://h/{i}", b, hashlib.sha256(b).hexdigest(), None)) for i, b in enumerate(bodies)]
    at, lines = 0, []
    for p in packed:
        lines.append(f"{at} {len(p)}\n")
        at += len(p)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end record"[4:]
        z.writestr("datapackage.json", "{}")
        with z.open(zipfile.ZipInfo(zip_warc.DATA), "w", force_zip64=True) as f:
            f.write(b"".join(packed))
        if index:
            z.writestr(zip_warc.INDEX, "".join(lines), zipfile.ZIP_DEFLATED)
    return bodies


@pytest.mark.parametrize("index", [True, False])
def test_foreign_archives_with_and_without_an_index(spark, tmp_path, index):
    bodies = package(tmp_path / "a.zip", index)
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.zip",)], "archive string")
    got = {r["id"]: bytes(r["payload"]) for r in zip_warc.read(archives).collect()}
    assert got == dict(enumerate(bodies))


def test_members_equal_the_zipfile_module(tmp_path):
    package(tmp_path / "a.zip", True, 50)
    with zip_warc.Archive(f"file://{tmp_path}/a.zip") as a, zipfile.ZipFile(tmp_path / "a.zip") as z:
        own = {m["member"]: (m["method"], m["packed"], m["plain"]) for m in a.members()}
        assert own == {i.filename: (i.compress_type, i.compress_size, i.file_size) for i in z.infolist()}


def test_zip64_directory(tmp_path):
    """More members than a short end record can count."""
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    with zip_warc.Archive(f"file://{tmp_path}/many.zip") as a:
        assert sum(1 for _ in a.members()) == 66_000


def test_not_a_zip_file(tmp_path):
    (tmp_path / "x.zip").write_bytes(b"nothing of the kind")
    with zip_warc.Archive(f"file://{tmp_path}/x.zip") as a, pytest.raises(ValueError):
        list(a.members())
