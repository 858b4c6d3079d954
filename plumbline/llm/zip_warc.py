"""ZIP-packaged web archives: written by tasks, read by range [operator 2].

An archive is a ZIP file with stored members: `archive/data.warc.gz`, one gzip
member per WARC record, and `indexes/index.idx`, a line of offset and length for
each record. The reader finds the end record (and its ZIP64 form) in the file's
tail, reads the central directory, resolves where each stored member's bytes
begin, and turns index lines into byte ranges that tasks read; nothing is
extracted. Archive members without an index are scanned in one stream.

Payloads that repeat are written once: of the records with an equal payload of
at least `least_bytes`, that with the smallest id is a response, the others are
revisits that name it and carry the payload's length and digest.

Defined results: a null page is an empty payload. Rows that repeat the smallest
id are all responses; a row with a null id is always a response, and none refers
to it. Other columns of the input do not matter. A folder without archives, or
an archive without members, has no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.workspace import in_tasks, keep, new_dir, split_near

LEAST_BYTES = 100
#: Neighbouring records up to so many bytes are one range read.
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.idx"
LEVEL = 3

# -- fixed values: signatures and layouts of the ZIP format -------------------------
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
ZIP64_EXTRA, STORED, DEFLATED = 0x0001, 0, 8
TAIL_BYTES = 22 + 65535
# -- end of fixed values --------------------------------------------------------------


# -- records ---------------------------------------------------------------------------


def _clean(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if id_ is None else id_}>",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of one record: id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", field.get(name, ""))
        return int(m[1]) if m else None

    out = {"id": page("warc-record-id"), "url": field.get("warc-target-uri"), "record_type": field["warc-type"], "refers_to": page("warc-refers-to")}
    if out["record_type"] == "revisit":
        length = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
        return out | {"payload": None, "payload_bytes": length, "payload_digest": field["warc-payload-digest"].rpartition(":")[2].lower()}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


# -- the ZIP directory -------------------------------------------------------------------


class Archive:
    """Range reader of one ZIP file."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def directory(self) -> tuple[int, int]:
        """Where the central directory begins, and its size."""
        tail_at = max(0, self.size - TAIL_BYTES)
        tail = self.read(tail_at, self.size - tail_at)
        k = tail.rfind(END)
        if k < 0:
            raise ValueError("not a ZIP file: it has no end record")
        size, at = struct.unpack_from("<II", tail, k + 12)
        entries = struct.unpack_from("<H", tail, k + 10)[0]
        if 0xFFFFFFFF in (size, at) or entries == 0xFFFF:
            locator = self.read(tail_at + k - 20, 20) if tail_at + k >= 20 else b""
            if locator[:4] == LOCATOR:
                end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != END64:
                    raise ValueError("the ZIP64 end record is not where the locator says")
                size, at = struct.unpack_from("<QQ", end64, 40)
        return at, size

    def members(self) -> Iterator[dict]:
        """name, method, where its bytes begin, packed and plain size; the directory is read in blocks."""
        at, size = self.directory()
        end, held = at + size, b""
        while at < end or held:
            while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
                if at >= end:
                    if held:
                        raise ValueError("the central directory breaks off")
                    return
                block = self.read(at, min(1 << 20, end - at))
                at += len(block)
                held += block
            if held[:4] != CENTRAL:
                raise ValueError("the central directory holds something else")
            method = struct.unpack_from("<H", held, 10)[0]
            packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", held, 20)
            local = struct.unpack_from("<I", held, 42)[0]
            name = held[46 : 46 + name_n].decode("utf-8", "replace")
            extra = held[46 + name_n : 46 + name_n + extra_n]
            plain, packed, local = _wide(extra, plain, packed, local)
            held = held[46 + name_n + extra_n + comment_n :]
            head = self.read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            begin = local + 30 + sum(struct.unpack_from("<HH", head, 26))
            yield {"member": name, "method": method, "begin": begin, "packed": packed, "plain": plain}

    def index_lines(self, member: dict) -> Iterator[tuple[int, int]]:
        inflate = zlib.decompressobj(-15) if member["method"] == DEFLATED else None
        held, at, end = b"", member["begin"], member["begin"] + member["packed"]
        while at < end:
            block = self.read(at, min(1 << 20, end - at))
            at += len(block)
            *lines, held = (held + (inflate.decompress(block) if inflate else block)).split(b"\n")
            for line in lines:
                yield tuple(map(int, line.split()))

    def scanned(self, member: dict) -> Iterator[tuple[int, int]]:
        """Offsets and lengths of the gzip members, found by streaming through them."""
        at, end = member["begin"], member["begin"] + member["packed"]
        first, inflate = at, zlib.decompressobj(31)
        while at < end:
            block = self.read(at, min(1 << 20, end - at))
            at += len(block)
            while block:
                inflate.decompress(block)
                if not inflate.eof:
                    break
                block = inflate.unused_data
                stop = at - len(block)
                yield first - member["begin"], stop - first
                first, inflate = stop, zlib.decompressobj(31)


def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int, int]:
    """The sizes and the offset, from the ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == ZIP64_EXTRA:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            plain, packed, local = (next(values) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
        at += 4 + n
    return plain, packed, local


# -- on Spark ------------------------------------------------------------------------------


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes one archive per task into the shared folder. Returns (archive): only
    archives of attempts that succeeded are named."""
    spark = pages.sparkSession
    folder = new_dir(spark, "archives")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(digest)))
    # only payloads that stand under more than one id have revisits; the digests travel, the pages do not
    groups = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    groups = keep(groups.filter("low != high").select("digest", F.col("low").alias("first")), "repeated")
    near, rest = split_near(rows, groups, "digest")
    rows = near.join(groups, "digest", "left").unionByName(rest.withColumn("first", F.lit(None).cast("long"))).select("id", "url", "html", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        index, at = io.BytesIO(), 0
        with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                for batch in batches:
                    for id_, url, page, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        body = page.encode()
                        packed = gzip.compress(record(id_, url, body, hashlib.sha256(body).hexdigest(), refers_to), LEVEL, mtime=0)
                        data.write(packed)
                        index.write(b"%d %d\n" % (at, len(packed)))
                        at += len(packed)
            package.writestr(zipfile.ZipInfo(INDEX), index.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["archive"])

    return keep(rows.mapInArrow(run, "archive string"), "archive-list")


def locate(archives: DataFrame) -> DataFrame:
    """Per range of neighbouring records: archive, begin, and the records' lengths."""

    def run(batches):
        schema = pa.schema([("archive", pa.string()), ("begin", pa.int64()), ("lengths", pa.list_(pa.int32()))])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with Archive(uri) as archive:
                    members = {m["member"]: m for m in archive.members()}
                    for name, member in members.items():
                        if not name.endswith(".warc.gz"):
                            continue
                        if member["method"] != STORED:
                            raise ValueError(f"{uri}: {name} is compressed by the ZIP file and cannot be read by range")
                        index = members.get(name.replace("archive/data", "indexes/index").removesuffix(".warc.gz") + ".idx")
                        ranges = archive.index_lines(index) if index else archive.scanned(member)
                        begin, end, lengths = 0, 0, []
                        for at, n in ranges:
                            if lengths and (at != end or end + n - begin > RANGE_BYTES):
                                yield pa.RecordBatch.from_pylist([{"archive": uri, "begin": member["begin"] + begin, "lengths": lengths}], schema)
                                lengths = []
                            begin = begin if lengths else at
                            lengths.append(n)
                            end = at + n
                        if lengths:
                            yield pa.RecordBatch.from_pylist([{"archive": uri, "begin": member["begin"] + begin, "lengths": lengths}], schema)

    return archives.select("archive").distinct().mapInArrow(run, "archive string, begin long, lengths array<int>")


FIELDS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Per record: id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest."""

    def run(batches):
        for batch in batches:
            for uri, begin, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Archive(uri) as archive:
                    data, at, rows = archive.read(begin, sum(lengths)), 0, []
                    for n in lengths:
                        row = parsed(gzip.decompress(data[at : at + n]))
                        rows.append(row if with_payload else row | {"payload": None})
                        at += n
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, FIELDS)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)

    ddl = "id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    return in_tasks(keep(locate(archives), "ranges")).mapInArrow(run, ddl)
