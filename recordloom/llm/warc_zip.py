"""WARC records in ZIP-packaged web archives: writer and range reader (operator 8).

A package is a ZIP file whose members are stored, not compressed: ``archive/*.warc.gz`` with one gzip member per
record, and ``indexes/index.cdxj``. Because members are stored, a record's place in the file is the member's
place plus the offset that the index gives, and one range read gets it. The reader finds the members by the end-of-directory record,
the ZIP64 ones where numbers don't fit 32 bits, and the central directory; nothing is extracted.

Writing and reading are Arrow tasks: one package per task when writing; when reading, packages are listed to (package, place,
length) rows first, which are dealt out anew, so one large package is read by many tasks. Files lie in a shared
folder; a task that is run again writes a file of another name, and only files of successful tasks are listed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.skew import join_by_weight
from recordloom.session import materialize, release, shared_dir

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
INDEX = "indexes/index.cdxj"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# ---- ZIP directory


def read_range(f, at: int, size: int) -> bytes:
    f.seek(at)
    got = f.read(size)
    if len(got) != size:
        raise ValueError(f"range {at}+{size} lies beyond the file")
    return got


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (place of the data, stored length, method), from the central directory."""
    tail_at = max(0, size - 65557)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_range(f, tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, out = read_range(f, start, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: the numbers that don't fit, in this order
                wide, w = extra[e + 4 : e + 4 + k], 0
                if full == 0xFFFFFFFF:
                    w += 8
                if packed == 0xFFFFFFFF:
                    packed, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", wide, w)[0]
            e += 4 + k
        head = read_range(f, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        a, b = struct.unpack_from("<HH", head, 26)
        out[name] = (local + 30 + a + b, packed, method)
        at += 46 + name_n + extra_n + comment_n
    return out


# ---- WARC records


def record_id(page_id: int | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else salt)}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%" + f"{ord(c):02X}" for c in url)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, salt: str) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its own length and that of the page stay in the headers."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, salt)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http
    if refers_to is None:
        body += payload
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, '')}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{b32}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields, its content checked against the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", version):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": len(payload) if kind == "response" else number("warc-payload-length"),
        "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload": payload if kind == "response" else None,
    }


# ---- tasks


class PackageWriter:
    """Writes records into members of about ``member_bytes``, then the index, and closes the ZIP."""

    def __init__(self, sink, member_bytes: int):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.limit, self.held, self.at, self.n, self.index = member_bytes, [], 0, 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.index.append(json.dumps({"page_id": page_id, "filename": f"data-{self.n:05d}.warc.gz", "offset": self.at, "length": len(packed)}))
        self.held.append(packed)
        self.at += len(packed)
        if self.at >= self.limit:
            self._member()

    def _member(self) -> None:
        if self.held:
            self.zip.writestr(zipfile.ZipInfo(f"archive/data-{self.n:05d}.warc.gz", (1980, 1, 1, 0, 0, 0)), b"".join(self.held))
            self.held, self.at, self.n = [], 0, self.n + 1

    def close(self) -> None:
        self._member()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "".join(x + "\n" for x in self.index))
        self.zip.close()


class _Sink(io.RawIOBase):
    """A stream that only goes forward, as stores offer it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


def _write_packages(folder: str, member_bytes: int, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = out = None
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.zip"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                    writer = PackageWriter(_Sink(out), member_bytes)
                writer.add(page_id, warc_record(page_id, url, payload, digest, refers_to, date, f"{uri}#{n}"))
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["package", "records"])

    return run


def _list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                members = zip_members(f, f.size())
                at, size, method = members[INDEX]
                if method:
                    raise ValueError("the index isn't stored")
                rows = [json.loads(x) for x in read_range(f, at, size).decode().splitlines()]
            if any(members[f"archive/{r['filename']}"][2] for r in rows):
                raise ValueError("an archive member isn't stored")
            for s in range(0, len(rows), 10_000):
                part = rows[s : s + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(part)), pa.array([members[f"archive/{r['filename']}"][0] + r["offset"] for r in part], pa.int64()), pa.array([r["length"] for r in part], pa.int64())],
                    names=["package", "at", "length"],
                )


def _read_records(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uri_now = f = None
            for s in range(0, batch.num_rows, 200):
                rows = []
                for i in range(s, min(s + 200, batch.num_rows)):
                    uri, at, length = (c[i].as_py() for c in batch.columns)
                    if uri != uri_now:
                        if f is not None:
                            f.close()
                        fs, path = open_fs(uri)
                        f, uri_now = fs.open_input_file(path), uri
                    r = parse_record(gzip.decompress(read_range(f, at, length)))
                    if not with_payload:
                        r["payload"] = None
                    rows.append(r)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
            if f is not None:
                f.close()

    return run


def write_archives(pages: DataFrame, min_revisit_bytes: int = 1000, member_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html, ...) -> (package, records): the packages written, in the session's shared folder.

    Of pages with equal payloads (html in UTF-8; null: empty) of at least ``min_revisit_bytes``, the one with the largest page_id
    is a response and the others revisit it. Pages without page_id are always responses, and so are all rows that repeat the largest page_id.
    An empty table writes nothing.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.withColumn("digest", F.sha1("payload")).withColumn("shared", F.when(F.octet_length("payload") >= min_revisit_bytes, F.col("digest")))
    groups = materialize(keyed.filter("shared is not null").groupBy("shared").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1"), "op8-groups")
    # payloads that very many pages share don't meet in a task, and small ones pass by
    marked = join_by_weight(keyed, groups, "shared", "n", groups.agg(F.sum("n")).first()[0] or 0)
    refers = F.when(F.col("page_id") < F.col("keep"), F.col("keep"))
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/packages-{uuid.uuid4().hex}"
    written = materialize(
        marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_write_packages(folder, member_bytes, date), "package string, records long"), "op8"
    )
    release(groups)
    return written


def read_archives(packages: DataFrame, with_payload: bool = True, parts: int | None = None) -> DataFrame:
    """(package, ...) -> one row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    parts = parts or int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = packages.select("package").repartition(parts, "package").mapInArrow(_list_records, "package string, at long, length long")
    # ranges near each other go to one task: of a package, pieces of 16 MiB
    dealt = places.repartition(parts, "package", F.floor(F.col("at") / (16 << 20)))
    return dealt.mapInArrow(_read_records(with_payload), RECORD)
