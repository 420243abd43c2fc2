"""Legacy ARC archives, their conversion to WARC, and readers of both.

Archives are files in a folder that all executors share, of bounded size, with
one gzip member per record. Tasks write under names of their own and return
them; only files that a manifest table names count, so what a lost or repeated
task left behind is ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_of

#: Uncompressed bytes after which a file is closed.
ROLL = 8_000_000
#: Bytes of an archive that are read at a time.
READ = 1_000_000
#: Tasks that read archives at most; beyond, a task reads several files in turn.
MAX_TASKS = 50_000
# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "path string, n_records long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: str, digest: str) -> str:
    """The same for the same page and payload, whoever writes it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


class Rolling:
    """Writes gzip members to files that are renamed once they are whole."""

    def __init__(self, folder: str, kind: str, head):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.folder, self.kind, self.head = folder, kind, head
        self.out, self.done = None, []

    def add(self, record) -> None:
        """record: bytes, or a function of file name, version and offset that makes them."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.{self.kind}.gz"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}.open", compression=None)
            self.size = self.at = self.n = 0
            self.write(self.head(self.name, len(self.done)))
        self.write(record(self.name, len(self.done), self.at) if callable(record) else record)
        self.n += 1
        if self.size >= ROLL:
            self.close()

    def write(self, data: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.size += len(data)
        self.at += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.base}/{self.name}.open", f"{self.base}/{self.name}")
            self.done.append((f"{self.folder}/{self.name}", self.n))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in self.done], pa.string()), pa.array([x[1] for x in self.done], pa.int64())], ["path", "n_records"])


def members(path: str) -> Iterator[bytes]:
    """The gzip members of a file, unpacked; one that is cut short ends it. Plain files are one member.

    A file is read piece by piece, so memory follows the longest member, whatever the archive's size.
    """
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        rest = f.read(READ)
        if rest[:2] != b"\x1f\x8b":
            yield rest + f.read()
            return
        while rest:
            unpack, parts = zlib.decompressobj(31), []
            try:
                while rest and not unpack.eof:
                    parts.append(unpack.decompress(rest))
                    rest = unpack.unused_data if unpack.eof else f.read(READ)
            except zlib.error:
                return
            if not unpack.eof:
                return
            yield b"".join(parts)
            rest = rest or f.read(READ)


def arc_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block.

    The version block says which fields header lines have; the URL is what
    stands before the others. A record shorter than declared ends the file.
    """
    fields = None
    for data in members(path):
        at = 0
        while at < len(data):
            end = data.find(b"\n", at)
            if end < 0:
                return
            line = data[at:end].decode("utf-8", "replace").rstrip("\r")
            at = end + 1
            if not line:
                continue
            length = line.rsplit(" ", 1)[-1]
            if not length.isdigit() or at + int(length) > len(data):
                return
            content = data[at : at + int(length)]
            at += int(length)
            if line.startswith("filedesc://"):
                version = content.split(b" ", 1)[0]
                fields = ARC_FIELDS[2 if version == b"2" else 1].split()
            elif fields is not None:
                values = line.rsplit(" ", len(fields) - 1)
                if len(values) == len(fields):
                    yield dict(zip(fields, values)), content


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP header block, with its empty line, and the payload."""
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def field(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", block)
    return found[1].decode("utf-8", "replace") if found else None


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000") -> DataFrame:
    """A manifest of ARC files that hold pages (page_id, url, html); versions 1 and 2 alternate.

    Null html is empty, a null url is "unknown:", and a null page_id is left out.
    page_id must be an integer column. Very long pages are written whole.
    """

    def head(name: str, k: int) -> bytes:
        version = 1 + k % 2
        body = f"{version} 0 paperloom\n{ARC_FIELDS[version]}\n\n".encode()
        more = "" if version == 1 else f" 200 - - 0 {name}"
        return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body

    def run(batches):
        out = Rolling(folder, "arc", head)
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "unknown:"
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload

                def record(name, k, at, url=url, content=content):
                    more = "" if k % 2 == 0 else f" 200 - - {at} {name}"
                    return f"{url} 0.0.0.0 {date} text/html{more} {len(content)}\n".encode() + content + b"\n"

                out.add(record)
        yield out.manifest()

    return stored(pages.select("page_id", text_of("url").alias("url"), text_of("html").alias("html")).mapInArrow(run, MANIFEST), "arc-manifest")


def one_each(manifest: DataFrame, work: DataFrame) -> DataFrame:
    """work, dealt out by path to as many tasks as manifest has files, MAX_TASKS at most, which adaptive execution doesn't merge."""
    return work.repartition(min(MAX_TASKS, max(1, manifest.count())), "path")


def arc_digests(manifest: DataFrame) -> DataFrame:
    """(path, page_id, digest) of each ARC record."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for _, content in arc_records(path):
                    block, payload = http_parts(content)
                    rows.append((field(block, "X-Page-Id"), sha1_base32(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([None if p is None else int(p) for p, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())], ["path", "page_id", "digest"])

    return one_each(manifest, manifest.select("path")).mapInArrow(run, "path string, page_id long, digest string")


def convert(manifest: DataFrame, folder: str) -> DataFrame:
    """A manifest of WARC files that equal the ARC files of manifest.

    Of equal payloads the one with the smallest page_id becomes a response and
    the others revisits. Each file is converted by one task, which gets the
    digests of that file alone that occur again somewhere.
    """
    digests = stored(arc_digests(manifest), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = digests.select("path", "digest").distinct().join(first, "digest")
    again = again.groupBy("path").agg(F.collect_list(F.struct("digest", "first")).alias("again"))
    work = one_each(manifest, manifest.select("path").join(again, "path", "left"))

    def head(name: str, k: int) -> bytes:
        body = b"software: paperloom\r\nformat: WARC File Format 1.1\r\n"
        return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nWARC-Record-ID: {record_id(name, '')}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    def run(batches):
        out = Rolling(folder, "warc", head)
        for batch in batches:
            for path, known in zip(*(c.to_pylist() for c in batch.columns)):
                known = {x["digest"]: x["first"] for x in known or ()}
                for fields, content in arc_records(path):
                    block, payload = http_parts(content)
                    page, digest, d = field(block, "X-Page-Id"), sha1_base32(payload), fields["Archive-date"]
                    origin = known.get(digest)
                    revisit = origin is not None and str(origin) != page
                    body = block if revisit else content
                    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {fields['URL']}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Record-ID: {record_id(page or fields['URL'], digest)}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(body)}"]
                    if revisit:
                        lines += [f"WARC-Refers-To: {record_id(str(origin), digest)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {origin}"]
                    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
                    out.add("\r\n".join(lines).encode() + body + b"\r\n\r\n")
        yield out.manifest()

    return stored(work.mapInArrow(run, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) of each record in WARC files.

    A response's digest and size are taken from its payload and must equal the
    declared digest; a revisit's are those declared, and the record it refers
    to must be named rightly.
    """

    def parse(path):
        for data in members(path):
            end = data.find(b"\r\n\r\n")
            head = data[: end + 2]
            kind = field(head, "WARC-Type")
            if kind not in ("response", "revisit"):
                continue
            body = data[end + 4 : end + 4 + int(field(head, "Content-Length"))]
            block, payload = http_parts(body)
            page, digest, origin = field(block, "X-Page-Id"), field(head, "WARC-Payload-Digest").removeprefix("sha1:"), field(head, "X-Refers-To-Page-Id")
            size = int(field(block, "Content-Length")) if kind == "revisit" else len(payload)
            if kind == "response" and sha1_base32(payload) != digest or kind == "revisit" and field(head, "WARC-Refers-To") != record_id(origin, digest):
                raise ValueError(f"damaged record {field(head, 'WARC-Record-ID')} in {path}")
            yield (None if page is None else int(page), size, digest, kind, None if origin is None else int(origin), field(head, "WARC-Target-URI"), field(head, "WARC-Record-ID"))

    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(parse(path))
                cols = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return one_each(manifest, manifest.select("path")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def convert_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages to ARC files, those to WARC files, and these read back.

    Repeated rows give a record each; equal page_ids with equal payloads are
    responses alike. folder is a URI that all executors reach.
    """
    folder = folder or shared_dir(pages.sparkSession)
    return read_warc(convert(write_arc(pages, f"{folder}/arc"), f"{folder}/warc"))


def found_files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """A manifest of the archives that lie in folder; their contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select("path")
    return listed.select("path", F.lit(None).cast("long").alias("n_records"))


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_CHARS}', CAST(((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31) + 1 AS BIGINT), 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
