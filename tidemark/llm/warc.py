"""Operator 7: WARC archives, written with one gzip member per record and read back sequentially.

Writing: the largest page_id of each payload digest is found first (maximum pre-aggregated per task, and
written). That page's record is a response; pages meet it by digest and page_id together, so html is spread
evenly. The others are revisits that refer to it and keep only the HTTP header; they are joined by digest
without their html, and a payload that a third of all pages share can be split, as both sides of that join
come straight from their exchanges. Each task writes archives of about `archive_bytes` into a shared folder
and returns their paths; archives of tasks that died are in no list and never read. The folder is on a file
system that pyarrow reaches (file, hdfs, s3 or s3a, gs, abfs); others are refused before any work.

Reading: a task goes through one archive, decompressing block by block. A record is a gzip member: its
header lines, Content-Length bytes, and an empty line; anything else is an error. The digest of each
response's payload is computed from what was read and held against the header. Archives of others are read
too: records other than responses and revisits are passed over, ids that name no page read as null, names of
header fields are taken in any case, and a response without a payload digest has a null digest_ok.

A null html is an empty payload. A null page_id has no name in the record and reads back as null; such
pages revisit the largest page_id of their payload, or are responses when there is none. Repeated rows
of the largest page_id are all responses. A null url leaves its line out; line breaks in it are
escaped. No pages give no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import folder, prepare, written
from tidemark.llm._text import pieces

_NAME = "urn:x-page:"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, digest_ok boolean"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """The uncompressed record; payload is empty for a revisit, size is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Member:
    """Reads of one gzip member after another from a stream, block by block."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.left, self.z, self.plain = stream, block, b"", None, bytearray()

    def next(self) -> bool:
        if not self.left:
            self.left = self.stream.read(self.block)
        self.z, self.plain = zlib.decompressobj(31), bytearray()
        return bool(self.left)

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.left or self.stream.read(self.block)
        if not data:
            raise ValueError("the archive ends inside a record")
        self.plain += self.z.decompress(data, self.block)
        self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.plain.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.plain)
            if not self._more():
                raise ValueError("a record's header does not end")
        out = bytes(self.plain[:found])
        del self.plain[: found + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            part = bytes(self.plain[:n])
            del self.plain[: len(part)]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        while self._more():
            pass
        return bytes(self.plain)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] = f"{out[last]} {line.decode('utf-8', 'replace').strip()}".strip()
        elif b":" in line:
            name, _, value = line.partition(b":")
            last = name.decode("utf-8", "replace").strip().lower()
            out[last] = value.decode("utf-8", "replace").strip()
    return out


def _page(name: str | None) -> int | None:
    """The page's number in a record's id, null for ids of other kinds."""
    number = (name or "").removeprefix(f"<{_NAME}").removesuffix(">")
    return int(number) if (number.removeprefix("-")).isascii() and number.removeprefix("-").isdigit() else None


def read_archive(stream, block: int = 1 << 16, payloads: bool = False) -> Iterator[dict]:
    """The responses and revisits of an archive in order."""
    member = _Member(stream, block)
    while member.next():
        first, *lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = _fields(lines)
        if not head.get("content-length", "").isdigit():
            raise ValueError("a record without a Content-Length")
        content, kind = int(head["content-length"]), head.get("warc-type", "").lower()
        if kind not in ("response", "revisit"):
            for _ in member.take(content):
                pass
            if member.rest() != b"\r\n\r\n":
                raise ValueError("a record is longer than its Content-Length")
            continue
        http, stated = _http(member, content)
        sha, body, n = hashlib.sha1(), [], 0
        for part in member.take(content - http):
            sha.update(part)
            n += len(part)
            if payloads:
                body.append(part)
        if member.rest() != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        stored = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        made = base64.b32encode(sha.digest()).decode()
        ok = True if kind == "revisit" else None if stored is None else (stated is None or n == stated) and made == stored
        size = n if stated is None else stated
        yield {"page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": _page(head.get("warc-refers-to")), "payload_digest": stored if kind == "revisit" else stored or made, "payload_bytes": size, "digest_ok": ok} | ({"payload": b"".join(body)} if payloads else {})


def _http(member: _Member, content: int) -> tuple[int, int | None]:
    """Length of the HTTP header, and the Content-Length that it states, if any."""
    if not content:
        return 0, None
    head = member.until(b"\r\n\r\n")
    if len(head) + 4 > content:
        raise ValueError("a record is shorter than its HTTP header")
    stated = _fields(head.split(b"\r\n")[1:]).get("content-length", "")
    return len(head) + 4, int(stated) if stated.isdigit() else None


def _reached(uri: str) -> str:
    """The URI as pyarrow takes it."""
    scheme, mark, rest = uri.partition("://")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) if mark else "file"
    if scheme not in ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss") and not uri.startswith("file:"):
        raise ValueError(f"archives cannot be kept on {scheme}://")
    return f"{scheme}://{rest}" if mark else uri


def write_archives(pages: DataFrame, to: str, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives below the folder `to`; returns path, records, bytes."""
    prepare(pages.sparkSession)
    to = _reached(to)
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    latest = written(keyed.groupBy("sha1").agg(F.max("page_id").alias("latest")), "latest")
    own = latest.withColumnRenamed("sha1", "own_sha1")
    responses = keyed.join(own, (F.col("sha1") == F.col("own_sha1")) & F.col("page_id").eqNullSafe(F.col("latest")))
    responses = responses.select("page_id", "url", "html", F.octet_length("html").alias("size"), "sha1", F.lit(None).cast("long").alias("refers_to"))
    narrow = keyed.select("page_id", "url", F.octet_length("html").alias("size"), "sha1")
    revisits = narrow.join(latest, "sha1").where(F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col("page_id")))
    revisits = revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "sha1", F.col("latest").cast("long").alias("refers_to"))
    joined = responses.unionByName(revisits)

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(to)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for part in pieces(batch, "html"):
                for r in part.to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        path, n, size = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(path, compression=None)
                    data = gzip_member(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["size"], base64.b32encode(r["sha1"]).decode(), r["refers_to"], date))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return written(joined.mapInArrow(run, "path string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The records of the archives listed in `path`; `root` is a URI on their file system."""
    prepare(archives.sparkSession)
    root = _reached(root)
    schema = READ + ", payload binary" * payloads
    n = max(1, archives.count())

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(root)
        empty = spark_schema.empty_table().to_batches()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for r in read_archive(f, payloads=payloads):
                        held.append(r)
                        size += len(r.get("payload", b"")) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=spark_schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=spark_schema)
        yield from empty

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    spark_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return archives.select("path").repartition(n).mapInArrow(run, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    to = folder(spark, "warc")
    got = read_archives(write_archives(pages, to), to)
    broken = F.raise_error(F.concat(F.lit("digest mismatch in the record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return got.select("page_id", "payload_bytes", F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(broken.cast("string")).alias("payload_digest"), "record_type", "refers_to")
