"""WARC archives: records in gzip members of their own, written once per page, read back in sequence.

A row of the archive table is one archive: its name and its bytes, as Spark's binaryFile source gives files; `save_archives`
makes files of them. Writing goes through Spark's own committer, so a lost executor leaves no half archive. The reader takes an archive in pieces
of `PIECE` bytes, inflates one gzip member after the other, frames records by their Content-Length and checks block and
payload digests; it holds a record and a piece at a time.

Of pages with equal payloads of at least `LEAST_REVISIT` bytes, that with the largest page_id is written in full and the others as
revisit records that name it. Record ids are unique; the page's own id stands in a field of its own.

Defined cases: a null html is an empty payload; pages without a page_id are responses and never referred to; rows that
repeat a page_id and payload are each written, as the response each; an empty table gives no archives and an empty result; other
columns are not read. The reader takes every type of record, with or without digests, and digests of any algorithm that hashlib has, in
base 32 or hex; those of other algorithms are not checked. Broken digests or framing raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from uuid import UUID

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.llm.batches import parts
from tessera.shared import materialise

LEAST_REVISIT = 1000
ARCHIVE_BYTES, PIECE = 4_000_000, 65_536
DATE = "2026-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of the table of records.
RECORDS = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join((url or "urn:unknown").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None, serial: str = "") -> bytes:
    """One record as a gzip member. A revisit has the head of the HTTP answer only. serial: makes ids of equal records differ."""
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    digest = _base32(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{UUID(bytes=hashlib.sha1(f'{serial}:{page_id}:{digest}'.encode()).digest()[:16], version=5)}>",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if refers_to is None else [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]),
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of each gzip member."""
    inflate, out = zlib.decompressobj(31), []
    begun = False
    for piece in pieces:
        while piece:
            begun = True
            out.append(inflate.decompress(piece))
            piece = b""
            if inflate.eof:
                piece = inflate.unused_data
                yield b"".join(out)
                inflate, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("archive ends within a gzip member")


def _digest(label: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest; None where either cannot be made out."""
    name, _, value = label.strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in hashlib.algorithms_available:
        return None
    size = hashlib.new(name).digest_size
    if re.fullmatch(rf"[0-9A-Fa-f]{{{2 * size}}}", value):
        return name, bytes.fromhex(value)
    try:
        found = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (name, found) if len(found) == size else None


def _check(what: str, headers: dict[str, str], data: bytes) -> None:
    known = _digest(headers.get(f"warc-{what}-digest", ""))
    if known and hashlib.new(known[0], data).digest() != known[1]:
        raise ValueError(f"{what} digest of {headers.get('warc-record-id')} differs")


def read_archive(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, in order, digests checked."""
    for data in _members(pieces):
        head, gap, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", -1))
        if not gap or not version.startswith("WARC/") or size < 0 or rest[size:] != b"\r\n\r\n":
            raise ValueError("record is not framed by its Content-Length")
        block = rest[:size]
        _check("block", headers, block)
        yield headers, block


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """A record's row of `RECORDS`. A revisit's payload is elsewhere: its length is what the HTTP head says, its digest what the record says."""
    kind = headers.get("warc-type", "")
    http = headers.get("content-type", "").replace(" ", "").startswith("application/http")
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])} if http else {}
    if kind == "revisit":
        known = _digest(headers.get("warc-payload-digest", ""))
        size, digest = _number(fields.get(b"content-length", b"").decode("latin-1")), known[1].hex() if known and known[0] == "sha1" else None
    else:
        payload = body if http else block
        if b"transfer-encoding" not in fields:  # of a payload in chunks, writers digest now one form, now the other
            _check("payload", headers, payload)
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return headers.get("warc-record-id", "").strip("<>"), kind, headers.get("warc-target-uri"), _number(headers.get("x-page-id")), _number(headers.get("x-refers-to-page-id")), size, digest


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []

    def out() -> pa.RecordBatch:
        data = b"".join(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(data).hexdigest()}.warc.gz"]), pa.array([data], pa.binary())], ["name", "content"])

    size = n = 0
    task = TaskContext.get()
    for batch in batches:
        for some in parts(batch, 2):
            for page_id, url, html, refers_to, refers_url in zip(*some.columns, strict=True):
                n += 1
                held.append(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), refers_to.as_py(), refers_url.as_py(), f"{task.partitionId() if task else 0}:{n}"))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    size = 0
    if held:
        yield out()


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The archives of pages: name, content."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    equal = rows.where(f"octet_length(coalesce(html, '')) >= {LEAST_REVISIT} and page_id is not null").groupBy("digest")
    equal = equal.agg(F.max(F.struct("page_id", "url")).alias("last"), F.min("page_id").alias("other")).where("last.page_id <> other")
    # Written, so that the join below reads plain shuffles and AQE can split a payload that very many pages have.
    equal = materialise(equal.select("digest", F.col("last.page_id").alias("last"), F.col("last.url").alias("last_url")), "equal")
    found = rows.join(equal, "digest", "left")
    later = F.col("page_id") < F.col("last")
    found = found.select("page_id", "url", "html", F.when(later, F.col("last")).alias("refers_to"), F.when(later, F.col("last_url")).alias("refers_url"))
    return materialise(found.mapInArrow(_archived, "name string, content binary"), "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in RECORDS.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            data = memoryview(content.as_buffer())
            rows = [_row(*x) for x in read_archive(bytes(data[at : at + PIECE]) for at in range(0, len(data), PIECE))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """A row of `RECORDS` per record of any type; also of real files, with spark.read.format("binaryFile")."""
    return archives.select(content).mapInArrow(_read, RECORDS)


class _Files(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Files under names that only this attempt has."""
        files, folder = self._at()
        made = []
        for row in rows:
            part = f"{folder}/.{row['name']}-{TaskContext.get().taskAttemptId()}"
            files.create_dir(folder)
            with files.open_output_stream(part, compression=None) as out:
                out.write(row["content"])
            made.append((part, f"{folder}/{row['name']}"))
        message = WriterCommitMessage()
        message.made = made
        return message

    def commit(self, messages: list) -> None:
        files, _ = self._at()
        for message in messages:
            for part, name in message.made:
                files.move(part, name)

    def abort(self, messages: list) -> None:
        files, _ = self._at()
        for message in messages:
            for part, _ in message.made if message else ():
                files.delete_file(part)


class WarcFiles(DataSource):
    """Sink of archives (name, content): a file each, in a folder that driver and executors share; names become visible when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool) -> _Files:  # noqa: ANN001, FBT001
        return _Files(self.options["path"])


def shared_folder(folder: str, master: str) -> str:
    """folder, if all executors see it: on a cluster a path without a scheme would be each executor's own disk, and is refused."""
    if ":/" not in folder and not master.startswith("local["):
        raise ValueError(f"{folder} names no store that all executors share")
    return folder


def save_archives(archives: DataFrame, folder: str) -> None:
    """Add the archives to a folder as .warc.gz files."""
    folder = shared_folder(folder, archives.sparkSession.sparkContext.master)
    archives.sparkSession.dataSource.register(WarcFiles)
    archives.select("name", "content").write.format("warc").mode("append").save(folder)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
