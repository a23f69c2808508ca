"""WARC archives: one gzip member per record, written to and read from the shared folder.

The reader is sequential: it inflates one member after the other, a bounded piece at a time, reads a record's header to
its blank line and then as many bytes as its Content-Length says, and holds the digests in the header against what it
read. Records of other writers are read as well: names in any case, values with or without a space before them, folded
lines, digests left out or of other algorithms and spellings.

Equal payloads are stored once; later records refer to the first by its record id, and are resolved against it: their
payload is that of the record they name, whose digest must be theirs. Files are reached through Arrow's file systems,
so the folder may be in any store that Arrow opens.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, staged

CHUNK = 1 << 16
#: Archives are closed once they hold so many bytes.
ARCHIVE_BYTES = 256 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Bytes of a header at most.
HEAD_BYTES = 1 << 20
#: Payloads too small to be referred to are dealt over so many keys of their own.
SPREAD = 4096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record that is cut off or does not have its digest."""


class Headers(dict):
    """Header values by name, in whatever case the name is asked for."""

    def __init__(self, pairs=()):
        super().__init__((k.lower(), v) for k, v in pairs)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


@dataclass
class Record:
    headers: Headers
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("WARC-Type", "")

    @property
    def payload(self) -> bytes:
        """The body of an HTTP message; the whole block of any other record."""
        message = self.headers.get("Content-Type", "").replace(" ", "").lower().startswith("application/http")
        return self.block.partition(b"\r\n\r\n")[2] if message else self.block


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def member(headers: dict[str, str], block: bytes, level: int) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def target(url: str) -> str:
    """A URL as a header's value: as it is where it fits on the line, else as a JSON string."""
    return url if url.isprintable() and url == url.strip() and url[:1] != '"' and url else json.dumps(url)


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The id of the record of a page and payload; `place` tells records apart that are equal in both."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int, place: str = "") -> bytes:
    """A response, or a revisit if `refers_to` names the page that holds the same payload."""
    digest, revisit = sha256(payload), refers_to is not None
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest, place),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else target(url),
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to, digest) if revisit else None,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{sha256(block)}",
        "X-Page-ID": None if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    return member(headers, block, level)


class Inflated:
    """The bytes of an archive, one gzip member after the other, inflated a piece at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.held, self.inflate = stream, stream.read(CHUNK), bytearray(), None

    def next_member(self) -> bool:
        """Begins a member; false at the end of the archive."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.inflate, self.held = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        """Inflates one more piece of the member; false at its end."""
        if self.inflate.eof:
            return False
        self.raw = self.raw or self.stream.read(CHUNK)
        if not self.raw:
            raise BadRecord("the archive ends within a member")
        try:
            self.held += self.inflate.decompress(self.raw, CHUNK)
        except zlib.error as wrong:
            raise BadRecord(f"a member is damaged: {wrong}") from wrong
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before `mark`, which is passed over."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > HEAD_BYTES or not self.more():
                raise BadRecord("a member does not begin with a record's header")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """The next `n` bytes of the member."""
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise BadRecord(f"a record has {len(self.held)} bytes and not {n}")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def ends(self) -> bool:
        """Whether the member has no more bytes."""
        while not self.held and self.more():
            pass
        return not self.held


def parsed_head(head: bytes) -> Headers:
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise BadRecord("a member does not begin with a record's header")
    pairs: list[list[str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and pairs:  # a folded line goes on
            pairs[-1][1] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"a header's line has no colon: {line[:80]!r}")
        pairs.append([name.strip(), value.strip()])
    return Headers(pairs)


def records(stream) -> Iterator[Record]:
    """The records of an archive in their order, each with its digests verified."""
    source = Inflated(stream)
    while source.next_member():
        headers = parsed_head(source.until(b"\r\n\r\n"))
        length = headers.get("Content-Length", "")
        if not (length.isascii() and length.isdigit()):
            raise BadRecord(f"Content-Length is {length!r}")
        block = source.take(int(length))
        if source.take(4) != b"\r\n\r\n" or not source.ends():
            raise BadRecord(f"a record's member does not end after {length} bytes")
        yield verified(Record(headers, block))


def agrees(data: bytes, stated: str | None) -> bool:
    """Whether data has a stated digest (`algorithm:value`, in base 16, 32 or 64). One that is left out, or of an
    algorithm that is not known here, is taken as it is."""
    name, _, value = (stated or "").partition(":")
    if not value or name.lower() not in hashlib.algorithms_guaranteed or name.lower().startswith("shake"):
        return True
    digest = hashlib.new(name.lower(), data).digest()
    for decode in (bytes.fromhex, lambda x: base64.b32decode(x.upper() + "=" * (-len(x) % 8)), lambda x: base64.b64decode(x + "=" * (-len(x) % 4), validate=True)):
        try:
            if decode(value) == digest:
                return True
        except (ValueError, binascii.Error):
            pass
    return False


def verified(found: Record) -> Record:
    """The record, if its digests hold. A revisit's payload digest is that of the record it refers to: see `resolved`."""
    if not agrees(found.block, found.headers.get("WARC-Block-Digest")):
        raise BadRecord(f"block digest of {found.headers.get('WARC-Record-ID')}")
    if found.kind != "revisit" and not agrees(found.payload, found.headers.get("WARC-Payload-Digest")):
        raise BadRecord(f"payload digest of {found.headers.get('WARC-Record-ID')}")
    return found


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def referred(pages: DataFrame, least: int, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """`pages` with `refers_to`: the smallest page_id with the same payload of at least `least` bytes, unless it is the row's own."""
    digest, first, size = fresh(pages, "digest", "first", "size")
    data = F.coalesce(F.col(html), F.lit("")).cast("binary")
    # smaller ones have no digest to meet by; numbers of their own spread them over many tasks
    spare = F.concat(F.lit("-"), (F.monotonically_increasing_id() % SPREAD).cast("string"))
    keyed = pages.withColumn(size, F.octet_length(data)).withColumn(digest, F.when(F.col(size) >= least, F.sha2(data, 256)).otherwise(spare))
    # only payloads that occur again meet the pages once more
    again = keyed.filter(F.col(size) >= least).groupBy(digest).agg(F.min(page_id).alias(first), F.count(F.lit(1)).alias(size)).filter(F.col(size) > 1).drop(size)
    own = F.col(page_id).eqNullSafe(F.col(first))
    return keyed.join(again, digest, "left").withColumn("refers_to", F.when(~own, F.col(first))).drop(digest, first, size)


def write(pages: DataFrame, folder: str, least: int = 100, level: int = 1) -> DataFrame:
    """Writes a record per page into archives in `folder`; returns a row per archive: archive, records.

    Null html is an empty payload, a null url is left out, and a null page_id is kept as null: such a row is never the
    one that others refer to unless all equal rows lack an id. Rows that repeat a page_id with its payload are
    responses all. No rows give no archives. An archive gets its name when it is complete, and only archives that a
    finished task names are read, so a task that is lost or runs twice leaves nothing to be read twice.
    """
    rows = referred(pages, least).select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        written = count = 0
        named: set[tuple] = set()  # digests of those equal payloads in this task that are responses

        def done() -> pa.RecordBatch:
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, written, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                payload, place = (row["html"] or "").encode(), f"{name} {count}"
                if row["refers_to"] is None and len(payload) >= least and (own := (row["page_id"], hash(payload))) not in named:
                    named.add(own)
                    place = ""  # the id by which revisits find it
                data = record(row["page_id"], row["url"], payload, row["refers_to"], level, place)
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return rows.mapInArrow(run, "archive string, records long")


FIELDS = {
    "page_id": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "record_id": pa.string(),
    "refers_to_record": pa.string(),
    "url": pa.string(),
    "payload": pa.binary(),
}
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_record string, url string, payload binary"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named in `archive`: page_id, payload_bytes, payload_digest (SHA-256), record_type,
    record_id, refers_to_record, url, and with `payloads` the payload.

    Size and digest are those of the payload that was read. A revisit has none, so its size and payload are null and its
    digest is what its header states, where that is SHA-256 in hexadecimal. `page_id` is null in archives of other
    writers. Raises BadRecord at a cut or damaged record; an archive without records gives no rows.
    """
    names = list(FIELDS) if payloads else list(FIELDS)[:-1]

    def row(found: Record) -> tuple:
        h, revisit = found.headers, found.kind == "revisit"
        number, url = h.get("X-Page-ID"), h.get("WARC-Target-URI")
        url = json.loads(url) if url and url[0] == '"' else url
        if revisit:
            algorithm, _, stated = (h.get("WARC-Payload-Digest") or "").partition(":")
            size, digest = None, stated.lower() if algorithm.lower() == "sha256" else None
        else:
            size, digest = len(found.payload), sha256(found.payload)
        return (None if number is None else int(number), size, digest, found.kind, h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), url, None if revisit else found.payload)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = opened(archive)
                with store.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for found in records(stream):
                        held.append(row(found))
                        size += len(found.block) if payloads else 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, FIELDS[n]) for x, n in zip(zip(*held), names)], names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, FIELDS[n]) for x, n in zip(zip(*held), names)], names)

    return archives.mapInArrow(run, SCHEMA if payloads else SCHEMA.rpartition(",")[0])


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of `found` (as `read` gives it,
    from a written table, as it is read twice).

    A revisit is resolved against the record that its WARC-Refers-To names: it has that record's size, and refers_to is
    that record's page. A revisit whose record is not there, or has another digest, is an error.
    """
    revisit = F.col("record_type") == "revisit"
    whole = found.filter(~F.coalesce(revisit, F.lit(False))).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    # records that are equal in page and payload may share an id
    held = found.filter(~F.coalesce(revisit, F.lit(False))).groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("own"))
    again = found.filter(revisit).join(held, "refers_to_record", "left")

    def sure(value: Column) -> Column:
        wrong = F.concat(F.lit("a revisit does not have the payload of the record it refers to: "), F.coalesce("record_id", F.lit("")))
        return F.when(F.col("own") == F.coalesce("payload_digest", "own"), value).otherwise(F.raise_error(wrong).cast("long"))

    return whole.unionAll(again.select("page_id", sure(F.col("size")).alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", sure(F.col("refers_to")).alias("refers_to")))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes all pages to new archives in the shared folder, reads these back and resolves revisits."""
    spark = pages.sparkSession
    listed = staged(write(pages, scratch(spark, "warc"), least), "archives", small=True)
    return resolved(staged(read(listed.repartition(max(1, listed.count()))), "records"))
