"""WARC archives: written whole, normalised to one gzip member a record, read by index.

``write_archives`` writes records into archives that are one gzip stream each.
``normalise`` inflates such a stream once, from start to end, and rewrites every record
as a member of its own, with a sidecar index of offsets (one line a record: offset,
length, type, id, digest). ``read_records`` reads records by those offsets.

Records with equal payloads are written once: that of the largest page_id is a response,
the others are revisits that name it. Payloads under ``min_bytes`` are always responses.

Writers give files names of their own for each attempt, and only names in a written
manifest count, so a lost or repeated task leaves no wrong row. Archives have a bounded
size, so no task holds more than one record and its buffers.

Defined results: a null html is an empty payload, a null url a record without a target.
A null page_id revisits the response if another row has one, else is a response. Repeated
rows of the largest page_id are responses each. A very long page is one record, which a
task holds whole. An empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefield.llm import common
from kinefield.llm.tokenfile import file_system

_DATE = "2020-01-01T00:00:00Z"
_ID = "urn:x-page:"
_BLOCK = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the response of ``refers_to``."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{_ID}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(_ID)
    return int(text) if text.lstrip("-").isdigit() else None


class _Output:
    """A file in the shared folder under a name of this attempt alone."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}"
        self.store, self.at = file_system(self.name)
        self.store.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.file = self.store.open_output_stream(self.at + ".warc.gz", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def beside(self, suffix: str, data: bytes) -> None:
        with self.store.open_output_stream(self.at + suffix) as f:
            f.write(data)


def revisits(pages: DataFrame, min_bytes: int, scratch: common.Scratch) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another row's response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    light = pages.select(
        F.col("page_id").cast("long"), F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("size")
    )
    light = scratch.table(light.filter(F.col("size") >= min_bytes).select("page_id", "sha"), "digests")
    groups = light.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    # Written apart, so that the join with it can split the rows of a common payload.
    groups = scratch.table(groups.filter("n > 1 and refers_to is not null").select("sha", "refers_to"), "groups")
    found = light.join(groups, "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return scratch.table(found.select(F.col("page_id").alias("rp"), F.col("sha").alias("rs"), "refers_to").distinct(), "revisits")


def write_archives(
    pages: DataFrame,
    folder: str,
    scratch: common.Scratch,
    min_bytes: int = 0,
    archive_bytes: int = 32 << 20,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Write all pages; the manifest (path, records), lazily. ``archive_bytes``: unzipped."""
    again = revisits(pages, min_bytes, scratch)
    small = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    sha = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    rows = rows.join(
        F.broadcast(again) if small else again,
        rows["page_id"].eqNullSafe(F.col("rp")) & (sha == F.col("rs")),
        "left",
    ).select("page_id", "url", "html", "refers_to")

    def run(batches):
        out = packer = None
        raw = count = 0

        def end():
            out.write(packer.flush())
            out.file.close()
            return pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([count])], names=["path", "records"])

        for batch in common.released(batches):
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))
            for page, url, html, refers in zip(*columns, strict=True):
                if out is None:
                    out, packer, raw, count = _Output(folder), zlib.compressobj(1, wbits=31), 0, 0
                data = record(page, url, (html or "").encode(), refers)
                out.write(packer.compress(data))
                raw, count = raw + len(data), count + 1
                if raw >= archive_bytes:
                    yield end()
                    out = None
        if out is not None:
            yield end()

    return rows.mapInArrow(run, "path string, records long")


def _inflated(file):
    """What a gzip stream of any count of members holds, in pieces of a bounded size."""
    inflate = zlib.decompressobj(wbits=31)
    while data := file.read(_BLOCK):
        while data:
            yield inflate.decompress(data, _BLOCK)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)
    # All input is taken, but a piece of full size may have left some of what it holds.
    while piece := inflate.decompress(b"", _BLOCK):
        yield piece


def read_stream(file):
    """The records (bytes) of one gzip stream, inflated once; one record is held at a time."""
    held = bytearray()
    need = -1  # bytes of the record at the front, once its header is there
    for piece in _inflated(file):
        held += piece
        at = 0
        while True:
            if need < 0:
                stop = held.find(b"\r\n\r\n", at)
                if stop < 0:
                    break
                need = stop + 4 - at + int(_fields(bytes(held[at:stop]))["content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, -1
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def normalise(manifest: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite each archive of ``manifest``; the new manifest (path, records), lazily."""

    def run(batches):
        for batch in common.released(batches):
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, at = file_system(path)
                out, index = _Output(folder), []
                with store.open_input_stream(at + ".warc.gz", compression=None) as f:
                    for data in read_stream(f):
                        head = _fields(data[: data.index(b"\r\n\r\n")])
                        packer = zlib.compressobj(level, wbits=31)
                        member = packer.compress(data) + packer.flush()
                        line = (out.size, len(member), head["warc-type"], head["warc-record-id"], head["warc-payload-digest"])
                        index.append("\t".join(map(str, line)))
                        out.write(member)
                out.file.close()
                if len(index) != records:
                    raise ValueError(f"{path}: {len(index)} records, {records} were written")
                out.beside(".index", "\n".join(index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([records])], names=["path", "records"])

    return _spread(manifest).mapInArrow(run, "path string, records long")


def read_records(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target), by index."""

    def run(batches):
        for batch in common.released(batches):
            for path in batch.column("path").to_pylist():
                store, at = file_system(path)
                with store.open_input_stream(at + ".index") as f:
                    index = [line.split("\t") for line in f.read().decode().split("\n") if line]
                with store.open_input_file(at + ".warc.gz") as f:
                    for k in range(0, len(index), common.BATCH_ROWS):
                        rows = [_read(f, int(x[0]), int(x[1])) for x in index[k : k + common.BATCH_ROWS]]
                        columns = list(zip(*rows, strict=True))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                        names = "page_id payload_bytes payload_digest record_type refers_to target".split()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
                        )

    return _spread(manifest).mapInArrow(
        run,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string",
    )


def _read(file, offset: int, length: int) -> tuple:
    file.seek(offset)
    data = zlib.decompress(file.read(length), wbits=31)
    stop = data.index(b"\r\n\r\n")
    head = _fields(data[:stop])
    block = data[stop + 4 : stop + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, told = int(_fields(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"{head['warc-record-id']}: the payload isn't what was written")
    refers = _page(head.get("warc-refers-to"))
    return _page(head["warc-record-id"]), size, told, head["warc-type"], refers, head.get("warc-target-uri")


def _spread(manifest: DataFrame) -> DataFrame:
    """An archive for each task, as far as tasks go."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(n)
