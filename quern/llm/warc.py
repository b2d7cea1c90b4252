"""Operator 7: WARC archives of pages, and a salvage reader.

Writing: each task writes gzip members, one a record, into archives of bounded size in a shared folder. An archive is
written under a name of its attempt and then renamed, so a repeated task leaves one whole archive.

Reading: an archive is a stream; memory is bounded by one record. A member is inflated, its version line,
headers, length and digest are checked. After a failed check the reader looks for the next place that holds
a valid member (or, in plain archives, a version line that starts a valid record), goes on from there, and
logs the bytes between as a quarantined gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, text_batches

#: An archive is closed at this size; payloads under LEAST bytes are never revisits; groups of equal payloads that are broadcast at most (about 100 bytes each).
ARCHIVE_BYTES, LEAST, GROUPS = 32 << 20, 100, 200_000
VERSION, MEMBER = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
#: Versions that are read, all as long as VERSION, and the digests that are verified; of others nothing is known.
VERSIONS, DIGESTS = (b"WARC/1.0\r\n", VERSION), ("md5", "sha1", "sha256", "sha512")
RECORDS = "archive string, start long, length long, record_type string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, gap string"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has no block but its payload's digest and length and the id it refers to."""
    block = b"" if kind == "revisit" else payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI": uri, "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)), "Content-Type": "text/html; charset=utf-8",
    }
    if kind == "revisit":
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(block))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(ValueError):
    """A check that failed."""


def _intact(head: dict[str, str], block: bytes) -> bool:
    """Whether the payload is as its digest says, in hex or base32; also if there is no digest, or none that can be verified."""
    name, _, want = head.get("warc-payload-digest", "").partition(":")
    if (name := name.lower().replace("-", "")) not in DIGESTS:
        return True
    if head.get("content-type", "").lower().startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        if b"-encoding:" in top.lower():  # the digest may be of the decoded payload
            return True
    digest = hashlib.new(name, block).digest()
    return want.lower() == digest.hex() or want.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at `at`; Bad if any check fails."""
    if not data.startswith(VERSIONS, at):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Bad("headers do not end")
    head = {}
    for line in data[at + len(VERSION) : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header has no colon")
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not (n := head.get("content-length", "")).isdigit():
        raise Bad("no content length")
    end = stop + 4 + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("the block does not end where its length says")
    block = data[stop + 4 : end]
    if head.get("warc-type") == "response" and not _intact(head, block):
        raise Bad("the payload's digest differs")
    return head, block, end + 4


class _Window:
    """A stream with what has been read and not yet dropped."""

    def __init__(self, stream, step: int = 1 << 20):
        self.stream, self.step, self.data, self.start, self.over = stream, step, b"", 0, False

    def more(self) -> bool:
        got = b"" if self.over else self.stream.read(self.step)
        self.over = not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.start = self.data[n:], self.start + n


def _member(w: _Window, at: int) -> tuple[bytes, int]:
    """The member at offset `at` of the window, inflated, and its end; reads on as needed."""
    while len(w.data) < at + 3 and w.more():
        pass
    if not w.data.startswith(MEMBER, at):
        raise Bad("no gzip member")
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        if pos >= len(w.data) and not w.more():
            raise Bad("the member is cut short")
        try:
            out.append(z.decompress(w.data[pos:]))
        except zlib.error as e:
            raise Bad(f"the member does not inflate: {e}") from None
        pos = len(w.data)
    return b"".join(out), pos - len(z.unused_data)


def _plain(w: _Window, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at offset `at` of a plain archive; reads on as needed, to the length its headers give."""
    while True:
        try:
            return parse(w.data, at)
        except Bad:
            stop = w.data.find(b"\r\n\r\n", at)
            if not w.data.startswith(tuple(v[: max(0, len(w.data) - at)] for v in VERSIONS), at) or stop >= 0 and not _short(w, at, stop) or not w.more():
                raise


def _short(w: _Window, at: int, stop: int) -> bool:
    n = [x.split(b":")[1].strip() for x in w.data[at:stop].split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return bool(n) and n[0].isdigit() and stop + 8 + int(n[0]) > len(w.data)


def _records(data: bytes) -> list[tuple[dict[str, str] | None, bytes, str | None]]:
    """(headers, block, None) of each record of an inflated member and (None, b"", reason) for what lies between; Bad if it has none."""
    found, at, why = [], 0, None
    while at < len(data) or not found and why is None:
        try:
            head, block, at = parse(data, at)
        except Bad as e:
            if why is None:
                why = str(e)
                found.append((None, b"", why))
            at = i if (i := data.find(VERSION[:5], at + 1)) >= 0 else len(data)
            continue
        found.append((head, block, None))
        why = None
    if all(head is None for head, _, _ in found):
        raise Bad(found[0][2])
    return found


def salvage(stream) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """(start, length, headers, block, None) for each valid record and (start, length, None, b"", reason) for each gap.

    Gzip archives and plain ones are told apart record by record. Every byte of the stream belongs to one result: of what
    a gzip member holds, the first has its start and length, and all others have its end and no length.
    An empty stream has none.
    """
    w, gap, why = _Window(stream), None, ""
    while w.data or w.more():
        try:
            while len(w.data) < 10 and w.more():
                pass
            if w.data.startswith(VERSION[:5]):
                head, block, end = _plain(w, 0)
                found = [(head, block, None)]
            else:
                data, end = _member(w, 0)
                found = _records(data)
        except Bad as e:
            if gap is None:
                gap, why = w.start, str(e)
            w.drop(_next(w))
            continue
        if gap is not None:
            yield gap, w.start - gap, None, b"", why
            gap = None
        for i, one in enumerate(found):
            yield w.start + end * (i > 0), end * (i == 0), *one
        w.drop(end)
    if gap is not None:
        yield gap, w.start - gap, None, b"", why


def _next(w: _Window) -> int:
    """Bytes to the next place that may start a record, or all that can be dropped before reading on."""
    while True:
        found = [i for i in (w.data.find(MEMBER, 1), w.data.find(VERSION[:5], 1)) if i > 0]
        if found:
            return min(found)
        if len(w.data) > 16:
            return len(w.data) - 4
        if not w.more():
            return max(1, len(w.data))


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _id(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps (see RECORDS; gap holds the reason, null for records) of the archives named in column `archive`.

    One task reads an archive from start to end. Names may repeat (then their records do). No archives: no rows.
    """
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("gap", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for start, n, head, block, gap in salvage(stream):
                        if head is None:
                            rows.append((path, start, n, None, None, None, None, None, None, None, gap))
                        else:
                            of_revisit = head.get("warc-type") == "revisit"
                            size = int(head.get("x-payload-length", 0)) if of_revisit else len(block)
                            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") if of_revisit else hashlib.sha256(block).hexdigest()
                            rows.append((path, start, n, head.get("warc-type"), head.get("warc-target-uri"), _id(head.get("warc-record-id")), _id(head.get("warc-refers-to")), size, digest, block if payloads else None, None))
                            held += len(block) * payloads
                        if len(rows) >= 2000 or held > 4_000_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    n = max(1, archives.count())
    return archives.select("archive").repartition(min(n, 10_000), "archive").mapInArrow(run, RECORDS)


def mark_revisits(pages: DataFrame, payload: Column) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of `pages`.

    Of rows with equal payloads of LEAST bytes or more the one with the smallest page_id is the response; others are
    revisits of it. A row with a null page_id takes part: it is a revisit if any row of its group has an id.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keyed = rows.where(F.length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    # A group's rows stay where they are if there are few groups; else adaptive skew handling splits a large one.
    groups = cut(keyed.select("digest", "first_id"), "groups")
    joined = rows.join(F.broadcast(groups) if groups.limit(GROUPS + 1).count() <= GROUPS else groups, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html; null html is an empty payload); the table of archives.

    Returns archive, records, bytes, already written. A task that is repeated writes archives of other names; those of the attempt before stay
    in the folder, but the table names them not, so nothing is read twice.
    """
    marked = mark_revisits(pages, F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8"))
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        held, records, size, done = io.BytesIO(), 0, 0, []

        def close() -> None:
            nonlocal held, records, size
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{base}/.{name}", compression=None) as out:
                out.write(held.getbuffer())
            store.move(f"{base}/.{name}", f"{base}/{name}")
            done.append({"archive": f"{folder}/{name}", "records": records, "bytes": size})
            held, records, size = io.BytesIO(), 0, 0

        for b in batches:
            for part in text_batches(iter([b])):
                for row in part.to_pylist():
                    data = gzipped(record(row["record_type"], row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                    held.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= archive_bytes:
                        close()
        if records:
            close()
        yield pa.RecordBatch.from_pylist(done, schema)

    return cut(marked.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def archive_pages(pages: DataFrame, folder: str | None = None, payloads: bool = True) -> DataFrame:
    """Write `pages` to archives in `folder` (in the shared folder if none is given) and read them back: see RECORDS."""
    import uuid

    from .common import bounded_arrow

    bounded_arrow(pages.sparkSession, 500)
    folder = folder or f"{shared_dir(pages.sparkSession)}/quern-warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), payloads)
