"""WARC archives and the monolithic gzip normaliser.

Some writers gzip a whole archive as one stream, which no offset can enter.  The
normaliser inflates such a file once, piece by piece, rewrites every record as a gzip
member of its own, and writes a sidecar index of the members' offsets and lengths.

Archives, rewritten archives and sidecars are files in the shared folder.  A task names
its files after itself and its attempt and returns their names; only names that Spark
has committed are read on, so files of lost or repeated attempts are never looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
SALTS = 16


def place(url: str | None) -> str:
    """The url with white space and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def record(kind: str, name: str, page: int | None, url: str | None, payload: bytes, digest: str, date: str, refers: str | None = None) -> bytes:
    """One WARC record of an HTTP response.  A revisit holds the HTTP head alone and names
    the payload by its digest and the target that has it."""
    body = HTTP + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", place(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", place(refers)), ("WARC-Refers-To-Date", date)]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; a revisit's payload is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, piece by piece."""
    machine = zlib.decompressobj(31)
    while piece := source.read(PIECE):
        while piece:
            yield machine.decompress(piece)
            piece = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive; holds one record and one piece."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"\r\nContent-Length: (\d+)", held[:end])
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def member(data: bytes, level: int = 6) -> bytes:
    machine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return machine.compress(data) + machine.flush()


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[dict]:
    """Rewrites ``source`` member by member and yields an index entry for each record."""
    at = 0
    for data in records(inflate(source)):
        packed = member(data)
        target.write(packed)
        fields, _ = parse(data)
        yield {"offset": at, "length": len(packed), "record_id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "date": fields["WARC-Date"], "uri": fields["WARC-Target-URI"]}
        at += len(packed)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that ``spark.checkpoint.dir`` may name."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def normalise_file(source: str, target: str) -> int:
    """Rewrites the file at ``source`` to ``target`` and its index to ``target`` + ".idx" (JSON
    lines); the number of records."""
    files, from_ = opened(source)
    _, to = opened(target)
    n = 0
    with files.open_input_stream(from_, compression=None) as i, files.open_output_stream(to, compression=None) as o, files.open_output_stream(f"{to}.idx") as x:
        for entry in normalise(i, o):
            x.write(json.dumps(entry).encode() + b"\n")
            n += 1
    return n


def entries(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record that the sidecar of an archive names, each
    member entered at its offset alone."""
    files, at = opened(path)
    with files.open_input_file(at) as archive, files.open_input_stream(f"{at}.idx") as index:
        rest = b""
        while piece := index.read(PIECE):
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                e = json.loads(line)
                archive.seek(e["offset"])
                yield parse(zlib.decompress(archive.read(e["length"]), 31))


def task_name() -> str:
    """A name that no other task or attempt has."""
    return f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, html, digest, first, of): the smallest id with an equal payload and its url,
    for payloads of at least ``least_bytes``.  A digest of many pages is dealt out by a hash."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "salt": F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))})
    narrow = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest", "salt").agg(F.min("id").alias("first"), F.min(F.struct(F.col("id").isNull(), "id", "url")).alias("head"))
    firsts = narrow.groupBy("digest").agg(F.min("first").alias("first"), F.min("head")["url"].alias("of"))
    told = narrow.select("digest", "salt").join(firsts, "digest")
    return rows.join(told, ["digest", "salt"], "left").select("id", "url", "html", "digest", "first", "of")


def write_archives(rows: DataFrame, folder: str, date: str, archive_bytes: int) -> DataFrame:
    """(path): monolithic archive files, one gzip stream each, of about ``archive_bytes``
    or one larger record."""

    def run(batches):
        task, count, at, paths = task_name(), 0, 0, []
        files, base = opened(folder)
        out = machine = None

        def close():
            out.write(machine.flush())
            out.close()

        for batch in batches:
            for page, url, html, digest, first, of in zip(*(c.to_pylist() for c in batch.columns)):
                again = first is not None and first != page
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{task}/{count}")
                data = record("revisit" if again else "response", str(name), page, url, shared.utf8(html), digest, date, of)
                count += 1
                if out and at + len(data) > archive_bytes:
                    close()
                    out = None
                if not out:
                    paths.append(f"{folder}/{task}-{len(paths)}.warc.gz")
                    out, machine, at = files.open_output_stream(f"{base}/{task}-{len(paths) - 1}.warc.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0  # read once and rewritten
                out.write(machine.compress(data))
                at += len(data)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return rows.mapInArrow(run, "path string")


def normalised(monoliths: DataFrame, folder: str) -> DataFrame:
    """(path, records): every archive file rewritten member by member beside its sidecar."""

    def run(batches):
        task, n = task_name(), 0
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{task}-{n}.warc.gz"
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([normalise_file(source, target)], pa.int64())], ["path", "records"])

    return monoliths.mapInArrow(run, "path string, records long")


def spread(paths: DataFrame) -> DataFrame:
    """A task for each file, up to some ten thousand."""
    return paths.repartition(min(max(1, paths.count()), 1 << 14))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_bytes: int = 100, archive_bytes: int = 1 << 24, date: datetime | None = None) -> DataFrame:
    """(path, records) of normalised archives of all pages: files in the shared folder, each
    with the sidecar path + ".idx".

    Of equal payloads of at least ``least_bytes`` the smallest id is a response, the
    others revisit it; smaller payloads are all responses.  Null html is an empty
    payload, a null url an empty target.  A row with a null id is never referred to
    unless all equal rows have null ids, which then are all responses; repeated rows become
    records of their own, of one id all responses.  ``date`` is every record's, now if not
    given.  An empty table gives no archive; other columns are not used.
    """
    spark = pages.sparkSession
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    raw, made = shared.new_path(spark, "monoliths"), shared.new_path(spark, "members")
    for folder in (raw, made):
        files, base = opened(folder)
        files.create_dir(base)
    with shared.swept(spark):  # else the shuffled pages may lie beside both sets of archives
        paths = shared.cut(write_archives(decided(pages, id_col, url_col, html_col, least_bytes), raw, when, archive_bytes), "paths")
    out = shared.cut(normalised(spread(paths), made), "archives")
    shared.remove(spark, raw)
    return out


def read_back(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records.  A
    response's length and digest are those of its payload; a revisit's come from the
    response that has its digest."""
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()))

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])

        rows = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for fields, payload in entries(path):
                    page, kind, digest = fields.get("X-Page-ID"), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                    rows.append((page and int(page), len(payload) if kind == "response" else None, digest, kind))
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    found = shared.cut(spread(archives.select("path")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string"), "records")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    revisits = salted.where("record_type = 'revisit'").drop("payload_bytes")
    firsts = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"))
    told = revisits.select("payload_digest", "salt").distinct().join(firsts, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = revisits.join(told, ["payload_digest", "salt"]).select(*columns)
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again)
