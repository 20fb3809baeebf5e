"""WARC archives inside ZIP packages: written by tasks, read back by byte ranges without extraction.

A package is a ZIP file with stored members: archives under ``archive/``, whose records are gzip members of their own,
and indexes under ``indexes/`` with archive, offset and length of every record. The writer makes one of each,
``archive/data.warc.gz`` and ``indexes/index.jsonl``. The reader fetches the end of the file, follows the ZIP64
locator where there is one, parses the central directory, finds where the stored members begin, reads all indexes
(JSON lines, also after a sort key as in CDXJ, plain or gzip), and then fetches runs of records of every archive by
range. A record that several indexes list is read once. Refused are compressed members, whose records have no place of
their own in the package, archives without an index line, and index lines that lead to no archive or past its end.

Packages live in any folder that Arrow's file systems can open on all executors (local shared paths, hdfs, s3,
gcs). A task writes under a name of its own, and only the packages that a finished task reported are read, so a
lost or repeated task leaves at most an unread file.

Defined results: a null payload is empty, a null url an empty target. Control characters of a url are percent-encoded.
Equal payloads of at least ``min_bytes`` bytes: the record with the largest page_id is the response, the others
revisit it; rows that repeat that very page_id are responses too, rows without an id revisit. If no row of
a group has an id, all are responses. An empty table writes no package. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrain.llm.common import load, only, query, settle, shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of archive after which a task begins a new package, and bytes of records read at once.
PACKAGE_BYTES, RANGE_BYTES = 128 << 20, 4 << 20
_DATE = "1970-01-01T00:00:00Z"
_CONTROL = {c: f"%{c:02X}" for c in [*range(33), 127]}

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# ---- ZIP directories ------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header_at: int
    stored_bytes: int


def _extra64(extra: bytes, wanted: list[int]) -> list[int]:
    """Fields that are all ones take their values from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(values) if w == 0xFFFFFFFF else w for w in wanted]
        at += 4 + n
    return wanted


def directory(file, size: int) -> list[Member]:
    """Members by the central directory of an open, seekable package of ``size`` bytes."""
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65_557)  # 22 bytes and the longest comment
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and (at := tail_at + end - 20) >= 0:
        mark, _, at64 = struct.unpack_from("<4sIQ", read(at, 20))
        if mark == b"PK\x06\x07":
            mark, count, length, start = struct.unpack("<4s28xQQQ", read(at64, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where the locator points")
    held, at, members = read(start, length), 0, []
    for _ in range(count):
        if held[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", held, at + 10)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", held, at + 20)
        header_at, = struct.unpack_from("<I", held, at + 42)
        name = held[at + 46 : at + 46 + names].decode("utf-8")
        extra = held[at + 46 + names : at + 46 + names + extras]
        plain, packed, header_at = _extra64(extra, [plain, packed, header_at])
        members.append(Member(name, method, header_at, packed))
        at += 46 + names + extras + comments
    return members


def stored_range(file, member: Member) -> tuple[int, int]:
    """First byte and length of a stored member's content."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; its records can't be read by range")
    file.seek(member.header_at)
    mark, names, extras = struct.unpack("<4s22xHH", file.read(30))
    if mark != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header_at + 30 + names + extras, member.stored_bytes


# ---- records --------------------------------------------------------------------------------------------------
def record_bytes(page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, which tells the payload's length, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {(url or '').translate(_CONTROL)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of RECORDS; a response's payload is measured and hashed again and must match its header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")

    def number(name: str):
        held = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(held) if held else None

    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": kind,
        "refers_to": number("WARC-Refers-To"), "payload_bytes": n_bytes, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


# ---- Spark jobs -----------------------------------------------------------------------------------------------
def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    file = system.open_input_file(inner)
    return file, file.size()


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, n_bytes and refers_to (null for responses).

    Only digests that come twice are joined back, so their table is small; ids are merged before the shuffle, and
    a digest that a third of the pages share is one row of it. Spark broadcasts it under its size threshold.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long"),
    })
    again = settle(
        pages.where(F.col("n_bytes") >= min_bytes).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last_id"))
        .where("n > 1").select("digest", "last_id"), "repeated-payloads"
    )
    joined = pages.join(again, "digest", "left")
    revisits = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("last_id"))).drop("last_id")


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write the records; returns a settled table of packages: path, n_records, n_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        row = next(rows, None)
        while row is not None:
            name = f"pages-{uuid.uuid4().hex}.zip"
            index, at = [], 0
            with system.open_output_stream(f"{inner}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                with package.open(ARCHIVE, "w", force_zip64=True) as archive:
                    while row is not None and at < PACKAGE_BYTES:
                        record = gzip.compress(record_bytes(
                            row["page_id"], row["url"], row["payload"], row["digest"], row["n_bytes"], row["refers_to"]
                        ), compresslevel=4, mtime=0)
                        archive.write(record)
                        index.append(json.dumps({"filename": ARCHIVE.removeprefix("archive/"), "offset": at, "length": len(record)}))
                        at += len(record)
                        row = next(rows, None)
                with package.open(INDEX, "w") as lines:
                    lines.write(("\n".join(index) + "\n").encode())
            yield pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "n_records": pa.array([len(index)], pa.int64()), "n_bytes": pa.array([at], pa.int64()),
            })

    spark = records.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return settle(records.mapInArrow(write, "path string, n_records long, n_bytes long"), "packages")


def entries_of(file, size: int) -> list[tuple[int, int]]:
    """Place in the package and length of every record, by all indexes of an open package, in order."""
    members = [m for m in directory(file, size) if not m.name.endswith("/")]
    archives = {m.name: stored_range(file, m) for m in members if m.name.startswith("archive/")}
    found = set()
    for index in members:
        # an .idx only leads into a compressed index beside it
        if not index.name.startswith("indexes/") or index.name.endswith(".idx"):
            continue
        at, n = stored_range(file, index)
        file.seek(at)
        held = file.read(n)
        for line in (gzip.decompress(held) if held[:2] == b"\x1f\x8b" else held).splitlines():
            if b"{" not in line:
                if line.strip() and not line.startswith(b"!"):
                    raise ValueError(f"{index.name} has a line without a JSON object")
                continue
            entry = json.loads(line[line.index(b"{") :])
            name = entry.get("filename")
            if name is None and len(archives) == 1:
                name = next(iter(archives))
            named = name if name in archives else f"archive/{name}"
            if named not in archives:
                raise ValueError(f"{index.name} leads to the archive {name}, which the package lacks")
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset < 0 or length <= 0 or offset + length > archives[named][1]:
                raise ValueError(f"{index.name} leads past the end of {named}")
            found.add((named, offset, length))
    unread = sorted(a for a, (_, n) in archives.items() if n and a not in {f[0] for f in found})
    if unread:
        raise ValueError(f"no index of {', '.join(unread)}")
    return sorted((archives[a][0] + offset, length) for a, offset, length in found)


def locate(packages: DataFrame) -> DataFrame:
    """Runs of whole records of about RANGE_BYTES: path, start, lengths. Reads directories and indexes only."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file, size = _open(path)
                with file:
                    entries = entries_of(file, size)
                runs, room, end = [], 0, None
                for at, n in entries:
                    if at != end or room < n:
                        runs.append((at, []))
                        room = RANGE_BYTES
                    runs[-1][1].append(n)
                    room -= n
                    end = at + n
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(runs), "start": pa.array([r[0] for r in runs], pa.int64()),
                    "lengths": pa.array([r[1] for r in runs], pa.list_(pa.int64())),
                })

    return packages.select("path").mapInArrow(find, "path string, start long, lengths array<long>")


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages with the columns of RECORDS. Runs are dealt out anew, so a large package is read by many tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for run in batch.to_pylist():
                file, _ = _open(run["path"])
                with file:
                    file.seek(run["start"])
                    held = file.read(sum(run["lengths"]))
                out, at = [], 0
                for n in run["lengths"]:
                    out.append(parse_record(gzip.decompress(held[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    parallel = max(packages.sparkSession.sparkContext.defaultParallelism, 1)
    return locate(packages).repartition(4 * parallel).mapInArrow(read, RECORDS)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS last_id FROM p WHERE strlen(html) >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, cast(strlen(p.html) AS bigint) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


@query("op9_warc_packages", SQL)
def op9_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(load(spark, sf_dir, "pages"), "page_id", "url", "html")
    packages = write_packages(with_revisits(pages, 1000), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
