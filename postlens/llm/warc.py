"""WARC archives with a two-level capture index (operator 10).

Every task writes its pages into archives of its own: gzip members, one record
each, so a record can be read by its byte range.  Of pages with equal payloads
the one with the largest id is written as a response, the others as revisits
without a payload.

The index has two levels.  Its lines (reversed-host URL key, page id, file,
offset, length) are sorted and packed into compressed blocks; the directory has
one row per block: first key, last key, and where the block lies.  A lookup reads
the directory rows between its smallest and largest key, binary-searches them
and then the block's lines, and reads only the byte ranges it needs.

Archives and index lie in the shared folder and are read and written by path
through Arrow's file systems.  A task that is repeated writes new files; only
the rows of the attempt that succeeded name files, so what a lost attempt left
is never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import broadcast_if_bounded, materialize, scratch_path

BLOCK_LINES = 3_000
#: A task starts a new archive beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then port, path and query; lower-case host, no scheme."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "~" + _line(url)
    if not host:
        return "~" + _line(url)
    host = ",".join(reversed(host.split(".")))
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return _line(host + (f":{port}" if port else "") + ")" + tail)


def _line(text: str) -> str:
    """``text`` without control characters and blanks, which would break a line of the index or a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
        ]
    head.append(f"Content-Length: {len(body)}")
    data = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class Archive:
    """Where the archives, the index blocks and the directory of a collection lie."""

    folder: str

    @property
    def directory(self) -> str:
        return f"{self.folder}/directory"


def with_record_type(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null: a response) of each page.

    Equal payloads of at least ``least_bytes`` are revisits of the largest page
    id among them.  Rows that repeat that id too are the same capture and stay
    responses; so do equal payloads without any id.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    groups = materialize(
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
        .where("n > 1 AND target IS NOT NULL")
        .select("sha1", "target"),
        "warc-targets",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))
    return rows.join(broadcast_if_bounded(groups), "sha1", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Write a record per row and return the index lines: key, page (text), file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for page, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(f"{base}/archives", recursive=True)
                        name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    member = _record(kind, page, url, payload, sha1_base32(payload), refers_to)
                    out.write(member)
                    lines.append((url_key(url), "" if page is None else str(page), name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*lines)] if lines else [pa.array([], t) for t in (pa.string(),) * 3 + (pa.int64(),) * 2],
                    names=["key", "page", "file", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return typed.select("page_id", "url", "payload", "refers_to").mapInArrow(
        run, "key string, page string, file string, offset long, length long"
    )


def write_index(lines: DataFrame, archive: Archive, block_lines: int = BLOCK_LINES) -> None:
    """Sort the lines into compressed blocks and write their directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(archive.folder)
        out, name, at, block = None, "", 0, []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(" ".join(map(str, x)) for x in block).encode(), 6)
            out.write(data)
            row = pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (_sort_key(*block[0][:2]), _sort_key(*block[-1][:2]), name, at, len(data))],
                names=["first", "last", "file", "offset", "length"],
            )
            at += len(data)
            return row

        try:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if out is None:
                        fs.create_dir(f"{base}/index", recursive=True)
                        name = f"index/{uuid.uuid4().hex}.cdx.z"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    block.append(row)
                    if len(block) >= block_lines:
                        yield flush()
                        block = []
            if block:
                yield flush()
        finally:
            if out is not None:
                out.close()

    order = ["key", "page"]
    parts = lines.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = lines.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    placed.mapInArrow(run, "first string, last string, file string, offset long, length long").write.parquet(archive.directory)


def _sort_key(key: str, page: str) -> str:
    return f"{key} {page}"


def locate(wanted: DataFrame, archive: Archive) -> DataFrame:
    """file, offset, length of every capture of the ``wanted`` (url, page_id), through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset

        fs, base = _open(archive.folder)
        directory = pyarrow.dataset.dataset(f"{base}/directory", format="parquet", filesystem=fs, exclude_invalid_files=True)
        held, lines, keys = None, [], []
        for batch in batches:
            asked = [_sort_key(k, p) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if not asked:
                continue
            low, high = min(asked), max(asked)
            rows = directory.to_table(
                filter=(pyarrow.dataset.field("last") >= low) & (pyarrow.dataset.field("first") <= high)
            ).sort_by("first").to_pylist()
            lasts = [r["last"] for r in rows]
            found = []
            for key in asked:
                b = bisect.bisect_left(lasts, key)
                while b < len(rows) and rows[b]["first"] <= key:  # equal keys may go on into the next block
                    r = rows[b]
                    if held != (r["file"], r["offset"]):
                        with fs.open_input_file(f"{base}/{r['file']}") as file:
                            text = zlib.decompress(file.read_at(r["length"], r["offset"])).decode()
                        lines = [x.split(" ") for x in text.split("\n")]
                        keys = [_sort_key(*x[:2]) for x in lines]
                        held = (r["file"], r["offset"])
                    i = bisect.bisect_left(keys, key)
                    while i < len(keys) and keys[i] == key:
                        found.append((lines[i][2], int(lines[i][3]), int(lines[i][4])))
                        i += 1
                    b += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["file", "offset", "length"])

    def keyed(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for u in urls:
            yield pa.array([url_key(x) for x in u.to_pylist()], pa.string())

    keys = wanted.select(
        F.arrow_udf(keyed, "string")("url").alias("key"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page")
    ).distinct()
    parts = wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return (
        keys.repartitionByRange(int(parts), "key", "page")
        .sortWithinPartitions("key", "page")
        .mapInArrow(run, "file string, offset long, length long")
    )


def read_records(places: DataFrame, archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, digest (as noted), payload_bytes and payload_digest (of what is there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(archive.folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, fs.open_input_file(f"{base}/{path}")
                headers, payload = parse_record(file.read_at(length, offset))
                rows.append(
                    (
                        _page(headers["warc-record-id"]),
                        headers["warc-type"],
                        _page(headers.get("warc-refers-to")),
                        headers["warc-payload-digest"].removeprefix("sha1:"),
                        len(payload),
                        sha1_base32(payload),
                    )
                )
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["page_id", "record_type", "refers_to", "noted", "bytes", "digest"],
            )
        if file is not None:
            file.close()

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = F.floor(F.col("offset") / (4 << 20))  # stretches of an archive go to different tasks
    return (
        places.repartition(parts, "file", near)
        .sortWithinPartitions("file", "offset")
        .mapInArrow(run, "page_id long, record_type string, refers_to long, noted string, bytes long, digest string")
    )


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> Archive:
    """Write archives and index of ``pages`` (page_id, url, html) into a new folder of the shared one."""
    archive = Archive(folder or scratch_path(pages.sparkSession, "warc"))
    write_index(materialize(write_archives(with_record_type(pages, least_bytes), archive.folder), "warc-lines"), archive)
    return archive


def captures(wanted: DataFrame, archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the captures of ``wanted``.

    The payload of a revisit is that of the response it refers to, which is read
    from the archives as well.
    """
    found = materialize(read_records(materialize(locate(wanted, archive), "warc-places"), archive), "warc-records")
    own = found.where("record_type = 'response'").select(F.col("page_id").alias("target"), F.col("digest").alias("noted"), F.col("bytes").alias("full"))
    revisits = found.where("record_type = 'revisit'").withColumnRenamed("refers_to", "target")
    resolved = revisits.join(own.distinct(), ["target", "noted"], "left").select(
        "page_id", F.col("full").alias("payload_bytes"), F.col("noted").alias("payload_digest"), "record_type", F.col("target").alias("refers_to")
    )
    whole = found.where("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return whole.unionAll(resolved)


def lookup(spark: SparkSession, archive: Archive, url: str, page_id: int | None = None) -> DataFrame:
    """The captures of one page."""
    return captures(spark.createDataFrame([(url, page_id)], "url string, page_id long"), archive)
