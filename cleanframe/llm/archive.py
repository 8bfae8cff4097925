"""Web archives in ZIP packages: writing, and reading by ranges without extraction.

A package holds one gzip-per-record WARC member and its index, both stored uncompressed, so any
record can be read with one range read. The reader parses the end record, the ZIP64 end record
and the central directory itself, reads the index member, and turns it into one row per record;
a second step reads the records' ranges. Packages hold a bounded number of records each, so
memory stays bounded and the work is spread.

Defined results: a null html is an empty payload. Rows with an equal page id and payload are all
responses if that id is the smallest of its payload. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.schema import quoted
from cleanframe.session import scratch_path, ship_package, write_table

RECORDS_PER_PACKAGE = 2000
LEAST_REVISIT_BYTES = 100
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"


# --- Writing -----------------------------------------------------------------------------

def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_package(sink, records: list[tuple]) -> None:
    """A ZIP package of records, its index beside them."""
    index = io.StringIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(WARC_MEMBER, "w", force_zip64=True) as member:
            at = 0
            for record in records:
                packed = gzip.compress(record_bytes(*record), 6, mtime=0)
                index.write(f"{at} {len(packed)}\n")
                member.write(packed)
                at += len(packed)
        package.writestr(INDEX_MEMBER, index.getvalue())


def record_kinds(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """Pages with payload, digest, record kind and the response a revisit refers to."""
    base = pages.select(
        quoted(id_column).cast("long").alias("page_id"), quoted("url").cast("string").alias("url"),
        F.coalesce(quoted(html_column), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= LEAST_REVISIT_BYTES
    firsts = base.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written so that both sides of the join are shuffled and Spark can split a hot payload.
    firsts = write_table(firsts.where("n > 1").select("digest", "first"), "payloads")
    joined = base.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Write all pages as packages in the scratch folder; returns their paths.

    Names are unique per attempt and only finished attempts are listed, so a task that runs
    again leaves no second copy in the result.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "packages")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = arrow_fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        waiting: list[tuple] = []

        def flush() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.wacz"
            with filesystem.open_output_stream(f"{root}/{name}") as sink:
                write_package(sink, waiting)
            found = pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(waiting)]})
            waiting.clear()
            return found

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                page_id, url, payload, digest, kind, refers_to = (None if v is None or v is pd.NA or v != v else v for v in row)
                waiting.append((None if page_id is None else int(page_id), url, payload, digest, kind, None if refers_to is None else int(refers_to)))
                if len(waiting) >= RECORDS_PER_PACKAGE:
                    yield flush()
        if waiting:
            yield flush()

    # Ids travel as text: pandas has nullable longs as doubles, which are not exact above 2^53.
    kinds = record_kinds(pages, id_column, html_column).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return write_table(kinds.mapInPandas(write, "path string, records long"), "manifest")


# --- Reading -----------------------------------------------------------------------------

def central_directory(source, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP: name to (method, stored size, size, offset of the local header).

    ``source`` has ``read_at(n, offset)``. Sizes and offsets beyond 32 bits come from the ZIP64
    end record and extra fields.
    """
    tail_at = max(0, size - (65535 + 22 + 20))
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP package: no end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        count, length, start = struct.unpack_from("<QQQ", source.read_at(56, at), 32)
    directory = source.read_at(length, start)
    members, at = {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra, e = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            e += 4 + n
        members[name] = (method, stored, full, offset)
        at += 46 + n_name + n_extra + n_comment
    return members


def member_start(source, member: tuple[int, int, int, int]) -> int:
    """Offset of the bytes of a stored member."""
    method, _, _, offset = member
    if method != 0:
        raise ValueError("the member is compressed; only stored members can be read by range")
    head = source.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra


def package_index(source, size: int) -> list[tuple[int, int]]:
    """(offset in the file, length) of every record of a package."""
    members = central_directory(source, size)
    base = member_start(source, members[WARC_MEMBER])
    index = members[INDEX_MEMBER]
    lines = source.read_at(index[1], member_start(source, index)).decode().split("\n")
    return [(base + int(a), int(n)) for a, n in (line.split(" ") for line in lines if line)]


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and body of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the packages at ``path``: ``page_id``, ``url``, ``record_type``,
    ``refers_to``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest``."""
    ship_package(manifest.sparkSession)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                filesystem, local = arrow_fs.FileSystem.from_uri(path)
                with filesystem.open_input_file(local) as source:
                    found = package_index(source, source.size())
                yield pd.DataFrame({"path": path, "at": [a for a, _ in found], "n": [n for _, n in found], "part": [k // 250 for k in range(len(found))]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ranges in batch.sort_values(["path", "at"]).groupby("path"):
                filesystem, local = arrow_fs.FileSystem.from_uri(path)
                rows = []
                with filesystem.open_input_file(local) as source:
                    for at, n in zip(ranges["at"].tolist(), ranges["n"].tolist()):
                        fields, http, body = parse_record(gzip.decompress(source.read_at(n, at)))
                        kind = fields["WARC-Type"]
                        rows.append((
                            _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, _page(fields.get("WARC-Refers-To")),
                            body if kind == "response" else None, int(http["Content-Length"]),
                            fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        ))
                names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
                # As objects, then: the ids must not pass through doubles.
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out.assign(**{c: pd.array(out[c].tolist(), dtype="Int64") for c in ("page_id", "refers_to", "payload_bytes")})

    paths = manifest.select("path").repartition("path")
    found = paths.mapInPandas(locate, "path string, at long, n long, part int").repartition("path", "part")
    return found.mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def verified(records: DataFrame) -> DataFrame:
    """Fails where the payload read does not have the digest its record states."""
    good = F.col("payload").isNull() | (F.sha2("payload", 256) == F.col("payload_digest"))
    return records.withColumn("payload_digest", F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload does not match its digest"))))
