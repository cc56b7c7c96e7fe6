"""WARC archives: writing, normalising whole-file gzip streams, indexed reading.

``write_archives`` writes one record per page, into files that are each one
gzip stream over all their records, as many crawlers and copy tools leave
them.  ``normalise`` is the operator: it inflates such a stream once, from
front to back, rewrites every record as a gzip member of its own, and writes
a sidecar index of offsets and lengths beside the new archive.  After that
``read_records`` fetches any record by its offset alone.

Equal payloads of at least ``least`` bytes are stored once: the page with the
largest id holds the response, the others are revisit records that name it.

Files are written by tasks through ``pyarrow.fs`` into a shared folder under
names that no other attempt uses.  The table of files and the index are Spark
tables, committed by Spark, so files of lost or repeated attempts are never
listed.  A stream is inflated piece by piece; memory holds one record.

Defined cases: a null html is an empty payload; null urls leave out the
target; pages with a null id never hold a response for others unless all
copies have null ids, then each is a response; rows that repeat the largest id
are all responses; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import run_folder, staged

LEAST_BYTES = 1000
#: Bytes of payload after which a task starts a new archive.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
GZIP = 31  # window bits that mean a gzip header and trailer
END = b"\r\n\r\n"

INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string"
RECORD_SCHEMA = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the holder's id for a revisit, else null)."""
    base = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least
    holders = (base.where(large).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
               .where("n > 1").select(F.col("digest").alias("shared"), "holder"))
    joined = base.join(holders, (F.col("digest") == F.col("shared")) & large, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def page_urn(page_id: object) -> str:
    return f"<urn:page:{quote(str(page_id), safe='')}>"


def from_urn(urn: str | None) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def format_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One uncompressed WARC record, with the two line ends that close it."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n")
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    if page_id is not None:
        head.append(f"WARC-Concurrent-To: {page_urn(page_id)}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def fields(head: bytes) -> dict[str, str]:
    """Header fields after the first line, names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and raw bytes of each record of an inflated stream."""
    buffer, start = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while True:
        while (at := buffer.find(END, start)) < 0:
            if not more():
                if buffer[start:].strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = fields(bytes(buffer[start:at]))
        end = at + len(END) + int(head["content-length"]) + len(END)
        while len(buffer) < end:
            if not more():
                raise ValueError("the archive ends inside a record")
        if buffer[end - len(END):end] != END:
            raise ValueError("a record is longer than it says")
        yield head, bytes(buffer[start:end])
        start = end
        if start >= READ_BYTES:
            del buffer[:start]
            start = 0


def inflate(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, piece by piece."""
    member = zlib.decompressobj(GZIP)
    while data := stream.read(READ_BYTES):
        while data:
            yield member.decompress(data, 4 * READ_BYTES)
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(GZIP)
            else:
                data = member.unconsumed_tail
    while tail := member.decompress(member.unconsumed_tail, 4 * READ_BYTES):
        yield tail


def _open_folder(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _open_file(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the planned records into whole-file gzip archives; (archive, records) as a table."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = zipper = name = None
        size = n = 0
        done = []

        def close() -> None:
            out.write(zipper.flush())
            out.close()
            done.append((name, n))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                record = format_record(*[c[i].as_py() for c in columns])
                if out is None:
                    system, path = _open_folder(folder)
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    name, out = f"{folder}/{file}", system.open_output_stream(f"{path}/{file}", compression=None)
                    zipper, size, n = zlib.compressobj(1, wbits=GZIP), 0, 0
                out.write(zipper.compress(record))
                size, n = size + len(record), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([d[0] for d in done], pa.string()),
                                          "records": pa.array([d[1] for d in done], pa.int64())})
    return staged(records.mapInArrow(run, "archive string, records long"), "archives", f"{folder}-tables")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each gzip file named in ``archives`` with a member per record and a sidecar index.

    Returns the index of all new archives.  The sidecar ``<archive>.idx`` has
    the same fields, tab-separated.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for source in batch.column("archive").to_pylist():
                system, path = _open_folder(folder)
                file = f"{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with _open_file(source) as stream, system.open_output_stream(f"{path}/{file}", compression=None) as out:
                    for head, record in split_records(inflate(stream)):
                        zipper = zlib.compressobj(level, wbits=GZIP)
                        member = zipper.compress(record) + zipper.flush()
                        out.write(member)
                        rows.append((f"{folder}/{file}", offset, len(member), head["warc-record-id"], head["warc-type"]))
                        offset += len(member)
                with system.open_output_stream(f"{path}/{file}.idx", compression=None) as out:
                    out.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [
                        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])],
                    ["archive", "offset", "length", "record_id", "record_type"])
    tasks = max(1, archives.count())
    spread = archives.select("archive").repartition(tasks, "archive")
    return staged(spread.mapInArrow(run, INDEX_SCHEMA), "index", f"{folder}-tables")


def parse_record(record: bytes) -> tuple:
    """A row of RECORD_SCHEMA; a response whose payload doesn't have its digest is an error."""
    head_end = record.index(END)
    head = fields(record[:head_end])
    http, _, payload = record[head_end + len(END):-len(END)].partition(END)
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(fields(http)["content-length"])
    if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    return (from_urn(head.get("warc-concurrent-to")), size, digest, head["warc-type"],
            from_urn(head.get("warc-refers-to")))


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` lists, each fetched and inflated by its offset and length."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        open_name = stream = None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
                if archive != open_name:
                    open_name, stream = archive, _open_file(archive)
                stream.seek(offset)
                rows.append(parse_record(zlib.decompress(stream.read(length), GZIP)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names)
    return index.select("archive", "offset", "length").mapInArrow(run, RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    folder: str | None = None) -> DataFrame:
    """Write, normalise, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or run_folder(pages.sparkSession, "warc")
    archives = write_archives(plan_records(pages, id_col, url_col, html_col), f"{folder}/whole")
    index = normalise(archives, f"{folder}/members")
    kind = pages.schema[id_col].dataType
    return read_records(index).withColumn("page_id", F.col("page_id").cast(kind)).withColumn(
        "refers_to", F.col("refers_to").cast(kind))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
h AS (SELECT payload_digest, max(page_id) AS holder FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM d LEFT JOIN h USING (payload_digest)
"""
