"""WARC archives compressed with Zstandard, one frame per record, dictionary in front.

Writing: each task writes the records of its partition to archives of about
``ARCHIVE_BYTES``.  An archive begins with a skippable frame (magic 0x184D2A5D)
that holds its dictionary, itself compressed, trained on the archive's first
records (or taken from the archive before it where they are too few); every record follows as a frame of its own.  Of records with equal
payloads the one with the smallest page_id is a response, the others are revisits
that refer to it and have no payload.

Reading: archives come through Spark's binary file source, so they may lie in any
store it reads, or from a listing that names them.  The reader takes the dictionary from the leading frame, finds
each frame's end from its block headers, decodes it to the size that the frame
states and no further (one that states none as a stream, up to ``limit`` bytes),
and checks version line, header fields, Content-Length against the block, the closing
empty lines and, for responses, payload length and digest.  A record that fails a
check is returned with a reason and no values; it doesn't stop the others.

Archives carry the number of the attempt that wrote them, and a table in the
shared folder lists those of the attempts that counted; ``round_trip`` reads what
is listed, so archives of a task that ran twice, or broke off, are not read.
Which record is the response is decided on digests alone: minima per digest are
pre-aggregated, and rows get them back by a join that is salted in the measure of
the largest group.

Defined results: null html is an empty payload.  Rows that repeat a page_id with
an equal payload are written each; they are responses if their id is the
smallest.  A record of more than ``limit`` bytes (as many as a value in Spark can
hold, by default) is returned with the reason "too long".  Among equal payloads null ids count as larger than any other.  A null
url is written as the empty target.  Columns besides page_id, url and html are
not read; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import scratch, settled, table

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 8 << 10
SAMPLE_RECORDS = 96
LEVEL = 3
LEAST_BYTES = 0
#: Rows of a group of equal payloads for each of its salts.
SALT_ROWS = 50_000
#: Bytes of the largest record.
LIMIT = (1 << 31) - 1
#: Fixed values of the format.
_DICTIONARY_MAGIC = 0x184D2A5D
_FRAME_MAGIC = 0xFD2FB528
_ID = "urn:page:"
_STAMP = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Record(NamedTuple):
    page_id: str | None
    payload_bytes: int | None
    payload_digest: str | None
    record_type: str | None
    refers_to: str | None
    payload: bytes | None
    problem: str | None


# -- writing ---------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one record; refers_to is None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_STAMP}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on the first of the records; None where they are too few or too short."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records[:SAMPLE_RECORDS])
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], trained: zstandard.ZstdCompressionDict | None = None) -> bytes:
    """A whole archive, with the given dictionary or one of its own."""
    trained = trained or dictionary(records)
    out = []
    if trained is not None:
        stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out += [struct.pack("<II", _DICTIONARY_MAGIC, len(stored)), stored]
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([*out, *map(coder.compress, records)])


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, role struct(refers_to): null role values for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html"))
    slim = pages.select(F.coalesce("html", F.lit("")).alias("html"), "page_id").select(
        "page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").alias("size")
    )
    firsts = slim.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = settled(firsts, "firsts")
    salts = 1 + (firsts.agg(F.max("n")).first()[0] or 0) // SALT_ROWS
    spread = firsts.select("sha", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = rows.join(spread, ["sha", "size", "salt"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row to archives below ``path``; returns the table of (file, records, bytes) of each archive."""

    def run(batches):
        place = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        size = count = 0
        trained = None

        def flush():
            nonlocal held, size, count, trained
            trained = dictionary(held) or trained
            name = f"part-{place.partitionId():06d}-{place.taskAttemptId():08d}-{count:05d}.warc.zst"
            data = archive(held, trained)
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            done = (f"{path}/{name}", len(held), len(data))
            held, size, count = [], 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in done], ["file", "records", "bytes"])

        for batch in batches:
            for k in range(batch.num_rows):
                i, url, page, refers = (batch.column(c)[k].as_py() for c in range(4))
                payload = page.encode()
                held.append(record(i, url, payload, payload_digest(payload), refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return settled(_roles(pages, least).mapInArrow(run, "file string, records long, bytes long"), "archives")


# -- reading ---------------------------------------------------------------


def _frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its block headers."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if pos + 3 > len(data):
            raise ValueError("cut frame")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * params.has_checksum
    if pos > len(data):
        raise ValueError("cut frame")
    return pos


#: Stands for a frame that was not decoded because it is longer than allowed.
TOO_LONG = object()


def _decoded(decoder: zstandard.ZstdDecompressor, frame: bytes, limit: int):
    """The content of a frame, None if it is broken, TOO_LONG beyond the limit; never more than that is decoded."""
    size = zstandard.frame_content_size(frame)
    if size > limit:
        return TOO_LONG
    try:
        if size >= 0:
            return decoder.decompress(frame, max_output_size=size) if size else b""
        with decoder.stream_reader(frame) as stream:
            out = _read(stream, limit)
    except zstandard.ZstdError:
        return None
    return TOO_LONG if out is None else out


def _read(stream, limit: int) -> bytes | None:
    parts, size = [], 0
    while part := stream.read(1 << 20):
        size += len(part)
        if size > limit:
            return None
        parts.append(part)
    return b"".join(parts)


def frames(data: bytes, limit: int = LIMIT) -> Iterator:
    """The decoded frames of an archive in order; None for one that can't be decoded, and last where the rest can't be split; TOO_LONG beyond the limit."""
    at, dictionary = 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == _DICTIONARY_MAGIC:
            stored, at = data[8 : 8 + size], 8 + size
            if stored[:4] == struct.pack("<I", _FRAME_MAGIC):
                stored = _decoded(zstandard.ZstdDecompressor(), stored, 1 << 24)
                if not isinstance(stored, bytes):
                    yield None
                    return
            dictionary = zstandard.ZstdCompressionDict(stored)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 <= len(data):
            magic, size = struct.unpack_from("<II", data, at)
            if magic >> 4 == 0x184D2A5:  # other skippable frames hold no record
                at += 8 + size
                continue
        try:
            end = _frame_end(data, at)
        except (ValueError, zstandard.ZstdError):
            yield None
            return
        yield _decoded(decoder, data[at:end], limit)
        at = end


def parse(data) -> Record:
    """A record from the bytes of its frame, checked."""
    bad = lambda why: Record(None, None, None, None, None, None, why)
    if data is None:
        return bad("frame")
    if data is TOO_LONG:
        return bad("too long")
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", errors="replace").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return bad("version")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.strip() != name or not name:
            return bad("header")
        fields[name.lower()] = value.strip()
    if any(k not in fields for k in ("warc-type", "warc-record-id", "warc-date", "content-length")):
        return bad("missing field")
    if not fields["content-length"].isdecimal():
        return bad("length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        return bad("length")
    http, mark, payload = rest[:n].partition(b"\r\n\r\n")
    size = next((v.strip() for k, c, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]) if k.lower() == "content-length"), "")
    kind = fields["warc-type"]
    if not mark or not size.isdecimal() or kind not in ("response", "revisit"):
        return bad("block")
    named = fields["warc-record-id"][1:-1]
    refers = fields.get("warc-refers-to", "")[1:-1]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not named.startswith(_ID) or (kind == "revisit") != refers.startswith(_ID):
        return bad("identity")
    if kind == "response" and (len(payload) != int(size) or payload_digest(payload) != digest):
        return bad("payload")
    if kind == "revisit" and payload:
        return bad("payload")
    return Record(named[len(_ID) :] or None, int(size), digest, kind, refers[len(_ID) :] or None, payload if kind == "response" else None, None)


_FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem", "payload"]
_TYPES = {"payload_bytes": ("long", pa.int64()), "payload": ("binary", pa.binary())}


def _records(contents: DataFrame, load, payloads: bool, id_type: str, limit: int) -> DataFrame:
    """The records of archives, each a value that ``load`` makes bytes of."""
    fields = _FIELDS[: len(_FIELDS) - (not payloads)]

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array([getattr(r, f) for r in held], _TYPES.get(f, ("", pa.string()))[1]) for f in fields], fields)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held: list[Record] = []
                for data in frames(load(content.as_py()), limit):
                    held.append(parse(data))
                    if len(held) == 512:
                        yield pack(held)
                        held = []
                yield pack(held)

    out = contents.mapInArrow(run, ", ".join(f"{f} {_TYPES.get(f, ('string',))[0]}" for f in fields))
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def read_archives(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "bigint", limit: int = LIMIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem (and payload) of every record below ``path``."""
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return _records(stored, lambda content: content, payloads, id_type, limit)


def read_listed(listing: DataFrame, payloads: bool = False, id_type: str = "bigint", limit: int = LIMIT) -> DataFrame:
    """The same of the archives that a table names (file)."""

    def load(file: str) -> bytes:
        store, name = pyarrow.fs.FileSystem.from_uri(file)
        with store.open_input_stream(name, compression=None) as f:
            return f.read()

    return _records(listing.select("file"), load, payloads, id_type, limit)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The records of ``pages`` as they read back from archives in the shared folder."""
    written = write_archives(pages, scratch(pages.sparkSession, "warc"), least)
    spread = written.repartition(max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return read_listed(spread, id_type=pages.schema["page_id"].dataType.simpleString())


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("problem")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substring(sha, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM d
"""

QUERIES = {"op4_warc_zstd": op4_warc_zstd}
ORACLES = {"op4_warc_zstd": ORACLE}
