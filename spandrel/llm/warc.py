"""WARC archives in Zstandard frames, one frame per record, with a dictionary in a leading skippable frame.

Writing: the payloads' SHA-256 digests are grouped; of records with equal payloads of at least `least_bytes` bytes the one with
the largest page_id is a response and the others revisit it. Each task writes its records, ordered by page_id, as archives of
about `ARCHIVE_BYTES` into the shared folder; an archive gets its name from the task's partition and is moved into place when
it is whole, so that a task that runs again replaces its archives by the same ones. Reading: Spark reads the files; the
dictionary comes from the first frame, each further frame must hold one whole record, and versions, header fields, lengths
and digests are checked. A frame that fails gives a row with `error` in place of a record.

Defined results: a null html is an empty payload; a null url is written as `urn:spandrel:unknown`; a null page_id is kept as
null and never revisited unless all equal payloads have null ids; rows that repeat the page_id that is the response are responses
too; other columns are ignored; an empty table gives an empty result. An archive is held in memory whole by its task, a
record of any size being the one exception to `ARCHIVE_BYTES`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import new_path, qualified, salt, stored

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on so many payloads at most, and on so many characters of each.
DICTIONARY_SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 32_768, 32_768
SALTS = 64
DATE = "2024-01-01T00:00:00Z"
UNKNOWN = "urn:spandrel:unknown"
_STEP = 16_384


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:spandrel:page:{'' if page is None else page}>"


def _page(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:spandrel:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page: int | None, url: str | None, payload: bytes, revisits: bool, original: int | None) -> bytes:
    """A response with its payload, or a revisit of the original with the response's HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or UNKNOWN)
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", _id(page)), ("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    if revisits:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(original))]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of one record; raises ValueError where it breaks a rule."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"missing {sorted(missing)}")
    length = fields["content-length"]
    if not length.isascii() or not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1(block)}":
        raise ValueError("block digest differs")
    out = {"type": fields["warc-type"], "page": _page(fields["warc-record-id"]), "refers": None, "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "bytes": None, "url": fields.get("warc-target-uri")}
    if out["type"] not in ("response", "revisit"):
        return out
    http, found, payload = block.partition(b"\r\n\r\n")
    told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(told) != 1 or not told[0].isdigit():
        raise ValueError("bad HTTP header")
    out["bytes"] = int(told[0])
    if out["type"] == "revisit":
        if "warc-refers-to" not in fields or payload:
            raise ValueError("bad revisit")
        out["refers"] = _page(fields["warc-refers-to"])
    elif len(payload) != out["bytes"] or sha1(payload) != out["digest"]:
        raise ValueError("payload length or digest differs")
    return out | {"payload": payload}


def frames(data: bytes) -> Iterator[bytes | ValueError]:
    """Contents of the frames after the dictionary; an error ends the archive where its frames can't be followed."""
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            yield ValueError("dictionary frame is cut short")
            return
        raw = bytes(view[8 : 8 + size])
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == zstandard.FRAME_HEADER else raw)
        at = 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, parts = unpack.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(data):
                    raise ValueError("frame is cut short")
                step = view[at : at + _STEP]
                parts.append(frame.decompress(step))
                at += len(step) - (len(frame.unused_data) if frame.eof else 0)
        except (zstandard.ZstdError, ValueError) as e:
            yield ValueError(str(e))
            return
        yield b"".join(parts)


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
    lead = [struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary] if dictionary else []
    return b"".join([*lead, *(pack.compress(r) for r in records)])


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of the payloads; empty if they are too few."""
    some = pages.filter("length(html) > 0")
    ids = some.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(DICTIONARY_SAMPLE)  # ids alone are gathered
    rows = some.join(F.broadcast(ids.distinct()), "page_id").select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(DICTIONARY_SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["html"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) into the folder; their manifest (name, records, bytes)."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"__digest": F.sha2("html", 256), "__salt": salt(F.col("page_id"), SALTS)})
    cells = own.select("page_id", "__digest", "__salt").groupBy("__digest", "__salt").agg(F.max("page_id").alias("most"))
    groups = cells.groupBy("__digest").agg(F.max("most").alias("__original"), F.collect_list("__salt").alias("salts"))
    known = groups.select("__digest", F.explode("salts").alias("__salt"), "__original")
    revisits = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("__original"))
    told = own.join(known, ["__digest", "__salt"]).select("page_id", "url", "html", revisits.alias("revisits"), "__original")
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages))  # of a fixed size
    folder = qualified(spark, folder)
    target, root = arrow_fs.FileSystem.from_uri(folder)
    target.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = arrow_fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt, done = task.partitionId(), task.taskAttemptId(), 0
        held: list[bytes] = []

        def put() -> pa.RecordBatch:
            nonlocal done, held
            name, data = f"part-{part:06d}-{done:06d}.warc.zst", archive(held, dictionary.value)
            with files.open_output_stream(f"{place}/_{attempt}-{name}", compression=None) as out:
                out.write(data)
            files.move(f"{place}/_{attempt}-{name}", f"{place}/{name}")
            made = pa.RecordBatch.from_pydict({"name": [name], "records": [len(held)], "bytes": [len(data)]})
            done, held = done + 1, []
            return made

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(record(r["page_id"], r["url"], r["html"].encode(), r["revisits"], r["__original"]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    size = 0
        if held:
            yield put()

    return stored(told.sortWithinPartitions("page_id", "url", "html").mapInArrow(run, "name string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (of responses), error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]

    def row(x: bytes | ValueError) -> tuple:
        try:
            if isinstance(x, ValueError):
                raise x
            r = parse(x)
        except ValueError as e:
            return (None, None, None, None, None, None, None, str(e))
        return (r["page"], r["url"], r["type"], r["bytes"], r["digest"], r["refers"], r.get("payload") if r["type"] == "response" else None, None)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for x in frames(content.as_py()):
                    rows.append(row(x))
                    size += len(rows[-1][6] or b"")
                    if size > ARCHIVE_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows)))), schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows)))), schema=kinds)

    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages, written as archives in a new folder of the shared one and read back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder, least_bytes)
    return read_archives(spark, folder)
