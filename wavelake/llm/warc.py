"""Operator 4: WARC archives compressed by Zstandard, one frame per record, and their reader.

Writing.  Payloads are compared by SHA-256; of equal payloads of at least `LEAST_REVISIT` bytes the row
with the smallest page_id is a ``response`` record and the others ``revisit`` it.  Only digests that
repeat are joined: by broadcast while they are few, else payloads of at least the bound are shuffled
once, those of a digest with many rows over several tasks.  Each task streams its rows into archives
of bounded size.  An archive begins with a skippable frame that holds a dictionary trained on its own
first records (themselves compressed), then has one frame per record.

Reading.  Archives are dealt out, one to a task where there are as many tasks, and streamed: the reader
loads the dictionary from the leading skippable frame, finds each frame's end from its block headers,
decodes it alone, and validates the frame's checksum, the record's headers, lengths and digests.
Memory holds a chunk and a record.  Archives of other writers are read too: WARC 1.0 and 1.1, all types
of record, frames that do not tell their size, HTTP without Content-Length or in chunks.  Digests (MD5,
SHA-1, SHA-256, SHA-512; hex or base 32) are checked where they are given, a payload's against the body
with or without its chunks; lengths too, unless the record says that it was cut.  A payload stays in its
Content-Encoding.

Archives are files in the shared folder, opened through ``pyarrow.fs``; a task writes under a name of
its attempt and renames at the end, so a repeated task replaces its file as a whole.

Defined cases: null html is an empty payload; a null page_id is never referred to and always a
response; a null url leaves the target out; repeated rows with the smallest page_id are all
responses; payloads under the bound are responses even if equal; an empty table writes no archives
and reads no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_REVISIT = 100
#: Bytes of records that an archive's dictionary is trained on, of the dictionary, and of records in an archive.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 256 << 20
#: Repeated digests that are broadcast (about a hundred bytes each), and rows of one digest that a task takes.
FEW_DIGESTS, HOT_ROWS = 100_000, 10_000
CHUNK = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PROFILES = {f"http://netpreserve.org/warc/{v}/revisit/{p}" for v in ("1.0", "1.1") for p in ("identical-payload-digest", "server-not-modified")}
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
HTTP_TYPE = "application/http;msgtype=response"

RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"
#: Types of record that hold pages.
PAGES = ("response", "revisit")
_FIELD = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+)[ \t]*:(.*)", re.DOTALL)


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record.  A revisit keeps the response's HTTP head but not the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _id(page_id, digest), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]~")
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    head |= {"Content-Type": HTTP_TYPE, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _lines(head: bytes, strict: bool) -> dict[str, str]:
    """Fields of a header block by lower-case name, its first line left out; a line that begins with a blank goes on with the one before.

    A line that is no field raises if ``strict``, as in WARC headers; web servers send such lines, so in HTTP they are passed over.
    """
    out: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
            continue
        field = _FIELD.match(text)
        if field:
            name = field[1].lower()
            out[name] = field[2].strip()
        elif strict:
            raise ValueError(f"header line {line[:40]!r}")
    return out


def _agrees(given: str | None, data: bytes) -> bool:
    """Whether a digest ``algorithm:value``, hex or base 32, is that of the data; also where there is none, or of an unknown algorithm."""
    algorithm, colon, value = (given or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if not colon or algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = hashlib.new(algorithm, data).digest()
    return value.lower() == found.hex() or value.rstrip("=").upper() == base64.b32encode(found).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes:
    """The content of a body in HTTP chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk has no size")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as its size")
        out.append(body[at : at + n])
        at += n + 2


def _http(block: bytes, cut: bool) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields, body as it is, payload) of an HTTP message; lengths are checked unless it was ``cut``."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("HTTP headers have no end")
    start = block[:end].partition(b"\r\n")[0]
    if b"HTTP/" not in start:
        raise ValueError(f"begins with {start[:40]!r}")
    head, body = _lines(block[:end], False), block[end + 4 :]
    if "chunked" in head.get("transfer-encoding", "").lower() and body:
        return head, body, body if cut else _unchunked(body)
    return head, body, body


def decode_record(record: bytes) -> dict:
    """The fields of `RECORDS`; ValueError if a header, a length, or a digest that is given is wrong."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("headers have no end")
    if record[:10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        raise ValueError(f"begins with {record[:40]!r}")
    head = _lines(record[:end], True)
    block = record[end + 4 : -4]
    if record[-4:] != b"\r\n\r\n" or len(block) != int(head["content-length"]):
        raise ValueError(f"Content-Length {head['content-length']}, {len(block)} bytes found")
    if not _agrees(head.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    kind, given, cut = head["warc-type"], head.get("warc-payload-digest"), "warc-truncated" in head
    if kind not in TYPES:
        raise ValueError(f"record of type {kind}")
    http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    fields, body, payload = _http(block, cut) if http and block else ({}, block, block)
    length = fields.get("content-length")
    if kind == "revisit":
        if payload and http or head.get("warc-profile", PROFILE) not in PROFILES:
            raise ValueError("a revisit with a payload or an unknown profile")
        size, digest, payload = None if length is None else int(length), None if given is None else given.removeprefix("sha256:"), None
    else:
        if kind == "response" and length is not None and int(length) != len(body) and not cut:
            raise ValueError(f"payload of {len(body)} bytes, not {length}")
        if not _agrees(given, payload) and not _agrees(given, body):
            raise ValueError("payload digest differs")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return {
        "page_id": None if page is None else int(page), "url": head.get("warc-target-uri"), "payload": payload,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else int(refers),
        "record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to"),
    }


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the first 16 KB of some records, or None where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:16384] for r in records], k=512, d=8)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes one archive to a binary stream."""

    def __init__(self, out):
        self.out, self.waiting, self.bytes, self.records, self.zip = out, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.bytes += len(record)
        self.records += 1
        if self.zip:
            self.out.write(self.zip.compress(record))
            return
        self.waiting.append(record)
        if self.bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        dictionary = train(self.waiting)
        if dictionary:
            raw = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.out.write(self.zip.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.zip:
            self._begin()
        self.out.close()


def frame_length(data: bytes | memoryview, at: int) -> int | None:
    """Bytes of the frame at ``at`` by its block headers; None if its end lies beyond the data."""
    if len(data) - at < 8:
        return None
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
        return 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME:
        raise ValueError(f"no frame at {at}: {magic:#x}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    sizes = (single, 2, 4, 8)[flags >> 6]
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + sizes
    while True:
        if len(data) < end + 3:
            return None
        block = int.from_bytes(data[end : end + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError(f"reserved block type at {end}")
        end += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            return end + (4 if flags & 4 else 0) - at


def unzipped(unzip: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """The content of one whole frame, also of one that does not tell its size, as streaming compressors write."""
    if zstandard.frame_content_size(frame) >= 0:
        return unzip.decompress(frame)
    one = unzip.decompressobj()
    out = one.decompress(frame)
    if not one.eof:
        raise ValueError("the frame has no end")
    return out


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive, each decoded from a frame of its own."""
    data, at, place, unzip = b"", 0, 0, zstandard.ZstdDecompressor()
    while True:
        size = frame_length(data, at) if len(data) > at else None
        while size is None or len(data) - at < size:
            more = stream.read(CHUNK if size is None else max(CHUNK, size - len(data) + at))
            if not more:
                if len(data) > at:
                    raise ValueError(f"the archive ends inside the frame at byte {place}")
                return
            data, at = data[at:] + more, 0
            size = frame_length(data, at) if size is None else size
        frame = data[at : at + size]
        if struct.unpack_from("<I", frame)[0] == FRAME:
            try:
                yield decode_record(unzipped(unzip, frame))
            except (ValueError, KeyError, zstandard.ZstdError) as e:
                raise ValueError(f"record at byte {place}: {e}") from e
        elif place == 0 and struct.unpack_from("<I", frame)[0] == SKIPPABLE:
            held = bytes(frame[8:])
            if held[:4] == struct.pack("<I", FRAME):
                held = unzipped(zstandard.ZstdDecompressor(), held)
            unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        at, place = at + size, place + size


def with_revisits(pages: DataFrame, few: int = FEW_DIGESTS, hot: int = HOT_ROWS) -> DataFrame:
    """(page_id, url, payload, digest, refers_to).  At most ``few`` repeated digests are broadcast."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = common.materialize(first, "digests")
    refers = F.when(large & (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to")
    columns = ("page_id", "url", "payload", "digest")
    if first.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(first.drop("n")), "digest", "left").select(*columns, refers)
    # a digest of many rows has its own entry for each of several parts, which its rows are dealt to
    parts = common.broadcast_if_small(first.where(F.col("n") > hot).select("digest", F.ceil(F.col("n") / hot).alias("parts")))
    dealt = rows.where(large).join(parts, "digest", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))))
    each = first.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / hot) - 1)).alias("part"))
    return dealt.join(each, ["digest", "part"], "left").select(*columns, refers).unionByName(rows.where(~large).select(*columns, F.lit(None).cast("long").alias("refers_to")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as archives into ``folder``; returns their list (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        writer, names, part = None, [], 0

        def close() -> None:
            writer.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            names.append((f"{folder}/{name.rsplit('/', 1)[1]}", writer.records))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/pages-{task.partitionId():05d}-{part:03d}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None))
                    part += 1
                writer.add(encode_record(*(c[i].as_py() for c in columns)))
                if writer.bytes >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer:
            close()
        yield pa.record_batch({"path": pa.array([p for p, _ in names], pa.string()), "records": pa.array([n for _, n in names], pa.int64())})

    return common.materialize(with_revisits(pages).mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame, payloads: bool = True, types: Sequence[str] | None = PAGES) -> DataFrame:
    """Rows of `RECORDS` from the archives named in ``path``; raises where a record is not valid.

    Records of other types than ``types`` are checked and passed over; None returns all.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in RECORDS.split(", ")])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for record in read_archive(stream):
                        if types is not None and record["record_type"] not in types:
                            continue
                        if not payloads:
                            record["payload"] = None
                        rows.append(record)
                        held += len(record["payload"] or b"")
                        if len(rows) == 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema).select(names)

    # an archive is the unit of work: with a number, adaptive execution does not merge the tasks again
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page of ``pages``, read back from the archives written of them."""
    archives = write_archives(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
