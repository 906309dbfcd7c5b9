"""Archives: round trip, damage and the revisit rule."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F
from wavelake.llm import common, warc


def archive(rows):
    out = io.BytesIO()
    out.close, close = (lambda: None), out.close
    w = warc.ArchiveWriter(out)
    for page, url, payload, refers in rows:
        w.add(warc.encode_record(page, url, payload, hashlib.sha256(payload).hexdigest(), refers))
    w.close()
    return out.getvalue()


ROWS = [(i, f"http://x/{i}?ü {i}", (f"<html><body>page {i} " + f"word{i} " * (i % 50) + "</body></html>").encode(), None) for i in range(400)]


def test_round_trip_with_dictionary():
    data = archive([*ROWS, (400, None, ROWS[3][2], 3), (None, "u\r\nv", b"\r\n\r\n", None)])
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
    back = list(warc.read_archive(io.BytesIO(data)))
    assert [(r["page_id"], r["payload"]) for r in back[:400]] == [(p, b) for p, _, b, _ in ROWS]
    assert back[400]["record_type"] == "revisit" and back[400]["refers_to"] == 3 and back[400]["payload_bytes"] == len(ROWS[3][2])
    assert back[401]["payload"] == b"\r\n\r\n" and back[401]["page_id"] is None


def test_frames_are_single_records():
    data = archive(ROWS[:40])
    at, frames = 0, 0
    while at < len(data):
        size = warc.frame_length(data, at)
        frames += data[at : at + 4] == struct.pack("<I", warc.FRAME)
        at += size
    assert at == len(data) and frames == 40


def test_without_dictionary():
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(archive(ROWS[:1])))] == [ROWS[0][2]]


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert len(list(warc.read_archive(io.BytesIO(archive(ROWS[:30]))))) == 30


@pytest.mark.parametrize("damage", ["cut", "flip", "junk"])
def test_damage_is_found(damage):
    data = archive(ROWS)
    data = {"cut": data[:-5], "flip": data[:-30] + bytes([data[-30] ^ 1]) + data[-29:], "junk": data + b"not a frame"}[damage]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data)))


@pytest.mark.parametrize("old,new", [(b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9.9"), (b"word", b"wort"), (b"WARC-Type: response", b"WARC-Type: responds")])
def test_wrong_records_are_found(old, new):
    record = warc.encode_record(1, "u", b"word" * 9, hashlib.sha256(b"word" * 9).hexdigest(), None)
    assert warc.decode_record(record)["payload"] == b"word" * 9
    with pytest.raises(ValueError):
        warc.decode_record(record.replace(old, new, 1))


def test_table_rules(spark):
    long, short = "é" * 50, "é" * 49
    rows = [(5, "a", long, 1), (2, "b", long, 1), (2, "b", long, 1), (9, None, long, 1), (None, "n", long, 1), (7, "s", short, 1), (8, "s", short, 1), (10, "", None, 1), (11, "x", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    back = warc.read_archives(warc.write_archives(pages, common.scratch(spark, "warc"))).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in back), key=str)
    assert got == sorted([(5, 100, "revisit", 2), (2, 100, "response", None), (2, 100, "response", None), (9, 100, "revisit", 2), (None, 100, "response", None), (7, 98, "response", None), (8, 98, "response", None), (10, 0, "response", None), (11, 0, "response", None)], key=str)
    assert all(r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() for r in back for p, _, h, _ in rows if p == r.page_id)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, common.scratch(spark, "warc"))).count() == 0


@pytest.mark.parametrize("few,hot", [(100, 100), (0, 100), (0, 3)])
def test_repeated_payloads_by_every_join(spark, few, hot):
    rows = [(i, f"u{i}", f"{'x' * 120}{i % 3 if i % 2 else 9}", 1) for i in range(60)] + [(100 + i, None, "short", 1) for i in range(20)] + [(200 + i, "v", f"{i}" * 150, 1) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(4)
    least = {}
    for page, _, html, _ in rows:
        if len(html) >= 100:
            least[html] = min(page, least.get(html, page))
    got = sorted((r.page_id, r.url, bytes(r.payload).decode(), r.refers_to) for r in warc.with_revisits(pages, few, hot).collect())
    assert got == sorted(((p, u, h, least[h] if p > least.get(h, p) else None) for p, u, h, _ in rows), key=lambda r: r[0])


def test_archives_are_read_by_a_task_each(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("text "), 50).alias("html")).repartition(4)
    archives = warc.write_archives(pages, common.scratch(spark, "warc"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and archives.count() == 4
    back = warc.read_archives(archives)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 40


def record(kind, block=b"", version="WARC/1.0", **fields):
    """A record as other writers make them: no blank after colons, no digests."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": str(len(block))}
    return "".join([version, "\r\n", *(f"{k}:{v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"
BODY = b"<html>caf\xc3\xa9 and some more words</html>"


def streamed(records, dictionary=None, told=False):
    """An archive whose frames do not tell their sizes."""
    out = io.BytesIO()
    if dictionary:
        raw = dictionary.as_bytes()
        if not told:
            z = zstandard.ZstdCompressor().compressobj()
            raw = z.compress(dictionary.as_bytes()) + z.flush()
        out.write(struct.pack("<II", 0x184D2A5D, len(raw)) + raw)
    for r in records:
        z = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False).compressobj()
        out.write(z.compress(r[: len(r) // 2]) + z.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) + z.compress(r[len(r) // 2 :]) + z.flush())
    return out.getvalue()


def foreign():
    sha1 = base64.b32encode(hashlib.sha1(BODY).digest()).decode()
    chunked = b"5;x=y\r\n" + BODY[:5] + b"\r\n" + f"{len(BODY) - 5:X}\r\n".encode() + BODY[5:] + b"\r\n0\r\nTrailer: 1\r\n\r\n"
    return [
        record("warcinfo", b"software:x\r\n", Content_Type="application/warc-fields", WARC_Filename="a.warc"),
        record("request", b"GET / HTTP/1.1\r\nHost:x\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("response", b"HTTP/1.1 200 OK\r\nServer:x\r\n folded\r\n\r\n" + BODY, Content_Type=HTTP, WARC_Target_URI="http://x/1", WARC_Payload_Digest=f"sha1:{sha1}"),
        record("response", b"HTTP/1.1 200\r\nTransfer-Encoding:chunked\r\n\r\n" + chunked, "WARC/1.1", Content_Type=HTTP, WARC_Payload_Digest=f"SHA-256:{hashlib.sha256(BODY).hexdigest()}"),
        record("response", b"HTTP/1.0 200 OK\r\n\r\n", Content_Type=HTTP),
        record("response", b"HTTP/1.0 200 OK\r\nContent-Length:900\r\n\r\n" + BODY, Content_Type=HTTP, WARC_Truncated="length"),
        record("response", b"192.0.2.1", Content_Type="text/dns"),
        record("resource", BODY, Content_Type="text/html"),
        record("metadata", b"a: b\r\n"),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", Content_Type=HTTP, WARC_Profile="http://netpreserve.org/warc/1.0/revisit/server-not-modified", WARC_Refers_To="<urn:uuid:0>"),
        record("revisit", b"", WARC_Payload_Digest=f"sha1:{sha1}"),
    ]


@pytest.mark.parametrize("told", [True, False])
def test_archives_of_other_writers(told, monkeypatch):
    dictionary = zstandard.train_dictionary(4096, [r for r in foreign() for _ in range(40)], k=64, d=8)
    monkeypatch.setattr(warc, "CHUNK", 50)
    for held in (dictionary, None):
        back = list(warc.read_archive(io.BytesIO(streamed(foreign(), held, told))))
        assert [r["record_type"] for r in back] == ["warcinfo", "request", *["response"] * 5, "resource", "metadata", "revisit", "revisit"]
        assert [r["payload"] for r in back[2:8]] == [BODY, BODY, b"", BODY, b"192.0.2.1", BODY]
        assert all(r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest() for r in back[:9]) and back[9]["refers_to_id"] == "<urn:uuid:0>"
        assert back[2]["url"] == "http://x/1" and {r["page_id"] for r in back} == {None} and back[10]["payload_bytes"] is None


def test_other_types_are_passed_over(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(streamed(foreign()))
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string")
    assert [r.record_type for r in warc.read_archives(paths).collect()] == ["response"] * 5 + ["revisit"] * 2
    assert warc.read_archives(paths, types=None).count() == 11 and warc.read_archives(paths, types=["resource"]).collect()[0].payload == BODY


def bad():
    ok = b"HTTP/1.1 200 OK\r\nContent-Length:%d\r\n\r\n"
    return {
        "length": record("response", ok % 3 + BODY, Content_Type=HTTP),
        "payload digest": record("response", ok % len(BODY) + BODY, Content_Type=HTTP, WARC_Payload_Digest="sha1:" + "A" * 32),
        "block digest": record("resource", BODY, WARC_Block_Digest="md5:" + "0" * 32),
        "chunk size": record("response", b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nabc", Content_Type=HTTP),
        "chunk length": record("response", b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n", Content_Type=HTTP),
        "no http": record("response", BODY, Content_Type=HTTP),
        "type": record("unheard-of", BODY),
        "profile": record("revisit", b"", WARC_Profile="http://x/"),
        "cut": record("resource", BODY)[:-1],
        "no end": record("resource", BODY).replace(b"\r\n\r\n", b"\r\n"),
        "no colon": record("resource", BODY).replace(b"WARC-Record-ID:", b"WARC-Record-ID"),
    }


@pytest.mark.parametrize("kind", sorted(bad()))
def test_damage_in_archives_of_other_writers(kind):
    with pytest.raises((ValueError, KeyError)):
        warc.decode_record(bad()[kind])
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(streamed([bad()[kind]]))))


def test_frame_without_size_must_end():
    data = streamed(foreign()[:1])
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
