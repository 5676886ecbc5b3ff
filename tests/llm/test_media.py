import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

import pytest

from millrace.llm import media

MAGIC = media.automaton()


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x04JF\xff\xda\x00\x04\x01\x02data\xff\x00more\xff\xd0x\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0"


def pdf():
    return b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n0\n%%EOF"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def tiff():
    entries = [(256, 3, 1, 1), (257, 3, 1, 1), (273, 4, 1, 62), (279, 4, 1, 2)]
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0) + b"ab"


def mp4():
    box = lambda kind, data: struct.pack(">I4s", 8 + len(data), kind) + data
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", b"xxxx") + box(b"mdat", b"1234")


def ogg():
    return b"OggS\0" + bytes(21) + b"\x01\x05hello"


SAMPLES = {"image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "application/pdf": pdf(), "application/zip": zipped(), "application/gzip": gzip.compress(b"hello" * 99), "audio/wav": media.as_wave(b"12345678"), "video/mp4": mp4(), "image/tiff": tiff(), "audio/ogg": ogg()}


@pytest.mark.parametrize("kind", SAMPLES)
def test_whole_carved_and_broken(kind):
    data = SAMPLES[kind]
    assert media.sniff(data, MAGIC)[0] == kind
    whole, carved = media.sniff(b"some text " + data + b" and more", MAGIC)
    assert whole is None and carved == [(kind, 10, 10 + len(data))]
    whole, carved = media.sniff(data[: len(data) // 2], MAGIC)
    assert whole is None and not [c for c in carved if c[0] == kind]


def test_magic_numbers_alone_prove_nothing():
    text = b"BM and GIF89a and %PDF- and PK\x03\x04 and RIFF and OggS\0 and ftyp and II*\0 and \xff\xd8\xff and \x1f\x8b\x08 and fLaC"
    assert media.sniff(text, MAGIC) == (None, [])


def test_a_checksum_counts():
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken), MAGIC) == (None, [])


@pytest.mark.parametrize("text", ["", "x", "é" * 40, "a" * 64, "a" * 65, "日" * 1000])
def test_samples_come_back(text):
    data = text.encode()
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    stored = media.as_wave(payload)
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert media.samples(stored) == payload


def test_described(spark, docs):
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in media.described(docs).collect():
        data = (by_id[r["doc_id"]] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = media.as_wave(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(payload), len(stored))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["feature"].startswith("audio/wav;declared=text/plain;proved=true;")


def test_types_are_corrected(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg", "x"), (2, bytearray(b"text"), "text/plain", "x"), (3, None, "a/b", "x"), (4, bytearray(b"z" + gif()), "text/plain", "x")], "id int, body binary, declared string, type string")
    got = {r["id"]: r for r in media.sniffed(df, "body").collect()}
    assert [(got[i]["type"], got[i]["proved"]) for i in (1, 2, 3)] == [("image/png", True), ("text/plain", False), ("a/b", False)]
    assert [tuple(c) for c in got[4]["carved"]] == [("image/gif", 1, 1 + len(gif()))]


HOSTILE = {
    "pdf": lambda n: b"%PDF-1.4 " * (n // 9), "pdf whole": lambda n: b"%PDF-1.4 startxref obj %%EOF" * (n // 28), "zip": lambda n: b"PK\3\4" * (n // 4), "zip whole": lambda n: (b"PK\3\4PK\5\6" + bytes(18)) * (n // 26),
    "gzip names": lambda n: b"\x1f\x8b\x08\x08" * (n // 4), "gzip blocks": lambda n: (b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x00\x20\x00\xdf\xff") * (n // 15),
    "png": lambda n: (png()[:33] + struct.pack(">I4s", n - 100, b"IDAT")) * (n // 41), "gif": lambda n: (b"GIF89a" + bytes(7) + b"!\xf9" + b"\x14" * 6) * (n // 21), "bmp": lambda n: b"BM" * (n // 2),
    "jpeg": lambda n: b"\xff\xd8\xff\xe0\x00\x02" * (n // 6), "jpeg segments": lambda n: b"\xff\xd8\xff\xe0\x00\x06\xff\xd8\xff\xe0" * 50 + b"\xff\xe0\x00\x02" * (n // 4), "jpeg scans": lambda n: b"\xff\xd8\xff\xda\x00\x08\xff\xd8\xff\xda\x00\x02" * (n // 24) + b"\xff\x00" * (n // 4),
    "ogg": lambda n: ogg() * (n // 33) + b"OggS", "mp4": lambda n: b"\0\0\0\x08ftyp" * (n // 8), "flac": lambda n: (b"\0\0\0\x26fLaC\0\0\0\x22" + bytes(30)) * (n // 42),
    "riff": lambda n: (b"abcd\x0c\0\0\0RIFF" + struct.pack("<I", n // 2) + b"WAVE") * (n // 20), "tiff": lambda n: b"".join(b"II*\0" + struct.pack("<I", n - 8 * i) for i in range(n // 8)) + struct.pack("<H", 16000) + struct.pack("<HHII", 1, 1, 1, 0) * 16000,
}


@pytest.mark.parametrize("case", HOSTILE)
def test_time_follows_the_length(case):
    import time

    took = {}
    for n in (500_000, 2_000_000):
        value, began = HOSTILE[case](n), time.perf_counter()
        media.sniff(value, MAGIC)
        took[n] = time.perf_counter() - began
    assert took[2_000_000] <= 8 * took[500_000] + 1 and took[2_000_000] < 20


def test_checksums_of_parts():
    import random

    rnd = random.Random(2)
    value = media.Trailers(rnd.randbytes(200_000))
    for _ in range(200):
        a, b = sorted((rnd.randrange(len(value)), rnd.randrange(len(value) + 1)))
        assert value.crc(a, b) == zlib.crc32(value[a:b])


def test_media_after_hostile_bytes_are_found():
    for case, bad in HOSTILE.items():
        value = bad(20_000) + b"|" + png()
        assert ("image/png", len(value) - len(png()), len(value)) in media.sniff(value, MAGIC)[1] or case in ("flac", "mp4", "ogg"), case


def test_a_pdf_ends_before_the_next_one():
    value = pdf() + b"x" + pdf() + b" %PDF-1.7 without an end"
    n = len(pdf())
    assert media.sniff(value, MAGIC) == (None, [("application/pdf", 0, n), ("application/pdf", n + 1, 2 * n + 1)])
