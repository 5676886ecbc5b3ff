"""Media columns: what a binary value really is, and what lies inside it.

One Aho-Corasick automaton finds every magic number in one pass; a validator for each format then
walks the structure from there (chunks, lengths, checksums) and says where the medium ends, or that
there is none. A medium from the value's first byte to its last gives its type, whatever was declared;
others are carved.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: The unit of the payload, and the sampling rate that is written for it.
BLOCK, RATE = 64, 8000
#: Bytes between two kept checksums; how often a value's bytes may be looked at in vain, where places cannot be remembered.
STEP, LOOKS = 4096, 64
CARVED = "array<struct<type: string, start: bigint, end: bigint>>"


def png(b: Trailers, at: int) -> int:
    """Each validator takes a value and the place of its magic number, and returns the end of the medium, 0 if it is none.

    What a walk finds does not depend on where it began, so it is remembered by place; all walks of a value
    together take time in proportion to its length.
    """

    def step(pos: int) -> tuple[int, int]:
        if pos + 12 > len(b):
            return 0, 0
        size, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or b.crc(pos + 4, end - 4) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0, 0
        return (0, end) if kind == b"IEND" else (end, 0)

    first = b[at + 8 : at + 16] == b"\0\0\0\x0dIHDR"
    return b.walk("png", at + 8, step)[0] if first else 0


def jpeg(b: Trailers, at: int) -> int:
    def step(pos: int) -> tuple[int, int, bool]:
        """The next segment, or the end, and whether a scan has begun here."""
        if b[pos : pos + 1] != b"\xff" or pos + 2 > len(b):
            return 0, 0, False
        kind = b[pos + 1]
        if kind == 0xD9:
            return 0, pos + 2, False
        if pos + 4 > len(b) or kind in (0x00, 0xD8) or 0xD0 <= kind <= 0xD7:
            return 0, 0, False
        size = struct.unpack_from(">H", b, pos + 2)[0]
        pos += 2 + size
        if kind == 0xDA and size >= 2:  # compressed data, up to a marker that is no stuffing or restart
            pos = b.after(rb"\xff(?=[^\x00\xd0-\xd7])", pos, pattern=True)
        return (pos, 0, kind == 0xDA) if 2 <= size and pos < len(b) else (0, 0, False)

    end, scans = b.walk("jpeg", at + 2, step)
    return end if scans else 0


def gif(b: Trailers, at: int) -> int:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0

    def block(p: int) -> tuple[int, int]:
        if p >= len(b):
            return 0, 0
        return (p + 1 + b[p], 0) if b[p] else (0, p + 1)

    def step(pos: int) -> tuple[int, int]:
        if pos >= len(b):
            return 0, 0
        if b[pos] == 0x3B:
            return 0, pos + 1
        if b[pos] == 0x21:
            return b.walk("gif blocks", pos + 2, block)[0], 0
        if b[pos] == 0x2C and pos + 10 <= len(b):
            return b.walk("gif blocks", pos + 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0), block)[0], 0
        return 0, 0

    return b.walk("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), step)[0]


def bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and spare == 0
    return at + size if good and 14 + header <= start <= size <= len(b) - at else 0


def riff(b: Trailers, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end, kind, first = at + 8 + struct.unpack_from("<I", b, at + 4)[0], b[at + 8 : at + 12], at + 12
    if kind not in FORMS or not first + 8 <= end <= len(b):
        return 0
    chunks = b.chunks(at % 2)
    last = chunks.until(first, end)
    if last not in (end, end + 1):
        return 0
    if kind == b"WEBP":
        return end if b[first : first + 4] in (b"VP8 ", b"VP8L", b"VP8X") else 0
    return end if all(chunks.between(name, first, last) for name in ((b"fmt ", b"data") if kind == b"WAVE" else (b"LIST",))) else 0


class Chunks:
    """The chunks of a value at even or odd distance from its start: where a chain of them stands when it reaches an end, and what it has passed.

    Chains join, so they form a tree; each place keeps a link to its next one and a longer link (as in a
    skip list), by which an end is found in logarithmic time.
    """

    COUNTED = (b"fmt ", b"data", b"LIST")

    def __init__(self, b: bytes, parity: int):
        self.b, self.parity = b, parity
        self.nodes: dict[int, tuple] = {}  # place -> next place, far place, distance to the root, counts of names up to it

    def build(self, pos: int) -> None:
        path, b = [], self.b
        while pos not in self.nodes and pos + 8 <= len(b):
            path.append(pos)
            pos += 8 + struct.unpack_from("<I", b, pos + 4)[0]
            pos += (pos - self.parity) % 2
        if pos not in self.nodes:
            self.nodes[pos] = (pos, pos, 0, (0,) * len(self.COUNTED))
        for place in reversed(path):
            _, far, depth, counts = self.nodes[pos]
            _, farther, far_depth, _ = self.nodes[far]
            jump = farther if depth - far_depth == far_depth - self.nodes[farther][2] else pos
            self.nodes[place] = (pos, jump, depth + 1, tuple(n + (b[place : place + 4] == name) for n, name in zip(counts, self.COUNTED, strict=True)))
            pos = place

    def until(self, pos: int, end: int) -> int:
        """The first place of the chain from pos of which no whole chunk header lies before the end."""
        if pos not in self.nodes:
            self.build(pos)
        while pos + 8 <= end:
            following, far, depth, _ = self.nodes[pos]
            if not depth:
                break
            pos = far if far + 8 <= end else following
        return pos

    def between(self, name: bytes, pos: int, last: int) -> bool:
        i = self.COUNTED.index(name)
        return self.nodes[pos][3][i] > self.nodes[last][3][i]


class Trailers(bytes):
    """A value that remembers what has been found in it, so that each thing is looked for once, however many magic numbers ask."""

    def remembered(self, name, make):
        known = self.__dict__.setdefault("known", {})
        if name not in known:
            known[name] = make()
        return known[name]

    def places(self, word: bytes, pattern: bool = False) -> list[int]:
        """All places of the word, or matches of the pattern, ascending."""
        return self.remembered(("places", word), lambda: [m.start() for m in re.finditer(word if pattern else re.escape(word), self, re.DOTALL)])

    def after(self, word: bytes, at: int, pattern: bool = False) -> int:
        """The first place of the word from ``at`` on, the length of the value if there is none."""
        places = self.places(word, pattern)
        i = bisect_left(places, at)
        return places[i] if i < len(places) else len(self)

    def walk(self, kind: str, pos: int, step: Callable[[int], tuple]) -> tuple[int, bool]:
        """(end, seen) of the chain from pos. step: place -> next place, else 0 and the end, and optionally whether to be seen from here."""
        known, path = self.remembered(("walk", kind), dict), []
        while pos not in known:
            following, end, *seen = step(pos)
            path.append((pos, bool(seen and seen[0])))
            if not following:
                known[pos] = (end, path.pop()[1])
                break
            pos = following
        end, seen = known[pos]
        for place, own in reversed(path):
            seen = seen or own
            known[place] = (end, seen)
        return end, seen

    def crc(self, start: int, end: int) -> int:
        """crc32 of a part: long parts from the checksums of what lies before their two ends, which are kept for each STEP bytes."""
        if end - start <= 4 * STEP:
            return zlib.crc32(self[start:end])

        def sums():
            out = [0]
            for at in range(0, len(self), STEP):
                out.append(zlib.crc32(self[at : at + STEP], out[-1]))
            return out

        kept = self.remembered("crc", sums)
        upto = lambda at: zlib.crc32(self[at - at % STEP : at], kept[at // STEP])
        return upto(end) ^ shifted(upto(start), end - start)

    def chunks(self, parity: int) -> Chunks:
        return self.remembered(("chunks", parity), lambda: Chunks(self, parity))

    def spend(self, kind: str, n: int) -> bool:
        """Whether n more bytes may be looked at in vain for media of this kind: LOOKS times the value's length in all."""
        spent = self.__dict__.setdefault("known", {})
        spent[kind] = spent.get(kind, 0) + n
        return spent[kind] <= LOOKS * (len(self) + STEP)

    def directories(self) -> dict[int, int]:
        """Of zip files: the ends by the starts that their directories' ends imply."""

        def found():
            ends: dict[int, int] = {}
            for pos in self.places(b"PK\x05\x06"):
                if pos + 22 > len(self):
                    break
                entries, size, start, note = struct.unpack_from("<HIIH", self, pos + 10)
                at = pos - size - start
                if entries and at >= 0 and self[at + start : at + start + 4] == b"PK\x01\x02" and pos + 22 + note <= len(self):
                    ends.setdefault(at, pos + 22 + note)
            return ends

        return self.remembered("zip", found)


@lru_cache(maxsize=1)
def zeros() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes make of each bit of a checksum."""
    one = [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)]
    out = [one]
    for _ in range(40):
        out.append([applied(out[-1], x) for x in out[-1]])
    return out


def applied(bits: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= bits[low.bit_length() - 1]
        value ^= low
    return out


def shifted(crc: int, n: int) -> int:
    """The part that a checksum has in that of the same bytes and n more."""
    i = 0
    while n:
        if n & 1:
            crc = applied(zeros()[i], crc)
        n, i = n >> 1, i + 1
    return crc


def pdf(b: Trailers, at: int) -> int:
    following = b.after(b"%PDF-", at + 5)
    ends = b.places(b"%%EOF")
    first = b.after(b"%%EOF", at)
    if first == len(b) or b[at + 5 : at + 7] not in (b"1.", b"2.") or b.after(b"startxref", at) > first or b.after(b" obj", at) > first:
        return 0
    last = ends[bisect_left(ends, following) - 1] if first < following else -1
    return last + 5 if last >= at else 0


def zipped(b: Trailers, at: int) -> int:
    return b.directories().get(at, 0)


def gzip(b: Trailers, at: int) -> int:
    chunk = 4096
    if at + 18 > len(b) or b[at + 3] & 0xE0 or not b.spend("gzip", 0):
        return 0
    pos = at + 10
    if b[at + 3] & 4:
        pos += 2 + int.from_bytes(b[pos : pos + 2], "little")
    for flag in (8, 16):  # a name and a comment end with a zero
        if b[at + 3] & flag:
            pos = b.after(b"\0", pos) + 1
    if pos >= len(b):
        return 0
    inflate, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not inflate.eof:  # in steps, so that a bomb takes no memory
            part = b[pos : pos + chunk]
            inflate.decompress(part, 1 << 20)
            while inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            pos, chunk = pos + len(part), min(65536, 2 * chunk)
    except zlib.error:
        b.spend("gzip", pos + chunk - at)
        return 0
    if not inflate.eof:
        b.spend("gzip", len(b) - at)
    return pos - len(inflate.unused_data) if inflate.eof else 0


def ogg(b: Trailers, at: int) -> int:
    def step(pos: int) -> tuple[int, int]:
        """Up to where whole pages follow; a page that is none ends the medium before it."""
        if b[pos : pos + 5] != b"OggS\0" or pos + 27 > len(b):
            return 0, pos
        end = pos + 27 + b[pos + 26] + sum(b[pos + 27 : pos + 27 + b[pos + 26]])
        return (end, 0) if end <= len(b) else (0, pos)

    end = b.walk("ogg", at, step)[0]
    return end if end > at else 0


def flac(b: Trailers, at: int) -> int:
    if b[at + 4 : at + 5] not in (b"\x00", b"\x80") or b[at + 5 : at + 8] != b"\0\0\x22":
        return 0

    def step(pos: int) -> tuple[int, int]:
        if pos + 4 > len(b):
            return 0, 0
        end = pos + 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
        if b[pos] < 0x80:
            return end, 0
        return 0, len(b) if end + 2 <= len(b) and b[end] == 0xFF and b[end + 1] & 0xFC == 0xF8 else 0

    return b.walk("flac", at + 4, step)[0]


def mp4(b: Trailers, at: int) -> int:
    def step(pos: int) -> tuple[int, int, bool]:
        """Up to where whole boxes follow, and whether this one is moov; what is no box ends the medium before it."""
        if pos + 8 > len(b):
            return 0, pos, False
        size, kind = struct.unpack_from(">I4s", b, pos)
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
        if size < 8 or pos + size > len(b) or not kind.isalnum():
            return 0, pos, False
        return pos + size, 0, kind == b"moov"

    if at < 4:
        return 0
    end, moov = b.walk("mp4", at - 4, step)
    return end if moov and end > at else 0


def tiff(b: Trailers, at: int) -> int:
    """Directories and strip lists may overlap in a hostile value; once LOOKS times its bytes have been looked at in vain, no more are found in it."""
    order = "<" if b[at] == 0x49 else ">"
    if at + 8 > len(b):
        return 0
    start, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], at + 8, set()
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8, 11: 4, 12: 8}
    while start and start not in seen:
        seen.add(start)
        if at + start + 2 > len(b) or start < 8:
            return 0
        n = struct.unpack_from(order + "H", b, at + start)[0]
        close = at + start + 2 + 12 * n
        if not n or close + 4 > len(b) or not b.spend("tiff", 2):
            return 0
        strips: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", b, at + start + 2 + 12 * i)
            size = width.get(kind, 0) * count
            if not size or (size > 4 and at + value + size > len(b)) or not b.spend("tiff", 12):
                return 0
            end = max(end, at + value + size if size > 4 else 0)
            if tag in (273, 279) and kind in (3, 4):
                if not b.spend("tiff", size):
                    return 0
                where = at + value if size > 4 else at + start + 10 + 12 * i
                strips[tag] = list(struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, where))
        end = max(end, close + 4, *(at + p + s for p, s in zip(strips.get(273, []), strips.get(279, []), strict=False)), 0)
        start = struct.unpack_from(order + "I", b, close)[0]
    if end > len(b):
        return 0
    b.spend("tiff", -min(b.remembered("tiff", int), end - at))  # nothing was in vain
    return end


#: The types of RIFF forms.
FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
#: Magic number, the place of the medium's start before it, and the validator.
MAGIC: dict[bytes, tuple[str, int, Callable[[Trailers, int], int]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0, png),
    b"\xff\xd8\xff": ("image/jpeg", 0, jpeg),
    b"GIF8": ("image/gif", 0, gif),
    b"BM": ("image/bmp", 0, bmp),
    b"RIFF": ("riff", 0, riff),
    b"%PDF-": ("application/pdf", 0, pdf),
    b"PK\x03\x04": ("application/zip", 0, zipped),
    b"\x1f\x8b\x08": ("application/gzip", 0, gzip),
    b"OggS": ("audio/ogg", 0, ogg),
    b"fLaC": ("audio/flac", 0, flac),
    b"ftyp": ("video/mp4", 4, mp4),
    b"II*\x00": ("image/tiff", 0, tiff),
    b"MM\x00*": ("image/tiff", 0, tiff),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (kind, before, check) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic), before, check))
    found.make_automaton()
    return found


def sniff(value: bytes, magic: ahocorasick.Automaton) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type of the whole value, None if it is no known medium, and the media carved from inside.

    Media that lie within a carved one are its own and not carved again; those within the whole value are.
    """
    whole, carved, free, value = None, [], 0, Trailers(value)
    for last, (kind, size, before, check) in magic.iter(value.decode("latin-1")):
        place = last - size + 1
        start = place - before
        if start < free:
            continue
        end = check(value, place)
        if not end:
            continue
        kind = FORMS[value[start + 8 : start + 12]] if kind == "riff" else kind
        if start == 0 and end == len(value) and whole is None:
            whole = kind
        else:
            carved.append((kind, start, end))
            free = end
    return whole, carved


def as_wave(payload: bytes) -> bytes:
    """The bytes as 8-bit samples of one channel: a canonical header of 44 bytes, then the samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a wave file, found by its chunks."""
    pos = 12
    while pos + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, pos)
        if kind == b"data":
            return media[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("a wave file without samples")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, declared): each whole text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a wave file.

    A null text is stored as the empty one. ``declared`` is what a crawler would have taken from the
    column: text/plain. Repeated rows are stored each; other columns of docs play no part.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            data = [x.encode() for x in texts(batch, text_col)]
            media = [as_wave(x + bytes(max(BLOCK, -(-len(x) // BLOCK) * BLOCK) - len(x))) for x in data]
            return {id_col: batch.column(id_col), "n_bytes": [len(x) for x in data], "media": media, "declared": ["text/plain"] * len(data)}

        return each

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary, declared string")


def sniffed(media: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """media with ``type`` (what the bytes prove, else what was declared), ``proved`` and ``carved`` (type, start, end).

    A null or empty value keeps its declared type, unproved, with nothing carved. Columns of these three names are replaced.
    """
    keep = [c for c in media.columns if c not in ("type", "proved", "carved")]
    kinds = {c: media.schema[c].dataType.simpleString() for c in keep}

    def make():
        magic = automaton()

        def each(batch: pa.RecordBatch) -> dict:
            found = [sniff(x or b"", magic) for x in batch.column(media_col).to_pylist()]
            declared = batch.column(declared_col).to_pylist()
            out = {c: batch.column(c) for c in keep}
            out["type"] = [whole or said for (whole, _), said in zip(found, declared, strict=True)]
            out["proved"] = [whole is not None for whole, _ in found]
            out["carved"] = [[dict(zip(("type", "start", "end"), x, strict=True)) for x in carved] for _, carved in found]
            return out

        return each

    return map_batches(media.select(*keep), make, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "type string, proved boolean, carved " + CARVED]))


def read_back(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with ``payload``, the samples of its wave files; null for a null value."""
    keep = [c for c in media.columns if c != "payload"]
    kinds = {c: media.schema[c].dataType.simpleString() for c in keep}

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in keep} | {"payload": [None if x is None else samples(x) for x in batch.column(media_col).to_pylist()]}

        return each

    return map_batches(media.select(*keep), make, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "payload binary"]))


def described(docs: DataFrame) -> DataFrame:
    """The digests of each document's stored form, and as its feature what sniffing finds in it."""
    full = read_back(sniffed(store(docs)))
    feature = F.concat_ws(";", "type", F.concat(F.lit("declared="), "declared"), F.concat(F.lit("proved="), F.col("proved").cast("string")),
                          F.concat(F.lit("samples="), F.length("payload").cast("string")), F.concat(F.lit("carved="), F.size("carved").cast("string")),
                          F.array_join(F.transform("carved", lambda c: F.concat(c["type"], F.lit("@"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))), ","))
    return full.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                       F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
                       F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
