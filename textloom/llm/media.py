"""Media columns: signature sniffing.

An Aho-Corasick automaton locates magic bytes; a validator for each format confirms structure and length. From that the
operator corrects declared types and carves embedded media.

Nulls are empty; empty bytes have no type and nothing carved. Every row gives a row, so equal rows and repeated ids give equal
ones; of two files that start in one place the format listed first counts; an empty table gives no rows; other columns, whatever
their names, are not read. Bytes of any length are read whole, in linear time but for what a format's own nesting costs.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

WIDTH = 192


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    size = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if not kind or size < 20 or at + size > len(b):
        return None
    pos, end = at + 12, at + size
    while pos + 8 <= end:
        pos += 8 + (n := struct.unpack_from("<I", b, pos + 4)[0]) + (n & 1)
    return (kind, size) if pos == end else None


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 8
    while pos + 12 <= len(b):
        n = struct.unpack_from(">I", b, pos)[0]
        if pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        kind, pos = b[pos + 4 : pos + 8], pos + 12 + n
        if kind == b"IEND":
            return "image/png", pos - at
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark, n = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if mark < 0xC0 or n < 2:
            return None
        pos += 2 + n
        if mark == 0xDA:
            while 0 <= (pos := b.find(b"\xff", pos)) < len(b) - 1:
                if b[pos + 1] == 0xD9:
                    return "image/jpeg", pos + 2 - at
                if b[pos + 1] != 0 and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            if pos < 0:
                return None
    return None


@functools.lru_cache(maxsize=1)
def _dead_ends(b: bytes) -> set[int]:
    """Places of b from which a walk over GIF blocks is known to fail."""
    return set()


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    skip = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    pos, dead, seen = at + 13 + skip(b[at + 10]), _dead_ends(b), []
    while pos < len(b) and pos not in dead:
        seen.append(pos)
        if b[pos] == 0x3B:
            return "image/gif", pos + 1 - at
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + skip(b[pos + 9])
        else:
            break
        while pos < len(b) and b[pos] and ~pos not in dead:
            seen.append(~pos)  # inside a row of data blocks
            pos += 1 + b[pos]
        if pos >= len(b) or b[pos]:
            break
        pos += 1
    dead.update(seen)
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", size) if header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at else None


_XREF = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")
_OBJECT = re.compile(rb"\s*(?:xref\b|\d{1,10}\s+\d{1,5}\s+obj\b)")


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """Up to the last %%EOF whose cross-reference stands where startxref says, before the next header."""
    nxt = b.find(b"%PDF-", at + 5)
    end = None
    for m in _XREF.finditer(b, at, nxt if nxt > 0 else len(b)):
        if _OBJECT.match(b, min(at + int(m[1]), m.start()), m.start()):
            end = m.end()
    return ("application/pdf", end - at) if end else None


@functools.lru_cache(maxsize=1)
def _directories(b: bytes) -> dict[int, int]:
    """End of each ZIP archive of b by its start, from the end records alone."""
    out: dict[int, int] = {}
    pos = -1
    while 0 <= (pos := b.find(b"PK\x05\x06", pos + 1)) <= len(b) - 22:
        entries, size, offset, note = struct.unpack_from("<HIIH", b, pos + 10)
        if b[pos - size : pos - size + 4] == b"PK\x01\x02" and entries and pos + 22 + note <= len(b):
            out.setdefault(pos - size - offset, pos + 22 + note)
    return out


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    end = _directories(b).get(at)
    return ("application/zip", end - at) if end else None


#: Longest name or comment in a gzip header; real ones are paths.
_NAME = 4096


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, pos = b[at + 3], at + 10
    if flags & 4:
        pos += 2 + struct.unpack_from("<H", b, pos)[0]
    for bit in (8, 16):
        if flags & bit:
            if (pos := b.find(b"\0", pos, pos + _NAME) + 1) <= 0:
                return None
    pos += 2 * (flags >> 1 & 1)
    d = zlib.decompressobj(-15)
    crc = size = 0
    try:
        rest = memoryview(b)[pos:]
        while rest and not d.eof:  # in pieces: a bomb is never held whole
            out = d.decompress(d.unconsumed_tail or rest[:4096], 1 << 20)
            crc, size = zlib.crc32(out, crc), size + len(out)
            if not d.unconsumed_tail and not d.eof:
                pos, rest = pos + 4096, rest[4096:]
    except zlib.error:
        return None
    end = pos + min(len(rest), 4096) - len(d.unused_data) if d.eof else len(b)
    ok = d.eof and end + 8 <= len(b) and struct.unpack_from("<II", b, end) == (crc, size & 0xFFFFFFFF)
    return ("application/gzip", end + 8 - at) if ok else None


def _crc_table(bits: int, poly: int) -> list[int]:
    out = []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = c << 1 ^ (poly if c >> bits - 1 else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(length of the header, samples of the frame) where a frame header of right checksum stands."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = b[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1  # UTF-8 like number
    pos = at + 5 + more
    extra = {6: 1, 7: 2}.get(size, 0)
    end = pos + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or end >= len(b):
        return None
    crc = 0
    for c in b[at:end]:
        crc = _CRC8[crc ^ c]
    samples = 192 if size == 1 else 576 << size - 2 if size < 6 else int.from_bytes(b[pos : pos + extra], "big") + 1 if size < 8 else 256 << size - 8
    return (end + 1 - at, samples) if crc == b[end] else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames, each with right checksums and followed by the next, up to the stream's number of samples."""
    pos, info = at + 4, None
    while True:
        if pos + 4 > len(b):
            return None
        kind, n = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if (info is None) != (kind & 127 == 0) or kind & 127 > 6 or pos + 4 + n > len(b):
            return None
        if info is None:
            if n != 34:
                return None
            info = b[pos + 4 : pos + 38]
        pos += 4 + n
        if kind & 128:
            break
    total, least, most = int.from_bytes(info[13:18], "big") & (1 << 36) - 1, int.from_bytes(info[4:7], "big"), int.from_bytes(info[7:10], "big") or 1 << 22
    done, end = 0, None
    while frame := _flac_frame(b, pos):
        done += frame[1]
        crc, start, end = 0, pos, None
        for k in range(start, min(len(b), start + most)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[k]]
            if crc == 0 and k + 1 - start >= max(least, frame[0] + 2) and (total and done >= total or k + 1 == len(b) or _flac_frame(b, k + 1)):
                end = k + 1
                break
        if end is None:
            return None
        pos = end
        if total and done >= total:
            break
    return ("audio/flac", end - at) if end and (not total or done >= total) else None


def _boxes(b: bytes, at: int) -> tuple[str, int] | None:
    """MP4, QuickTime and HEIF: a row of known boxes from ftyp on, one with a movie or a picture's items among them."""
    kind = {b"qt  ": "video/quicktime", b"heic": "image/heif", b"heix": "image/heif", b"mif1": "image/heif", b"avif": "image/avif", b"M4A ": "audio/mp4"}.get(b[at + 8 : at + 12], "video/mp4")
    pos, seen = at, set()
    while pos + 8 <= len(b):
        n, name = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if n == 1 and pos + 16 <= len(b):
            n = int.from_bytes(b[pos + 8 : pos + 16], "big")
        if n < 8 or pos + n > len(b) or name not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"meta", b"moof", b"mfra", b"sidx", b"styp", b"pdin", b"udta", b"emsg") or name == b"ftyp" and seen:
            break
        seen.add(name)
        pos += n
    return (kind, pos - at) if seen & {b"moov", b"moof", b"meta"} else None


def _tiff(b: bytes, at: int) -> tuple[str, int] | None:
    """Directories, and the furthest byte that one of their values or strips takes."""
    order = "<" if b[at : at + 2] == b"II" else ">"
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    if at + 8 > len(b):
        return None
    nxt, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()

    def numbers(kind: int, count: int, where: int) -> list[int]:
        return list(struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, where)) if kind in (3, 4) else []

    while nxt:
        if nxt in seen or nxt < 8 or at + nxt + 2 > len(b):
            return None
        seen.add(nxt)
        n = struct.unpack_from(order + "H", b, at + nxt)[0]
        if not n or at + nxt + 6 + 12 * n > len(b):
            return None
        end, strips = max(end, nxt + 6 + 12 * n), {}
        for k in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", b, at + nxt + 2 + 12 * k)
            size = width.get(kind, 1 << 62) * count
            where = at + nxt + 10 + 12 * k if size <= 4 else at + struct.unpack_from(order + "I", b, at + nxt + 10 + 12 * k)[0]
            if where + size > len(b):
                return None
            end = max(end, where + size - at)
            if tag in (273, 279, 324, 325):
                strips[tag] = numbers(kind, count, where)
        for offsets, counts in ((273, 279), (324, 325)):
            for o, c in zip(strips.get(offsets, ()), strips.get(counts, ())):
                if at + o + c > len(b):
                    return None
                end = max(end, o + c)
        nxt = struct.unpack_from(order + "I", b, at + nxt + 2 + 12 * n)[0]
    return ("image/tiff", end) if seen else None


def _vint(b: bytes, at: int, keep: bool = False) -> tuple[int, int] | None:
    """(value, length) of an EBML number; keep: with its marker, as ids have it."""
    if at >= len(b) or not b[at]:
        return None
    n = 9 - b[at].bit_length()
    value = int.from_bytes(b[at : at + n], "big")
    return (value if keep else value & (1 << 7 * n) - 1, n) if at + n <= len(b) else None


def _ebml(b: bytes, at: int) -> tuple[str, int] | None:
    """An EBML header that names its document type, then one segment of known size."""
    head = _vint(b, at + 4)
    if not head or (body := at + 4 + head[1]) + head[0] > len(b):
        return None
    kind = {True: "video/webm", False: "video/x-matroska"}[b"webm" in b[body : body + head[0]]]
    pos = body + head[0]
    if b"webm" not in b[body:pos] and b"matroska" not in b[body:pos] or b[pos : pos + 4] != b"\x18\x53\x80\x67" or not (size := _vint(b, pos + 4)):
        return None
    end = pos + 4 + size[1] + size[0]
    return (kind, end - at) if end <= len(b) else None


def _id3(b: bytes, at: int) -> tuple[str, int] | None:
    """An ID3 tag, then MPEG audio frames, three at least, each where the last one ends."""
    if at + 10 > len(b) or max(b[at + 6 : at + 10]) > 127 or b[at + 3] > 4:
        return None
    pos = at + 10 + sum(c << 7 * (3 - k) for k, c in enumerate(b[at + 6 : at + 10]))
    rates = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
    frames = 0
    while pos + 4 <= len(b) and b[pos] == 255 and b[pos + 1] & 0xE6 == 0xE2:  # layer III
        version, bits, hz = b[pos + 1] >> 3 & 3, b[pos + 2] >> 4, b[pos + 2] >> 2 & 3
        if version == 1 or bits in (0, 15) or hz == 3:
            break
        rate = (44100, 48000, 32000)[hz] >> {3: 0, 2: 1, 0: 2}[version]
        n = (144 if version == 3 else 72) * rates[3 if version == 3 else 2][bits] * 1000 // rate + (b[pos + 2] >> 1 & 1)
        if pos + n > len(b):
            break
        pos, frames = pos + n, frames + 1
    return ("audio/mpeg", pos - at) if frames >= 3 else None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at
    if len(b) < at + 27 or not b[at + 5] & 2:  # not the first page of a stream
        return None
    while b[pos : pos + 5] == b"OggS\x00" and pos + 27 <= len(b):
        n, last = b[pos + 26], b[pos + 5] & 4
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos > len(b):
            return None
        if last:
            return "audio/ogg", pos - at
    return None


#: Magic bytes, where they stand in their file, and the validator.
FORMATS = [
    (b"RIFF", 0, _riff), (b"\x89PNG\r\n\x1a\n", 0, _png), (b"\xff\xd8\xff", 0, _jpeg), (b"GIF87a", 0, _gif), (b"GIF89a", 0, _gif), (b"BM", 0, _bmp),
    (b"%PDF-", 0, _pdf), (b"PK\x03\x04", 0, _zip), (b"\x1f\x8b\x08", 0, _gzip), (b"fLaC", 0, _flac), (b"OggS\x00", 0, _ogg),
    (b"ftyp", 4, _boxes), (b"II*\x00", 0, _tiff), (b"MM\x00*", 0, _tiff), (b"\x1a\x45\xdf\xa3", 0, _ebml), (b"ID3", 0, _id3),
]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(data: bytes, aho: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each confirmed file, outermost and leftmost first; those inside a carved one are left to a second call."""
    found, free = [], 0
    for end, k in aho.iter(data.decode("latin-1")):
        magic, lead, check = FORMATS[k]
        at = end + 1 - len(magic) - lead
        if at >= free and (x := check(data, at)):
            found.append((at, x[1], x[0]))
            free = at + x[1]
    return found


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """For rows of bytes: doc_id, declared, mime (of the file that starts at 0, else null), corrected (declared type unless a confirmed one contradicts it), and carved: array of (offset, length, mime, content) for all confirmed media."""

    def run(ids, said, blobs):
        aho, kinds, right, carved = automaton(), [], [], []
        for want, b in zip(said, blobs):
            hits = sniff(b or b"", aho)
            kinds.append(next((m for o, _, m in hits if o == 0), None))
            right.append(kinds[-1] or want)
            carved.append([{"offset": o, "length": n, "mime": m, "content": b[o : o + n]} for o, n, m in hits])
        return ids, said, kinds, right, carved

    said = df[declared].cast("string") if declared else F.lit(None).cast("string")
    rows = df.select(df[id_col].alias("doc_id"), said.alias("declared"), df[content].cast("binary").alias("content"))
    return map_batches(rows, run, "doc_id long, declared string, mime string, corrected string, carved array<struct<offset:long,length:long,mime:string,content:binary>>")


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono PCM of 8-bit samples; the payload's length is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples, found by walking the chunks of the stored file."""
    pos = 12
    while media[pos : pos + 4] != b"data":
        pos += 8 + (n := struct.unpack_from("<I", media, pos + 4)[0]) + (n & 1)
    return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each whole text as an 8-bit PCM file, sniffs and reads the stored bytes back and describes them.

    feature: confirmed type, number of media carved inside the payload, and the shares of its 16 sample bands in 255ths
    (hex). Null texts are empty: 192 spaces.
    """

    def run(ids, values):
        aho, out = automaton(), []
        for t in values:
            n, payload = payload_of(t)
            media = to_wav(payload)
            outer = sniff(media, aho)
            back = from_wav(media)
            inner = sniff(back, aho)
            bands = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16) * 255 // len(back)
            kind = outer[0][2] if outer and outer[0][:2] == (0, len(media)) else "application/octet-stream"
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};{len(inner)};{bytes(bands.astype(np.uint8)).hex()}", kind, len(inner)))
        return ids, *zip(*out)

    return map_batches(texts(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sniffed_type string, n_carved long")
