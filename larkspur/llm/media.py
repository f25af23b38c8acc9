"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a binary value; a validator for each format
then walks its structure and returns the length it really has, or rejects the hit. The outermost confirmed hits are the media in
the value: a hit at 0 that spans it all is its type, whatever was declared; others are embedded and can be carved out.

store() writes a payload losslessly as 8-bit samples of a mono WAV file; payload_of() reads the samples of a stored file back.

Defined results: null and empty values have no media and keep the declared type; hits that no validator confirms are ignored;
truncated files are not confirmed, nor are Ogg pages of a wrong checksum or of several streams in turns; FLAC, which does not say
where it ends, ends where the next medium begins; equal values give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import appended, fresh

RATE = 8000


def _wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    end += end - at & 1
    if end > len(b):
        return None
    k, form, data = at + 12, None, False
    while k + 8 <= end:
        name, size = b[k : k + 4], struct.unpack_from("<I", b, k + 4)[0]
        if k + 8 + size > end:
            return None
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", b, k + 8) if size >= 16 else None
            if form is None or not form[1] or form[4] != form[1] * ((form[5] + 7) // 8):
                return None
        data |= name == b"data" and form is not None
        k += 8 + size + (size & 1)
    return end if data and k >= end else None


def _png(b: bytes, at: int) -> int | None:
    k, first = at + 8, True
    while k + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, k)[0], b[k + 4 : k + 8]
        if k + 12 + size > len(b) or first and (name != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[k + 4 : k + 8 + size]) != struct.unpack_from(">I", b, k + 8 + size)[0]:
            return None
        k, first = k + 12 + size, False
        if name == b"IEND":
            return k
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 14:
        return None
    flags, k = b[at + 10], at + 13
    k += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while k < len(b):
        kind = b[k]
        if kind == 0x3B:
            return k + 1
        if kind == 0x21:
            k += 2
        elif kind == 0x2C and k + 10 < len(b):
            k += 10 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 0x80 else 0) + 1
        else:
            return None
        while k < len(b) and b[k]:
            k += 1 + b[k]
        k += 1
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return at + size if 14 + head <= offset and offset + rows <= size <= len(b) - at else None


def _jpeg(b: bytes, at: int) -> int | None:
    k, frame = at + 2, False
    while k + 2 <= len(b) and b[k] == 0xFF:
        kind = b[k + 1]
        if kind == 0xFF:
            k += 1
            continue
        if kind == 0xD9:
            return k + 2 if frame else None
        if k + 4 > len(b):
            return None
        size = struct.unpack_from(">H", b, k + 2)[0]
        if size < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        k += 2 + size
        if kind == 0xDA:  # entropy-coded data up to the next marker that is no restart or stuffing
            while (k := b.find(b"\xff", k)) >= 0 and (k + 1 >= len(b) or b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k += 2
            if k < 0:
                return None
    return None


def _flac(b: bytes, at: int) -> int | None:
    """The end of the metadata: only that has lengths. The frames run to the next medium, or to the end of the value."""
    k, first = at + 4, True
    while k + 4 <= len(b):
        kind, size = b[k], int.from_bytes(b[k + 1 : k + 4], "big")
        if first and (kind & 0x7F or size != 34):
            return None
        k, first = k + 4 + size, False
        if kind & 0x80:
            return k if k < len(b) and b[k] == 0xFF else None
    return None


@cache
def _crc_table() -> list[int]:
    """Of the checksum of Ogg pages: polynomial 0x04c11db7, highest bit first."""
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


def page_checksum(page: bytes) -> int:
    """Of an Ogg page whose own checksum counts as zero."""
    table, c = _crc_table(), 0
    for x in page[:22] + bytes(4) + page[26:]:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ x]
    return c


def _ogg(b: bytes, at: int) -> int | None:
    k, serial = at, None
    while k + 27 <= len(b) and b[k : k + 4] == b"OggS" and b[k + 4] == 0:
        flags, parts = b[k + 5], b[k + 26]
        if serial is None and not flags & 2:
            return None
        if serial is not None and b[k + 14 : k + 18] != serial:
            return None
        serial = b[k + 14 : k + 18]
        stop = k + 27 + parts + sum(b[k + 27 : k + 27 + parts])
        if stop > len(b) or struct.unpack_from("<I", b, k + 22)[0] != page_checksum(b[k:stop]):
            return None
        k = stop
        if flags & 4:
            return k
    return None


# Magic bytes, type, validator.
FORMATS = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"fLaC": ("audio/flac", _flac),
    b"OggS": ("audio/ogg", _ogg),
}
#: Formats that do not say where they end.
OPEN = {"audio/flac"}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(value: bytes | None) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the outermost confirmed media in a value."""
    out, end, last = [], 0, None
    for at, magic in sorted(((i - len(m) + 1, m) for i, m in _automaton().iter((value or b"").decode("latin-1"))), key=lambda x: (x[0], -len(x[1]))):
        if at >= end:
            kind, validate = FORMATS[magic]
            stop = validate(value, at)
            if stop is not None:
                if last is not None:
                    out.append((last[0], at - last[0], last[1]))
                    last = None
                if kind in OPEN:
                    last = (at, kind)
                else:
                    out.append((at, stop - at, kind))
                end = stop
    if last is not None:
        out.append((last[0], len(value) - last[0], last[1]))
    return out


def store(payload: bytes) -> bytes:
    """A mono WAV file with the payload as unsigned 8-bit samples; an even number of bytes."""
    pad = b"\0" if len(payload) & 1 else b""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def payload_of(media: bytes) -> bytes:
    """The samples of a stored file, found by walking its chunks."""
    k = 12
    while media[k : k + 4] != b"data":
        size = struct.unpack_from("<I", media, k + 4)[0]
        k += 8 + size + (size & 1)
    return media[k + 8 : k + 8 + struct.unpack_from("<I", media, k + 4)[0]]


def sniffed(table: DataFrame, value: str, declared: str, carve: bool = False) -> DataFrame:
    """All columns of table with media_type (corrected), corrected, embedded: array of (offset, length, type, bytes).

    bytes is null unless carve. Where table has such names, the new ones get an underscore.
    """
    def run(values: list[bytes | None], said: list[str | None]) -> tuple[list, list, list]:
        found = [sniff(v) for v in values]
        whole = [f[0][2] if v and f and f[0][:2] == (0, len(v)) else None for v, f in zip(values, found, strict=True)]
        inner = [[{"offset": o, "length": n, "type": t, "bytes": v[o : o + n] if carve else None} for o, n, t in f if not w] for v, f, w in zip(values, found, whole, strict=True)]
        return [w or d for w, d in zip(whole, said, strict=True)], [bool(w) and w != d for w, d in zip(whole, said, strict=True)], inner

    names = fresh(table, "media_type", "corrected", "embedded")
    kinds = ("string", "boolean", "array<struct<offset:long,length:long,type:string,bytes:binary>>")
    return appended(table, [value, declared], run, rows=64, **dict(zip(names, kinds, strict=True)))


def text_media(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """docs(doc_id, text) -> the stored form's digest columns; each text is stored, sniffed, read back and described."""

    def run(texts: list[str | None]) -> list[list]:
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = store(raw + bytes(-len(raw) % 64 if raw else 64))
            hits = sniff(media)
            kind = hits[0][2] if hits and hits[0][:2] == (0, len(media)) else declared
            back = payload_of(media)
            inner = sniff(back)
            samples = np.frombuffer(back, np.uint8)
            level = samples.astype(np.int64) - 128
            cross = int(np.count_nonzero(np.diff(np.signbit(level))))
            feature = f"{kind};declared={declared};rate={RATE};samples={len(samples)};min={samples.min()};max={samples.max()};energy={int(level @ level)};crossings={cross};embedded={','.join(f'{t}@{o}+{n}' for o, n, t in inner)}"
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return [list(c) for c in zip(*rows, strict=True)]

    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return appended(docs.select("doc_id", "text"), ["text"], run, **kinds).drop("text")
