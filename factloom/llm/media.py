"""Media columns: signature sniffing, structural validation and carving.

An Aho-Corasick automaton finds every magic number of the known formats in one
pass over the bytes.  A hit counts only if the format's validator can follow
the structure from there: chunk lengths, checksums, block chains, trailers.
The validated type at offset 0 corrects a wrong declared type; validated hits
further in are embedded media, with exact offset and length, and can be carved
out.  Hits inside a validated embedded item belong to that item.

``store_payloads`` writes payloads losslessly as 8-bit mono PCM in RIFF/WAVE,
as a binary column of a Parquet table; ``describe_media`` reads stored bytes
back, sniffs them, unpacks the samples and computes features.

Defined results: null bytes or text count as empty; the payload of an empty
text is 64 zero bytes; equal texts give equal stored bytes and features; bytes
of no known format are ``application/octet-stream``; repeated rows are handled
each; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, id_and_text, write_table

# Magic numbers, the place of the format's first byte before them, media types.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
)
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
UNKNOWN = "application/octet-stream"
SAMPLE_RATE = 8000
PAYLOAD_UNIT = 64


@dataclass(frozen=True)
class Found:
    kind: str
    offset: int
    length: int


# ---------------------------------------------------------------- validators
# Each takes (data, start, notes) and returns (type, length), or None if the structure does not hold.
# Notes are kept for one payload: how far a chain of parts leads from a place is found once, however many
# starts lead there, so that a payload full of magic numbers takes time in proportion to its size.


def _followed(notes: dict, name: str, start, step):
    """Where the chain from ``start`` ends.  ``step`` gives (True, the next place) or (False, the result)."""
    known, path, at = notes.setdefault(name, {}), [], start
    while at not in known:
        path.append(at)
        more, value = step(at)
        if not more:
            known[at] = value
            break
        at = value
    result = known[at]
    for place in path:
        known[place] = result
    return result


def _places(notes: dict, d: bytes, mark: bytes) -> list[int]:
    """Where ``mark`` stands, found once."""
    if mark not in notes:
        notes[mark] = [m.start() for m in re.finditer(re.escape(mark), d)]
    return notes[mark]


def _png(d: bytes, start: int, notes: dict):
    def chunk(at: int):
        if at + 12 > len(d):
            return False, None
        size, name = struct.unpack_from(">I4s", d, at)
        if at + 12 + size > len(d) or zlib.crc32(d[at + 4 : at + 8 + size]) != struct.unpack_from(">I", d, at + 8 + size)[0]:
            return False, None
        return (False, at + 12 + size) if name == b"IEND" else (True, at + 12 + size)

    if d[start + 8 : start + 16] != b"\0\0\0\x0dIHDR":
        return None
    end = _followed(notes, "png", start + 8, chunk)
    return ("image/png", end - start) if end else None


def _jpeg(d: bytes, start: int, notes: dict):
    def segment(state: tuple[int, bool]):
        at, scanned = state
        if at + 2 > len(d):
            return False, None
        if d[at] != 0xFF:
            at = d.find(b"\xff", at) if scanned else -1
            return (True, (at, True)) if at >= 0 else (False, None)
        mark = d[at + 1]
        if mark == 0xD9:
            return False, at + 2 if scanned else None
        if mark in (0x00, 0xFF) or 0xD0 <= mark <= 0xD7:
            if not scanned and mark != 0xFF:
                return False, None
            return True, (at + (1 if mark == 0xFF else 2), scanned)
        if at + 4 > len(d) or (size := struct.unpack_from(">H", d, at + 2)[0]) < 2:
            return False, None
        return True, (at + 2 + size, scanned or mark == 0xDA)

    end = _followed(notes, "jpeg", (start + 2, False), segment)
    return ("image/jpeg", end - start) if end else None


def _gif(d: bytes, start: int, notes: dict):
    flags = d[start + 10] if start + 13 <= len(d) else None
    if flags is None or 0 in struct.unpack_from("<HH", d, start + 6):
        return None

    def sub_block(at: int):
        if at >= len(d):
            return False, None
        return (False, at + 1) if d[at] == 0 else (True, at + 1 + d[at])

    def block(at: int):
        if at >= len(d):
            return False, None
        if d[at] == 0x3B:
            return False, at + 1
        if d[at] == 0x21:
            at = _followed(notes, "gif data", at + 2, sub_block)
        elif d[at] == 0x2C and at + 10 <= len(d):
            local = d[at + 9]
            at = _followed(notes, "gif data", at + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0), sub_block)
        else:
            return False, None
        return (True, at) if at else (False, None)

    end = _followed(notes, "gif", start + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), block)
    return ("image/gif", end - start) if end else None


def _bmp(d: bytes, at: int, notes: dict):
    if at + 30 > len(d):
        return None
    size, spare, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if header not in (40, 52, 56, 64, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    row = (width * bits + 31) // 32 * 4
    packed = struct.unpack_from("<I", d, at + 30)[0] if at + 34 <= len(d) else 1
    holds = pixels >= 14 + header and (packed not in (0, 3) or pixels + row * abs(height) <= size)
    return ("image/bmp", size) if holds and spare == 0 and at + size <= len(d) else None


def _riff(d: bytes, at: int, notes: dict):
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end = at + 8 + size
    if form not in RIFF_TYPES or end > len(d) or (form == b"WAVE" and d[at + 12 : at + 16] != b"fmt "):
        return None

    def chunk(place: int):
        """Chains of chunks join: each place gets (the tree's name, steps left and data chunks left to the end of it)."""
        return place + 8 + int.from_bytes(d[place + 4 : place + 8], "little") + (d[place + 4] & 1)

    # Whether the chain from the first chunk meets `end`, and a data chunk before it.
    known, path, place = notes.setdefault("riff", {}), [], at + 12
    while place + 8 <= len(d) and place not in known:
        path.append(place)
        place = chunk(place)
    tree, steps, data = known.get(place, (place, 0, 0))
    for p in reversed(path):
        steps, data = steps + 1, data + (d[p : p + 4] == b"data")
        known[p] = tree, steps, data
    first = known.get(at + 12)
    last = known.get(end, (end, 0, 0))
    if at + 12 >= end or first is None or first[0] != last[0] or first[1] <= last[1] or not _meets(notes, d, chunk, at + 12, end, first[1] - last[1]):
        return None
    if form == b"WAVE" and first[2] == last[2]:
        return None
    return RIFF_TYPES[form], end - at


def _meets(notes: dict, d: bytes, step, start: int, end: int, steps: int) -> bool:
    """Whether ``end`` is ``steps`` steps from ``start``; by jumps of doubled length, kept in the notes."""
    jumps = notes.setdefault("riff jumps", {})

    def jump(place: int, level: int) -> int:
        if level == 0:
            return step(place) if place + 8 <= len(d) else -1
        if (place, level) not in jumps:
            half = jump(place, level - 1)
            jumps[place, level] = jump(half, level - 1) if half >= 0 else -1
        return jumps[place, level]

    at, level = start, 0
    while steps and at >= 0:
        if steps & 1:
            at = jump(at, level)
        steps, level = steps >> 1, level + 1
    return at == end


def _flac(d: bytes, start: int, notes: dict):
    if start + 42 > len(d) or d[start + 4] & 0x7F or int.from_bytes(d[start + 5 : start + 8], "big") != 34:
        return None

    def block(at: int):
        if at + 4 > len(d):
            return False, None
        end = at + 4 + int.from_bytes(d[at + 1 : at + 4], "big")
        return (False, end) if d[at] & 0x80 else (True, end)

    at = _followed(notes, "flac", start + 4, block)
    return ("audio/flac", len(d) - start) if at and at + 2 <= len(d) and d[at] == 0xFF and d[at + 1] & 0xFC == 0xF8 else None


def _ogg(d: bytes, start: int, notes: dict):
    def page(at: int):
        if at + 27 > len(d) or d[at : at + 4] != b"OggS" or d[at + 4]:
            return False, None
        n = d[at + 26]
        end = at + 27 + n + sum(d[at + 27 : at + 27 + n])
        if at + 27 + n > len(d) or end > len(d):
            return False, None
        return (False, end) if d[at + 5] & 4 else (True, end)

    end = _followed(notes, "ogg", start, page) if d[start + 5 : start + 6] and d[start + 5] & 2 else None
    return ("audio/ogg", end - start) if end else None


def _pdf(d: bytes, at: int, notes: dict):
    """Up to the last end mark before the next file's header."""
    if not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"." and d[at + 7 : at + 8].isdigit()):
        return None
    ends, heads, crossed = (_places(notes, d, m) for m in (b"%%EOF", b"%PDF-", b"startxref"))
    k = bisect_left(ends, at)
    if k == len(ends):
        return None
    following = bisect_left(heads, ends[k])
    if following < len(heads):
        k = max(k, bisect_left(ends, heads[following]) - 1)
    else:
        k = len(ends) - 1
    end, x = ends[k], bisect_left(crossed, at)
    return ("application/pdf", end + 5 - at) if x < len(crossed) and crossed[x] + 9 <= end else None


def _zip(d: bytes, at: int, notes: dict):
    if "zip" not in notes:
        notes["zip"] = _archives(d, notes)
    end = notes["zip"].get(at)
    return ("application/zip", end - at) if end else None


def _archives(d: bytes, notes: dict) -> dict[int, int]:
    """Begin and end of every archive: from the end records, whose directory must hold as many entries as they say."""

    def entry(state: int):
        if state + 46 > len(d) or d[state : state + 4] != b"PK\x01\x02":
            return None
        return state + 46 + sum(struct.unpack_from("<HHH", d, state + 28))

    known: dict[int, tuple[int, int]] = {}  # entry -> (where its chain ends, entries up to there)
    found: dict[int, int] = {}
    for end in _places(notes, d, b"PK\x05\x06"):
        if end + 22 > len(d):
            break
        count, total, size, directory, comment = struct.unpack_from("<HHIIH", d, end + 8)
        begin = end - size - directory
        if count != total or begin < 0 or end + 22 + comment > len(d):
            continue
        path, place = [], end - size
        while place not in known and (following := entry(place)) is not None:
            path.append(place)
            place = following
        last, n = known.get(place, (place, 0))
        for p in reversed(path):
            n += 1
            known[p] = last, n
        if known.get(end - size, (end - size, 0)) == (end, total):
            found.setdefault(begin, end + 22 + comment)
    return found


def _gzip(d: bytes, at: int, notes: dict):
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    unpack, fed = zlib.decompressobj(31), at
    try:
        while not unpack.eof and fed < len(d):
            piece, fed = d[fed : fed + 65536], fed + 65536
            while piece and not unpack.eof:
                unpack.decompress(piece, 1 << 20)
                piece = unpack.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", min(fed, len(d)) - len(unpack.unused_data) - at) if unpack.eof else None


def _mp4(d: bytes, start: int, notes: dict):
    known, path, at = notes.setdefault("mp4", {}), [], start  # box -> (end of the chain, whether a moov box follows)
    while at not in known and at + 8 <= len(d):
        size, name = struct.unpack_from(">I4s", d, at)
        if size < 8 or at + size > len(d) or not name.isalnum():
            break
        path.append((at, name))
        at += size
    end, moov = known.get(at, (at, False))
    for place, name in reversed(path):
        moov |= name == b"moov"
        known[place] = end, moov
    return ("video/mp4", end - start) if moov and d[start + 4 : start + 8] == b"ftyp" else None


VALIDATORS: dict[str, Callable] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac,
    "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4,
}


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, before, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), before, kind))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[Found]:
    """Validated media in order of offset; what lies inside an earlier embedded item is part of it."""
    found: list[Found] = []
    covered, notes = 0, {}
    for last, (size, before, kind) in _automaton().iter(data.decode("latin-1")):
        start = last + 1 - size - before
        if start < covered:
            continue
        if start >= 0 and (held := VALIDATORS[kind](data, start, notes)):
            found.append(Found(held[0], start, held[1]))
            covered = start + held[1] if start else 0  # the outermost item may hold others
    return found


def corrected_type(declared: str | None, found: list[Found]) -> str:
    """The type the bytes prove; the declared one stands only if nothing is proved and it claims no known format."""
    if found and found[0].offset == 0:
        return found[0].kind
    known = {k for *_, k in SIGNATURES} | set(RIFF_TYPES.values())
    return declared if declared and declared not in known else UNKNOWN


def carve(data: bytes) -> list[tuple[Found, bytes]]:
    """Embedded media and their bytes."""
    return [(f, data[f.offset : f.offset + f.length]) for f in sniff(data) if f.offset]


# ------------------------------------------------------------------ storage


def padded(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAYLOAD_UNIT or (0 if raw else PAYLOAD_UNIT))


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n)
    return head + payload + bytes(n & 1)


def wav_samples(data: bytes) -> bytes:
    at = 12
    while at + 8 <= len(data):
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def features(samples: bytes) -> str:
    """Length, level and spread of 8-bit samples, and the entropy of their values."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256).astype(np.float64)
    total = max(1.0, counts.sum())
    values = np.arange(256) - 128.0
    mean = (counts * values).sum() / total
    rms = np.sqrt((counts * values**2).sum() / total)
    p = counts[counts > 0] / total
    return f"n={len(samples)};mean={mean:.4f};rms={rms:.4f};entropy={-(p * np.log2(p)).sum():.4f}"


def _store(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            payloads = [padded(t) for t in part.column("text").to_pylist()]
            n = [len(t.as_py().encode("utf-8", "surrogatepass")) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(["audio/wav"] * len(n)), pa.array(map(to_wav, payloads), pa.binary())],
                names=["doc_id", "n_bytes", "declared", "media"],
            )


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written media table: doc_id, n_bytes, declared, media (binary)."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    stored = rows.mapInArrow(_store, f"doc_id {kind}, n_bytes long, declared string, media binary")
    return write_table(docs.sparkSession, stored, "media")[0]


_EMBEDDED = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def _describe(batches: Iterator[pa.RecordBatch], keep: list[str]):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            cols: dict[str, list] = {k: [] for k in ("kind", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "embedded")}
            for data, declared in zip(part.column("media").to_pylist(), part.column("declared").to_pylist(), strict=True):
                data = data or b""
                found = sniff(data)
                kind = corrected_type(declared, found)
                payload = wav_samples(data) if kind == "audio/wav" else data
                cols["kind"].append(kind)
                cols["payload_bytes"].append(len(payload))
                cols["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                cols["tail_crc32"].append(zlib.crc32(payload[-PAYLOAD_UNIT:]))
                cols["media_bytes"].append(len(data))
                cols["media_sha256"].append(hashlib.sha256(data).hexdigest())
                inner = [{"kind": f.kind, "offset": f.offset, "length": f.length} for f in found if f.offset]
                cols["embedded"].append(inner)
                cols["feature"].append(f"{kind};{features(payload)};embedded={len(inner)}")
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _EMBEDDED]
            arrays = [pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], names=[*keep, *cols])


def describe_media(table: DataFrame, keep: list[str]) -> DataFrame:
    """For a table with media and declared: proved type, digests, features and embedded items of every row.

    A kept column with the name of a result is returned as input_<name>.
    """
    out = "kind string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out += ", embedded array<struct<kind:string,offset:bigint,length:bigint>>"
    taken, named = {f.split(" ")[0] for f in out.split(", ")}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name = f"input_{name}"
        taken.add(name.lower())
        named.append(name)
    fields = ", ".join(f"`{n}` {table.schema[c].dataType.simpleString()}" for n, c in zip(named, keep, strict=True))
    chosen = table.select("media", "declared", *(table[c].alias(n) for n, c in zip(named, keep, strict=True) if n not in ("media", "declared")))
    return chosen.mapInArrow(functools.partial(_describe, keep=named), f"{fields}, {out}")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples, read back and described."""
    stored = store_payloads(documents(spark, sf_dir))
    return describe_media(stored, ["doc_id", "n_bytes"]).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        F.col("kind").alias("media_type"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_media": op8_media}
SQL: dict[str, str] = {}
