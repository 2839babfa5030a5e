"""Secret scan with structural confirmation.

Base rules (patterns below) report assignments, access ids and long hex runs.
The method adds what it can confirm by decoding: base64 or hex candidates are
decoded and must parse as a key encoding down to their nested lengths (DER
private keys, OpenSSH private keys, PEM blocks), as a signed token whose header
names an algorithm, or as printable text in which a base rule matches again.
A candidate that does not parse is not reported.

Every step is linear in the text: lines that begin and end a key block are found
once and paired in order, and a run of token characters is split once.  A text
is searched in full; its long words are looked at first, and the slower
patterns run only where one of them can match, which changes no result.

Defined results: null text counts as empty (no spans); spans count code points,
end exclusive, ordered by start, then kind as listed; repeated rows are scanned
each; an empty table gives no rows; columns other than id and text are ignored
by ``find_secrets`` and passed through by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, id_and_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "pem", "der", "openssh", "encoded")
MARK = "[REDACTED]"

_assign = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_keyword = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex_run = re.compile(r"[0-9a-f]{16,}")
_token_run = re.compile(r"[A-Za-z0-9_.-]+")
_pem_line = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,60})-----")
_pem_body = re.compile(r"[A-Za-z0-9+/=\s:,-]{16,}")
_b64_run = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_hex_candidate = re.compile(r"[0-9A-Fa-f]{48,}")


# ------------------------------------------------------------- base rules


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = [(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= 12] if _keyword.search(text) else []
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), "hex", m.end()) for m in _hex_run.finditer(text)]


# ------------------------------------------------- structural confirmation


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_private_key(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    whole_numbers = [c for t, c in inner if t == 0x02]
    if any(not c for c in whole_numbers):
        return False
    if len(inner) >= 6 and all(t == 0x02 for t in tags):  # RSA: version and 8 numbers; DSA: version and 5
        return len(inner) in (6, 9) and whole_numbers[0] in (b"\0", b"\1") and len(whole_numbers[1]) >= 32
    if tags[:2] == [0x02, 0x04] and whole_numbers[0] == b"\1":  # elliptic curve
        return len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) and der_items(c) for t, c in inner[2:])

    def names_algorithm(content: bytes) -> bool:
        parts = der_items(content)
        return bool(parts) and parts[0][0] == 0x06 and len(parts[0][1]) >= 3

    if tags[:3] == [0x02, 0x30, 0x04]:  # any algorithm, wrapped
        return whole_numbers[0] in (b"\0", b"\1") and names_algorithm(inner[1][1]) and len(inner[2][1]) >= 16
    return tags == [0x30, 0x04] and names_algorithm(inner[0][1]) and len(inner[1][1]) >= 16  # encrypted


def is_openssh_private_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def take() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = take(), take(), take()
    if not cipher or not kdf or options is None:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or any(not take() for _ in range(keys)):
        return False
    return bool(take()) and at == len(data)


def decode64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(run: str) -> bool:
    parts = run.split(".")
    if len(parts) not in (3, 5):
        return False
    try:
        header = json.loads((decode64(parts[0]) or b"").decode("utf-8"))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(header.get("enc"), str)
        return (parts[2] != "" or header["alg"].lower() == "none") and decode64(parts[1]) is not None
    except (ValueError, RecursionError):
        return False


def confirmed_kind(data: bytes | None, as_text: bool = True) -> str | None:
    """What decoded bytes are, if they are secret material; ``as_text`` also looks for secrets in printable text."""
    if not data:
        return None
    if data[0] == 0x30 and is_der_private_key(data):
        return "der"
    if is_openssh_private_key(data):
        return "openssh"
    if as_text and not data.translate(None, _PRINTABLE):
        text = data.decode("ascii")
        if base_spans(text) or confirmed_spans(text):
            return "encoded"
    return None


_PRINTABLE = bytes([9, 10, 13, *range(0x20, 0x7F)])


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Where a signed token can be: from ``eyJ``, three to five parts between dots.  Every character is looked at once."""
    for run in _token_run.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, k = run[0].split("."), run.start(), 0
        while k < len(parts):
            begin = parts[k].find("eyJ")
            if 0 <= begin < len(parts[k]) - 3 and k + 2 < len(parts) and parts[k + 1]:
                taken = parts[k : k + 5]
                end = at + sum(map(len, taken)) + len(taken) - 1
                yield at + begin, end
                at, k = end + 1, k + len(taken)
            else:
                at, k = at + len(parts[k]) + 1, k + 1


def _pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body): a BEGIN line, then its END line as the next such line."""
    last = None
    for line in _pem_line.finditer(text):
        if line[1] == "BEGIN":
            last = line
        elif last is not None and last[2] == line[2]:
            if _pem_body.fullmatch(text, last.end(), line.start()):
                yield last.start(), line.end(), line[2], text[last.end() : line.start()]
            last = None
        else:
            last = None


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    if "eyJ" in text:
        found += [(a, "token", b) for a, b in _tokens(text) if is_signed_token(text[a:b])]
    if "-----BEGIN " in text:
        for start, end, label, body in _pem_blocks(text):
            lines = [x for x in body.split("\n") if ":" not in x]
            data = decode64("".join("".join(lines).split()))
            if confirmed_kind(data, as_text=False) or (":" in body and "PRIVATE" in label and data):
                found.append((start, "pem", end))
    blocks = sorted((a, b) for a, _, b in found)
    furthest = list(accumulate((b for _, b in blocks), max))
    for pattern, decode in ((_b64_run, decode64), (_hex_candidate, _unhex)):
        for m in pattern.finditer(text):
            before = bisect_left(blocks, (m.end(),))
            if before and furthest[before - 1] > m.start():
                continue
            if kind := confirmed_kind(decode(m[0])):
                found.append((m.start(), kind, m.end()))
    return found


def _unhex(run: str) -> bytes | None:
    return bytes.fromhex(run) if len(run) % 2 == 0 else None


def scan(text: str) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end), by start, then kind as listed."""
    long_words = {w for w in text.split() if len(w) >= 16}
    found = base_spans(text) if _keyword.search(text) or any("AKIA" in w or _hex_run.search(w) for w in long_words) else []
    if any("eyJ" in w or _b64_run.search(w) or _hex_candidate.search(w) for w in long_words) or "-----BEGIN " in text:
        found += confirmed_spans(text)
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[1]), s[2])) if found else found


# ---------------------------------------------------------------- operators

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in scan(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan_batches, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced; overlapping spans become one."""
    spans = scan(text) if text else []
    if not spans:
        return text
    out, at, end = [], 0, -1
    for start, _, stop in spans:
        if start >= end:
            if end >= 0:
                at = end
            out += [text[at:start], MARK]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, secrets in ``text_col`` replaced; a column n_chars follows the new text."""
    names, at = docs.columns, docs.columns.index(text_col)

    def batches(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                columns = list(part.columns)
                columns[at] = pa.array([redacted(t) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(batches, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.char_length(text_col).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts, a digest of the base spans, all spans."""
    found = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_secret_scan": op10_secret_scan}
SQL: dict[str, str] = {}
