"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and log scores of a model file are read; the normal pieces go into a
double-array trie over UTF-8 bytes (``base``, ``check``, ``value``).  Encoding
finds the segmentation with the greatest sum of scores; a character that no
piece covers costs the least score minus ten and falls back to byte pieces.  Of
equal sums the earliest start of the last piece wins.  White space is marked
with U+2581, with one mark before a non-empty text; decoding turns marks into
spaces, drops the first one and joins byte pieces as UTF-8.

No piece has a mark after another character, so the best segmentation of a text
is that of its marked words, one after the other.  A worker keeps the ids of
words it has met (bounded), and encodes new ones by the hundred: all words of
a size class walk the trie in step, as numpy arrays.  Words of over 64 bytes are
walked one by one.  (A model with such a piece is refused.)

Defined results: null text counts as empty and has no ids; decoding restores
every text without U+2581 that is valid Unicode; repeated rows get equal ids;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import sys
import zlib
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import documents, id_and_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of encoded words kept by a Python worker; beyond it the store starts afresh.
CACHE_BYTES = 160 << 20
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)

_chunks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_long = 64


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file."""
    with open(path, "rb") as f:
        data = f.read()
    pieces = []
    for field, message in _wire(data):
        if field == 1:
            got = dict(_wire(message))
            score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            pieces.append((got.get(1, b"").decode("utf-8"), score, got.get(3, NORMAL)))
    return pieces


class DoubleArrayTrie:
    """State s goes over byte c to t = base[s] + c + 1 if check[t] == s; value[t] is a key's number or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: dict = {}
        for key, value in zip(keys, values, strict=True):
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        work, hole, top = [(tree, 0)], 257, 257  # below 257 not every byte could reach
        while work:
            node, state = work.pop()
            value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            while used[hole]:
                hole += 1
            # A single child fills the first hole; several look for room near the top.
            at = (hole if len(codes) == 1 else max(hole, top - 512)) - codes[0] - 1
            while True:
                if at + 260 >= size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    used += bytes(size)
                    size *= 2
                if not any(used[at + c + 1] for c in codes):
                    break
                at += 1
            base[state] = at
            for c in codes:
                t = at + c + 1
                used[t], check[t], top = 1, state, max(top, t)
                work.append((node[c], t))
        self.base = np.array(base + [0] * 512, dtype=np.int32)
        self.check = np.array(check + [-1] * 512, dtype=np.int32)
        self.value = np.array(value + [-1] * 512, dtype=np.int32)


class Codec:
    """Pieces, trie and fallback of a model; plain arrays, so that it can be broadcast."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        normal = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for p, _ in normal):
            raise ValueError("a piece has a mark inside")
        self.trie = DoubleArrayTrie([p.encode("utf-8") for p, _ in normal], [i for _, i in normal])
        self.scores = np.array([s for _, s, _ in pieces], dtype=np.float64)
        self.unknown_score = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        self.text = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            else:
                self.text.append(b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode("utf-8"))

        self.known: dict[str, bytes] = {}
        self.held = 0
        self._as_lists: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "_as_lists": None}

    # ------------------------------------------------------------ encoding

    def _trace(self, word: bytes, length_at, id_at) -> bytes:
        """Ids from the best last piece of every position."""
        ids, at = [], len(word)
        while at:
            n, piece = int(length_at[at]), int(id_at[at])
            if piece >= 0:
                ids.append(piece)
            elif (self.byte_ids >= 0).all():
                ids += [int(self.byte_ids[b]) for b in reversed(word[at - n : at])]
            else:
                ids.append(self.unknown_id)
            at -= n
        ids.reverse()
        return array("I", ids).tobytes()

    def _one(self, word: bytes) -> bytes:
        base, check, value, scores = self._lists()
        n = len(word)
        best, length_at, id_at = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if word[i] & 0xC0 == 0x80:
                continue
            first = word[i]
            char = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, covered = 0, False
            for j in range(i, n):
                t = base[state] + word[j] + 1
                if check[t] != state:
                    break
                state = t
                piece = value[t]
                if piece >= 0:
                    covered |= j + 1 - i == char
                    if (s := best[i] + scores[piece]) > best[j + 1]:
                        best[j + 1], length_at[j + 1], id_at[j + 1] = s, j + 1 - i, piece
            if not covered and best[i] + self.unknown_score > best[min(n, i + char)]:
                end = min(n, i + char)
                best[end], length_at[end], id_at[end] = best[i] + self.unknown_score, end - i, -1
        return self._trace(word, length_at, id_at)

    def _lists(self):
        if self._as_lists is None:
            t = self.trie
            self._as_lists = (t.base.tolist(), t.check.tolist(), t.value.tolist(), self.scores.tolist())
        return self._as_lists

    def _many(self, words: list[bytes], width: int) -> list[bytes]:
        """All words (of up to ``width`` bytes) in step."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        sizes = np.array([len(w) for w in words])
        byte = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width).astype(np.int32)
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0
        length_at = np.zeros((len(words), width + 1), dtype=np.int32)
        id_at = np.full((len(words), width + 1), -1, dtype=np.int32)
        for i in range(width):
            rows = np.flatnonzero((sizes > i) & (byte[:, i] & 0xC0 != 0x80))
            if not len(rows):
                continue
            first = byte[rows, i]
            end = np.minimum(i + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0), sizes[rows])
            covered = np.zeros(len(words), dtype=bool)
            at, state, ends = rows, np.zeros(len(rows), dtype=np.int32), end
            for j in range(i, width):
                t = base[state] + byte[at, j] + 1
                go = (check[t] == state) & (sizes[at] > j)
                at, state, ends = at[go], t[go], ends[go]
                if not len(at):
                    break
                piece = value[state]
                held = piece >= 0
                covered[at[held & (ends == j + 1)]] = True
                hit, piece = at[held], piece[held]
                score = best[hit, i] + self.scores[piece]
                better = score > best[hit, j + 1]
                hit, piece = hit[better], piece[better]
                best[hit, j + 1], length_at[hit, j + 1], id_at[hit, j + 1] = score[better], j + 1 - i, piece
            bare = ~covered[rows]
            rows, end = rows[bare], end[bare]
            score = best[rows, i] + self.unknown_score
            better = score > best[rows, end]
            rows, end = rows[better], end[better]
            best[rows, end], length_at[rows, end], id_at[rows, end] = score[better], end - i, -1
        lengths, ids = length_at.tolist(), id_at.tolist()
        return [self._trace(w, a, b) for w, a, b in zip(words, lengths, ids, strict=True)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encode words that aren't known yet, and keep them; returns the long ones, which aren't kept."""
        long: dict[str, bytes] = {}
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "replace")
            if len(raw) > _long:
                long[w] = self._one(raw)
            else:
                classes.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, members in classes.items():
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                for (w, _), ids in zip(part, self._many([r for _, r in part], width), strict=True):
                    self.known[w] = ids
                    self.held += sys.getsizeof(w) + sys.getsizeof(ids) + 100
        return long

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32 bytes."""
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
                split.append(_chunks.findall(MARK + text.replace(" ", MARK)))
            else:
                split.append((MARK + text.replace(" ", " " + MARK)).split(" "))
        out: list[bytes] = []
        for at in range(0, len(split), 64):
            part = split[at : at + 64]
            new = {w for words in part for w in words if w not in self.known}
            found = self.known
            if new:
                if self.held > CACHE_BYTES:
                    self.known.clear()
                    self.held = 0
                    new = {w for words in part for w in words}
                if long := self.learn(new):
                    found = ChainMap(long, self.known)
            out += [b"".join([found[w] for w in words]) for words in part]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    # ------------------------------------------------------------ decoding

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_pieces(path))


# ---------------------------------------------------------------- operators


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path or model_path()))

    def batches(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = shared.value.encode_batch(part.column("text").to_pylist())
                ids = pa.array([np.frombuffer(f, dtype="<u4").astype(np.int32) for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec(path or model_path()))

    def batches(source: Iterator[pa.RecordBatch]):
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [shared.value.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, n_ids, n_byte_ids, ids_crc32, decoded_sha256, lossless."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path or model_path()))

    def batches(source: Iterator[pa.RecordBatch]):
        is_byte = np.zeros(len(shared.value.scores), dtype=bool)
        is_byte[shared.value.byte_ids[shared.value.byte_ids >= 0]] = True
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                n_ids, n_bytes, crc, sha, same = [], [], [], [], []
                for text, raw in zip(texts, shared.value.encode_batch(texts), strict=True):
                    ids = np.frombuffer(raw, dtype="<u4")
                    back = shared.value.decode(ids.tolist())
                    n_ids.append(len(ids))
                    n_bytes.append(int(is_byte[ids].sum()))
                    crc.append(zlib.crc32(raw))
                    sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                    same.append(back == text)
                columns = [pa.array(n_ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "lossless"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        batches, f"doc_id {kind}, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces and decoded again."""
    return round_trips(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
