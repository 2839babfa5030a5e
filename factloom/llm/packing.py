"""Best-fit packing by minimum bin slack.

Every document is tokenised, closed with an end id and, only if it is longer
than the capacity, cut into pieces of the capacity (the first piece takes the
remainder).  The pieces are packed by the minimum-bin-slack rule: a bin is
opened with the longest piece left, and a bitset subset-sum dynamic programme
over the lengths still available finds the fullest feasible filling, which is
then removed.

Scale.  Pieces of one length are interchangeable, so the packer needs only the
histogram of lengths: at most ``capacity`` counters, whatever the corpus.  A
filling that fits m times is removed m times at once; each such step at least
halves the count of one length, so there are at most capacity * log2(pieces)
patterns.  That list is the only thing broadcast.  Pieces find their place by
their rank among pieces of their length, made of a rank within the writing
task and a prefix sum over tasks; no length is ever gathered in one task.

Defined results: null text counts as empty (one piece: the end id alone);
equal documents and repeated rows are packed separately; an empty table gives
no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import documents, id_and_text, write_table

CAPACITY = 1024
END_ID = 2
#: Bytes of encoded words kept by a Python worker; beyond it the store starts afresh.
CACHE_BYTES = 96 << 20
#: Characters of the longest word that is kept: text without spaces isn't.
CACHED_WORD = 64
_RANK_BITS = 40


# ---------------------------------------------------------------- tokenising


def vocabulary_path() -> str:
    """The rank file of the byte-level BPE vocabulary (the same ids as byte_bpe_50k.json)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordCachedEncoder:
    """Byte-level BPE ids as little-endian uint32 bytes.

    A single space between two non-space characters always starts a new
    pre-token, so a text is the concatenation of its space-separated chunks,
    and equal chunks have equal ids.  Texts in which a space touches other
    white space are encoded whole.  Short chunks are kept, up to ``CACHE_BYTES``.
    """

    _odd_space = re.compile(r"\A | \Z| \s|\s ")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ordinary = bpe.encode_ordinary
        self._chunks: dict[str, bytes] = {}
        self._held = 0

    def _encode(self, text: str) -> bytes:
        return array("I", self._ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._odd_space.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known = self._chunks
        try:
            tail = b"".join([known[w] for w in rest])
        except KeyError:
            tail = b"".join([known.get(w) or self._new(w) for w in rest])
        return self._encode(first) + tail

    def _new(self, word: str) -> bytes:
        ids = self._encode(" " + word)
        if len(word) <= CACHED_WORD:
            if self._held > CACHE_BYTES:
                self._chunks.clear()
                self._held = 0
            self._chunks[word] = ids
            self._held += sys.getsizeof(word) + sys.getsizeof(ids) + 100
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordCachedEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCachedEncoder(path)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens, with ids, of the JSON file beside a rank file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only added tokens that match as they stand are supported")
    return {t["content"]: t["id"] for t in found}


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> Callable[[str], bytes]:
    """``encoder`` after the text is split at the added tokens, as the tokenizers library does."""
    encode = encoder(path)
    added = {word: array("I", [id_]).tobytes() for word, id_ in added_tokens(path).items()}
    parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def whole(text: str) -> bytes:
        if any(word in text for word in added):
            return b"".join([added.get(part) or encode(part) for part in parts.split(text)])
        return encode(text)

    return whole


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool):
    encode = text_encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                ids = encode(text) + end
                view = memoryview(ids)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(view[4 * s : 4 * (s + n)]))
                    rank.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        kept.append(np.frombuffer(view[4 * s : 4 * (s + n)], dtype="<u4").astype(np.int32))
            columns = [
                part.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([task] * len(rows), pa.int32()),
                pa.array(rank, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


# ------------------------------------------------------- minimum bin slack


def fullest_filling(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    Bitset subset-sum: bit s of ``reach`` says that a sum of s is feasible.
    Counts enter in binary portions.  Lengths enter from long to short and are
    traced back from short to long, so among equal sums the long ones go first.
    """
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in available.items() if n and x <= room), reverse=True):
        left, portion = min(available[length], room // length), 1
        while left:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            portion *= 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if target and not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (lengths with counts, number of equal bins) that use up the histogram."""
    left = {x: n for x, n in histogram.items() if n}
    patterns = []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = fullest_filling(left, capacity - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[x] // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        patterns.append((bin_, times))
    return patterns


def slot_table(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each pattern and length: where the ranks of that length begin, and where they are put."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in patterns:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            rows.append((length << _RANK_BITS | used.get(length, 0), used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    names = ("key", "first", "per_bin", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def _place(batches: Iterator[pa.RecordBatch], slots, names: list[str]):
    table = slots.value
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
        at = np.searchsorted(table["key"], (length << _RANK_BITS) | rank, side="right") - 1
        inside = rank - table["first"][at]
        bin_, slot = np.divmod(inside, table["per_bin"][at])
        columns = [batch.column(n) for n in names]
        columns += [pa.array(table["sequence"][at] + bin_), pa.array(table["offset"][at] + slot * length)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents; one row per piece, with its sequence and its place there.

    ``with_ids`` adds the token ids of each piece as an array column.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema += ", ids array<int>" if with_ids else ""
    cutter = functools.partial(
        _pieces, path=tokenizer_path or vocabulary_path(), capacity=capacity, end_id=end_id, with_ids=with_ids
    )
    pieces, _ = write_table(spark, rows.mapInArrow(cutter, schema), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases, _ = write_table(
        spark, per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))), "packing-bases"
    )
    # One row for each possible length: at most `capacity`.
    histogram = {r["length"]: r["total"] for r in bases.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    slots = spark.sparkContext.broadcast(slot_table(minimum_bin_slack(histogram, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    out = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    out += ", ids array<int>" if with_ids else ""
    joined = pieces.join(bases.select("task", "length", "before"), ["task", "length"])
    return joined.mapInArrow(functools.partial(_place, slots=slots, names=names), out + ", sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
