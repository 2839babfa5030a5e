"""Suffix-array deduplication: remove every byte of a string of N bytes that also starts elsewhere.

The suffix order of a whole corpus is cut into independent shards.  A content
anchor (the least hash of 64 bytes) is chosen in every window of N bytes, so
equal windows have the same anchor at the same place; a run of windows with one
anchor is a context.  Windows can only be equal below the same anchor, so each
anchor's contexts are a part of the suffix array that can be sorted alone.

1. Count contexts by (anchor, context).  Anchors met once are done: their windows
   occur nowhere else.  A context met more than once is repeated as a whole, and
   one copy of it stands for all in what follows.  Contexts travel under digests;
   that equal digests mean equal bytes is proved by counting the different bytes
   of all that was met more than once.  Should two ever share a digest, all
   starts again with another one.
2. Contexts of an anchor with several different ones go to the shard of their
   anchor, where ``induced`` sorts their suffixes by recursive external
   induction.  Neighbours whose carried common prefix reaches N are repeats.  A
   shard is sorted in portions of whole anchors.
3. An anchor with more than ``HOT_CONTEXTS`` different contexts is parted: a
   window reaches half of the free bytes beyond the anchor either to its left or
   to its right, so that longer anchor, and the windows that have it, is a part
   of its own, treated like step 1.  Parts are parted again until they are small;
   after at most eight times an anchor is a whole window, and equal windows are
   one context.  So a shard is bounded whatever the corpus repeats.
4. The found runs are united per document, and the rest is kept.

Defined results: texts are bytes of UTF-8; null counts as empty; matches never
cross documents, overlaps count, and strings are judged on the input; repeated
rows are copies of each other; texts under N bytes are kept; an empty table
gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, drop_table, rows_of, write_table
from factloom.llm.induced import Shard

WINDOW = 200
ANCHOR = 64
#: Different contexts of one anchor in one shard; an anchor with more is parted.
HOT_CONTEXTS = 512
SEEDS = 16
#: Bits of the digests of contexts; tests lower those of the first attempt.
FIRST_DIGEST_BITS = DIGEST_BITS = 64
SHARD_BYTES = 1 << 20  # what is sorted at once; small enough for a core's cache
_SEGMENT = 1 << 16  # bytes looked at together: small enough for a core's cache
_MULTIPLIER = 0x9E3779B97F4A7C15


# -------------------------------------------------------------- hashing


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    p = _MULTIPLIER if not seed else int(_mix(np.array([seed], dtype=np.uint64))[0]) | 5
    out = []
    for q in (p, pow(p, -1, 1 << 64)):
        powers = np.full(_SEGMENT + 4096, np.uint64(q))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return tuple(out)


class Rolling:
    """Digests of any stretch of a buffer."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        powers, self._inverse = _powers(seed)
        values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER), seed + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self._sums[start + length] - self._sums[start]) * self._inverse[start]


# -------------------------------------------------------------- anchors


def _context_digest(rolling: Rolling, first, last, at, length, window: int, bits: int) -> np.ndarray:
    """Of the bytes of a run of windows and of where its anchor lies."""
    shape = ((last - first) << 16 | (at - first) << 8 | length).astype(np.uint64)
    return _mix(rolling.of(first, last - first + window) ^ _mix(shape, 3), 5) >> np.uint64(64 - bits)


def anchored_runs(data: np.ndarray, doc: np.ndarray, window: int, anchor: int, seed: int = 0, bits: int = DIGEST_BITS) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor place, anchor digest, context digest) of every run of windows with one anchor.

    ``doc`` numbers the text of each byte; windows don't cross texts.
    """
    none = np.zeros(0, dtype=np.int64)
    n, span = len(data) - window + 1, window - anchor + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(data, seed)
    places = np.arange(len(data) - anchor + 1)
    digest = _mix(rolling.of(places, anchor))
    value = (digest >> np.uint64(24) << np.uint64(24)) | places.astype(np.uint64)
    full = -len(value) % span
    blocks = np.append(value, np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = doc[:n] == doc[window - 1 :]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.r_[True, (place[starts[1:]] != place[starts[:-1]]) | (np.diff(starts) != 1)]
    first = starts[new]
    last = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    at = place[first]
    context = _context_digest(rolling, first, last, at, anchor, window, bits)
    return first, last, at, digest[at], context


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text of each byte, begin of each part in the buffer, number to add to get its place in its text)."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def out():
        sizes = np.array([len(p[2]) for p in parts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        part = np.repeat(np.arange(len(parts)), sizes)
        return data, part, np.array([p[0] for p in parts]), np.array([p[1] for p in parts]) - starts

    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), _SEGMENT // 2):
            piece = t[at : at + _SEGMENT // 2 + window - 1]
            if len(piece) < window:
                continue
            if held + len(piece) > _SEGMENT:
                yield out()
                parts, held = [], 0
            parts.append((k, at, piece))
            held += len(piece)
    if parts:
        yield out()


def _encoded(texts: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


# A place packs a context: first window << 24 | last - first << 16 | anchor - first << 8 | bytes of the anchor.


def _unpacked(place):
    return place >> 24, place >> 16 & 0xFF, place >> 8 & 0xFF, place & 0xFF


def _run_batch(row, place, a, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(map(pa.array, (row, place, a.view(np.int64), c.view(np.int64)))), names=["_row", "place", "a", "c"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, seed: int, bits: int):
    """The runs of all texts: _row, place, a, c."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = part.column("_row").to_numpy()
            for data, doc, text, shift in _segments(_encoded(part.column("text")), window):
                first, last, anchor, a, c = anchored_runs(data, doc, window, ANCHOR, seed, bits)
                if len(first):
                    of = doc[first]
                    yield _run_batch(rows[text[of]], (first + shift[of]) << 24 | (last - first) << 16 | (anchor - first) << 8 | ANCHOR, a, c)


def halves(first, span, off, length, window: int) -> list[tuple[np.ndarray, ...]]:
    """Contexts parted by longer anchors: (which, side, first, span, off, length) of those that reach to the right, and to the left."""
    slack = window - length
    half = slack // 2
    right = np.maximum(0, off - half), np.minimum(span, off)  # windows that begin at most `half` before the anchor
    left = np.zeros_like(off), np.minimum(span, off - half - 1)
    out = []
    for side, (low, high), begin, size in ((0, right, off, length + slack - half), (1, left, off - half - 1, length + half + 1)):
        which = np.flatnonzero((low <= high) & (slack > 0))
        low, high = low[which], high[which]
        out.append((which, side, first[which] + low, high - low, begin[which] - low, size[which]))
    return out


def _parted(batches: Iterator[pa.RecordBatch], window: int, seed: int, bits: int):
    """The contexts of anchors with too many of them, by longer anchors: _row, place, a, c."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for r, text, edges in zip(part.column("_row").to_pylist(), _encoded(part.column("text")), part.column("edges").to_pylist(), strict=True):
                hot = [(e["place"], e["a"]) for e in edges if e["hot"]]
                for k in range(0, len(hot), 4096):
                    place, a = (np.array(x, dtype=np.int64) for x in zip(*hot[k : k + 4096], strict=True))
                    first, span, off, length = _unpacked(place)
                    # Only the contexts' bytes, one after the other.
                    sizes = span + window
                    starts = np.cumsum(sizes) - sizes
                    for low in range(0, len(place), 128):
                        some = slice(low, low + 128)
                        data = np.frombuffer(b"".join([text[f : f + n] for f, n in zip(first[some].tolist(), sizes[some].tolist(), strict=True)]), np.uint8)
                        shift = starts[some] - starts[low]
                        rolling = Rolling(data, seed)
                        for which, side, f, s, o, n in halves(shift, span[some], off[some], length[some], window):
                            if not len(which):
                                continue
                            digest = rolling.of(f + o, n) ^ _mix(a[some][which].view(np.uint64), 7 + side)
                            c = _context_digest(rolling, f, f + s, f + o, n, window, bits)
                            real = f - shift[which] + first[some][which]
                            yield _run_batch(np.full(len(f), r), real << 24 | s << 16 | o << 8 | n, _mix(digest), c)


# -------------------------------------------------------------- contexts


def _cut(parts: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 4 << 20):
    """Rows (the last value: bytes) in batches of a few megabytes."""
    held, size = [], 0
    for row in parts:
        held.append(row)
        size += len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _contexts(batches: Iterator[pa.RecordBatch], window: int):
    """The bytes of each context that has to be sorted."""

    def parts():
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for r, text, edges in zip(part.column("_row").to_pylist(), _encoded(part.column("text")), part.column("edges").to_pylist(), strict=True):
                    for e in edges:
                        if not e["hot"]:
                            first, span, _, _ = _unpacked(e["place"])
                            yield r, e["a"], first, text[first : first + span + window]

    return _cut(parts(), ["_row", "a", "first", "context"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def _copies(batches: Iterator[pa.RecordBatch], window: int):
    """What tells contexts met more than once apart: anchor, shape and bytes; those of one batch once."""

    def parts():
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, seen = batch.slice(at, 512), set()
                for text, whole in zip(_encoded(part.column("text")), part.column("whole").to_pylist(), strict=True):
                    for e in whole:
                        first, span, _, _ = _unpacked(e["place"])
                        key = e["a"], e["place"] & 0xFFFFFF, text[first : first + span + window]
                        if key not in seen:
                            if len(seen) == 50_000:
                                seen.clear()
                            seen.add(key)
                            yield key

    return _cut(parts(), ["a", "shape", "context"], [pa.int64(), pa.int64(), pa.binary()])


def _runs_of(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches covered by the windows that begin at sorted ``starts``."""
    if not len(starts):
        return starts, starts
    new = np.r_[True, np.diff(starts) > window]
    first = starts[new]
    last = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    return first, last + window


def _sorted_shards(batches: Iterator[pa.RecordBatch], window: int):
    """Contexts ordered by anchor -> stretches (_row, start, end) that also occur elsewhere."""
    shard, rows, firsts, anchor = Shard(), [], [], None

    def out():
        row, start, end = [], [], []
        for r, first, hits in zip(rows, firsts, shard.repeated(window), strict=True):
            for s, e in zip(*_runs_of(hits, window), strict=True):
                row.append(r)
                start.append(first + int(s))
                end.append(first + int(e))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, start, end)], names=["_row", "start", "end"])

    for batch in batches:
        for r, a, first, context in zip(*(batch.column(c).to_pylist() for c in ("_row", "a", "first", "context")), strict=True):
            if shard.bytes >= SHARD_BYTES and a != anchor:
                yield out()
                shard, rows, firsts = Shard(), [], []
            shard.add(context)
            rows.append(r)
            firsts.append(first)
            anchor = a
    if rows:
        yield out()


# -------------------------------------------------------------- removal


def united(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


def _kept(batches: Iterator[pa.RecordBatch], window: int, with_text: bool):
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            whole, found = part.column("whole").to_pylist(), part.column("found").to_pylist()
            for text, places, stretches in zip(_encoded(part.column("text")), whole, found, strict=True):
                starts = [p >> 24 for p in places or ()] + [s["start"] for s in stretches or ()]
                ends = [(p >> 24) + (p >> 16 & 0xFF) + window for p in places or ()] + [s["end"] for s in stretches or ()]
                runs = united(starts, ends)
                digest, end, rest = hashlib.sha256(), 0, []
                for s, e in [*runs, (len(text), len(text))]:
                    digest.update(text[end:s])
                    if with_text:
                        rest.append(text[end:s])
                    end = e
                values = len(text), sum(e - s for s, e in runs), len(runs), digest.hexdigest(), [{"start": s, "end": e} for s, e in runs], b"".join(rest)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans, pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)][: 6 if with_text else 4]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *names[: len(arrays)]])


def _clean_up(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _met(spark: SparkSession, runs: DataFrame) -> tuple[DataFrame, int, int, list[str]]:
    """(runs whose anchor was met more than once, with n and kinds; contexts met more than once; most kinds of an anchor; tables)."""
    seen = runs.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"))
    per_anchor = seen.groupBy("a").agg(F.sum("n").alias("met"), F.count(F.lit(1)).alias("kinds")).filter("met > 1").drop("met")
    repeated, repeated_path = write_table(spark, seen.join(per_anchor, "a"), "repeated-contexts")
    del seen, per_anchor
    _clean_up(spark)
    met, met_path = write_table(spark, runs.join(repeated, ["a", "c"]), "repeated-places")
    sums = repeated.agg(F.count_if(F.col("n") > 1).alias("keys"), F.max("kinds").alias("kinds")).first()
    return met, sums["keys"], sums["kinds"] or 0, [repeated_path, met_path]


def _marked(spark: SparkSession, texts: DataFrame, met: DataFrame) -> tuple[DataFrame, str]:
    """Texts with marks: whole (contexts met more than once) and edges (what is to be sorted, one copy of each)."""
    edge = F.struct("a", "place", (F.col("kinds") > HOT_CONTEXTS).alias("hot"))
    whole = F.when(F.col("n") > 1, F.struct("place", "a"))
    own = met.select("_row", whole.alias("whole"), F.when((F.col("n") == 1) & (F.col("kinds") > 1), edge).alias("edge"))
    one = met.filter("n > 1 and kinds > 1").groupBy("a", "c").agg(F.min(F.struct("_row", "place", "kinds")).alias("one")).select("a", "one.*")
    one = one.select("_row", F.lit(None).cast(own.schema["whole"].dataType).alias("whole"), edge.alias("edge"))
    marks = own.unionByName(one).groupBy("_row").agg(F.collect_list("whole").alias("whole"), F.collect_list("edge").alias("edges"))
    return write_table(spark, texts.join(marks, "_row"), "marked")


def _proved(marked: DataFrame, keys: int, window: int) -> bool:
    """Whether the contexts met more than once have as many different bytes as digests."""
    schema = "a long, shape long, context binary"
    different = marked.filter(F.size("whole") > 0).select("text", "whole").mapInArrow(functools.partial(_copies, window=window), schema)
    return different.groupBy("a", "shape", "context").agg(F.lit(1).alias("one")).count() == keys


def _repeats(rows: DataFrame, window: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """(marked texts, stretches found besides whole contexts); None if two contexts share a digest."""
    spark = rows.sparkSession
    options = {"window": window, "seed": seed, "bits": DIGEST_BITS if seed else FIRST_DIGEST_BITS}
    run = "_row long, place long, a long, c long"
    runs = rows.select("_row", "text").mapInArrow(functools.partial(_anchor_rows, **options), run)
    levels, wholes, texts = [], [], rows
    while True:
        met, keys, kinds, paths = _met(spark, runs)
        marked, path = _marked(spark, texts, met)
        for p in paths:
            drop_table(spark, p)
        if levels:
            drop_table(spark, runs_path)
        del met, runs
        _clean_up(spark)
        levels.append((marked, path))
        if not _proved(marked, keys, window):
            for _, p in levels:
                drop_table(spark, p)
            return None
        if len(levels) > 1:
            place = marked.select("_row", F.explode("whole.place").alias("p"))
            start = F.shiftright("p", 24)
            wholes.append(place.select("_row", start.alias("start"), (start + F.shiftright("p", 16).bitwiseAND(F.lit(255)) + window).alias("end")))
        if kinds <= HOT_CONTEXTS:
            break
        hot = marked.filter(F.exists("edges", lambda e: e["hot"]))
        runs, runs_path = write_table(spark, hot.select("_row", "text", "edges").mapInArrow(functools.partial(_parted, **options), run), "parted")
        texts = hot.select("_row", "text")
    cutter = functools.partial(_contexts, window=window)
    contexts = None
    for marked, _ in levels:
        sortable = marked.filter(F.exists("edges", lambda e: ~e["hot"])).select("_row", "text", "edges")
        cut = sortable.mapInArrow(cutter, "_row long, a long, first long, context binary")
        contexts = cut if contexts is None else contexts.unionByName(cut)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = contexts.repartition(tasks, "a").sortWithinPartitions("a")
    stretches = shards.mapInArrow(functools.partial(_sorted_shards, window=window), "_row long, start long, end long")
    for more in wholes:
        stretches = stretches.unionByName(more)
    found = stretches.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    found, _ = write_table(spark, found, "stretches")
    for _, path in levels[1:]:
        drop_table(spark, path)
    return levels[0][0], found


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the removed spans and the bytes kept."""
    if not ANCHOR < window <= 255:
        raise ValueError(f"the window must have {ANCHOR + 1} to 255 bytes")
    rows = rows_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = next((x for x in (_repeats(rows, window, seed) for seed in range(SEEDS)) if x), None)
    if got is None:
        raise RuntimeError("no digest separates the contexts")
    marked, found = got
    has_edges = F.size("edges") > 0
    marked = marked.withColumn("whole", F.col("whole.place"))

    columns = ["doc_id", "text", "whole"]
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("found")
    simple = marked.filter(~has_edges).select(*columns, empty)
    joined = marked.filter(has_edges).join(found, "_row", "left").select(*columns, "found")
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out += ", spans array<struct<start:bigint,end:bigint>>, kept binary" if with_text else ""
    cut = simple.unionByName(joined).mapInArrow(functools.partial(_kept, window=window, with_text=with_text), out)
    # Documents without any mark are whole; of them only the digest is shuffled.
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")]
    whole.append(F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
    if with_text:
        whole += [F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.encode("text", "UTF-8").alias("kept")]
    untouched = rows.select("_row", "doc_id", *whole).join(marked.select("_row"), "_row", "left_anti").drop("_row")
    return cut.unionByName(untouched)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur more than once."""
    return remove_repeats(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_suffix_dedup": op3_suffix_dedup}
SQL: dict[str, str] = {}
