"""SimHash near-deduplication over a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of a few
words (repeats included), XXH64 with seed 42; a bit is 1 if it is set in over
half the hashes.  A text with fewer words is one shingle, a text without words
has fingerprint zero.  Distinct fingerprints link at a few differing bits.

Index.  The top of the index holds masked bit patterns: the 64 bits in four
parts; two fingerprints that differ in at most two bits agree in at least two
whole parts, so each fingerprint hangs below six patterns of 32 fixed bits.  A
pattern with more than ``SPLIT_OVER`` fingerprints is split the same way once
more over its 32 free bits (48 bits are then fixed, so such a group has at most
2**16 fingerprints, whatever the corpus).  Below a pattern the fingerprints are
sorted by Gray rank; every eight neighbours get a node that holds the bits they
share and their parents don't.  A search adds up the differences on its way
down and drops a whole group once they exceed the limit.  A group gives a
forest of links (linear in its size), never all its pairs.

Components are then found by alternating large-star and small-star steps over
written tables, until nothing changes.  All of this runs on distinct
fingerprints; copies only meet again in joins and partial aggregations.

Defined results: null text counts as empty; repeated rows share a component;
null ids are never a component's id unless all its ids are null; an empty table
gives no rows; columns other than id and text are ignored by
``near_duplicates`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, drop_table, numbered, rows_of, write_table

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
FANOUT = 8
SPLIT_OVER = 512
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ------------------------------------------------------------- fingerprints


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(hashes) < 200:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, chunk: int = 1 << 16) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only [\x20\x09-\x0D]
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, chunk):
        m = min(chunk, n - at)
        parts = [words[at + k : at + k + m] for k in range(shingle_words)] if len(words) >= shingle_words else None
        shingles = map(b" ".join, zip(*parts, strict=True)) if parts else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=m)
        ones += bit_counts(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int, keep: list[str]):
    for batch in batches:
        texts = batch.column("text")
        found = np.empty(batch.num_rows, dtype=np.uint64)
        for at in range(0, batch.num_rows, 512):
            for k, text in enumerate(texts.slice(at, 512).to_pylist()):
                found[at + k] = fingerprint(text, shingle_words)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found.view(np.int64))], names=[*keep, "fp"])


# -------------------------------------------------------- Gray-order index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Groups of fingerprints, each in Gray order under a tree of shared bits."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        """fps: uint64; groups: number of each one's group, from 0, without gaps."""
        self.order = np.lexsort((gray_rank(fps), groups))
        self.fps, group = fps[self.order], groups[self.order]
        self.root = group
        shared = np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF))
        last = np.arange(len(fps))
        #: From the leaves up: (bits, where they are shared, first child, last row below).
        self.levels = [(self.fps, shared, None, last)]
        all_, any_ = self.fps, self.fps
        while len(group) > (group[-1] + 1 if len(group) else 0):
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
            first = np.flatnonzero(place % fanout == 0)
            all_, any_ = np.bitwise_and.reduceat(all_, first), np.bitwise_or.reduceat(any_, first)
            last = last[np.r_[first[1:], len(group)] - 1]
            group = group[first]
            self.levels.append((all_, ~(all_ ^ any_), np.r_[first, len(place)], last))

    def pairs(self, max_bits: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, later row) of one group that differ in at most ``max_bits`` bits, as rows of the input."""
        top = len(self.levels) - 1
        for at in range(0, len(self.fps), 4096):
            query = np.arange(at, min(at + 4096, len(self.fps)))
            work = [(top, query, self.root[query], np.zeros(len(query), dtype=np.uint8))]
            while work:
                level, query, node, differ = work.pop()
                if level == 0:
                    if len(query):
                        yield self.order[query], self.order[node]
                    continue
                _, above, first, _ = self.levels[level]
                size = first[node + 1] - first[node]
                if len(query) > 1 and size.sum() > most:
                    half = len(query) // 2
                    work += [(level, query[s], node[s], differ[s]) for s in (slice(half, None), slice(None, half))]
                    continue
                parent = np.repeat(np.arange(len(node)), size)
                child = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size) + first[node][parent]
                bits, shared, _, last = self.levels[level - 1]
                later = last[child] > query[parent]
                parent, child = parent[later], child[later]
                new = shared[child] & ~above[node[parent]]
                sums = differ[parent] + np.bitwise_count((self.fps[query[parent]] ^ bits[child]) & new)
                near = sums <= max_bits
                work.append((level - 1, query[parent[near]], child[near], sums[near]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], rank: np.ndarray) -> np.ndarray:
    """For each of n rows, the row of least rank that it is connected with."""
    label = np.argsort(np.argsort(rank, kind="stable"), kind="stable")
    row_of = np.argsort(label, kind="stable")
    root = np.arange(n)  # over labels

    def lowered(root: np.ndarray) -> np.ndarray:
        while True:
            up = root[root]
            if (up == root).all():
                return root
            root = up

    for a, b in pairs:
        a, b = label[a], label[b]
        while True:
            root = lowered(root)
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
    return row_of[lowered(root)[label]]


def _group_links(fps: np.ndarray, keys: list[np.ndarray], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(len(fps), dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    unsigned = fps.view(np.uint64)
    index = GrayIndex(unsigned, np.cumsum(change))
    to = forest(len(fps), index.pairs(max_bits), fps)
    moved = np.flatnonzero(fps[to] != fps)
    return fps[moved], fps[to[moved]]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, at_once: int = 200_000):
    """Batches sorted by (mask, pattern), each group whole in this task."""
    kept: list[np.ndarray] = []

    def out(mask, pattern, fp):
        return pa.RecordBatch.from_arrays(list(map(pa.array, _group_links(fp, [mask, pattern], max_bits))), names=["u", "v"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "pattern", "fp")]
        kept = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
        if len(kept[0]) >= at_once:
            same = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end:
                yield out(*(x[:end] for x in kept))
                kept = [x[end:] for x in kept]
    if kept and len(kept[0]):
        yield out(*kept)


def _two_of_four(bits: list[int]) -> list[int]:
    """Masks of two of the four quarters of ``bits``."""
    step = len(bits) // 4
    quarters = [sum(1 << b for b in bits[k * step : (k + 1) * step]) for k in range(4)]
    return [a | b for a, b in combinations(quarters, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: mask -> the masks that split it further
MASKS = {m: [m | s for s in _two_of_four([b for b in range(64) if not m >> b & 1])] for m in _two_of_four(list(range(64)))}


def _under(rows: DataFrame, masks: list[int]) -> DataFrame:
    of = F.array(*[F.lit(_signed(m)) for m in masks])
    return rows.select("fp", F.explode(of).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links (u, v) that connect what lies within ``max_bits`` (at most 2) bits; a forest for each pattern."""
    if max_bits > 2:
        raise ValueError("the patterns are complete for at most 2 differing bits")
    keyed = _under(distinct, list(MASKS))
    sizes = keyed.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    candidates = keyed.join(sizes, ["mask", "pattern"])
    cold = candidates.filter(F.col("n") <= split_over).select("fp", "mask", "pattern")
    hot = candidates.filter(F.col("n") > split_over)
    split = None
    for mask, below in MASKS.items():
        part = _under(hot.filter(F.col("mask") == _signed(mask)).select("fp"), below)
        split = part if split is None else split.unionAll(part)
    rows = cold.unionAll(split.select("fp", "mask", "pattern"))
    grouped = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return grouped.mapInArrow(functools.partial(_links, max_bits=max_bits), "u long, v long")


# -------------------------------------------------------------- components


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (u, v)."""

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = write_table(spark, now, "edges")
    before, seen = None, mark(now)
    while seen != before and seen[0]:
        after, after_path = write_table(spark, small_star(large_star(now)), "edges")
        drop_table(spark, path)
        now, path, before, seen = after, after_path, seen, mark(after)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, row: str | None) -> DataFrame:
    rows = rows_of(docs, id_col, text_col, row)
    kind = rows.schema["doc_id"].dataType.simpleString()
    make = functools.partial(_fingerprints, shingle_words=shingle_words, keep=["_row", "doc_id"])
    found, _ = write_table(docs.sparkSession, rows.mapInArrow(make, f"_row long, doc_id {kind}, fp long"), "fingerprints")
    return found


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    row: str | None = None,
) -> DataFrame:
    """One row per input row: _row, doc_id, fingerprint, component_id, kept (one row of each component)."""
    spark = docs.sparkSession
    found = _fingerprinted(docs, id_col, text_col, shingle_words, row)
    roots = components(spark, links(found.select("fp").distinct(), max_bits))
    labelled = found.join(roots, found["fp"] == roots["node"], "left")
    labelled = labelled.select("_row", "doc_id", "fp", F.coalesce("root", "fp").alias("component"))
    labelled, _ = write_table(spark, labelled, "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row").alias("row"))).alias("first")
    groups = labelled.groupBy("component").agg(first)
    groups = groups.select("component", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    groups, _ = write_table(spark, groups, "groups")  # so that the join can split a large component
    return labelled.join(groups, "component").select(
        "_row",
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("_row") == F.col("first_row")).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the first of each component."""
    rows, row = numbered(docs)
    kept = near_duplicates(rows, id_col, text_col, row=row).filter("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*(rows[c] for c in docs.columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its near-duplicate component."""
    return near_duplicates(documents(spark, sf_dir)).drop("_row", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
