"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.  The
normalised text is cut into blocks of a fixed number of characters.  Distinct
blocks are sorted and numbered: equal blocks get equal integers, different
blocks different ones.  Then adjacent names are paired, distinct pairs are
sorted and numbered in turn, and so on, until one name is left of each
document.  (number of rounds, name) is equal for two documents exactly when
their normalised texts are.

Blocks travel under a 128-bit sort key, so that texts are shuffled once, as
grouping keys with map-side combining.  The names stay free of collisions
because the shuffle also counts the different blocks under each key; should
there ever be two, the naming starts again with another seed.

Skew: names and group results are written before they are joined to their
occurrences, so that such a join deals both sides anew and adaptive execution
can split a hot one; groups are only aggregated (with partial aggregation),
never collected.

Defined results: null text counts as empty, and empty texts (or texts of white
space only) are one group.  Of equal texts the row with the most code points in
the original text stays, then the smallest doc_id (null ids last), then the row
read first, so of repeated rows one stays.  An empty table gives no rows.
Columns other than id and text are ignored by ``exact_groups`` and passed
through by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, drop_table, numbered, rows_of, write_table

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def _blocks(text: Column, block_chars: int) -> Column:
    """The text in blocks of ``block_chars`` characters; the empty text is one empty block."""
    last = F.greatest(F.lit(0), F.floor((F.char_length(text) - 1) / block_chars)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * block_chars + 1, F.lit(block_chars)))


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def _numbered(spark: SparkSession, distinct: DataFrame, by: list[str], label: str) -> tuple[DataFrame, str]:
    """Sorted and numbered: an integer for each row, written so that it never changes."""
    ordered = distinct.sortWithinPartitions(*by)
    return write_table(spark, ordered.withColumn("name", F.monotonically_increasing_id()), label)


def _named_blocks(spark: SparkSession, rows: DataFrame, block_chars: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(occurrences with the keys of their blocks, names by key, paths written)."""
    for seed in range(64):
        cut = rows.withColumn("block", _blocks(F.col("norm"), block_chars))
        seen = cut.select(
            "_row",
            "doc_id",
            "n_chars",
            F.sha2(F.col("norm"), 256).alias("text_sha256"),
            F.transform("block", lambda b: _key(b, seed)).alias("keys"),  # noqa: B023
        )
        occurrences, path = write_table(spark, seen, "block-keys")
        variants = cut.select(F.explode("block").alias("block")).select(_key(F.col("block"), seed).alias("k"), "block")
        variants = variants.groupBy("k.a", "k.b", "block").agg(F.lit(1).alias("one"))
        distinct = variants.groupBy("a", "b").agg(F.count(F.lit(1)).alias("variants"))
        names, names_path = _numbered(spark, distinct, ["a", "b"], "block-names")
        if names.filter("variants > 1").isEmpty():
            return occurrences, names.select("a", "b", "name"), [path, names_path]
        drop_table(spark, path)
        drop_table(spark, names_path)
    raise RuntimeError("no seed separates the blocks")


def identities(docs: DataFrame, id_col: str, text_col: str, block_chars: int, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences: _row, doc_id, n_chars, text_sha256; identities: _row, level, name)."""
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col, row).select(
        "_row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm")
    )
    occurrences, names, _ = _named_blocks(spark, rows, block_chars)
    placed = occurrences.select("_row", F.size("keys").alias("left"), F.posexplode("keys").alias("pos", "k"))
    placed = placed.select("_row", "left", "pos", "k.a", "k.b").join(names, ["a", "b"]).select("_row", "left", "pos", "name")
    placed, _ = write_table(spark, placed, "named-blocks")
    done = [placed.filter("left = 1").select("_row", F.lit(0).alias("level"), "name")]
    longest = placed.agg(F.max("left")).first()[0] or 0
    level = 0
    while longest > 1:
        level += 1
        halves = placed.filter("left > 1").groupBy("_row", "left", F.floor(F.col("pos") / 2).cast("int").alias("half"))
        pairs = halves.agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("second"),
        )
        pairs, pairs_path = write_table(spark, pairs, "pairs")
        distinct = pairs.groupBy("first", "second").agg(F.lit(1).alias("one")).drop("one")
        names, names_path = _numbered(spark, distinct, ["first", "second"], "pair-names")
        placed = pairs.join(names, ["first", "second"]).select(
            "_row", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("half").alias("pos"), "name"
        )
        placed, _ = write_table(spark, placed, "named-pairs")
        drop_table(spark, pairs_path)
        drop_table(spark, names_path)
        done.append(placed.filter("left = 1").select("_row", F.lit(level).alias("level"), "name"))
        longest = (longest + 1) // 2
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    return occurrences.drop("keys"), found


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, row: str | None = None
) -> DataFrame:
    """One row per input row: _row, doc_id, keep_id, group_size, kept, text_sha256."""
    occurrences, found = identities(docs, id_col, text_col, block_chars, row)
    rows, _ = write_table(docs.sparkSession, occurrences.join(found, "_row"), "identified")
    best = F.struct(
        (-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row").alias("row")
    )
    groups = rows.groupBy("level", "name").agg(F.min(best).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("level", "name", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
    # Written, so that the join deals both sides anew and a large group can be split.
    groups, _ = write_table(docs.sparkSession, groups, "groups")
    return rows.join(groups, ["level", "name"]).select(
        "_row", "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, row = numbered(docs)
    kept = exact_groups(rows, id_col, text_col, row=row).filter("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*(rows[c] for c in docs.columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays."""
    return exact_groups(documents(spark, sf_dir)).drop("_row")


OP4_SQL = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), hashed AS (
  SELECT doc_id, n_chars, sha256(norm) AS text_sha256 FROM norm
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) = 1 AS kept,
       text_sha256
FROM hashed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_exact_dedup": op4_exact_dedup}
SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL}
