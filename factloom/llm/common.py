"""Shared plumbing of the corpus operators: inputs, written tables, texts.

Cutting lineage: ``write_table`` stores a DataFrame as Parquet below the folder
named by ``spark.checkpoint.dir`` and reads it back, so a lost executor costs a
re-read, never a recomputation with other partitions.  Only where that setting
is unset (tests, notebooks) a folder is chosen here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts call white space: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "/tmp/checkpoints"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_table(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return it as read back, and its path."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator needs; other columns cannot clash. Null text counts as empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def rows_of(docs: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    """_row, doc_id, text.  ``row`` names the numbers of ``docs`` that is numbered already (by ``numbered``)."""
    known = docs.select(*([docs[row]] if row else []), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    if not row:
        known, row = numbered(known)
    return known.select(known[row].alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether the plan only reads files (or literal rows), in one order each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith(("LogicalRelation", "Relation", "LocalRelation"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that stays the row's own however often the plan runs, and the name of that column.

    Rows are numbered in reading order.  What isn't a plain scan is written first.
    The name is one that ``docs`` doesn't have.
    """
    row = "_factloom_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    if not _is_plain_scan(docs):
        docs, _ = write_table(docs.sparkSession, docs, "rows")
    return docs.withColumn(row, F.monotonically_increasing_id()), row
