"""Delivery: coverage of the reading, readiness, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, unfinished files, issues, and whether the reading is complete."""
    seen = issues.agg(F.count(F.lit(1)).alias("issue_count"), F.count_distinct("file").alias("unfinished_files"))
    total = files.agg(F.count(F.lit(1)).alias("files"))
    status = F.when(F.col("issue_count") > 0, "partial").otherwise("complete")
    return total.crossJoin(seen).withColumn("status", status)  # one row each


def readiness(facts: DataFrame, key: str) -> DataFrame:
    """Per key: verified facts, blockers in order, and complete, partial or blocked."""
    per = facts.groupBy(key).agg(
        F.count_if((F.col("fact_status") == "verified") & F.col("current")).alias("verified_count"), F.count_if(F.col("fact_status") == "conflict").alias("_conflicts"),
        F.count_if(F.col("fact_status") == "pending_confirmation").alias("_pending"), F.count_if(~F.col("current")).alias("_stale"),
    )
    listed = F.array_compact(F.array(
        F.when(F.col("_conflicts") > 0, "conflict"), F.when(F.col("_pending") > 0, "pending"), F.when(F.col("_stale") > 0, "stale"),
        F.when(F.col("verified_count") == 0, "no_verified_facts"),
    ))
    per = per.withColumn("blockers", F.array_join(listed, ","))
    status = F.when(F.col("blockers") == "", "complete").when(F.col("verified_count") > 0, "partial").otherwise("blocked")
    return per.select(key, "verified_count", "blockers", status.alias("delivery_status"))


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet won't run as a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def export_rows(facts: DataFrame, key: list[str], value: str, order: list[Column]) -> DataFrame:
    """The last row of each key; keys with contradictory values are refused (left out, see ``refused``)."""
    by = Window.partitionBy(*key)
    ranked = facts.withColumns({"_n": F.row_number().over(by.orderBy(*order)), "_low": F.min(value).over(by), "_high": F.max(value).over(by)})
    return ranked.filter("_n = 1 and _low = _high").drop("_n", "_low", "_high")


def refused(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    return facts.groupBy(*key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def status_order(c: Column) -> Column:
    """Conflicts first, then pending, then verified."""
    return F.when(c == "conflict", 0).when(c == "pending_confirmation", 1).otherwise(2)


def within_budget(files: DataFrame, group: str, size: str, order: str, budget: int) -> DataFrame:
    """Files read in order while they fit: one that doesn't is skipped and adds nothing, so a later smaller one may fit.

    A fold over each group's files in order; a group is one run's file list, which is bounded (100 files).
    """
    listed = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("_files"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda a, f: F.when(a["used"] + f["s"] <= budget, F.struct((a["used"] + f["s"]).alias("used"), F.concat(a["kept"], F.array(f["o"].cast("string"))).alias("kept"))).otherwise(a)
    folded = listed.select(group, F.aggregate("_files", start, step).alias("_fold"))
    return folded.select(group, F.col("_fold.used").alias("used"), F.size("_fold.kept").alias("files_kept"), F.array_join("_fold.kept", ",").alias("kept"))


def markdown(facts: DataFrame) -> DataFrame:
    """One markdown line per fact, in report order (status, product, field)."""
    escape = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")
    line = F.concat(F.lit("- **"), escape(F.col("field_label")), F.lit("**: "), escape(F.col("shown")), F.lit(" ("), F.col("fact_status"), F.lit(")"))
    return facts.select(line.alias("line"), status_order(F.col("fact_status")).alias("rank"), "product_id", "field").orderBy("rank", "product_id", "field")
