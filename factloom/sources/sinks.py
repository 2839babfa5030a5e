"""Sinks: tables, exports and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.delivery import safe_cell, status_order


def write_generation(tables: dict[str, DataFrame], root: str, generation: str) -> None:
    """Write all tables of a run into a folder of its own, and name it in the last step; readers follow the name.

    A run that stops before that leaves the former generation in force.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{generation}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def read_generation(spark, root: str, name: str) -> DataFrame:
    current = spark.read.schema("generation string").json(f"{root}/current").first()["generation"]
    return spark.read.parquet(f"{root}/{current}/{name}")


def append_audit(events: DataFrame, path: str) -> None:
    """Audit events are only ever added, and before the decision takes effect."""
    events.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def facts_document(facts: DataFrame) -> DataFrame:
    """One JSON document per product."""
    return facts.groupBy("product_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("field", "scope", "fact_status", "classification", "selected_value")))).alias("document"))


def write_csv(facts: DataFrame, path: str) -> None:
    """Verified facts as CSV, safe for spreadsheets."""
    cells = [safe_cell(F.col(c).cast("string")).alias(c) for c in facts.columns]
    facts.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def review_sheet(groups: DataFrame) -> DataFrame:
    """Conflicts first, then pending, then verified."""
    return groups.orderBy(status_order(F.col("fact_status")), "product_id", "field", "scope")
