"""Command line: analyse a folder, list facts, export verified ones.

    python -m factloom analyze FOLDER OUT
    python -m factloom facts OUT [--status conflict]
    python -m factloom export OUT CSV
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.functions.values import value_key
from factloom.plans.analysis import analyse
from factloom.sources import files, sinks


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyze")
    run.add_argument("folder")
    run.add_argument("out")
    show = commands.add_parser("facts")
    show.add_argument("out")
    show.add_argument("--status")
    export = commands.add_parser("export")
    export.add_argument("out")
    export.add_argument("csv")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "analyze":
        blocks = files.read_blocks(files.discover(spark, asked.folder)).cache()
        done = analyse(files.evidence(blocks))
        tables = {"candidates": done.candidates, "facts": done.groups, "relations": done.relations, "products": done.products, "issues": files.reading_issues(blocks)}
        generation = spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS') as g").first()["g"]
        sinks.write_generation(tables, asked.out, f"run-{generation}")
        return
    facts = sinks.read_generation(spark, asked.out, "facts")
    if asked.command == "facts":
        chosen = facts.filter(F.col("fact_status") == asked.status) if asked.status else facts
        sinks.review_sheet(chosen).select("product_id", "field_label", "scope", "fact_status", "review_reason").show(1000, False)
        return
    products = sinks.read_generation(spark, asked.out, "products").select("product_id", "label")
    verified = facts.filter("fact_status = 'verified'").join(products, "product_id")
    sinks.write_csv(verified.select("label", "field_label", "scope", value_key(F.col("selected_value")).alias("value"), "verification_method"), asked.csv)


if __name__ == "__main__":
    main()
