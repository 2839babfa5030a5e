"""Scoring results against expected rows; nothing here uses the normaliser."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(rows: DataFrame, key: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 per key; shares are 0 where nothing counts."""
    flags = rows.select(*key, truth.alias("_t"), predicted.alias("_p"))
    c = lambda t, p: F.count_if((F.col("_t") == t) & (F.col("_p") == p))
    per = (flags.groupBy(*key) if key else flags.groupBy()).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    per = per.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.withColumn("f1", F.round(f1, 6)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def missing_and_unexpected(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Multiset differences both ways, with a column side."""
    left = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return left.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def match_equal(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """One-to-one matches of rows with equal keys: the n-th of one side to the n-th of the other."""
    n = lambda d, i, out: d.select(*key, F.col(i).alias(out), F.row_number().over(Window.partitionBy(*key).orderBy(i)).alias("_n"))
    return n(expected, "id", "expected_id").join(n(actual, "id", "actual_id"), [*key, "_n"]).drop("_n")


def maximum_matching(pairs: DataFrame, group: str) -> DataFrame:
    """A largest one-to-one matching among allowed (expected_id, actual_id) pairs of each group, by augmenting paths.

    A group is one evaluation case, which is small.
    """

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        options = frame.groupby("expected_id")["actual_id"].apply(lambda s: sorted(set(s))).to_dict()
        owner: dict = {}

        def place(e, seen: set) -> bool:
            for a in options[e]:
                if a not in seen:
                    seen.add(a)
                    if a not in owner or place(owner[a], seen):
                        owner[a] = e
                        return True
            return False

        for e in sorted(options):
            place(e, set())
        rows = [(frame[group].iloc[0], e, a) for a, e in owner.items()]
        return pd.DataFrame(rows, columns=[group, "expected_id", "actual_id"])

    schema = pairs.select(group, "expected_id", "actual_id").schema
    return pairs.groupBy(group).applyInPandas(match, schema)


def spread(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Median and 90th percentile per key."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(value), 4).alias("median"), F.round(F.percentile(value, F.lit(0.9)), 4).alias("p90"))
