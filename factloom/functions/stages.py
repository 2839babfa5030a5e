"""Computing columns once.

The optimizer puts the definition of a column wherever the column is used,
also into filters that it moves down.  With many stages that use a column
several times the plan grows exponentially.  ``stage`` computes columns in a
generator of one row, which keeps their definitions in one place; the generator
is part of whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns added or replaced, each computed once per row."""
    kept = [df[c] for c in df.columns if c not in columns]
    return df.select(*kept, F.stack(F.lit(1), *columns.values()).alias(*columns))


def windowed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that hold window functions, which a generator can't; then computed once, too."""
    kept = [df[c] for c in df.columns if c not in columns]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])
