"""Recognised text lines: which need a second look, and which belong together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.operators.layout import overlap_ratio

SURE, USABLE = 0.97, 0.88
#: Height of the strips of a page in which lines meet.
STRIP = 16
_labels = "|".join(re.escape(x) for x in sorted(registry.labels(), key=lambda x: (-len(x), x)))
_units = "|".join(re.escape(x) for x in sorted(registry.spellings(), key=lambda x: (-len(x), x)))


def looks_like_parameter(text: Column) -> Column:
    return text.rlike(rf"(?i)(?:{_labels})") | text.rlike(rf"[0-9]\s*(?:{_units})(?![A-Za-z])")


def needs_review(text: Column, confidence: Column) -> Column:
    """Uncertain lines, and lines with a number and a unit-like word that isn't a known unit."""
    unknown_unit = text.rlike(r"[0-9]\s*[A-Za-zµμΩω°]{1,6}(?![A-Za-z])") & ~text.rlike(rf"[0-9]\s*(?:{_units})(?![A-Za-z])")
    return (confidence < USABLE) | (looks_like_parameter(text) & (confidence < SURE)) | unknown_unit


def is_value_fragment(text: Column) -> Column:
    """A short piece that can only be the value of some label."""
    return (F.length(text) <= 24) & text.rlike(r"^[≤≥<>≈±+\-]?\s*[0-9][0-9.,]*\s*\S{0,8}$")


def pair_rows(lines: DataFrame) -> DataFrame:
    """Lines (image, line_id, text, x0, y0, x1, y1) that are a bare label, with the value to their right on the same row.

    A pair needs one value for the label and one label for the value; all else stays apart.
    """
    label = lines.filter(F.col("text").rlike(rf"(?i)^\s*(?:{_labels})\s*[:：]?\s*$"))
    value = lines.filter(is_value_fragment(F.col("text")))
    l = label.select("image", F.col("line_id").alias("label_id"), F.col("text").alias("label"), F.col("x1").alias("_lx1"), F.col("y0").alias("_ly0"), F.col("y1").alias("_ly1"))  # noqa: E741
    v = value.select("image", F.col("line_id").alias("value_id"), F.col("text").alias("value"), F.col("x0").alias("_vx0"), F.col("y0").alias("_vy0"), F.col("y1").alias("_vy1"))
    # The middle of the lower of two lines that share most of a row lies in the other: they meet in a strip of the page.
    strip = lambda y: F.floor(y / STRIP)
    middle = lambda a, b: strip((F.col(a) + F.col(b)) / 2).alias("_strip")
    span = lambda a, b: F.explode(F.sequence(strip(F.col(a)), strip(F.greatest(F.col(a), F.col(b))))).alias("_strip")
    one = l.select("*", span("_ly0", "_ly1")).join(v.select("*", middle("_vy0", "_vy1")), ["image", "_strip"])
    other = l.select("*", middle("_ly0", "_ly1")).join(v.select("*", span("_vy0", "_vy1")), ["image", "_strip"])
    near = one.unionByName(other).drop("_strip").dropDuplicates(["image", "label_id", "value_id"])
    near = near.filter((F.col("_vx0") >= F.col("_lx1")) & (overlap_ratio(F.col("_ly0"), F.col("_ly1"), F.col("_vy0"), F.col("_vy1")) >= 0.6))
    near = near.withColumns({"_of_label": F.count(F.lit(1)).over(Window.partitionBy("image", "label_id")), "_of_value": F.count(F.lit(1)).over(Window.partitionBy("image", "value_id"))})
    joined = F.concat(F.regexp_replace("label", r"\s*[:：]\s*$", ""), F.lit(": "), "value")
    return near.filter("_of_label = 1 and _of_value = 1").select("image", "label_id", "value_id", joined.alias("text"))


def review_band(lines: DataFrame) -> DataFrame:
    """Per image the full-width band (0 to 1000) around lines that matter; none if it is too thin or nearly everything."""
    matters = lines.filter(F.col("text").rlike("[0-9]") | (F.col("confidence") < SURE) | looks_like_parameter(F.col("text")))
    margin = F.greatest(F.lit(35), F.least(F.lit(100), F.max(F.col("y1") - F.col("y0")) * 2))
    per = matters.groupBy("image").agg(F.greatest(F.lit(0), F.min("y0") - margin).alias("top"), F.least(F.lit(1000), F.max("y1") + margin).alias("bottom"))
    return per.filter(F.col("bottom") - F.col("top") <= 800).filter(F.col("bottom") - F.col("top") >= 100)
