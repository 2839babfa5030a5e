"""Geometry and page layout: islands, containment, boxes, margins, page classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: list[str], order: str, gap: Column, out: str) -> DataFrame:
    """Number the runs of rows (from 0) within ``key``: a new one begins where ``gap`` holds (null: at the first row)."""
    by = Window.partitionBy(*key).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_new", F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0))
    return marked.withColumn(out, F.sum("_new").over(upto)).drop("_new")


def text_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """Words (page, text, x0, top, x1, bottom) to lines: page, line, text and bounding box."""
    by = Window.partitionBy("page").orderBy("top", "x0")
    lined = islands(words, ["page"], "top", F.col("top") - F.lag("top").over(by) > gap, "line")
    return lined.groupBy("page", "line").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("x0", "text")))["text"], " ").alias("text"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
    )


def aligned_pairs(lines: DataFrame, words: DataFrame, column_gap: float = 30.0) -> DataFrame:
    """Label and value cells of lines that a wide gap splits in two, where at least three lines share the columns."""
    by = Window.partitionBy("page", "line").orderBy("x0")
    at = words.join(lines.select("page", "line", F.col("top").alias("_top"), F.col("bottom").alias("_bottom")), "page")
    at = at.filter((F.col("top") >= F.col("_top")) & (F.col("bottom") <= F.col("_bottom")))
    cells = islands(at, ["page", "line"], "x0", F.col("x0") - F.lag("x1").over(by) > column_gap, "cell")
    cells = cells.groupBy("page", "line", "cell").agg(F.array_join(F.sort_array(F.collect_list(F.struct("x0", "text")))["text"], " ").alias("text"), F.min("x0").alias("x0"))
    pairs = cells.groupBy("page", "line").agg(F.count(F.lit(1)).alias("_n"), F.min_by("text", "x0").alias("label"), F.max_by("text", "x0").alias("value"), F.max("x0").alias("_x")).filter("_n = 2")
    column = Window.partitionBy("page", F.round(F.col("_x") / 5))
    numeric = F.count_if(F.col("value").rlike(r"^[≤≥<>±~]?\s*[0-9.]")).over(column)
    return pairs.withColumns({"_rows": F.count(F.lit(1)).over(column), "_numeric": numeric}).filter("_rows >= 3 and _numeric >= 2").select("page", "line", "label", "value")


def inside(x0: Column, y0: Column, x1: Column, y1: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Whether the first box lies in the second."""
    return (x0 >= left) & (y0 >= top) & (x1 <= right) & (y1 <= bottom)


def contained(words: DataFrame, boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """Pairs of a word (x0, y0, x1, y1) and a box (left, top, right, bottom) around it, within ``key``.

    They meet in grid cells of side ``cell``: a word in that of its corner, a box in all it covers.
    """
    c = F.col
    at = lambda x: F.floor(x.cast("double") / cell)
    placed = words.withColumns({"_column": at(c("x0")), "_row": at(c("y0"))})
    spread = boxes.filter((c("left") <= c("right")) & (c("top") <= c("bottom"))).withColumn("_column", F.explode(F.sequence(at(c("left")), at(c("right")))))
    spread = spread.withColumn("_row", F.explode(F.sequence(at(c("top")), at(c("bottom")))))
    pairs = placed.join(spread, [key, "_column", "_row"]).drop("_column", "_row")
    return pairs.filter(inside(c("x0"), c("y0"), c("x1"), c("y1"), c("left"), c("top"), c("right"), c("bottom")))


def union_box(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def overlap_ratio(top: Column, bottom: Column, other_top: Column, other_bottom: Column) -> Column:
    """Vertical overlap as a share of the lower of the two heights."""
    shared = F.greatest(F.lit(0.0), F.least(bottom, other_bottom) - F.greatest(top, other_top))
    return F.coalesce(shared / F.nullif(F.least(bottom - top, other_bottom - other_top), F.lit(0.0)), F.lit(0.0))


def nearest_label(values: DataFrame, labels: DataFrame, key: str, reach: float, tie: float) -> DataFrame:
    """Each value's nearest label (x, y) within ``reach``; none if the next one is within ``tie`` of it.

    They meet in grid cells as wide as the reach: a label in its own, a value in that and the eight around it.
    """
    cell = lambda c: F.floor(F.col(c).cast("double") / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    v = values.select(key, "value_id", F.col("x").alias("_vx"), F.col("y").alias("_vy"), around("x").alias("_column")).withColumn("_row", F.explode(F.sequence(F.floor(F.col("_vy").cast("double") / reach) - 1, F.floor(F.col("_vy").cast("double") / reach) + 1)))
    placed = labels.select(key, "label_id", F.col("x").alias("_lx"), F.col("y").alias("_ly"), cell("x").alias("_column"), cell("y").alias("_row"))
    pairs = v.join(placed, [key, "_column", "_row"]).drop("_column", "_row")
    pairs = pairs.withColumn("distance", F.round(F.sqrt(F.pow(F.col("_vx") - F.col("_lx"), 2) + F.pow(F.col("_vy") - F.col("_ly"), 2)), 6))
    by = Window.partitionBy(key, "value_id").orderBy("distance", "label_id")
    ranked = pairs.filter(F.col("distance") <= reach).withColumns({"_n": F.row_number().over(by), "_next": F.lead("distance").over(by)})
    return ranked.filter((F.col("_n") == 1) & (F.col("_next").isNull() | (F.col("_next") - F.col("distance") >= tie))).select(key, "value_id", "label_id", "distance")


def without_running_margins(rows: DataFrame, label: str, page: str, place: list[str], least_pages: int = 2) -> DataFrame:
    """Rows whose label does not come back on several pages at the same place."""
    running = rows.groupBy(label, *place).agg(F.count_distinct(page).alias("_pages")).filter(F.col("_pages") >= least_pages)
    return rows.join(running, [label, *place], "left_anti")


def page_class(large_images: Column, vector_operators: Column, keyword: Column, unit_values: Column) -> Column:
    """Why a page needs reading as an image, or null."""
    return F.when(large_images > 0, "large_image").when((vector_operators >= 24) & keyword, "vector_keyword").when((vector_operators >= 120) & (unit_values >= 2), "vector_units")


def note_bodies(notes: DataFrame, references: DataFrame) -> DataFrame:
    """References (page, marker) with the note they mean: of their own page, else of the only page that uses the marker; unique texts only."""
    one = lambda by: notes.groupBy(*by).agg(F.min("text").alias("_low"), F.max("text").alias("_high"), F.count_distinct("page").alias("_pages"))
    own = one(["page", "marker"]).select("page", "marker", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_own"), F.lit(True).alias("_here"))
    far = one(["marker"]).filter("_pages = 1 and _low = _high").select("marker", F.col("_low").alias("_far"))
    found = references.join(own, ["page", "marker"], "left").join(far, "marker", "left")
    return found.withColumn("note", F.when(F.col("_here"), F.col("_own")).otherwise(F.col("_far"))).drop("_own", "_here", "_far")
