"""From segments to fact candidates.

Every rule is a column expression; labels and units come from broadcast
dimensions of fixed size.  Rules, first match wins: an explicit correction, an
explicit pair (label: value, or two cells), several electrical quantities after
a direction, a known label before its value, a value before its known label.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.functions.stages import stage
from factloom.functions.tables import by_merge
from factloom.functions.values import clean_text, fact_text, normalise, review_reason, value_key
from factloom.operators.segments import DENIAL, segments

_known = "|".join(re.escape(x) for x in sorted(registry.labels(), key=lambda x: (-len(x), x)))
_numeric = [f for f in registry.fields() if f.kind != "text"]
_numeric_labels = "|".join(re.escape(x) for x in sorted((k for k, (f, _) in registry.labels().items() if f in {n.name for n in _numeric}), key=lambda x: (-len(x), x)))
_token = r"(?=[A-Za-z0-9_.-]*[0-9])[A-Za-z][A-Za-z0-9_.-]*"
_number = r"[-+−]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
_unit_word = "|".join(re.escape(u) for u in sorted(registry.spellings(), key=lambda x: (-len(x), x)))
_annotated = rf"^(.+?)\s*[\[(（]\s*({_unit_word}|rpm|dB|ppm|%|[kMGT]i?B/?s?)\s*[\])）]$"
_open_label = r"^[a-z0-9㐀-鿿][a-z0-9㐀-鿿 _/()（）%+°.\-]{0,63}$"


def _part(c: str | Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def custom_field(label: Column) -> Column:
    """A reversible id for a label that no field has."""
    return F.concat(F.lit("custom_"), F.lower(F.hex(F.encode(label, "UTF-8"))))


def label_of_custom(field: Column) -> Column:
    return F.decode(F.unhex(F.substring(field, F.lit(8), F.length(field))), "UTF-8")


def _is_open_label(label: Column) -> Column:
    plain = label.rlike(_open_label) & label.rlike("[a-z㐀-鿿]") & ~label.isin(*registry.STRUCTURE_LABELS)
    condition = ~label.rlike("^[0-9]") | label.rlike(r"^[0-9]+(?:\.[0-9]+)?\s*(?:°[cf]|%)\s*[a-z㐀-鿿]")
    return plain & condition & ~label.rlike(r"(?:^|\s)https?$|^(?:please\s+)?(?:refer\s+to|see\s+)|^(?:figure|fig\.?|table)\s+[0-9]|^[图表]\s*[0-9]+")


def bind(rows: DataFrame) -> DataFrame:
    """Add token (an explicit product), label, raw, rule to rows with ``segment``; unmatched rows stay with a null label."""
    prefixed = rf"^\s*({_token}(?:\s*(?:/|、|,|，)\s*{_token})*)\s+((?i:{_known})(?=\s|[:：=0-9]).*)$"
    step = stage(rows, {"token": _part("segment", prefixed, 1), "_body": F.coalesce(_part("segment", prefixed, 2), F.col("segment"))})
    corrected = _part("_body", r"(?:正确(?:为|是)?|更正为|应为)\s*(.+)$", 1)
    own = F.trim(F.element_at(F.split("_body", DENIAL), 1))
    label_first = corrected.rlike(rf"^(?i:{_known})")
    fixed = F.when(F.col("_body").rlike(DENIAL), F.when(label_first, corrected).otherwise(F.concat(own, F.lit(":"), corrected)))
    step = stage(step, {"_body": F.when(F.col("_body").rlike(DENIAL), fixed).otherwise(F.col("_body"))}).filter("_body is not null")
    cells = F.filter(F.transform(F.split("_body", r"[|\t]"), lambda x: F.trim(x)), lambda c: c != "")
    step = stage(step, {"_cells": F.when(F.col("_body").rlike(r"[|\t]"), cells)})
    pair = r"(?s)^\s*(?:[-*•]\s*)?([^:：=\n]{1,64})\s*[:：=]\s*(.+)$"
    before = rf"^\s*(?:[-*•]\s*)?(?:(?:该|本)产品)?((?i:{_numeric_labels}))(?![A-Za-z0-9_](?<![0-9]))\s*(?:->|为|是)?\s*((?:[≤≥<>≈约+\-−]|(?i:no |not |at |up |about )|[0-9]).*)$"
    words = rf"^\s*(?:[-*•]\s*)?(?:(?:该|本)产品)?((?i:{_known}))\s*(?:->|为|是)\s*(.+)$"
    first = rf"^\s*(?:[-*•]\s*)?({_number}\s*(?:[^\s0-9]\S{{0,31}})?)\s+((?i:{_numeric_labels}))$"
    two = F.size("_cells") == 2
    rule = (
        F.when(two, "pair").when(F.col("_body").rlike(pair), "pair").when(F.col("_body").rlike(words), "words").when(F.col("_body").rlike(before), "before")
        .when((F.length("_body") <= 96) & F.col("_body").rlike(first), "value_first")
    )
    step = stage(step, {"rule": rule})
    by = lambda k, f: F.when(F.col("rule") == "pair", F.when(two, F.col("_cells")[k]).otherwise(_part("_body", pair, k + 1))).when(
        F.col("rule") == "words", _part("_body", words, k + 1)).when(F.col("rule") == "before", _part("_body", before, k + 1)).when(
        F.col("rule") == "value_first", _part("_body", first, f))
    step = stage(step, {"label": F.trim(by(0, 2)), "raw": F.trim(by(1, 1))})
    unit = _part("label", _annotated, 2)
    step = stage(step, {"_unit": unit})
    labelled = F.when(F.col("_unit").isNotNull(), _part("label", _annotated, 1)).otherwise(F.col("label"))
    measured = F.when(F.col("_unit").isNotNull() & ~F.col("raw").contains(F.col("_unit")), F.concat_ws(" ", "raw", "_unit")).otherwise(F.col("raw"))
    step = stage(step, {"label": labelled, "raw": measured})
    return step.drop("_body", "_cells", "_unit")


def _electrical(rows: DataFrame) -> DataFrame:
    """INPUT: 5V/3A is one row for each quantity, under the direction as scope."""
    direction = F.when(F.col("label_key").isin("input", "输入"), "input").when(F.col("label_key").isin("output", "输出"), "output")
    found = F.regexp_extract_all("raw", F.lit(rf"{_number}\s*(?:m|k|M)?[VAW](?![A-Za-z])"), F.lit(0))
    rest = F.regexp_replace("raw", rf"{_number}\s*(?:m|k|M)?[VAW](?![A-Za-z])", "")
    declared = rows.withColumn("_direction", direction).filter(F.col("_direction").isNotNull() & rest.rlike(r"^[\s/,，;；|·+⎓=-]*$"))
    each = declared.select("*", F.explode(found).alias("_quantity"))
    field = F.when(F.col("_quantity").endswith("V"), "voltage").when(F.col("_quantity").endswith("A"), "current").otherwise("power")
    return each.withColumns({"field": field, "label_scope": F.col("_direction"), "raw": F.col("_quantity")}).drop("_direction", "_quantity")


def _with_marks(field: Column, scope: Column, text: Column) -> Column:
    """A scope with what the text itself marks: the only kind of current of a voltage or current, the axes of dimensions."""
    signals = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z])(?:[mk]?[va])?\s*(ac|dc)\b"), F.lit(1)), lambda s: F.lower(s)))
    signal = F.when(field.isin("voltage", "current") & (F.size(signals) == 1), F.concat(F.lit("signal:"), F.get(signals, F.lit(0))))
    sides = F.regexp_extract(text, r"(?i)\b([LWHD]\s*[x×*]\s*[LWHD](?:\s*[x×*]\s*[LWHD])?)\b", 1)
    axes = F.when((field == "dimensions") & (sides != ""), F.concat(F.lit("axes:"), F.upper(F.regexp_replace(sides, r"(?i)\s*[x×*]\s*", "×"))))
    mark = F.coalesce(signal, axes)
    return F.when(mark.isNull(), scope).otherwise(F.array_join(F.array_distinct(F.filter(F.concat(F.split(F.coalesce(scope, F.lit("")), r"\|"), F.array(mark)), lambda x: x != "")), "|"))


def candidates(blocks: DataFrame) -> DataFrame:
    """Fact candidates of blocks (block_id, source_file, file_hash, position, text, atomic, recognition_confidence)."""
    spark = blocks.sparkSession
    rows = bind(segments(blocks)).filter("label is not null and raw <> '' and length(raw) <= 512")
    fixes = F.create_map(*[F.lit(x) for pair in registry.LABEL_FIXES.items() for x in pair])
    rows = stage(rows, {"label_key": clean_text(F.col("label"))})
    rows = stage(rows, {"label_key": F.coalesce(fixes[F.col("label_key")], F.col("label_key"))})
    electric = _electrical(rows)
    rows = rows.join(by_merge(electric.select("block_id", "seq").distinct()), ["block_id", "seq"], "left_anti")
    known = F.broadcast(registry.label_table(spark))
    rows = rows.join(known, "label_key", "left")
    open_ = F.when(_is_open_label(F.col("label_key")) & (F.col("rule") == "pair"), custom_field(F.col("label_key")))
    rows = stage(rows, {"field": F.coalesce("field", open_)}).filter("field is not null")
    rows = rows.unionByName(electric.select(*rows.columns))
    dims = F.broadcast(registry.field_table(spark))
    rows = stage(rows.join(dims, "field", "left"), {
        "value_type": F.coalesce("value_type", F.lit("text")),
        "field_label": F.coalesce("field_label", "label_key"),
        "mapping_confidence": F.when(F.col("rule").isin("pair") & F.col("confidence").isNull(), 0.95).otherwise(F.coalesce("confidence", F.lit(0.95))),
        "scope": F.coalesce("label_scope", "default_scope"),
    })
    rows = stage(rows, {"scope": _with_marks(F.col("field"), F.col("scope"), F.col("segment"))})
    if "parents" in rows.columns:  # what a table says above or beside a parameter qualifies it
        named = F.create_map(*[F.lit(x) for p in {"input": "input", "output": "output", "输入": "input", "输出": "output"}.items() for x in p])
        above = F.transform(F.split("parents", r"\|"), lambda x: F.coalesce(named[F.lower(x)], F.concat(F.lit("context:"), fact_text(x))))
        own = F.when(F.col("scope") != "unspecified", F.array("scope")).otherwise(F.array().cast("array<string>"))
        atoms = F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), above))
        ordered = F.array_sort(F.transform(atoms, lambda x: F.struct(F.when(x.isin("input", "output"), 0).otherwise(1).alias("rank"), x.alias("atom"))))
        joined = F.array_join(ordered["atom"], "|")
        rows = stage(rows, {"scope": F.when(F.col("parents").isNotNull() & ~F.col("field").isin("sku", "model", "variant"), joined).otherwise(F.col("scope"))})
    rows = rows.filter((F.col("value_type") == "text") | F.col("raw").rlike("[0-9]") | clean_text(F.col("raw")).isin(*registry.MISSING_VALUES))
    rows = normalise(rows)
    reason = review_reason(F.col("field"), F.col("value_type"), F.col("family"), F.col("raw"), F.col("value"))
    rows = stage(rows, {"value_key": value_key(F.col("value")), "review_reason": reason})
    identity = F.to_json(F.struct("block_id", "field", "raw", F.coalesce("scope", F.lit("")).alias("scope"), "seq", "value_key"))
    return rows.withColumn("candidate_id", F.substring(F.sha2(identity, 256), 1, 20)).drop("default_scope", "label_scope", "confidence", "label", "label_key")
