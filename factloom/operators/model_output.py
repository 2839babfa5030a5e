"""Gates for the JSON that an external reader returns: nothing unproved gets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.functions.stages import stage
from factloom.functions.values import clean_text
from factloom.operators.extract import custom_field

MOST_TRANSCRIPTIONS, MOST_MAPPINGS, MOST_TEXT, MOST_VALUE = 64, 128, 500, 256
# The closed sets of keys and words of the two formats.
TRANSCRIPTION_KEYS = ("bbox_1000", "confidence_estimate", "confidence_source", "id", "legibility", "position_precision", "raw_text")
MAPPING_KEYS = ("confidence_source", "field", "mapping_confidence_estimate", "raw_value", "transcription_id")
SELF_ASSESSED = "model_self_assessment"
_id = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}$"
_transcription = "id string, raw_text string, bbox_1000 array<int>, position_precision string, legibility string, confidence_estimate double, confidence_source string"
_mapping = "transcription_id string, field string, raw_value string, mapping_confidence_estimate double, confidence_source string"


def _items(outputs: DataFrame, most: int, keys: tuple[str, ...], schema: str) -> DataFrame:
    """One row per item of ``output`` (a JSON array, or an object with items), with issue where its shape is wrong."""
    text = F.trim("output")
    wrapped = F.get_json_object(text, "$.items")
    rows = outputs.withColumn("_array", F.from_json(F.when(text.startswith("["), text).otherwise(wrapped), "array<string>"))
    whole = F.when(F.try_parse_json(text).isNull(), "invalid_json").when(F.col("_array").isNull(), "no_items").when(F.size("_array") > most, "too_many_items")
    rows = stage(rows, {"_whole": whole})
    listed = F.when(F.col("_whole").isNull(), F.col("_array")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select(*[c for c in rows.columns if c not in ("output", "_array")], F.posexplode(listed).alias("item", "_json"))
    shape = F.when(F.col("_whole").isNotNull(), F.col("_whole")).when(~F.col("_json").startswith("{"), "item_not_object")
    shape = F.coalesce(shape, F.when(~F.array_sort(F.json_object_keys("_json")).eqNullSafe(F.array(*map(F.lit, sorted(keys)))), "invalid_item_schema"))
    return stage(rows, {"issue": shape, "_item": F.from_json("_json", schema)}).drop("_whole", "_json")


def _share(c: Column) -> Column:
    return F.coalesce(c.between(0, 1), F.lit(False))


def transcriptions(outputs: DataFrame) -> DataFrame:
    """Items of a transcription output (image, output) with issue; only rows without one may be used."""
    rows = _items(outputs, MOST_TRANSCRIPTIONS, TRANSCRIPTION_KEYS, _transcription)
    i, box = (lambda c: F.col(f"_item.{c}")), F.col("_item.bbox_1000")
    boxed = (F.size(box) == 4) & F.forall(box, lambda v: v.between(0, 1000)) & (box[0] < box[2]) & (box[1] < box[3])
    issue = (
        F.when(~F.coalesce(i("id").rlike(_id), F.lit(False)), "invalid_identifier")
        .when((F.trim(F.coalesce(i("raw_text"), F.lit(""))) == "") | (F.length(i("raw_text")) > MOST_TEXT), "invalid_text")
        .when(box.isNotNull() & ~F.coalesce(boxed, F.lit(False)), "invalid_bbox")
        .when(~_share(i("confidence_estimate")) | (i("confidence_source") != SELF_ASSESSED), "invalid_confidence")
        .when(~i("position_precision").isin("approximate", "unavailable") | (box.isNull() & (i("position_precision") != "unavailable")), "invalid_position_precision")
        .when(~i("legibility").isin("clear", "uncertain"), "invalid_legibility")
    )
    names = [f.split(" ")[0] for f in _transcription.split(", ")]
    kept = [c for c in rows.columns if c not in ("issue", "_item")]
    return rows.select(*kept, *[i(n).alias(n) for n in names], F.coalesce("issue", issue).alias("issue"))


def mappings(outputs: DataFrame, texts: DataFrame, key: str = "image") -> DataFrame:
    """Items of a mapping output, checked against the accepted transcriptions: the value must stand in the text, whole."""
    rows = _items(outputs, MOST_MAPPINGS, MAPPING_KEYS, _mapping)
    names = [f.split(" ")[0] for f in _mapping.split(", ")]
    rows = rows.select(*[c for c in rows.columns if c != "_item"], *[F.col(f"_item.{n}").alias(n) for n in names])
    source = texts.filter("issue is null").select(key, F.col("id").alias("transcription_id"), F.col("raw_text").alias("source_text"))
    rows = rows.join(source, [key, "transcription_id"], "left")
    known = {f.name: f.kind for f in registry.fields()}
    label = clean_text(F.col("field"))
    labelled = clean_text(F.col("source_text")).startswith(F.concat(label, F.lit(":")))
    field = F.when(F.col("field").isin(*known), F.col("field")).when(labelled, custom_field(label))
    at = F.instr(F.col("source_text"), F.col("raw_value"))
    before = F.substring(F.col("source_text"), F.lit(1), at - 1)
    after = F.substring(F.col("source_text"), at + F.length("raw_value"), F.length("source_text"))
    numeric = F.col("field").isin(*[n for n, kind in known.items() if kind != "text"])
    cut = before.rlike(r"(?:<=|>=|[≤≥<>≈±~]|约|大约)\s*$") | after.rlike(r"^\s*(?:±|\+/-)")
    issue = (
        F.when((F.trim(F.coalesce("raw_value", F.lit(""))) == "") | (F.length("raw_value") > MOST_VALUE), "invalid_value")
        .when(~_share(F.col("mapping_confidence_estimate")) | (F.col("confidence_source") != SELF_ASSESSED), "invalid_confidence")
        .when(F.col("source_text").isNull(), "unknown_transcription_id")
        .when(field.isNull(), "field_not_allowed")
        .when(clean_text(F.col("source_text")).isin(*registry.labels()), "heading_without_value")
        .when(at == 0, "raw_value_not_in_source")
        .when(numeric & cut, "truncated_measurement")
    )
    return rows.withColumns({"field": F.coalesce(field, F.col("field")), "issue": F.coalesce("issue", issue)})


def explained(text: Column, label: Column, value: Column, qualifier: Column, condition: Column) -> Column:
    """Whether label, value, qualifier and condition, taken out of a text, leave only punctuation behind."""
    rest, whole = text, F.lit(True)
    for token in (label, value, qualifier, condition):
        token = F.coalesce(token, F.lit(""))
        at = F.instr(rest, token)
        whole = whole & ((token == "") | (at > 0))
        rest = F.when(token == "", rest).otherwise(F.concat(F.substring(rest, F.lit(1), at - 1), F.lit(" "), F.substring(rest, at + F.length(token), F.length(rest))))
    return whole & rest.rlike(r"^[\s:：=()（）\[\],，;；.。\-*•]*$")
