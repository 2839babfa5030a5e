"""Which product a candidate belongs to.

Ordered passes, each a window or a join: an explicit SKU wins, then model and
variant; one SKU in a file's prose covers that prose; otherwise SKU (or model)
sections carry on to the next heading; SKU rows learn their model; a model with
one SKU takes it, with several it is ambiguous; a file with one product lends
it; so does a data set with one product; the rest is ambiguous per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.stages import stage, windowed
from factloom.functions.values import clean_text

NEEDS_REVIEW = ("ambiguous", "unresolved")


def product_id(sku: Column, model: Column, variant: Column) -> Column:
    """A stable id: by SKU, else by model and variant; null without either."""
    by_sku = F.concat_ws("\x1f", F.lit("sku"), clean_text(sku))
    by_model = F.concat_ws("\x1f", F.lit("model"), clean_text(model), clean_text(variant))
    key = F.when(clean_text(sku) != "", by_sku).when(clean_text(model) != "", by_model)
    return F.concat(F.lit("product_"), F.substring(F.sha2(key, 256), 1, 20))


def product_label(sku: Column, model: Column, variant: Column) -> Column:
    return F.coalesce(sku, F.nullif(F.concat_ws(" / ", model, variant), F.lit("")))


def _only(field: str, by: Window) -> Column:
    """The value of an identity field, if the window has exactly one."""
    value = F.when(F.col("field") == field, clean_text(F.col("raw")))
    first = F.min_by(F.when(F.col("field") == field, F.col("raw")), F.when(F.col("field") == field, F.col("_order"))).over(by)
    return F.when(F.min(value).over(by) == F.max(value).over(by), first)


def expand_tokens(candidates: DataFrame) -> DataFrame:
    """A100/A200 in front of a parameter (or as a SKU) makes one row for each."""
    listed = F.when(F.col("token").isNotNull(), F.col("token")).when(F.col("field") == "sku", F.col("raw"))
    tokens = F.transform(F.split(listed, r"\s*(?:/|、|,|，)\s*"), lambda x: F.trim(x))
    good = (F.size(tokens) <= 32) & F.forall(tokens, lambda t: t.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"))
    rows = stage(candidates, {"_tokens": F.when(listed.isNotNull() & good, tokens)})
    rows = rows.select("*", F.explode_outer("_tokens").alias("applies_to"))
    several = (F.col("field") == "sku") & (F.size("_tokens") > 1)
    raw = F.when(several, F.col("applies_to")).otherwise(F.col("raw"))
    return rows.withColumn("several_products", F.coalesce(several, F.lit(False))).withColumn("raw", raw).drop("_tokens")


def resolve_products(candidates: DataFrame) -> DataFrame:
    """Add product_id, sku, model, variant and identity_status.

    Needs source_file, block_id, position, seq, field, raw, token; a column
    row_id marks rows bound by a table (null for prose).
    """
    rows = candidates if "row_id" in candidates.columns else candidates.withColumn("row_id", F.lit(None).cast("string"))
    rows = expand_tokens(rows)
    rows = stage(rows, {
        "_order": F.struct(F.col("position").cast("long").alias("position"), F.col("seq").alias("seq")),
        "_row": F.coalesce(F.concat(F.lit("row:"), "row_id"), F.concat_ws(":", F.lit("block"), "block_id", F.coalesce("applies_to", F.lit("")))),
        "_prose": F.col("row_id").isNull(),
    })
    row = Window.partitionBy("source_file", "_row")
    rows = windowed(rows, {"_sku": F.coalesce("applies_to", _only("sku", row)), "_model": _only("model", row), "_variant": _only("variant", row)})
    rows = stage(rows, {
        "_pid": product_id(F.col("_sku"), F.col("_model"), F.col("_variant")),
        "_status": F.when(F.col("_sku").isNotNull(), "explicit_sku").when(F.col("_variant").isNotNull(), "explicit_model_variant").otherwise("explicit_model"),
    })

    # One SKU (and at most one model) in a file's prose covers the prose; else sections.
    file = Window.partitionBy("source_file")
    in_prose = lambda f: F.when((F.col("field") == f) & F.col("_prose"), clean_text(F.col("raw")))
    rows = windowed(rows, {
        "_low_sku": F.min("_sku").over(file), "_high_sku": F.max("_sku").over(file),
        "_low_model": F.min(in_prose("model")).over(file), "_high_model": F.max(in_prose("model")).over(file), "_file_sku": F.min(F.when(F.col("_prose"), F.col("_sku"))).over(file),
        "_file_model": F.min_by(F.when(F.col("_prose") & (F.col("field") == "model"), F.col("raw")), "_order").over(file),
        "_file_variant": F.min_by(F.when(F.col("_prose") & (F.col("field") == "variant"), F.col("raw")), "_order").over(file),
    })
    one_sku, several_skus = F.col("_low_sku") == F.col("_high_sku"), F.col("_low_sku") < F.col("_high_sku")
    several_models = F.coalesce(F.col("_low_model") < F.col("_high_model"), F.lit(False))
    single = F.coalesce(one_sku & F.col("_file_sku").isNotNull(), F.lit(False)) & ~several_models
    heading = F.when(single, F.lit(None)).when(several_skus, "sku").when(F.col("_low_sku").isNull() & several_models, "model")
    rows = stage(rows, {"_single": single, "_heading": heading})
    is_head = F.col("field") == F.col("_heading")
    resets = F.when(F.col("_heading").isNotNull() & (is_head | ~F.col("_prose")), 1).otherwise(0)
    so_far = file.orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = windowed(rows, {"_section": F.sum(resets).over(so_far)})
    section = Window.partitionBy("source_file", "_section")
    lead = is_head & F.col("_prose") & ~F.col("several_products")
    anchor = F.struct(F.col("_pid").alias("pid"), F.col("_sku").alias("sku"), F.col("_model").alias("model"), F.col("_variant").alias("variant"))
    rows = windowed(rows, {"_anchor": F.min_by(F.when(lead, anchor), F.when(lead, F.col("_order"))).over(section)})
    free = F.col("_prose") & F.col("applies_to").isNull()
    whole = F.struct(
        product_id(F.col("_file_sku"), F.col("_file_model"), F.col("_file_variant")).alias("pid"), F.col("_file_sku").alias("sku"),
        F.col("_file_model").alias("model"), F.col("_file_variant").alias("variant"),
    )
    inherited = F.when(F.col("_single") & free, whole).when(F.col("_heading").isNotNull() & free & ~F.coalesce(is_head, F.lit(False)), F.col("_anchor"))
    rows = stage(rows, {"_from": inherited})
    rows = stage(rows, {
        "_status": F.when(F.col("_from.pid").isNotNull(), F.when(F.col("_single"), "derived_from_unique_source_identity").otherwise("derived_from_source_section"))
        .when(F.col("_pid").isNotNull(), F.col("_status")),
        "_sku": F.when(F.col("_from.pid").isNotNull(), F.col("_from.sku")).otherwise(F.col("_sku")),
        "_model": F.when(F.col("_from.pid").isNotNull(), F.col("_from.model")).otherwise(F.col("_model")),
        "_variant": F.when(F.col("_from.pid").isNotNull(), F.col("_from.variant")).otherwise(F.col("_variant")),
        "_pid": F.coalesce("_from.pid", "_pid"),
    })
    rows = rows.drop("_low_sku", "_high_sku", "_low_model", "_high_model", "_file_sku", "_file_model", "_file_variant", "_single", "_heading", "_section", "_anchor", "_from")

    # SKU rows learn the model of their product; a model learns its only SKU.
    known = rows.filter("_sku is not null and _model is not null").groupBy(F.col("_pid").alias("_known_pid")).agg(
        F.min_by("_model", "_order").alias("_known_model"), F.min_by("_variant", "_order").alias("_known_variant"), F.min("_sku").alias("_known_sku")
    )
    rows = rows.join(known.select("_known_pid", "_known_model", "_known_variant"), F.col("_pid") == F.col("_known_pid"), "left")
    learns = F.col("_sku").isNotNull() & F.col("_model").isNull() & F.col("_known_model").isNotNull()
    rows = stage(rows, {
        "_variant": F.when(learns, F.coalesce("_variant", "_known_variant")).otherwise(F.col("_variant")),
        "_model": F.coalesce("_model", F.when(learns, F.col("_known_model"))),
    }).drop("_known_pid", "_known_model", "_known_variant")
    owners = known.groupBy(clean_text(F.col("_known_model")).alias("_owner_model")).agg(
        F.count(F.lit(1)).alias("_owners"), F.min(F.struct("_known_pid", "_known_sku", "_known_model", "_known_variant")).alias("_owner")
    )
    rows = rows.join(owners, clean_text(F.col("_model")) == F.col("_owner_model"), "left")
    bare = F.col("_sku").isNull() & F.col("_model").isNotNull() & F.col("_variant").isNull()
    takes = bare & (F.col("_owners") == 1)
    rows = stage(rows, {
        "_pid": F.when(takes, F.col("_owner._known_pid")).otherwise(F.col("_pid")),
        "_sku": F.when(takes, F.col("_owner._known_sku")).otherwise(F.col("_sku")),
        "_variant": F.when(takes, F.col("_owner._known_variant")).otherwise(F.col("_variant")),
        "_status": F.when(takes, "derived_from_unique_model").when(bare & (F.col("_owners") > 1), "ambiguous").otherwise(F.col("_status")),
    }).drop("_owner_model", "_owners", "_owner")

    # A file, then a data set, with exactly one product lends it.
    of = lambda w: F.when(F.min("_pid").over(w) == F.max("_pid").over(w), F.min(F.when(F.col("_pid").isNotNull(), F.struct("_pid", "_sku", "_model", "_variant", "_status"))).over(w))
    rows = windowed(rows, {"_lent": of(file)})
    lent = F.col("_pid").isNull() & F.col("_lent").isNotNull()
    rows = stage(rows, {
        "_status": F.when(lent, F.when(F.col("_lent._status") == "ambiguous", "ambiguous").otherwise("derived_from_unique_source_identity")).otherwise(F.col("_status")),
        **{c: F.when(lent, F.col(f"_lent.{c}")).otherwise(F.col(c)) for c in ("_sku", "_model", "_variant")},
        "_pid": F.coalesce("_pid", "_lent._pid"),
    }).drop("_lent")
    total = rows.agg(F.min("_pid").alias("_least"), F.max("_pid").alias("_most"), F.min(F.when(F.col("_pid").isNotNull(), F.struct("_pid", "_sku", "_model", "_variant"))).alias("_lone"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    none, one = F.col("_least").isNull(), F.col("_least") == F.col("_most")
    missing = F.col("_pid").isNull()
    rows = stage(rows, {
        "_status": F.when(~missing, F.col("_status")).when(none, "dataset_default").when(one, "derived_from_single_dataset_product").otherwise("ambiguous"),
        **{c: F.when(missing & one, F.col(f"_lone.{c}")).otherwise(F.col(c)) for c in ("_sku", "_model", "_variant")},
        "_pid": F.when(~missing, F.col("_pid")).when(none, F.lit("product_dataset")).when(one, F.col("_least"))
        .otherwise(F.concat(F.lit("product_"), F.substring(F.sha2(F.concat(F.lit("ambiguous\x1f"), "source_file"), 256), 1, 20))),
    }).drop("_least", "_most", "_lone")

    # Different stated specifications under a bare model may be variants; charge capacity joins the battery field.
    spec = F.col("field").isin("length", "capacity", "capacity_charge", "capacity_volume") & F.col("_sku").isNull() & F.col("_model").isNotNull() & F.col("_variant").isNull()
    stated, same = F.when(spec, F.col("value_key")), Window.partitionBy("_pid", "field", "scope")
    rows = windowed(rows, {"_kinds": F.when(F.min(stated).over(same) < F.max(stated).over(same), 2).otherwise(1)})
    product = Window.partitionBy("_pid")
    rows = windowed(rows, {"_unsure": F.max(F.when(F.col("_kinds") > 1, 1).otherwise(0)).over(product), "_battery": F.max(F.when(F.col("field") == "capacity_charge", 1).otherwise(0)).over(product)})
    status = F.when(F.col("_unsure") == 1, "ambiguous").otherwise(F.col("_status"))
    charge = (F.col("field") == "capacity") & (F.col("value.unit") == "mAh") & (F.col("_battery") == 1) & ~status.isin(*NEEDS_REVIEW)
    return rows.withColumns({
        "product_id": F.col("_pid"), "sku": F.col("_sku"), "model": F.col("_model"), "variant": F.col("_variant"), "identity_status": status,
        "field_label": F.when(charge, F.lit("电池容量")).otherwise(F.col("field_label")),
        "field": F.when(charge, F.lit("capacity_charge")).otherwise(F.col("field")),
    }).drop("_order", "_row", "_prose", "_sku", "_model", "_variant", "_pid", "_status", "_kinds", "_unsure", "_battery")


def product_entities(candidates: DataFrame) -> DataFrame:
    """One row per product: label, sku, model, variants, candidate ids."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("candidate_id")))
    per = candidates.groupBy("product_id").agg(
        first("sku").alias("sku"), first("model").alias("model"), F.array_sort(F.collect_set("variant")).alias("variants"),
        F.min("identity_status").alias("identity_status"), F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"),
    )
    named = F.coalesce("sku", F.nullif(F.concat_ws(" / ", "model", F.get("variants", F.lit(0))), F.lit("")), F.lit("Ambiguous product"))
    return per.withColumn("label", F.when(F.col("identity_status") == "dataset_default", "Dataset").otherwise(named))


def section_fill(rows: DataFrame, key: str, order: list[str], value: str, resets: Column, out: str) -> DataFrame:
    """Carry ``value`` forward within ``key`` until the next value; ``resets`` starts a section without one."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = windowed(rows, {"_section": F.sum(F.when(resets, 1).otherwise(0)).over(upto)})
    within = Window.partitionBy(key, "_section").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(within)).drop("_section")


def unique_owner(rows: DataFrame, name: str, owner: str) -> DataFrame:
    """Names that have exactly one owner, with it."""
    return rows.groupBy(name).agg(F.min(owner).alias("_low"), F.max(owner).alias("_high")).filter("_low = _high").select(name, F.col("_low").alias(owner))
