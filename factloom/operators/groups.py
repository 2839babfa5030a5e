"""Fact groups: grouping, classification and the status of a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.functions.stages import stage, windowed
from factloom.functions.values import bounds, clean_text, fact_text, numbers_equal, values_equal

NEEDS_REVIEW = ("ambiguous", "unresolved")
# Fixed value: a version in a file name.
VERSION = r"(?i)(?:^|[_\-.\s])(?:v|ver|version|版本)\s*([0-9]{1,4})(?:[_\-.]([0-9]{1,2}))?(?:[_\-.]([0-9]{1,2}))?(?:$|[_\-.\s])"


def version_hint(name: Column) -> Column:
    """The version that a name states, as numbers joined by dots."""
    return F.nullif(F.concat_ws(".", *[F.nullif(F.regexp_extract(name, VERSION, k), F.lit("")) for k in (1, 2, 3)]), F.lit(""))


def keep_best(rows: DataFrame, key: list[str], best: Column, order: list[str]) -> DataFrame:
    """One row per key: the greatest ``best``, then the first in ``order``."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(best.desc(), *order)))
    return ranked.filter("_n = 1").drop("_n")


def scope_key(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows without a scope join the only explicit one of their product and field, if there is exactly one."""
    over = Window.partitionBy(*by)
    rows = windowed(rows, {"_low": F.min("scope").over(over), "_high": F.max("scope").over(over)})
    only = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    return rows.withColumn("scope_key", F.coalesce("scope", only, F.lit(""))).withColumn("split_scopes", F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))).drop("_low", "_high")


def fact_groups(candidates: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """One row per (product, field, scope): classification, measures, fact_status and its reason.

    The first candidate by (source_file, position, candidate_id) is what the
    others are compared with, as equality is up to rounding and not transitive.
    Optional columns: status, source_current, version, historical, binding,
    mapping_source.
    """
    defaults = {
        "status": F.lit("pending"), "source_current": F.lit(True), "version": F.lit(None).cast("string"), "historical": F.lit(False),
        "binding": F.lit("explicit"), "mapping_source": F.lit("deterministic"),
    }
    rows = candidates.select("*", *[c.alias(n) for n, c in defaults.items() if n not in candidates.columns])
    rows = rows.withColumn("_spelt", fact_text(F.col("raw")))
    identity = ["block_id", "product_id", "field", "scope", "value_key"]
    rows = keep_best(rows, identity, F.col("mapping_confidence"), ["source_file", "position", "candidate_id"])
    rows = scope_key(rows, ["product_id", "field"])
    key = ["product_id", "field", "scope_key"]
    hint = F.coalesce("version", version_hint(F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")), F.when(F.col("historical"), "historical"))
    rows = stage(rows, {"_hint": hint, "_valid": (F.col("status") != "rejected") & (F.col("status") != "stale") & F.col("source_current")})
    order = F.struct("source_file", "position", "candidate_id")
    group = Window.partitionBy(*key)
    first = lambda w, when=None: F.min_by("value", order if when is None else F.when(when, order)).over(w)
    rows = windowed(rows, {
        "_first": first(group), "_first_valid": first(group, F.col("_valid")), "_first_hint": first(Window.partitionBy(*key, "_hint")),
        "_same_value": F.count(F.lit(1)).over(Window.partitionBy(*key, "value_key")),
        "_shortest": F.min_by(clean_text(F.col("value.txt")), F.length("value.txt")).over(group),
        "_bounds": bounds(F.col("value")),
    })
    text = clean_text(F.col("value.txt"))
    scoped_ok = F.col("_valid") & (F.coalesce("scope", F.lit("")) == F.col("scope_key"))
    clear = (F.col("status") == "confirmed") | (F.col("recognition_confidence") >= 0.8)
    clear_value = Window.partitionBy(*key, "value_key")
    rows = windowed(rows, {
        "_eq": values_equal(F.col("_first"), F.col("value")), "_eq_valid": values_equal(F.col("_first_valid"), F.col("value")),
        "_eq_hint": values_equal(F.col("_first_hint"), F.col("value")), "_contains": F.coalesce(text.contains(F.col("_shortest")), F.lit(False)),
        "_scoped": scoped_ok, "_clear": clear, "_backed": F.max(F.when(F.col("_valid") & clear, 1).otherwise(0)).over(clear_value) == 1,
        "_explicit": F.max(F.when(F.col("_valid") & (F.col("binding") != "inferred_value_first") & clear & (F.col("mapping_confidence") >= 0.8), 1).otherwise(0)).over(Window.partitionBy(*key, "scope")) == 1,
    })
    any_ = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    all_ = lambda c: F.min(F.when(c, 1).otherwise(0)) == 1
    valid_only = lambda c: F.when(F.col("_valid"), c)
    human = F.col("_valid") & (F.col("status") == "confirmed")
    unclear = (F.col("review_reason") == "unclear_value") | (
        (F.col("status") != "confirmed")
        & (((F.col("binding") == "inferred_value_first") & ~F.col("_explicit")) | ~F.col("_backed") | ((F.col("mapping_source") != "deterministic") & (F.col("mapping_confidence") < 0.8)))
    )
    source = F.coalesce(F.nullif("file_hash", F.lit("")), F.col("source_file"))
    unit_word = F.regexp_extract("value.txt", r"^[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*([A-Za-zµμΩω°℃%²³/·㐀-鿿]*)$", 1)
    scalar = F.col("value.txt").rlike(r"^[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*[A-Za-zµμΩω°℃%²³/·㐀-鿿]*$")
    g = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.round(F.avg("recognition_confidence"), 4).alias("recognition_confidence"), F.round(F.avg("mapping_confidence"), 4).alias("mapping_confidence"),
        F.round(F.max("_same_value") / F.count(F.lit(1)), 4).alias("evidence_consistency"),
        F.count_distinct(F.when(F.col("_scoped"), source)).alias("_scoped_sources"), F.count_distinct(valid_only(source)).alias("_valid_sources"),
        F.min_by("field_label", order).alias("field_label"),
        any_(F.col("identity_status").isin(*NEEDS_REVIEW)).alias("_ambiguous"), any_(F.col("_valid") & F.col("identity_status").isin(*NEEDS_REVIEW)).alias("_ambiguous_valid"),
        any_(F.col("split_scopes")).alias("_split"), all_(F.col("_eq")).alias("_equal"), F.count_distinct("_spelt").alias("_spellings"),
        all_(F.col("_contains")).alias("_contained"), F.count_distinct("_hint").alias("_hints"), F.count_distinct(F.coalesce("_hint", F.lit("-"))).alias("_buckets"),
        all_(F.col("_eq_hint")).alias("_equal_in_hint"), any_(F.col("historical")).alias("_historical"),
        F.count_if(F.col("status") != "rejected").alias("_active"), F.count_if("_valid").alias("_valid_n"), any_(F.col("_scoped")).alias("_any_scoped"),
        F.coalesce(F.min(valid_only(F.when(F.col("_eq_valid"), 1).otherwise(0))) == 1, F.lit(False)).alias("_equal_valid"),
        any_(F.col("_valid") & (F.coalesce("scope", F.lit("")) != F.col("scope_key"))).alias("_unscoped"),
        any_(F.col("_valid") & (F.col("review_reason") == "invalid_value")).alias("_invalid"), any_(F.col("_valid") & unclear).alias("_unclear"),
        any_(human).alias("_human"), any_((F.col("status") == "rejected") & ~F.col("_eq_valid")).alias("_rejected_other"),
        F.coalesce(F.max(valid_only(F.col("_bounds.low"))) <= F.min(valid_only(F.col("_bounds.high"))), F.lit(False)).alias("_bounds_meet"),
        F.coalesce(F.min(valid_only(F.when(F.col("_bounds").isNotNull(), 1).otherwise(0))) == 1, F.lit(False)).alias("_bounded"), F.count_distinct("value.unit").alias("_units"),
        (~all_(scalar)).alias("_prose"), F.count_distinct(unit_word).alias("_unit_words"),
        F.coalesce(F.min_by("value", F.when(human, order)), F.min_by("value", F.when(F.col("_scoped"), order)), F.min_by("value", F.when(F.col("_valid"), order))).alias("_chosen"),
        F.sort_array(F.collect_list(F.struct("source_file", "position", "candidate_id")))["candidate_id"].alias("candidate_ids"),
    )
    explicit = F.max(F.when(F.col("scope_key") != "", 1).otherwise(0)).over(Window.partitionBy("product_id", "field")) == 1
    if relations is None:
        g = g.withColumn("_blocked", F.lit(False))
    else:
        ids = relations.filter("severity = 'block'").select(F.explode("candidate_ids").alias("_id"))
        held = g.select(*key, F.explode("candidate_ids").alias("_id")).join(ids, "_id", "left_semi").select(*key).distinct().withColumn("_blocked", F.lit(True))
        g = g.join(held, key, "left").withColumn("_blocked", F.coalesce("_blocked", F.lit(False)))
    electrical = F.col("field").isin(*[f.name for f in registry.fields() if f.policy == "electrical"])
    agreeing = (F.col("scope_key") != "") & F.col("_any_scoped") & F.col("_equal_valid")
    version = F.col("_equal_in_hint") & ((F.col("_hints") > 1) | (F.col("_historical") & (F.col("_buckets") > 1)))
    soft_text = F.col("field").isin("material", "color") & F.col("_contained")
    opaque = F.col("field").startswith("custom_") & (F.col("_prose") | (F.col("_unit_words") > 1))
    g = windowed(g, {"_explicit_scopes": explicit, "_agreeing": agreeing, "_version": version, "_soft": opaque | soft_text | (F.col("_bounded") & F.col("_bounds_meet") & (F.col("_units") <= 1))})
    classification = (
        F.when(F.col("_ambiguous"), "identity_ambiguous")
        .when((F.col("candidate_count") == 1) & F.col("_split"), "semantic_scope_split")
        .when(F.col("candidate_count") == 1, "insufficient_evidence")
        .when(F.col("_equal"), F.when(F.col("_spellings") == 1, "exact_match").otherwise("converted_match"))
        .when(soft_text, "compatible_expression")
        .when(F.col("_version"), "likely_version_update")
        .otherwise("strong_conflict")
    )
    reason = (
        F.when(F.col("_valid_n") < F.col("_active"), "source_changed")
        .when(F.col("_active") == 0, "all_rejected")
        .when(F.col("_ambiguous_valid"), "identity_ambiguous")
        .when((F.col("_unscoped") & ~F.col("_agreeing")) | ((F.col("scope_key") == "") & (electrical | F.col("_explicit_scopes"))), "scope_unclear")
        .when(F.col("_blocked"), "blocking_relation")
        .when(F.col("_invalid"), "invalid_value")
        .when(F.col("_unclear"), "unclear_value")
        .when(F.col("_version") & ~F.col("_equal_valid"), "version_unclear")
        .when(~F.col("_equal_valid") & F.col("_soft"), "compatible_expression")
    )
    g = stage(g, {"classification": classification, "review_reason": reason, "sources": F.when(F.col("_agreeing"), F.col("_scoped_sources")).otherwise(F.col("_valid_sources"))})
    fact_status = F.when(F.col("review_reason").isNotNull(), "pending_confirmation").when(F.col("_equal_valid"), "verified").otherwise("conflict")
    g = stage(g, {"fact_status": fact_status})
    method = F.when(F.col("fact_status") == "verified", F.when(F.col("_human") & F.col("_rejected_other"), "human_resolved_conflict").when(F.col("_human"), "human_confirmed")
                    .when(F.col("sources") < 2, "single_value").when(F.col("_spellings") == 1, "cross_source_exact").otherwise("cross_source_converted"))
    severity = F.when(F.col("classification").isin("exact_match", "converted_match"), "pass").when(F.col("classification") == "strong_conflict", "block").otherwise("review")
    chosen = F.when(F.col("fact_status") == "verified", F.col("_chosen"))
    return g.select(
        F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, 20).alias("group_id"), "product_id", "field", "field_label", F.nullif("scope_key", F.lit("")).alias("scope"),
        "classification", severity.alias("severity"), "fact_status", "review_reason", method.alias("verification_method"), chosen.alias("selected_value"), "candidate_count",
        F.col("sources").alias("independent_source_count"), "recognition_confidence", "mapping_confidence", "evidence_consistency",
        (F.col("_valid_n") == F.col("_active")).alias("current"), (F.col("_human") & (F.col("fact_status") == "verified")).alias("human_approved"), "candidate_ids",
    )


def cross_field_relations(candidates: DataFrame) -> DataFrame:
    """Products whose net, gross and plain weights differ: different notions, not a conflict."""
    weights = candidates.filter(F.col("field").isin("net_weight", "gross_weight", "weight") & ~F.col("identity_status").isin(*NEEDS_REVIEW))
    per = weights.groupBy("product_id").agg(
        F.array_sort(F.collect_set("field")).alias("fields"), F.count_distinct(F.when(F.col("value.unit") == "g", F.col("value_key"))).alias("_values"),
        F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"),
    )
    found = per.filter("size(fields) > 1 and _values > 1")
    return found.select("product_id", F.lit("semantic_scope_mismatch").alias("relation_type"), "fields", F.lit("info").alias("severity"), "candidate_ids")


def numeric_groups(rows: DataFrame, key: list[str], value: str, source: str, order: list[str]) -> DataFrame:
    """Groups of plain numbers: counts, distinct sources, mode share, classification and status."""
    first = F.first(value).over(Window.partitionBy(*key).orderBy(*order))
    same = F.count(F.lit(1)).over(Window.partitionBy(*key, value))
    marked = rows.select(*key, F.col(source).alias("_source"), numbers_equal(F.col(value), first).alias("_eq"), same.alias("_same"))
    per = marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_source").alias("sources"), (F.min(F.col("_eq").cast("int")) == 1).alias("_equal"), F.max("_same").alias("_most")
    )
    share = F.round(F.col("_most") / F.col("n"), 4)
    classification = F.when(F.col("n") == 1, "insufficient_evidence").when(F.col("_equal"), "exact_match").otherwise("strong_conflict")
    return per.select(*key, "n", "sources", share.alias("mode_share"), classification.alias("classification"), F.when(F.col("_equal"), "verified").otherwise("conflict").alias("fact_status"))
