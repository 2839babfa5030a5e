"""Checking drafts: from their text to findings, as one plan.

A draft's lines are cut into segments and clauses, clauses are read like
evidence, and what they state is held against approved facts.  A clause's
product is the one it names; where it names none, the only product there is.

Findings: the outcomes of ``claims.evaluate`` other than supported; assertions
that no fact table can support (unsupported); numbers with a unit in a clause
from which nothing was read (unverified).  A draft is blocked by a conflict or
an unsupported claim, needs review for other findings or if it states nothing,
and else matches in the fields that it covers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.functions.tables import by_merge, settled
from factloom.functions.values import value_key, values_equal
from factloom.operators import claims, extract, segments

_units = "|".join(sorted(map(lambda u: rf"\Q{u}\E", registry.spellings()), key=len, reverse=True))
#: A number with a unit of the registry.
MEASUREMENT = rf"(?<![A-Za-z0-9_.])[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(?:{_units})(?![A-Za-z0-9])"
IDENTITY = ("sku", "model", "variant")


@dataclass
class DraftCheck:
    claims: DataFrame
    findings: DataFrame
    drafts: DataFrame


def clauses_of(drafts: DataFrame) -> DataFrame:
    """Drafts (draft_id, text) to clauses: draft_id, line (from 1), clause_id, clause."""
    lines = drafts.select("draft_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("position", "text"), F.lit(False).alias("atomic"))
    cut = segments.segments(lines).select("draft_id", (F.col("position") + 1).alias("line"), "seq", F.posexplode(claims.clauses(F.col("segment"))).alias("part", "clause"))
    return cut.select("draft_id", "line", F.concat_ws(":", "draft_id", "line", "seq", "part").alias("clause_id"), "clause")


def check(drafts: DataFrame, facts: DataFrame) -> DraftCheck:
    """Hold drafts (draft_id, text) against approved facts (fact_id, field, product_id, scope, value).

    ``value`` is a normalised value; facts of the identity fields name products.
    """
    clauses, facts = settled(clauses_of(drafts), "clauses"), settled(facts, "approved")
    names = facts.filter(F.col("field").isin(*IDENTITY) & F.col("product_id").isNotNull()).select(F.col("value.txt").alias("name"), "product_id").distinct()
    owned = claims.mentioned_products(clauses, names, take_only=True)
    several = names.agg((F.min("product_id") < F.max("product_id")).alias("_several"))  # one row
    owned = owned.crossJoin(F.broadcast(several))
    unsure = F.col("product_ambiguous") | (F.col("product_id").isNull() & F.coalesce("_several", F.lit(False)))
    owned = owned.withColumn("product_ambiguous", unsure).drop("_several")
    read = settled(extract.candidates(clauses.select(
        F.col("clause_id").alias("block_id"), F.col("draft_id").cast("string").alias("source_file"), F.lit("").alias("file_hash"), F.lit(0).alias("position"),
        F.col("clause").alias("text"), F.lit(True).alias("atomic"), F.lit(1.0).alias("recognition_confidence"),
    )), "claimed")
    stated = read.filter(~F.col("field").isin(*IDENTITY)).select(
        F.col("candidate_id").alias("claim_id"), F.col("block_id").alias("clause_id"), "field", "scope", "value", F.col("value.unit").alias("unit"), "raw"
    )
    made = settled(stated.join(by_merge(owned.select("draft_id", "line", "clause_id", "product_id", "product_ambiguous")), "clause_id"), "claims")
    approved = facts.select("fact_id", F.col("field").alias("fact_field"), F.col("product_id").alias("fact_product_id"), F.col("scope").alias("fact_scope"), F.col("value").alias("fact_value"), F.col("value.unit").alias("fact_unit"))
    same = values_equal(F.col("value"), F.col("fact_value"))
    judged = claims.evaluate(made, approved, same, (value_key(F.col("value")), value_key(F.col("fact_value"))))
    judged = settled(judged, "judged-claims")

    told = by_merge(read.select(F.col("block_id").alias("clause_id")).distinct())
    inferred = clauses.select("draft_id", "line", "clause_id", F.explode(F.regexp_extract_all("clause", F.lit(claims.INFERENTIAL), F.lit(0))).alias("observed"))
    inferred = inferred.join(told, "clause_id", "left_anti")
    loose = clauses.join(told, "clause_id", "left_anti")
    loose = loose.select("draft_id", "line", "clause_id", F.explode(F.regexp_extract_all("clause", F.lit(MEASUREMENT), F.lit(0))).alias("observed"))
    none = F.lit(None).cast("string")
    findings = judged.filter("outcome <> 'supported'").select("draft_id", "line", F.col("outcome").alias("kind"), "field", F.col("raw").alias("observed"))
    findings = findings.unionByName(inferred.select("draft_id", "line", F.lit("unsupported").alias("kind"), none.alias("field"), "observed"))
    findings = findings.unionByName(loose.select("draft_id", "line", F.lit("unverified").alias("kind"), none.alias("field"), "observed"))

    marks = judged.select("draft_id", F.lit(1).alias("claim"), F.lit(None).cast("string").alias("kind"))
    marks = marks.unionByName(inferred.select("draft_id", F.lit(1).alias("claim"), none.alias("kind")))
    marks = marks.unionByName(findings.select("draft_id", F.lit(0).alias("claim"), "kind"))
    per = marks.groupBy("draft_id").agg(F.sum("claim").alias("claims"), F.count("kind").alias("findings"), F.count_if(F.col("kind").isin("conflict", "unsupported")).alias("blocking"))
    whole = drafts.select("draft_id").join(by_merge(per), "draft_id", "left").na.fill(0, ["claims", "findings", "blocking"])
    status = F.when(F.col("blocking") > 0, "blocked").when((F.col("findings") > 0) | (F.col("claims") == 0), "needs_review").otherwise("covered_fields_match")
    return DraftCheck(judged, findings, whole.withColumn("draft_status", status))
