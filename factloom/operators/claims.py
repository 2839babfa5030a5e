"""Checking claims of a draft against approved facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.tables import by_merge
from factloom.functions.values import numbers_equal

# Fixed value: assertions that nothing in a fact table can support.
INFERENTIAL = r"(?i)适合户外|户外使用|长期浸水|效率提升\s*[0-9]+(?:\.[0-9]+)?%|supports?\s+[^,.;，。；]{1,80}|兼容[^，。；;]{1,80}"


def clauses(text: Column) -> Column:
    """Sentences of a segment; a point between digits does not end one."""
    return F.filter(F.transform(F.split(text, r"[。！？!?]|(?<![0-9])\.(?![0-9])"), lambda x: F.trim(x)), lambda c: c != "")


def _buckets(value: Column) -> Column:
    """Keys of a number, of which two numbers equal up to rounding share one: six digits, taken a little below and above."""

    def key(x: Column) -> Column:
        exponent = F.greatest(F.lit(0), F.ceil(F.log10(F.greatest(F.abs(x), F.lit(1.0)))).cast("int") - 6)
        return F.concat_ws(":", exponent, F.floor(x * 1e3 / F.pow(F.lit(10.0), exponent)).cast("string"))

    slack = F.greatest(2e-12 * F.abs(value), F.lit(2e-9))
    return F.array_distinct(F.array(key(value - slack), key(value), key(value + slack)))


def evaluate(claims: DataFrame, facts: DataFrame, same: Column | None = None, key: tuple[Column, Column] | None = None) -> DataFrame:
    """Each claim (claim_id, field, product_id, scope, value, unit, product_ambiguous) with outcome and evidence.

    Facts are (fact_id, fact_field, fact_product_id, fact_scope, fact_value,
    fact_unit).  Outcomes: product_ambiguous, supported, scope_ambiguous,
    conflict, else unsupported.  A missing product on either side matches any.
    ``same`` says when values are equal, by default up to rounding; ``key`` gives
    a text of claim and fact that equal values share, needed with ``same``.

    Claims meet facts by field, product, scope, unit and value, never by field
    alone.  Where a product is missing on one side, the other's facts are first
    gathered by their distinct values.  An ambiguous claim has no evidence.
    """
    c = F.col
    if same is None:
        same = numbers_equal(c("value"), c("fact_value"))
        claim_keys, fact_keys = _buckets(c("value")), _buckets(c("fact_value"))
    else:
        claim_keys, fact_keys = F.array(key[0]), F.array(key[1])
    asked = claims.filter(~c("product_ambiguous"))
    none = F.lit("")
    own = lambda unit: F.coalesce(unit, none)
    left = asked.withColumns({"_scope": F.coalesce("scope", none), "_unit": own(c("unit")), "_key": F.explode(claim_keys)})
    right = facts.select("*", F.coalesce("fact_scope", none).alias("_scope"), own(c("fact_unit")).alias("_unit"), F.explode(fact_keys).alias("_key"))
    by = ["_field", "_scope", "_unit", "_key"]
    left, right = left.withColumnRenamed("field", "_field"), right.withColumnRenamed("fact_field", "_field")
    scopes_agree = c("scope").eqNullSafe(c("fact_scope"))

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, "fact_value", "fact_scope").agg(F.collect_set("fact_id").alias("_ids"))

    pairs = [
        left.filter("product_id is not null").join(by_merge(right.withColumnRenamed("fact_product_id", "product_id").filter("product_id is not null")), ["product_id", *by]).withColumn("_ids", F.array("fact_id")),
        left.filter("product_id is not null").join(by_merge(gathered(right.filter("fact_product_id is null"))), by),
        left.filter("product_id is null").join(by_merge(gathered(right)), by),
    ]
    evidence = None
    for pair in pairs:
        found = pair.filter(same & scopes_agree).select("claim_id", "_ids")
        evidence = found if evidence is None else evidence.unionByName(found)
    evidence = evidence.groupBy("claim_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("evidence_ids"))

    def known(with_scope: bool) -> DataFrame:
        """Which claims have a fact of their field and product (and scope) at all."""
        at = ["_field", "_scope"] if with_scope else ["_field"]
        mine = asked.select("claim_id", "product_id", c("field").alias("_field"), F.coalesce("scope", none).alias("_scope"))
        have = facts.select(c("fact_field").alias("_field"), F.coalesce("fact_scope", none).alias("_scope"), c("fact_product_id").alias("product_id")).select("product_id", *at).distinct()
        hits = mine.join(by_merge(have.filter("product_id is not null")), ["product_id", *at], "left_semi").select("claim_id")
        hits = hits.unionByName(mine.join(have.filter("product_id is null").drop("product_id"), at, "left_semi").select("claim_id"))
        hits = hits.unionByName(mine.filter("product_id is null").join(have.drop("product_id").distinct(), at, "left_semi").select("claim_id"))
        return hits.distinct()

    here = known(False).withColumn("_here", F.lit(True))
    scoped = known(True).withColumn("_scoped", F.lit(True))
    rows = claims
    for more in (evidence, here, scoped):
        rows = rows.join(by_merge(more), "claim_id", "left")
    outcome = (
        F.when(c("product_ambiguous"), "product_ambiguous").when(c("evidence_ids").isNotNull(), "supported").when(c("_scoped"), "conflict")
        .when(c("_here"), "scope_ambiguous").otherwise("unsupported")
    )
    return rows.select(*claims.columns, F.coalesce("evidence_ids", F.array().cast(evidence.schema["evidence_ids"].dataType)).alias("evidence_ids"), outcome.alias("outcome"))


def draft_status(outcomes: DataFrame) -> DataFrame:
    """blocked, needs_review or covered_fields_match, per draft."""
    bad = F.count_if(F.col("outcome").isin("conflict", "unsupported"))
    open_ = F.count_if(F.col("outcome").isin("scope_ambiguous", "product_ambiguous"))
    status = F.when(bad > 0, "blocked").when((open_ > 0) | (F.count(F.lit(1)) == 0), "needs_review").otherwise("covered_fields_match")
    return outcomes.groupBy("draft_id").agg(F.count(F.lit(1)).alias("claims"), bad.alias("blocking"), status.alias("draft_status"))


#: Characters of the longest run of letters without spaces that is looked up as one.
_RUN = 16
_word = r"[a-z0-9][a-z0-9_.-]*[a-z0-9]|[a-z0-9]"
_run = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+"


def _longest(parts: Column) -> Column:
    return F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"]


def mentioned_products(rows: DataFrame, names: DataFrame, take_only: bool = False) -> DataFrame:
    """rows (clause_id, clause) with the one product whose name stands in the clause; null if none or several.

    A name may have spaces or be of a script without them; its Latin ends must
    be ends of words.  ``take_only`` takes the only product there is where none
    is named.  Clauses meet names in an equi-join by the name's longest word or
    run of letters, so the names may be many.
    """
    text = F.lower("clause")
    runs = F.regexp_extract_all(text, F.lit(_run), F.lit(0))
    cuts = lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(_RUN), F.length(r) - i + 1)), lambda n: F.substring(r, i, n))))
    keys = F.concat(F.regexp_extract_all(text, F.lit(_word), F.lit(0)), F.flatten(F.transform(runs, cuts)))
    words = rows.select("clause_id", text.alias("_text"), F.explode(F.array_distinct(keys)).alias("_key"))
    named = names.select(F.trim(F.lower("name")).alias("_name"), "product_id")
    own = F.coalesce(_longest(F.regexp_extract_all("_name", F.lit(_word), F.lit(0))), F.substring(_longest(F.regexp_extract_all("_name", F.lit(_run), F.lit(0))), 1, _RUN))
    named = named.withColumn("_key", own).filter("_key is not null")
    whole = F.concat(F.lit(r"(?<![a-z0-9])(?<![a-z0-9][_.-])\Q"), "_name", F.lit(r"\E(?![a-z0-9])(?![_.-][a-z0-9])"))
    hits = words.join(by_merge(named), "_key").filter((F.col("_name") == F.col("_key")) | F.regexp("_text", whole))
    one = hits.groupBy("clause_id").agg(F.min("product_id").alias("_low"), F.max("product_id").alias("_high"))
    found = rows.join(by_merge(one), "clause_id", "left")
    product = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    if take_only:
        only = names.agg(F.when(F.min("product_id") == F.max("product_id"), F.min("product_id")).alias("_only"))  # one row
        found = found.crossJoin(F.broadcast(only))
        product = F.when(F.col("_low").isNull(), F.col("_only")).otherwise(product)
    return found.withColumns({"product_id": product, "product_ambiguous": F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))}).drop("_low", "_high", "_only")
