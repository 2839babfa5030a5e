"""Claims by key, products by name, drafts from text to findings."""

import re

from pyspark.sql import functions as F

from factloom.functions.values import normalise
from factloom.operators import claims, layout, ocr
from factloom.plans import draft_check

FACT = "fact_id string, fact_field string, fact_product_id string, fact_scope string, fact_value double, fact_unit string"
CLAIM = "claim_id int, field string, product_id string, scope string, value double, unit string, product_ambiguous boolean"


def test_claims_without_a_product_and_facts_without_one(spark):
    facts = spark.createDataFrame([("f1", "length", "p1", None, 0.1 + 0.2, "mm"), ("f2", "length", "p2", None, 0.3, "mm"), ("f3", "width", None, None, 7e9, "mm"), ("f4", "width", "p1", "x", 1.0, "mm")], FACT)
    made = [(1, "length", None, None, 0.3, "mm", False), (2, "width", "p9", None, 7e9 + 1e-3, "mm", False), (3, "width", "p9", None, 7.1e9, "mm", False), (4, "length", "p2", None, 0.3, "cm", False), (5, "width", None, "x", 1.0, "mm", False)]
    got = {r["claim_id"]: (r["outcome"], r["evidence_ids"]) for r in claims.evaluate(spark.createDataFrame(made, CLAIM), facts).collect()}
    assert got == {1: ("supported", ["f1", "f2"]), 2: ("supported", ["f3"]), 3: ("conflict", []), 4: ("conflict", []), 5: ("supported", ["f4"])}


def test_many_claims_of_one_field_meet_only_their_facts(spark, tmp_path):
    rows = spark.range(2000)
    facts = rows.select(F.col("id").alias("fact_id"), F.lit("length").alias("fact_field"), F.col("id").alias("fact_product_id"), F.lit("net").alias("fact_scope"), F.lit(5.0).alias("fact_value"), F.lit("mm").alias("fact_unit"))
    made = rows.select(F.col("id").alias("claim_id"), F.lit("length").alias("field"), F.col("id").alias("product_id"), F.lit("net").alias("scope"), F.lit(5.0).alias("value"), F.lit("mm").alias("unit"), F.lit(False).alias("product_ambiguous"))
    for name, table in (("facts", facts), ("made", made)):
        table.write.parquet(f"{tmp_path}/{name}")
    got = claims.evaluate(spark.read.parquet(f"{tmp_path}/made"), spark.read.parquet(f"{tmp_path}/facts"))
    assert got.filter("outcome = 'supported' and evidence_ids = array(claim_id)").count() == 2000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_names_with_spaces_and_other_scripts(spark):
    names = spark.createDataFrame([("A 100", 1), ("净重王", 2), ("B-7", 3), ("A 10", 4)], "name string, product_id int")
    said = ["the A 100 is out", "新的净重王上市", "b-7!", "xB-7 and A 1000", "A 100 or B-7", "nothing"]
    rows = spark.createDataFrame(list(enumerate(said)), "clause_id int, clause string")
    got = {r["clause_id"]: (r["product_id"], r["product_ambiguous"]) for r in claims.mentioned_products(rows, names).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, False), 3: (None, False), 4: (None, True), 5: (None, False)}
    only = claims.mentioned_products(rows, names.filter("product_id = 3"), take_only=True).collect()
    assert {r["product_id"] for r in only} == {3}


def test_drafts_from_text_to_findings(spark):
    raw = [("1", "sku", None, "P1", "text", None, "p1"), ("2", "sku", None, "P2", "text", None, "p2"), ("3", "length", None, "10cm", "number", "length", "p1"), ("4", "net_weight", "net", "300g", "number", "mass", "p2")]
    facts = normalise(spark.createDataFrame(raw, "fact_id string, field string, scope string, raw string, value_type string, family string, product_id string"))
    texts = {
        "fits": "P1 length: 100 mm.\nP2 净重：0.3kg",
        "wrong": "P1 length: 11cm",
        "nobody": "length: 10cm",
        "silent": "a fine thing",
        "claims too much": "P1 length: 10cm。适合户外",
        "loose": "P1 length: 10cm. It holds 5 kg",
        "unknown field": "P1 width: 5 mm",
    }
    got = draft_check.check(spark.createDataFrame(list(texts.items()), "draft_id string, text string"), facts)
    status = {r["draft_id"]: r["draft_status"] for r in got.drafts.collect()}
    assert status == {"fits": "covered_fields_match", "wrong": "blocked", "nobody": "needs_review", "silent": "needs_review", "claims too much": "blocked", "loose": "needs_review", "unknown field": "blocked"}
    kinds = {(r["draft_id"], r["kind"]) for r in got.findings.collect()}
    assert kinds == {("wrong", "conflict"), ("nobody", "product_ambiguous"), ("claims too much", "unsupported"), ("loose", "unverified"), ("unknown field", "unsupported")}


def test_nearest_label_over_cell_borders(spark):
    values = spark.createDataFrame([(1, 1, 0.99, 0.5), (1, 2, 5.0, 5.0)], "page int, value_id int, x double, y double")
    labels = spark.createDataFrame([(1, 10, 1.01, 0.5), (1, 11, 0.2, 0.5), (1, 12, 9.0, 9.0)], "page int, label_id int, x double, y double")
    got = layout.nearest_label(values, labels, "page", 1.0, 0.1).collect()
    assert [(r["value_id"], r["label_id"], r["distance"]) for r in got] == [(1, 10, 0.02)]


def test_rows_of_recognised_lines_meet_in_strips(spark):
    lines = [("i", 1, "净重", 0, 10, 50, 40), ("i", 2, "300g", 60, 14, 90, 44), ("i", 3, "长度", 0, 60, 50, 100), ("i", 4, "5cm", 60, 70, 90, 80), ("i", 5, "7g", 60, 300, 90, 320)]
    rows = spark.createDataFrame(lines, "image string, line_id int, text string, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["text"] for r in ocr.pair_rows(rows).collect()) == ["净重: 300g", "长度: 5cm"]


def test_small_files_are_not_taken_for_small_tables(spark, tmp_path):
    """A million repetitive rows make a file below the broadcast limit; no side that may grow is broadcast."""
    claim = "claim_id string, field string, product_id string, scope string, value double, unit string, product_ambiguous boolean"
    fact = "fact_id string, fact_field string, fact_product_id string, fact_scope string, fact_value double, fact_unit string"
    tables = {
        "claims": spark.createDataFrame([("c1", "length", "P1", None, 10.0, "mm", False), ("c2", "length", None, None, 11.0, "mm", False)], claim),
        "facts": spark.createDataFrame([("f1", "length", "P1", None, 10.0, "mm")], fact),
        "clauses": spark.createDataFrame([("c1", "P1 is long"), ("c2", "long")], "clause_id string, clause string"),
        "names": spark.createDataFrame([("P1", "P1")], "name string, product_id string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    judged = claims.evaluate(read["claims"], read["facts"])
    named = claims.mentioned_products(read["clauses"], read["names"])
    for made in (judged, named):
        plan = made._jdf.queryExecution().executedPlan().toString()
        keys = {key for found in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan) for key in re.findall(r"(\w+)#", found)}
        assert "SortMergeJoin" in plan, plan
        assert keys <= {"field", "_field", "_scope"}  # distinct fields are few
    assert {r["claim_id"]: r["outcome"] for r in judged.collect()} == {"c1": "supported", "c2": "conflict"}
    assert {r["clause_id"]: r["product_id"] for r in named.collect()} == {"c1": "P1", "c2": None}
