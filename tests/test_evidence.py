"""Evidence operators on small inputs: what each case must come out as."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.functions.values import normalise, review_reason, value_key, values_equal
from factloom.operators import claims, decisions, delivery, evaluate, extract, groups, layout, segments
from factloom.plans.analysis import analyse
from factloom.sources import files, sinks
from factloom.streaming import incremental

BLOCK = "block_id string, source_file string, file_hash string, position int, text string, atomic boolean, recognition_confidence double"


def blocks(spark, sources):
    rows = [(f"{name}:{n}", name, f"hash of {name}", n, line, False, 1.0) for name, text in sources.items() for n, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, BLOCK)


VALUES = [
    ("net_weight", "0.3kg", "g|300", None), ("net_weight", "300 g", "g|300", None), ("net_weight", "1,000g", "g|1000", None),
    ("net_weight", "1,00g", "|1,00g", "unclear_value"), ("net_weight", "不超过300g", "g|≤300", None), ("net_weight", "300g以下", "g|≤300", None),
    ("net_weight", "300±5g", "g|300±5", None), ("net_weight", "0.3kg±5g", "g|300±5", None), ("net_weight", "5 stone", "|5 stone", "unclear_value"),
    ("net_weight", "300g/400g", "|300g/400g", "unclear_value"), ("net_weight", "300 g/m²", "|300 g/m²", "unclear_value"), ("net_weight", "-5g", "g|-5", "invalid_value"),
    ("net_weight", "tbd", "|tbd", "invalid_value"), ("net_weight", "10 pounds", "g|4535.9237", None), ("net_weight", "约300g", "g|≈300", None),
    ("temperature", "0-40°C", "°C|[0,40]", None), ("temperature", "40-0°C", "°C|[40,0]", "invalid_value"), ("temperature", "32°F", "°C|0", None),
    ("dimensions", "10x20x30cm", "mm|[100,200,300]", None), ("dimensions", "100 × 200 mm", "mm|[100,200]", None), ("quantity", "2个", "count|2", None),
    ("quantity", "2.5", "|2.5", "unclear_value"), ("power", "1 MW", "W|1000000", None), ("power", "1 mW", "W|0.001", None), ("capacity", "2Ah", "mAh|2000", None),
    ("capacity", "1.5 L", "mL|1500", None), ("color", "Black", "|黑色", None), ("custom_61", "24个月", "|2年", None), ("custom_61", "1 mΩ", "|1mΩ", None),
    ("custom_61", "1 MΩ", "|1MΩ", None), ("voltage", "100-240V", "V|[100,240]", None), ("frequency", "2.4GHz", "Hz|2400000000", None),
]


def test_values(spark):
    known = {f.name: f for f in registry.fields()}
    rows = [(k, f, known[f].kind if f in known else "text", known[f].family if f in known else None, raw) for k, (f, raw, _, _) in enumerate(VALUES)]
    df = normalise(spark.createDataFrame(rows, "k int, field string, value_type string, family string, raw string"))
    reason = review_reason(F.col("field"), F.col("value_type"), F.col("family"), F.col("raw"), F.col("value"))
    got = {r["k"]: (r["key"], r["reason"]) for r in df.select("k", value_key(F.col("value")).alias("key"), reason.alias("reason")).collect()}
    assert [got[k] for k in range(len(VALUES))] == [(key, why) for _, _, key, why in VALUES]


def test_equality_has_rounding_tolerance_only(spark):
    v = "struct<kind:string,num:double,arr:array<double>,txt:string,unit:string,note:string>"
    n = lambda x, u="g": ("number", x, None, None, u, None)
    l = lambda *x: ("range", None, list(x), None, "V", None)  # noqa: E731, E741
    cases = [(n(0.1 + 0.2), n(0.3), True), (n(300.0), n(300.1), False), (n(1.0), n(1.0, "mm"), False), (l(1.0, 2.0), l(1.0, 2.0), True), (l(1.0, 2.0), l(1.0, 3.0), False), (l(1.0), l(1.0, 2.0), False)]
    got = spark.createDataFrame([(a, b) for a, b, _ in cases], f"a {v}, b {v}").select(values_equal(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r["e"] for r in got] == [e for *_, e in cases]


EXTRACTED = {
    "净重：300g；毛重：400g": [("net_weight", "net", "g|300"), ("gross_weight", "gross", "g|400")],
    "A100/A200 净重: 300g": [("net_weight", "net", "g|300")],
    "输入电压：5V": [("voltage", "input", "V|5")],
    "净重不是300g，正确净重320g": [("net_weight", "net", "g|320")],
    "净重：999g（仅为模板）": [],
    "80 grams net weight": [("net_weight", "net", "g|80")],
    "INPUT: 5V/3A": [("current", "input", "A|3"), ("voltage", "input", "V|5")],
    "Weight (kg): 2": [("weight", "unspecified", "g|2000")],
    "净重 | 300g": [("net_weight", "net", "g|300")],
    "note: hello": [],
    "leakage current: 3mA": [("custom_" + "leakage current".encode().hex(), None, "|3mA")],
}


def test_extraction(spark):
    source = blocks(spark, {str(k): t for k, t in enumerate(EXTRACTED)})
    got = {str(k): [] for k in range(len(EXTRACTED))}
    for r in extract.candidates(source).collect():
        got[r["source_file"]].append((r["field"], r["scope"], r["value_key"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {str(k): sorted(v, key=str) for k, v in enumerate(EXTRACTED.values())}


def test_document_context(spark):
    c = {r["source_file"]: r for r in segments.document_context(blocks(spark, {"a.txt": "文档版本: v1.2\nx", "content_draft.md": "x", "旧版.txt": "document version: 1\ndocument version: 2"})).collect()}
    assert (c["a.txt"]["role"], c["a.txt"]["version"]) == ("evidence", "1.2") and c["content_draft.md"]["role"] == "draft"
    assert c["旧版.txt"]["historical"] and c["旧版.txt"]["version"] is None


def test_facts_from_text(spark):
    """Each case has products of its own, so all share one analysis."""
    done = analyse(blocks(spark, {
        "1a.txt": "SKU: A1\n净重：0.3kg\nnet width: x", "1b.txt": "SKU: A1\n净重：300g",
        "2a.txt": "SKU: B10\n净重：300g", "2b.txt": "SKU: B10\n净重：320g", "2c.txt": "SKU: B10\n净重：300g",
        "3_v1.txt": "SKU: C1\n最大压力：100kPa", "3_v2.txt": "SKU: C1\n最大压力：160kPa",
        "4.txt": "SKU: D1\n输入电压：5V\n额定电压：7.4V", "5a.txt": "SKU: E1\n净重：≤300g", "5b.txt": "SKU: E1\n净重：300g",
        "6.txt": "SKU: F1\n净重：5 stone", "7.txt": "SKU: G1\n长度：10cm\nSKU: G2\n长度：20cm", "8.txt": "SKU: H1\n电压：5V",
        "9.txt": "SKU: I1\n净重：300g\n毛重：400g", "content_draft.txt": "SKU: A1\n净重：999g", "10.txt": "宽度：5cm",
    }))
    products = done.products.select("product_id", "sku")
    facts = done.groups.filter("field <> 'sku'").join(products, "product_id").collect()
    got = {(r["sku"], r["field"], r["scope"]): (r["fact_status"], r["review_reason"], r["verification_method"], r["classification"]) for r in facts}
    assert got["A1", "net_weight", "net"] == ("verified", None, "cross_source_converted", "converted_match")
    assert got["B10", "net_weight", "net"] == ("conflict", None, None, "strong_conflict")
    assert got["C1", "pressure", "rating:max"] == ("pending_confirmation", "version_unclear", None, "likely_version_update")
    assert got["D1", "voltage", "input"][:3] == ("verified", None, "single_value") and got["D1", "voltage", "rating:rated"][0] == "verified"
    assert got["E1", "net_weight", "net"][:2] == ("pending_confirmation", "compatible_expression")
    assert got["F1", "net_weight", "net"][:2] == ("pending_confirmation", "unclear_value")
    assert got["G1", "length", None][0] == got["G2", "length", None][0] == "verified"
    assert got["H1", "voltage", None][:2] == ("pending_confirmation", "scope_unclear")
    assert [r["fields"] for r in done.relations.collect()] == [["gross_weight", "net_weight"]]
    stray = done.candidates.filter("source_file = '10.txt'").first()
    assert stray["identity_status"] == "ambiguous"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")
    (root / "a.txt").write_text("SKU: A1\n\n净重：300g\n", encoding="gb18030")
    (root / "b.csv").write_text("SKU;净重;颜色\nA1;300g;Black\nA2;400g;\n", encoding="utf-8-sig")
    (root / "c.json").write_text(json.dumps({"items": [{"sku": "A1", "net weight": {"value": 0.3, "unit": "kg"}, "tags": ["x", "y"]}, {"sku": "A2", "length": "5 cm"}]}))
    (root / "bad.json").write_text('{"a": 1, "a": 2}')
    (root / "d.ocr.json").write_text(json.dumps({"blocks": [{"text": "净重: 300g", "confidence": 1.7}, {"text": " "}, {"text": "x"}]}))
    (root / ".hidden.txt").write_text("x")
    (root / "e.exe").write_text("x")
    with zipfile.ZipFile(root / "f.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        row = lambda *c: "<w:tr>" + "".join(map(cell, c)) + "</w:tr>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:tbl>{row('SKU', '净重')}{row('A1', '300g')}</w:tbl></w:body></w:document>")
    with zipfile.ZipFile(root / "g.xlsx", "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>SKU</t></si><si><t>净重</t></si><si><t>A1</t></si></sst>")
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><f>1+1</f><v>2</v></c></row>'
        z.writestr("xl/worksheets/s.xml", f"<worksheet {m}><sheetData>{cells}</sheetData></worksheet>")
    return str(root)


def test_readers(spark, folder):
    found = files.discover(spark, folder)
    rows = files.read_blocks(found).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r["source_file"], r["position"])):
        texts.setdefault(r["source_file"], []).append((r["text"], r["identity_sku"], r["issue"]))
    assert texts["a.txt"] == [("SKU: A1", None, None), ("净重：300g", None, None)]
    assert texts["b.csv"] == [("SKU: A1", "A1", None), ("净重: 300g", "A1", None), ("颜色: Black", "A1", None), ("SKU: A2", "A2", None), ("净重: 400g", "A2", None)]
    assert texts["c.json"] == [("sku: A1", "A1", None), ("net weight: 0.3 kg", "A1", None), ("tags: x; y", "A1", None), ("sku: A2", "A2", None), ("length: 5 cm", "A2", None)]
    assert texts["bad.json"] == [("", None, "duplicate_key")] and texts["e.exe"] == [("", None, "unsupported")] and ".hidden.txt" not in texts
    assert sorted(r["recognition_confidence"] for r in rows if r["source_file"] == "d.ocr.json") == [0.75, 1.0]
    assert texts["f.docx"] == [("Intro", None, None), ("SKU: A1", "A1", None), ("净重: 300g", "A1", None)]
    assert texts["g.xlsx"] == [("", None, "formula_or_error_cells"), ("SKU: A1", "A1", None)]
    cover = delivery.coverage(found, files.reading_issues(files.read_blocks(found))).first()
    assert (cover["files"], cover["unfinished_files"], cover["status"]) == (8, 3, "partial")


def test_streamed_files_are_read_once(spark, folder, tmp_path):
    count = lambda: spark.read.parquet(f"{tmp_path}/out").count()
    for _ in range(2):
        incremental.stream_files(spark, folder, f"{tmp_path}/out", f"{tmp_path}/state", lambda d: d.select("path")).awaitTermination()
        assert count() >= 8


def test_incremental_reading(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2x"), ("d", "4")], "source_file string, file_hash string")
    done = spark.createDataFrame([("a", "1", "s", None), ("b", "2", "s", None), ("c", "3", "s", None), ("d", "4", "s", "failed")], "source_file string, file_hash string, signature string, error string")
    assert sorted(r[0] for r in incremental.to_read(now, done, "s").collect()) == ["b", "d"]
    assert sorted(r[0] for r in incremental.to_read(now, done, "t").collect()) == ["a", "b", "d"]
    assert [r[0] for r in incremental.removed(done, now).collect()] == ["c"]
    kept = incremental.current_sources(done, now)
    assert {r["source_file"]: r["source_current"] for r in kept.collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_decisions(spark):
    made = [("x", "confirm", "s1", "t1", None, 1), ("x", "reject", "s1", "t2", None, 2), (None, "undo", None, "t3", "t2", 3), ("y", "confirm", "old", "t4", None, 4)]
    log = spark.createDataFrame([(*r, "why") for r in made], "candidate_id string, action string, snapshot string, transaction_id string, target_transaction string, decided_at int, reason string")
    rows = spark.createDataFrame([("x", "s1", "pending"), ("y", "s2", "pending"), ("z", "s3", "pending")], "candidate_id string, snapshot string, status string")
    assert {r["candidate_id"]: r["status"] for r in decisions.apply(rows, log).collect()} == {"x": "confirmed", "y": "stale", "z": "pending"}


def test_human_choice_resolves_a_conflict(spark):
    rows = analyse(blocks(spark, {"a.txt": "SKU: A\n净重：300g", "b.txt": "SKU: A\n净重：320g"})).candidates
    weights = rows.filter("field = 'net_weight'").withColumn("status", F.when(F.col("source_file") == "a.txt", "confirmed").otherwise("rejected"))
    fact = groups.fact_groups(weights).first()
    assert (fact["fact_status"], fact["verification_method"], fact["human_approved"], fact["selected_value"]["num"]) == ("verified", "human_resolved_conflict", True, 300.0)
    stale = groups.fact_groups(weights.withColumn("status", F.lit("stale"))).first()
    assert (stale["fact_status"], stale["review_reason"]) == ("pending_confirmation", "source_changed")
    gone = groups.fact_groups(weights.withColumn("status", F.lit("rejected"))).first()
    assert gone["review_reason"] == "all_rejected"


def test_claims(spark):
    facts = spark.createDataFrame([("f1", "length", "p1", "net", 5.0, "mm"), ("f2", "width", "p1", None, 5.0, "mm")], "fact_id string, fact_field string, fact_product_id string, fact_scope string, fact_value double, fact_unit string")
    made = [(1, "length", "p1", "net", 5.0, False), (2, "length", "p1", "net", 6.0, False), (3, "width", "p1", "net", 5.0, False), (4, "height", "p1", None, 5.0, False), (5, "length", None, "net", 5.0, True), (6, "length", "p2", "net", 5.0, False)]
    rows = spark.createDataFrame([(*r[:5], "mm", r[5]) for r in made], "claim_id int, field string, product_id string, scope string, value double, unit string, product_ambiguous boolean")
    got = {r["claim_id"]: r["outcome"] for r in claims.evaluate(rows, facts).collect()}
    assert got == {1: "supported", 2: "conflict", 3: "scope_ambiguous", 4: "unsupported", 5: "product_ambiguous", 6: "unsupported"}
    parts = spark.createDataFrame([("净重1.5g。 Good! Yes",)], "t string").select(claims.clauses(F.col("t")).alias("c")).first()["c"]
    assert parts == ["净重1.5g", "Good", "Yes"]


def test_layout(spark):
    words = [(1, "Net", 0.0, 10.0, 20.0, 20.0), (1, "weight", 22.0, 10.0, 60.0, 20.0), (1, "300", 120.0, 10.0, 140.0, 20.0), (1, "Length", 0.0, 30.0, 30.0, 40.0), (1, "5", 120.0, 30.0, 130.0, 40.0), (1, "Use", 0.0, 50.0, 30.0, 60.0), (1, "indoor", 120.0, 50.0, 150.0, 60.0)]
    df = spark.createDataFrame(words, "page int, text string, x0 double, top double, x1 double, bottom double")
    lines = layout.text_lines(df)
    assert [r["text"] for r in lines.orderBy("line").collect()] == ["Net weight 300", "Length 5", "Use indoor"]
    assert sorted((r["label"], r["value"]) for r in layout.aligned_pairs(lines, df).collect()) == [("Length", "5"), ("Net weight", "300"), ("Use", "indoor")]
    notes = spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (3, "b", "three"), (4, "c", "far")], "page int, marker string, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (9, "b"), (9, "c")], "page int, marker string")
    assert {(r["page"], r["marker"]): r["note"] for r in layout.note_bodies(notes, asked).collect()} == {(1, "a"): "one", (2, "b"): "two", (9, "b"): None, (9, "c"): "far"}


def test_matching_is_maximum(spark):
    pairs = spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 2, 1), ("g", 3, 2), ("h", 1, 1)], "case string, expected_id long, actual_id long")
    got = evaluate.maximum_matching(pairs, "case").collect()
    assert sum(r["case"] == "g" for r in got) == 2 and sum(r["case"] == "h" for r in got) == 1


def test_budget_skips_without_adding(spark):
    rows = spark.createDataFrame([("r", 1, 60), ("r", 2, 50), ("r", 3, 30)], "run string, n int, size int")
    assert delivery.within_budget(rows, "run", "size", "n", 100).first()["kept"] == "1,3"


def test_generations_switch_at_the_end(spark, tmp_path):
    one, two = spark.range(1).toDF("x"), spark.range(2).toDF("x")
    sinks.write_generation({"facts": one}, str(tmp_path), "g1")
    two.write.parquet(f"{tmp_path}/g2/facts")
    assert sinks.read_generation(spark, str(tmp_path), "facts").count() == 1
    sinks.write_generation({"facts": two}, str(tmp_path), "g3")
    assert sinks.read_generation(spark, str(tmp_path), "facts").count() == 2
