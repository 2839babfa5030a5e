"""Matrix tables, charts, pictures, model-output gates and recognised lines."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from factloom.operators import extract, model_output, ocr
from factloom.operators.identity import resolve_products
from factloom.sources import files, matrices, visuals


def test_parameter_matrix():
    rows = [["Title"], ["Parameter", "Condition", "Min", "Typ", "Max", "Unit"], ["Supply", "25°C", "1.8", "-", "3.6", "V"], ["", "x", "1", "2", "3", "A"], ["Leak", "", "", "", "5", "mA"]]
    how, cells = matrices.bind_table(rows)
    assert how == "parameter"
    assert [(c.label, c.value, c.parents) for c in cells] == [("Supply", "min: 1.8 V; max: 3.6 V", ("25°C",)), ("Leak", "max: 5 mA", ())]


def test_model_matrix():
    rows = [["Model", "X-1", "X-2"], ["Input", "", ""], ["Voltage", "5V", "9V"], ["Model", "Y-1", "Y-1"], ["Voltage", "1V", "2V"], ["Model", "Z-1", "Z-2"], ["Weight", "3g", ""]]
    how, cells = matrices.bind_table(rows)
    assert how == "model"
    assert [(c.label, c.value, c.identity, c.parents) for c in cells] == [
        ("Voltage", "5V", {"model": "X-1"}, ("Input",)), ("Voltage", "9V", {"model": "X-2"}, ("Input",)), ("Weight", "3g", {"model": "Z-1"}, ()),
    ]


def test_matrix_tables_become_facts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Model,X-1,X-2\n净重,300g,400g\nInput,,\nVoltage,5V,9V\n", encoding="utf-8")
    blocks = files.read_blocks(files.discover(spark, str(tmp_path)))
    got = resolve_products(extract.candidates(files.evidence(blocks))).filter("field <> 'model'").collect()
    assert sorted((r["model"], r["field"], r["scope"], r["value_key"]) for r in got) == [
        ("X-1", "net_weight", "net", "g|300"), ("X-1", "voltage", "input", "V|5"), ("X-2", "net_weight", "net", "g|400"), ("X-2", "voltage", "input", "V|9"),
    ]


def test_reference_and_record_tables():
    assert matrices.bind_table([["Version", "Date"], ["1", "2020"]])[0] == "reference"
    assert matrices.bind_table([["SKU", "净重"], ["A1", "300g"]]) == ("row", [])


CHART = (
    '<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><c:chart>'
    "<c:title><a:t>Load</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:v>S</c:v></c:tx><c:cat><c:pt idx='0'><c:v>a</c:v></c:pt><c:pt idx='1'><c:v>b</c:v></c:pt></c:cat>"
    "<c:val><c:pt idx='1'><c:v>2.5</c:v></c:pt></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>"
)


def test_office_visuals(spark, monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/media/a.png", b"1" * 10)
        z.writestr("word/media/b.png", b"2" * 100)
        z.writestr("word/media/c.png", b"3" * 10)
        z.writestr("word/charts/chart1.xml", CHART)
    found = spark.createDataFrame([("f.docx", ".docx", bytearray(out.getvalue()), None), ("bad.docx", ".docx", bytearray(b"x"), None)], "source_file string, kind string, content binary, skip_reason string")
    got = {r["part"]: r["issue"] for r in visuals.embedded_images(found).filter("source_file = 'f.docx'").collect()}
    assert got == {"word/media/a.png": None, "word/media/b.png": None, "word/media/c.png": None}
    assert visuals.embedded_images(found).filter("source_file = 'bad.docx' and issue is not null").count() == 1
    points = [(r["title"], r["chart_type"], r["series_name"], r["category"], r["value"]) for r in visuals.charts(found).orderBy("point").collect()]
    assert points == [("Load", "bar", "S", "a", None), ("Load", "bar", "S", "b", 2.5)]


def test_model_output_gate(spark):
    good = {"id": "t1", "raw_text": "净重：≤300g", "bbox_1000": [0, 0, 10, 10], "position_precision": "approximate", "legibility": "clear", "confidence_estimate": 0.9, "confidence_source": "model_self_assessment"}
    bad = [good | {"extra": 1}, good | {"confidence_estimate": 2}, good | {"bbox_1000": [5, 0, 5, 1]}, good | {"raw_text": " "}, good | {"bbox_1000": None}]
    outputs = [("a", json.dumps([good, *bad], ensure_ascii=False)), ("b", "not json"), ("c", json.dumps({"items": [good]}, ensure_ascii=False)), ("d", '{"x": 1}')]
    texts = model_output.transcriptions(spark.createDataFrame(outputs, "image string, output string")).cache()
    issues = lambda image: [r["issue"] for r in texts.filter(F.col("image") == image).orderBy("item").collect()]
    assert issues("a") == [None, "invalid_item_schema", "invalid_confidence", "invalid_bbox", "invalid_text", "invalid_position_precision"]
    assert issues("b") == ["invalid_json"] and issues("c") == [None] and issues("d") == ["no_items"]
    one = {"transcription_id": "t1", "field": "net_weight", "raw_value": "≤300g", "mapping_confidence_estimate": 0.9, "confidence_source": "model_self_assessment"}
    maps = [one, one | {"raw_value": "300g"}, one | {"raw_value": "400g"}, one | {"transcription_id": "t9"}, one | {"field": "height of it"}]
    got = model_output.mappings(spark.createDataFrame([("a", json.dumps(maps, ensure_ascii=False))], "image string, output string"), texts).orderBy("item").collect()
    assert [r["issue"] for r in got] == [None, "truncated_measurement", "raw_value_not_in_source", "unknown_transcription_id", "field_not_allowed"]
    whole = spark.createDataFrame([("毛重：约为60g（运输状态）", "毛重", "60g", "约为", "运输状态"), ("毛重：非60g", "毛重", "60g", "", "")], "t string, l string, v string, q string, c string")
    assert [r[0] for r in whole.select(model_output.explained(*map(F.col, "tlvqc"))).collect()] == [True, False]


def test_recognised_lines(spark):
    rows = [(1, 1, "净重", 0, 0, 50, 20, 0.99), (1, 2, "300g", 100, 2, 150, 20, 0.99), (1, 3, "长度", 0, 200, 50, 220, 0.99), (1, 4, "5cm", 60, 200, 80, 220, 0.99), (1, 5, "6cm", 90, 200, 99, 220, 0.5)]
    lines = spark.createDataFrame(rows, "image int, line_id int, text string, x0 int, y0 int, x1 int, y1 int, confidence double")
    assert [r["text"] for r in ocr.pair_rows(lines).collect()] == ["净重: 300g"]
    assert [r["line_id"] for r in lines.filter(ocr.needs_review(F.col("text"), F.col("confidence"))).collect()] == [5]
    band = ocr.review_band(lines).first()
    assert (band["top"], band["bottom"]) == (0, 260)
