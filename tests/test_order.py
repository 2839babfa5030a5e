"""Order within long blocks, labels and scopes, ranges in two units."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract, segments
from factloom.operators.identity import resolve_products
from factloom.plans.analysis import analyse
from tests.test_evidence import blocks

BLOCK = "block_id string, source_file string, file_hash string, position int, text string, atomic boolean, recognition_confidence double"


def test_long_blocks_keep_their_order(spark):
    """118 plain lines and a second SKU after the first one: what the next block states is the second's."""
    text = "SKU: G1\n" + "plain line\n" * 118 + "SKU: G2"
    rows = [("b1", "f", "h", 0, text, False, 1.0), ("b2", "f", "h", 1, "长度：20cm", False, 1.0)]
    got = resolve_products(extract.candidates(spark.createDataFrame(rows, BLOCK))).filter("field = 'length'").collect()
    assert [r["sku"] for r in got] == ["G2"]


def test_blocks_with_very_many_lines(spark):
    row = [("b", "plain\n" * 230_000 + "length: 5 cm", False)]
    got = segments.segments(spark.createDataFrame(row, "block_id string, text string, atomic boolean"))
    assert got.agg(F.max("seq")).first()[0] == 230_000 << 31 and got.count() == 230_001


CUTS = {
    "net weight 300g, length: 5 cm; width 3 mm": ["net weight 300g", "length: 5 cm", "width 3 mm"],
    "colours: red, green and blue": ["colours: red, green and blue"],
    "note; see (table) 3: x": ["note", "see (table) 3: x"],
    "净重：300g；毛重400g，材质钢": ["净重：300g", "毛重400g，材质钢"],
    "a\x01b: 1; length": ["a b: 1; length"],
    "length: 5; width ": ["length: 5", "width"],
}


def test_lines_break_in_front_of_labels_only(spark):
    rows = spark.createDataFrame([(k, t, False) for k, t in enumerate(CUTS)], "block_id int, text string, atomic boolean")
    got: dict[int, list[str]] = {}
    for r in segments.segments(rows).orderBy("block_id", "seq").collect():
        got.setdefault(r["block_id"], []).append(r["segment"])
    assert [got[k] for k in range(len(CUTS))] == list(CUTS.values())


SCOPES = [
    ("包装尺寸：10×20×30mm", "dimensions", "packaging", "mm|[10,20,30]"),
    ("产品尺寸：99*82*30mm (L*W*H)", "dimensions", "product|axes:L×W×H", "mm|[99,82,30]"),
    ("尺寸：10x20 mm", "dimensions", None, "mm|[10,20]"),
    ("尺寸：10x20 mm (L×W)", "dimensions", "axes:L×W", "mm|[10,20]"),
    ("输入电压：12V DC", "voltage", "input|signal:dc", "V|12"),
    ("工作温度：0°C~40°C (32°F~104°F)", "temperature", "operating", "°C|[0,40]"),
    ("工作温度：0°C~40°C (32°F~105°F)", "temperature", "operating", "|0°C~40°C (32°F~105°F)"),
]


@pytest.mark.parametrize(("text", "field", "scope", "key"), SCOPES)
def test_scopes_and_ranges_in_two_units(spark, text, field, scope, key):
    got = extract.candidates(blocks(spark, {"a.txt": text})).collect()
    assert [(r["field"], r["scope"], r["value_key"].lower()) for r in got] == [(field, scope, key.lower())]


def test_sizes_of_box_and_product_are_no_conflict(spark):
    done = analyse(blocks(spark, {"a.txt": "SKU: A\n包装尺寸：10×20×30mm", "b.txt": "SKU: A\n产品尺寸：1×2×3mm"}))
    facts = {r["scope"]: r["fact_status"] for r in done.groups.filter("field = 'dimensions'").collect()}
    assert facts == {"packaging": "verified", "product": "verified"}


def test_a_model_without_sku_and_variant(spark):
    done = analyse(blocks(spark, {"a.txt": "型号：A100\n电池容量：2000mAh\n容量：2Ah"}))
    assert [(r["label"], r["variants"]) for r in done.products.collect()] == [("A100", [])]
    fact = done.groups.filter("field = 'capacity_charge'").first()
    assert (fact["fact_status"], fact["selected_value"]["num"]) == ("verified", 2000.0)
