"""Driver queries against plain versions over whole tables."""

import collections
import random
import re

import duckdb
import numpy as np

import __spark_entry__
from factloom.operators import layout

SF = "/root/testdata/sf0.01"


def test_running_margins_take_all_words_of_a_page(spark):
    words = {r["page_id"]: re.findall("[A-Za-z]{9,}", r["html"] or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    pages = collections.Counter((place, word) for found in words.values() for place, word in enumerate(found))
    want = sorted((page, place, word) for page, found in words.items() for place, word in enumerate(found) if pages[place, word] < 2)
    assert max(map(len, words.values())) > 12 and max(place for _, place, _ in want) >= 12
    assert sorted(map(tuple, __spark_entry__.queries()["running_margin_pages"](spark, SF).collect())) == want


def test_every_vector_is_a_box(spark):
    rows = [(r["vec_id"], r["label"], *r["embedding"][:2]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = sorted((w, b) for w, k, x, y in rows for b, m, left, top in rows if k == m and left <= x <= left + 0.2 and top <= y <= top + 0.2)
    assert any(b % 10 for _, b in want)
    assert sorted(map(tuple, __spark_entry__.queries()["bbox_contain"](spark, SF).collect())) == want


def test_box_sides_are_added_as_floats(spark, tmp_path):
    """As in SQL: the corner of a box is a float, so what lies between its sum in float and in double counts by the former."""
    rng = np.random.default_rng(7)
    left = rng.uniform(-0.4, 0.4, 400).astype(np.float32)
    right = left + np.float32(0.2)
    rows = [(k, [float(x), 0.0], k // 2) for k, x in enumerate(np.column_stack([left, right]).ravel())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = __spark_entry__.oracle_sql()["bbox_contain"].replace("JOIN embeddings", "JOIN vectors").replace("FROM embeddings", "FROM vectors")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW vectors AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(db.execute(sql).fetchall())
    in_double = sum(float(r) <= float(x) + 0.2 for x, r in zip(left, right, strict=True))
    assert len(want) == 1200 and in_double < 400
    assert sorted(map(tuple, __spark_entry__.queries()["bbox_contain"](spark, str(tmp_path)).collect())) == want


def test_boxes_of_any_size_on_the_grid(spark):
    rng = random.Random(4)
    words = [(k, rng.choice("ab"), x := rng.uniform(-2, 2), y := rng.uniform(-2, 2), x + rng.choice([0, 0.3]), y + 0.1) for k in range(200)]
    boxes = [(k, rng.choice("ab"), x := rng.uniform(-2, 2), y := rng.uniform(-2, 2), x + rng.choice([-1, 0, 0.5, 3]), y + rng.uniform(0, 3)) for k in range(60)]
    boxes += [(60, "a", words[0][2], words[0][3], words[0][4], words[0][5]), (61, "b", None, 0.0, 1.0, 1.0)]
    want = sorted((w[0], b[0]) for w in words for b in boxes if w[1] == b[1] and b[2] is not None and w[2] >= b[2] and w[3] >= b[3] and w[4] <= b[4] and w[5] <= b[5])
    corners = "x0 double, y0 double, x1 double, y1 double"
    made = spark.createDataFrame(words, f"word int, page string, {corners}"), spark.createDataFrame(boxes, "box int, page string, left double, top double, right double, bottom double")
    got = layout.contained(*made, "page", 0.5).select("word", "box").collect()
    assert want and sorted(map(tuple, got)) == want
