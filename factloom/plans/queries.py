"""Driver queries: every operator over whole tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.values import clean_text, normalise, number_text
from factloom.operators import claims, decisions, delivery, evaluate, extract, groups, identity, layout, segments
from factloom.plans import draft_check
from factloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------- groups and status

_GROUPED = """
WITH v AS (SELECT l_partkey, l_returnflag, l_suppkey, l_orderkey, l_linenumber, floor(l_discount * 20 + 0.0000001) AS val FROM lineitem),
f AS (SELECT *, first_value(val) OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS first_val,
      count(*) OVER (PARTITION BY l_partkey, l_returnflag, val) AS same FROM v)
SELECT l_partkey, l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS sources, round(max(same) * 1.0 / count(*), 4) AS mode_share,
  CASE WHEN count(*) = 1 THEN 'insufficient_evidence' WHEN bool_and(val = first_val) THEN 'exact_match' ELSE 'strong_conflict' END AS classification,
  CASE WHEN bool_and(val = first_val) THEN 'verified' ELSE 'conflict' END AS fact_status
FROM f GROUP BY l_partkey, l_returnflag
"""


def _lineitem_facts(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber", F.floor(F.col("l_discount") * 20 + 0.0000001).cast("double").alias("val"))
    return groups.numeric_groups(rows, ["l_partkey", "l_returnflag"], "val", "l_suppkey", ["l_orderkey", "l_linenumber"])


@query(_GROUPED)
def fact_groups_lineitem(spark, sf):
    """Grouping, consistency and classification of numbers stated by several suppliers."""
    return _lineitem_facts(spark, sf)


@query(f"SELECT fact_status, classification, count(*) AS facts, sum(n) AS candidates FROM ({_GROUPED}) GROUP BY fact_status, classification")
def fact_status_lineitem(spark, sf):
    """How many facts have each status."""
    return _lineitem_facts(spark, sf).groupBy("fact_status", "classification").agg(F.count(F.lit(1)).alias("facts"), F.sum("n").alias("candidates"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, count(*) AS n FROM lineitem GROUP BY l_partkey")
def independent_sources(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice, 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1
""")
def dedupe_keep_best(spark, sf):
    best = groups.keep_best(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], F.col("l_extendedprice"), ["l_linenumber"])
    return best.select("l_orderkey", "l_partkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS scope FROM lineitem),
k AS (SELECT *, min(scope) OVER (PARTITION BY l_partkey, l_suppkey) AS low, max(scope) OVER (PARTITION BY l_partkey, l_suppkey) AS high FROM s)
SELECT l_partkey, l_suppkey, coalesce(scope, CASE WHEN low = high THEN low END, '') AS scope_key, count(*) AS n, bool_or(coalesce(low <> high, false)) AS split_scopes
FROM k GROUP BY 1, 2, 3
""")
def scope_merge(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("scope"))
    keyed = groups.scope_key(rows, ["l_partkey", "l_suppkey"])
    return keyed.groupBy("l_partkey", "l_suppkey", "scope_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("split_scopes").alias("split_scopes"))


@query("""
WITH w AS (SELECT p_partkey AS product_id, p_size % 10 + 1 AS net, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size % 7 + 1 END AS gross FROM part)
SELECT product_id, 'gross_weight,net_weight' AS fields, 2 AS candidates FROM w WHERE gross IS NOT NULL AND net <> gross
""")
def cross_field_weights(spark, sf):
    p = table(spark, sf, "part")
    one = lambda field, v, unit: p.select(
        F.col("p_partkey").alias("product_id"), F.lit(field).alias("field"), F.lit("explicit_sku").alias("identity_status"), F.concat_ws(":", "p_partkey", F.lit(field)).alias("candidate_id"),
        F.struct(F.lit(unit).alias("unit")).alias("value"), F.concat(F.lit("g|"), v.cast("string")).alias("value_key"),
    )
    rows = one("net_weight", F.col("p_size") % 10 + 1, "g").unionAll(one("gross_weight", F.col("p_size") % 7 + 1, "g").filter("product_id % 3 <> 0"))
    found = groups.cross_field_relations(rows)
    return found.select("product_id", F.array_join("fields", ",").alias("fields"), F.size("candidate_ids").alias("candidates"))


@query("""
SELECT o_orderpriority, 'spec_v' || (o_custkey % 4) || '.' || (o_orderkey % 3) AS name, (o_custkey % 4) || '.' || (o_orderkey % 3) AS version, count(*) AS n
FROM orders GROUP BY ALL
""")
def version_hint(spark, sf):
    name = F.concat(F.lit("spec_v"), F.col("o_custkey") % 4, F.lit("."), F.col("o_orderkey") % 3)
    rows = table(spark, sf, "orders").select("o_orderpriority", name.alias("name"))
    return rows.withColumn("version", groups.version_hint(F.col("name"))).groupBy("o_orderpriority", "name", "version").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- text


@query("""
SELECT p_partkey, 'Net weight: ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' kg' WHEN p_partkey % 3 = 1 THEN ' g' ELSE ' stone' END AS text,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 1000.0 WHEN p_partkey % 3 = 1 THEN p_size * 1.0 END AS DOUBLE) AS grams,
  CASE WHEN p_partkey % 3 = 2 THEN 'unparsed_unit' END AS note
FROM part
""")
def unit_normalize_part(spark, sf):
    """Unit-safe normalisation: known units are converted, unknown ones kept as text."""
    unit = F.when(F.col("p_partkey") % 3 == 0, " kg").when(F.col("p_partkey") % 3 == 1, " g").otherwise(" stone")
    raw = F.concat(F.col("p_size").cast("string"), unit)
    rows = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("Net weight: "), raw).alias("text"), raw.alias("raw"), F.lit("net_weight").alias("field"), F.lit("number").alias("value_type"), F.lit("mass").alias("family")
    )
    return normalise(rows).select("p_partkey", "text", F.round("value.num", 4).alias("grams"), F.col("value.note").alias("note"))


def part_blocks(spark: SparkSession, sf: str, every: Column | None = None) -> DataFrame:
    """Evidence text of every part: a data sheet of two lines, and a catalogue that states the length in another unit."""
    p = table(spark, sf, "part")
    sku = F.concat(F.lit("SKU: P"), F.col("p_partkey"))
    sheet = F.concat(sku, F.lit("\nModel: "), F.col("p_brand"), F.lit("-"), F.col("p_partkey"), F.lit("\nLength: "), F.col("p_size"), F.lit(" cm; Material: "), F.col("p_type"))
    other = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    catalogue = F.concat(sku, F.lit("\nLength: "), other * 10, F.lit(" mm"))
    one = lambda name, text: p.select(
        F.concat(F.lit(name), F.col("p_partkey")).alias("block_id"), F.concat(F.lit(name), F.col("p_partkey"), F.lit(".txt")).alias("source_file"),
        F.sha2(text, 256).alias("file_hash"), F.lit(0).alias("position"), text.alias("text"), F.lit(False).alias("atomic"), F.lit(1.0).alias("recognition_confidence"),
    )
    return one("sheet-", sheet).unionAll(one("catalogue-", catalogue))


@query("""
SELECT p_partkey, 'sku' AS field, 'p' || p_partkey AS value FROM part
UNION ALL SELECT p_partkey, 'model', lower(p_brand) || '-' || p_partkey FROM part
UNION ALL SELECT p_partkey, 'length', CAST(p_size * 10 AS VARCHAR) FROM part
UNION ALL SELECT p_partkey, 'material', lower(p_type) FROM part
""")
def extract_label_value_part(spark, sf):
    """Segments, label binding, field lookup and normalisation of part data sheets."""
    found = extract.candidates(part_blocks(spark, sf).filter("block_id like 'sheet-%'"))
    value = F.coalesce(F.when(F.col("value.num").isNotNull(), number_text(F.col("value.num"))), F.col("value.txt"))
    return found.select(F.substring_index("block_id", "-", -1).cast("long").alias("p_partkey"), "field", value.alias("value"))


def _as_files(rows: DataFrame, name: Column, kind: str, content: Column) -> DataFrame:
    """Rows as files, the way ``files.discover`` lists them."""
    data = F.coalesce(content, F.lit("")).cast("binary")
    return rows.select(name.alias("source_file"), F.sha2(data, 256).alias("file_hash"), F.lit(kind).alias("kind"), data.alias("content"), F.lit(None).cast("string").alias("skip_reason"))


_LINES = r"""
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines
FROM documents
"""


@query(f"SELECT doc_id, len(lines) AS lines, list_sum(list_transform(lines, lambda x: length(x))) AS characters FROM ({_LINES}) WHERE len(lines) > 0")
def text_lines_documents(spark, sf):
    """Every text read as a file: its lines that say something, and their characters."""
    d = _as_files(table(spark, sf, "documents"), F.concat(F.col("doc_id"), F.lit(".txt")), ".txt", F.col("text"))
    read = files.evidence(files.read_blocks(d))
    per = read.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("characters"))
    return per.select(F.substring_index("source_file", ".", 1).cast("long").alias("doc_id"), "lines", "characters")


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR regexp_matches(array_to_string(lines[1:6], chr(10)), '(?i)文案待(?:回检|核查)|(?:商品介绍|电商文案)(?:测试稿|草稿)|content[_ -]?draft') THEN 'draft' ELSE 'evidence' END AS role, doc_id % 5 = 0 AS historical
FROM ({_LINES}) WHERE len(lines) > 0
""")
def document_role(spark, sf):
    """Role of every document by its name and first lines (a draft certifies nothing), and whether its name says it is old."""
    mark = F.concat(F.when(F.col("doc_id") % 3 == 0, "content_draft-").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "obsolete-").otherwise(""))
    d = _as_files(table(spark, sf, "documents"), F.concat(mark, F.lit("text-"), F.col("doc_id"), F.lit(".txt")), ".txt", F.col("text"))
    found = segments.document_context(files.evidence(files.read_blocks(d)))
    return found.select(F.regexp_extract("source_file", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "role", "historical")


@query(r"""
WITH t AS (SELECT o_orderkey, 'Status: ' || o_orderstatus || '; Priority: ' || o_orderpriority || '; Total: ' || CAST(floor(o_totalprice) AS BIGINT) || ', plain' AS text FROM orders)
SELECT o_orderkey, i - 1 AS seq, trim(parts[i]) AS segment FROM (SELECT o_orderkey, string_split(text, '; ') AS parts FROM t), range(1, 4) r(i)
""")
def segments_orders(spark, sf):
    """Splitting of a line only in front of a label."""
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("Status: "), "o_orderstatus", F.lit("; Priority: "), "o_orderpriority", F.lit("; Total: "), F.floor("o_totalprice").cast("long"), F.lit(", plain"))
    return segments.segments(o.select("o_orderkey", text.alias("text"), F.lit(False).alias("atomic"))).select("o_orderkey", F.col("seq").cast("long").alias("seq"), "segment")


@query(r"""
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 7 = 0 THEN 'duplicate_key' END AS issue FROM events
""")
def json_walk_events(spark, sf):
    """Leaves of JSON properties; a key that is there twice is refused, not repaired."""
    body = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"k": 0, '), F.substring("props", F.lit(2), F.length("props")))).otherwise(F.col("props"))
    read = files.read_blocks(_as_files(table(spark, sf, "events"), F.col("event_id").cast("string"), ".json", body))
    return read.select(F.col("source_file").cast("long").alias("event_id"), F.nullif(F.regexp_extract("text", "^k: (.*)$", 1), F.lit("")).cast("long").alias("k"), "issue")


@query(r"""
SELECT c_custkey, CASE WHEN regexp_matches(s, '^\s*[=+@-]') THEN '''' || s ELSE s END AS cell FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '=' WHEN c_custkey % 4 = 1 THEN '-' ELSE '' END || c_name AS s FROM customer)
""")
def safe_cells_customer(spark, sf):
    """Formula-injection quoting of exported cells."""
    text = F.concat(F.when(F.col("c_custkey") % 4 == 0, "=").when(F.col("c_custkey") % 4 == 1, "-").otherwise(""), "c_name")
    return table(spark, sf, "customer").select("c_custkey", delivery.safe_cell(text).alias("cell"))


@query(r"""
SELECT p_partkey, 'custom_' || lower(hex(encode(lower(p_type)))) AS field, lower(p_type) AS label FROM part
""")
def custom_field_ids(spark, sf):
    """Reversible ids of open fields."""
    p = table(spark, sf, "part").select("p_partkey", extract.custom_field(clean_text(F.col("p_type"))).alias("field"))
    return p.withColumn("label", extract.label_of_custom(F.col("field")))


# ------------------------------------------------------------- order and windows


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, value, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events)
SELECT event_id, user_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id, section ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS owner FROM e
""")
def section_ffill_events(spark, sf):
    """Section inheritance: the last heading holds until the next, or until a reset."""
    e = table(spark, sf, "events").withColumn("heading", F.when(F.col("value") > 50, F.col("event_type")))
    return identity.section_fill(e, "user_id", ["ts", "event_id"], "heading", F.col("event_type") == "purchase", "owner").select("event_id", "user_id", "owner")


@query("""
WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island
""")
def islands_events(spark, sf):
    """Runs of events less than 30 minutes apart."""
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    by = Window.partitionBy("user_id").orderBy("at")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(by) > 1800 * 1_000_000
    found = layout.islands(e, ["user_id"], "at", gap, "island")
    return found.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 8
""")
def keep_last_jobs(spark, sf):
    """The last eight rows of each history."""
    return decisions.keep_last(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 8).select("o_custkey", "o_orderkey")


@query(None)
def text_budget_suppliers(spark, sf):
    """Text budget: files that don't fit are skipped without using it up."""
    files = table(spark, sf, "part").select((F.col("p_partkey") % 1000).alias("run"), "p_partkey", (F.col("p_size") * 10).alias("size"))
    return delivery.within_budget(files, "run", "size", "p_partkey", 500)


# ------------------------------------------------------------- joins and sets


@query("""
WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '+' ELSE '' END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN n ON b.doc_id = n.doc_id WHERE b.h IS NULL OR n.h IS NULL OR b.h <> n.h
""")
def changed_files(spark, sf):
    """Two inventories of the documents: what was added, removed or changed."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = d.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    now = d.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 5 == 0, "+").otherwise("")), 256).alias("h"))
    return decisions.changed_files(before, now, "doc_id", "h")


@query("""
WITH s AS (SELECT c_custkey, md5(c_custkey || '|' || c_mktsegment || '|' || c_nationkey) AS snap FROM customer),
d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN md5('old') ELSE snap END AS snap FROM s WHERE c_custkey % 2 = 0
      UNION ALL SELECT c_custkey + 1000000000, snap FROM s WHERE c_custkey % 10 = 1)
SELECT d.c_custkey, CASE WHEN s.snap = d.snap THEN 'current' ELSE 'stale' END AS state FROM d LEFT JOIN s ON d.c_custkey = s.c_custkey
""")
def decision_reconcile(spark, sf):
    """Decisions hold only while the snapshot they were made on is unchanged."""
    snap = F.md5(F.concat_ws("|", "c_custkey", "c_mktsegment", "c_nationkey").cast("binary"))
    rows = table(spark, sf, "customer").select("c_custkey", snap.alias("snapshot"))
    made = rows.filter("c_custkey % 2 = 0").withColumn("snapshot", F.when(F.col("c_custkey") % 3 == 0, F.md5(F.lit("old").cast("binary"))).otherwise(F.col("snapshot")))
    gone = rows.filter("c_custkey % 10 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    return decisions.reconcile(made.unionAll(gone), rows, "c_custkey").select("c_custkey", "state")


@query("""
WITH m AS (SELECT p_brand || '/' || p_type || '/' || p_size AS model, p_partkey FROM part)
SELECT model, min(p_partkey) AS p_partkey FROM m GROUP BY model HAVING min(p_partkey) = max(p_partkey)
""")
def model_to_unique_sku(spark, sf):
    """Models that exactly one part has."""
    rows = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type", "p_size").alias("model"), "p_partkey")
    return identity.unique_owner(rows, "model", "p_partkey")


@query("""
SELECT p_brand AS product_id, p_brand AS label, count(*) AS candidates, count(DISTINCT p_type) AS variants FROM part GROUP BY p_brand
""")
def product_entities(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("product_id"), F.col("p_brand").alias("sku"), F.lit(None).cast("string").alias("model"), F.col("p_type").alias("variant"),
        F.lit("explicit_sku").alias("identity_status"), F.col("p_partkey").cast("string").alias("candidate_id"),
    )
    return identity.product_entities(rows).select("product_id", "label", F.size("candidate_ids").cast("long").alias("candidates"), F.size("variants").cast("long").alias("variants"))


_CLAIMS = """
WITH f AS (SELECT p_partkey, p_size * 10.0 AS v, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'net' END AS scope FROM part WHERE p_partkey % 6 <> 0),
c AS (SELECT p_partkey, p_size * 10.0 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS v, 'net' AS scope, p_partkey % 9 = 0 AS amb FROM part)
SELECT c.p_partkey AS claim_id, CASE WHEN amb THEN 'product_ambiguous' WHEN f.scope = c.scope AND abs(f.v - c.v) < 0.000001 THEN 'supported'
  WHEN f.p_partkey IS NOT NULL AND f.scope IS NULL THEN 'scope_ambiguous' WHEN f.scope = c.scope THEN 'conflict' ELSE 'unsupported' END AS outcome
FROM c LEFT JOIN f ON c.p_partkey = f.p_partkey
"""


def _claim_outcomes(spark, sf):
    p = table(spark, sf, "part")
    field = F.lit("length")
    facts = p.filter("p_partkey % 6 <> 0").select(
        F.col("p_partkey").alias("fact_id"), field.alias("fact_field"), F.col("p_partkey").alias("fact_product_id"), F.when(F.col("p_partkey") % 4 != 0, "net").alias("fact_scope"),
        (F.col("p_size") * 10.0).alias("fact_value"), F.lit("mm").alias("fact_unit"),
    )
    made = p.select(
        F.col("p_partkey").alias("claim_id"), field.alias("field"), F.col("p_partkey").alias("product_id"), F.lit("net").alias("scope"),
        (F.col("p_size") * 10.0 + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).alias("value"), F.lit("mm").alias("unit"), (F.col("p_partkey") % 9 == 0).alias("product_ambiguous"),
    )
    return claims.evaluate(made, facts)


@query(_CLAIMS)
def claim_check_parts(spark, sf):
    """Claims about parts against approved facts."""
    return _claim_outcomes(spark, sf).select("claim_id", "outcome")


@query(f"""
SELECT claim_id % 100 AS draft_id, count(*) AS claims, count(*) FILTER (outcome IN ('conflict', 'unsupported')) AS blocking,
  CASE WHEN count(*) FILTER (outcome IN ('conflict', 'unsupported')) > 0 THEN 'blocked' WHEN count(*) FILTER (outcome IN ('scope_ambiguous', 'product_ambiguous')) > 0 THEN 'needs_review' ELSE 'covered_fields_match' END AS draft_status
FROM ({_CLAIMS}) GROUP BY claim_id % 100
""")
def draft_status_parts(spark, sf):
    return claims.draft_status(_claim_outcomes(spark, sf).withColumn("draft_id", F.col("claim_id") % 100))


@query("""
SELECT p_partkey AS draft_id, CAST(1 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS claims,
  CAST(CASE WHEN p_partkey % 6 = 0 OR p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS blocking,
  CASE WHEN p_partkey % 6 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'blocked' WHEN p_partkey % 11 = 0 THEN 'needs_review' ELSE 'covered_fields_match' END AS draft_status
FROM part
""")
def draft_check_parts(spark, sf):
    """Drafts about parts, from their text to findings: a length in another unit, a promise no fact supports, a number without a field."""
    p = table(spark, sf, "part")
    name = F.concat(F.lit("P"), "p_partkey")
    wrong = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") * 10 + 1).otherwise(F.col("p_size") * 10)
    text = F.concat(name, F.lit(" Length: "), wrong, F.lit(" mm。"), F.when(F.col("p_partkey") % 7 == 0, "适合户外。").otherwise(""), F.when(F.col("p_partkey") % 11 == 0, "It carries 5 kg").otherwise(""))
    drafts = p.select(F.col("p_partkey").alias("draft_id"), text.alias("text"))
    fact = lambda rows, field, raw, kind, family: rows.select(
        F.concat(F.lit(field), "p_partkey").alias("fact_id"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("scope"), raw.alias("raw"),
        F.lit(kind).alias("value_type"), F.lit(family).cast("string").alias("family"), name.alias("product_id"),
    )
    lengths = fact(p.filter("p_partkey % 6 <> 0"), "length", F.concat("p_size", F.lit(" cm")), "number", "length")
    facts = normalise(fact(p, "sku", name, "text", None).unionByName(lengths))
    return draft_check.check(drafts, facts).drafts.select("draft_id", "claims", "blocking", "draft_status")


@query("""
WITH w AS (SELECT DISTINCT o_orderkey, CAST(regexp_extract_all('order of P' || o_custkey || CASE WHEN o_orderkey % 4 = 0 THEN ' or P' || (o_custkey + 1) ELSE '' END || ' today', 'P([0-9]+)', 1) AS VARCHAR[]) AS names FROM orders),
h AS (SELECT o_orderkey, CAST(unnest(names) AS BIGINT) AS p FROM w),
m AS (SELECT o_orderkey, min(p) AS low, max(p) AS high FROM h JOIN part ON p = p_partkey GROUP BY o_orderkey)
SELECT o.o_orderkey AS clause_id, CASE WHEN low = high THEN low END AS product_id, coalesce(low <> high, false) AS product_ambiguous FROM orders o LEFT JOIN m ON o.o_orderkey = m.o_orderkey
""")
def claim_owner_orders(spark, sf):
    """The product that a clause names, if it names one."""
    other = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" or P"), F.col("o_custkey") + 1)).otherwise("")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clause_id"), F.concat(F.lit("order of P"), "o_custkey", other, F.lit(" today")).alias("clause"))
    names = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_partkey").alias("product_id"))
    return claims.mentioned_products(rows, names).select("clause_id", "product_id", "product_ambiguous")


@query("""
SELECT l_orderkey, count(*) FILTER (st = 'verified') AS verified_count,
  concat_ws(',', CASE WHEN count(*) FILTER (st = 'conflict') > 0 THEN 'conflict' END, CASE WHEN count(*) FILTER (st = 'pending_confirmation') > 0 THEN 'pending' END, CASE WHEN count(*) FILTER (st = 'verified') = 0 THEN 'no_verified_facts' END) AS blockers,
  CASE WHEN count(*) FILTER (st <> 'verified') = 0 THEN 'complete' WHEN count(*) FILTER (st = 'verified') > 0 THEN 'partial' ELSE 'blocked' END AS delivery_status
FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'conflict' WHEN 'A' THEN 'pending_confirmation' ELSE 'verified' END AS st FROM lineitem) GROUP BY l_orderkey
""")
def readiness_by_product(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "conflict").when(F.col("l_returnflag") == "A", "pending_confirmation").otherwise("verified")
    facts = table(spark, sf, "lineitem").select("l_orderkey", status.alias("fact_status"), F.lit(True).alias("current"))
    return delivery.readiness(facts, "l_orderkey")


@query("""
SELECT o_custkey, o_orderstatus, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey, o_orderstatus) AS k FROM orders) WHERE n = 1 AND k = 1
""")
def export_table_orders(spark, sf):
    """One exported row per key; contradictory keys are refused."""
    out = delivery.export_rows(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return out.select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""
SELECT c_nationkey AS k, 'missing' AS side, n FROM (SELECT c_nationkey, count(*) AS a, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS b, greatest(count(*) - (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey), 0) AS n FROM customer GROUP BY c_nationkey) WHERE n > 0
UNION ALL
SELECT s_nationkey, 'unexpected', n FROM (SELECT s_nationkey, greatest(count(*) - (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey), 0) AS n FROM supplier GROUP BY s_nationkey) WHERE n > 0
""")
def multiset_difference(spark, sf):
    """What is missing and what is unexpected, with multiplicity."""
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return evaluate.missing_and_unexpected(a, b).groupBy("k", "side").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- geometry and pages


@query("""
WITH b AS (SELECT label, embedding[1] AS x0, embedding[2] AS y0, embedding[1] + abs(embedding[3]) AS x1, embedding[2] + abs(embedding[4]) AS y1 FROM embeddings)
SELECT label, round(min(x0), 5) AS x0, round(min(y0), 5) AS y0, round(max(x1), 5) AS x1, round(max(y1), 5) AS y1 FROM b GROUP BY label
""")
def bbox_union(spark, sf):
    e = F.col("embedding")
    boxes = table(spark, sf, "embeddings").select("label", e[0].alias("x0"), e[1].alias("y0"), (e[0] + F.abs(e[2])).alias("x1"), (e[1] + F.abs(e[3])).alias("y1"))
    return layout.union_box(boxes, ["label"]).select("label", *[F.round(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""
SELECT w.vec_id AS word_id, b.vec_id AS box_id FROM embeddings w JOIN embeddings b ON w.label = b.label
WHERE w.embedding[1] >= b.embedding[1] AND w.embedding[2] >= b.embedding[2] AND w.embedding[1] <= b.embedding[1] + 0.2 AND w.embedding[2] <= b.embedding[2] + 0.2
""")
def bbox_contain(spark, sf):
    """Words in the boxes of their page (every vector is a word and a box)."""
    e, t = F.col("embedding"), table(spark, sf, "embeddings")
    words = t.select("label", F.col("vec_id").alias("word_id"), e[0].alias("x0"), e[1].alias("y0"), e[0].alias("x1"), e[1].alias("y1"))
    side = F.lit(0.2).cast("float")  # the corners are floats, as in SQL: a sum in double would lie beside theirs
    boxes = t.select("label", F.col("vec_id").alias("box_id"), e[0].alias("left"), e[1].alias("top"), (e[0] + side).alias("right"), (e[1] + side).alias("bottom"))
    return layout.contained(words, boxes, "label", 0.2).select("word_id", "box_id")


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '[A-Za-z]{9,}') AS words FROM pages),
n AS (SELECT page_id, unnest(words) AS label, generate_subscripts(words, 1) - 1 AS place FROM l),
r AS (SELECT place, label FROM n GROUP BY place, label HAVING count(DISTINCT page_id) >= 2)
SELECT page_id, CAST(n.place AS INTEGER) AS place, n.label FROM n ANTI JOIN r ON n.place = r.place AND n.label = r.label
""")
def running_margin_pages(spark, sf):
    """All long words of a page, without those that come back on other pages at the same place."""
    words = F.regexp_extract_all("html", F.lit("[A-Za-z]{9,}"), F.lit(0))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(words).alias("place", "label"))
    return layout.without_running_margins(rows, "label", "page_id", ["place"]).select("page_id", "place", "label")


@query(r"""
SELECT page_id, CASE WHEN len(regexp_extract_all(html, '<img')) > 0 THEN 'large_image' WHEN len(regexp_extract_all(html, '<p')) >= 24 AND contains(html, 'table') THEN 'vector_keyword'
  WHEN len(regexp_extract_all(html, '<p')) >= 120 AND len(regexp_extract_all(html, '<td')) >= 2 THEN 'vector_units' END AS reason FROM pages
""")
def page_class(spark, sf):
    n = lambda p: F.regexp_count("html", F.lit(p))
    reason = layout.page_class(n("<img"), n("<p"), F.col("html").contains("table"), n("<td"))
    return table(spark, sf, "pages").select("page_id", reason.alias("reason"))


@query(r"""
WITH v AS (SELECT label, vec_id AS value_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE vec_id % 3 <> 0),
l AS (SELECT label, vec_id AS label_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE vec_id % 3 = 0),
d AS (SELECT v.label, value_id, label_id, round(sqrt(pow(v.x - l.x, 2) + pow(v.y - l.y, 2)), 6) AS distance FROM v JOIN l ON v.label = l.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label, value_id ORDER BY distance, label_id) AS n, lead(distance) OVER (PARTITION BY label, value_id ORDER BY distance, label_id) AS nxt FROM d WHERE distance <= 0.3)
SELECT value_id, label_id FROM r WHERE n = 1 AND (nxt IS NULL OR nxt - distance >= 0.01)
""")
def nearest_labels(spark, sf):
    """Each value's nearest label of its page, if no other is about as near (two vectors of three are values, the third a label)."""
    e, t = F.col("embedding"), table(spark, sf, "embeddings")
    at = [e[0].cast("double").alias("x"), e[1].cast("double").alias("y")]
    values = t.filter("vec_id % 3 <> 0").select("label", F.col("vec_id").alias("value_id"), *at)
    labels = t.filter("vec_id % 3 = 0").select("label", F.col("vec_id").alias("label_id"), *at)
    return layout.nearest_label(values, labels, "label", 0.3, 0.01).select("value_id", "label_id")


# ------------------------------------------------------------- evaluation


@query("""
WITH p AS (SELECT l.quality = 1 AS t, length(d.text) > 400 AS p, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM p GROUP BY lang),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0 END AS re FROM c)
SELECT lang, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM s
""")
def score_prf(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return evaluate.precision_recall(rows, ["lang"], F.col("quality") == 1, F.char_length("text") > 400)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1, 2")
def p90_median(spark, sf):
    return evaluate.spread(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("""
WITH a AS (SELECT c_nationkey AS k, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT a.k, a.id AS expected_id, b.id AS actual_id FROM a JOIN b ON a.k = b.k AND a.n = b.n
""")
def match_equal_rows(spark, sf):
    """One-to-one matching of rows with equal keys."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return evaluate.match_equal(a, b, ["k"])


# ------------------------------------------------------------- the whole analysis


@query(r"""
SELECT 'P' || p_partkey AS sku, CASE WHEN p_partkey % 5 = 0 THEN 'conflict' ELSE 'verified' END AS fact_status,
  CASE WHEN p_partkey % 5 = 0 THEN 'strong_conflict' ELSE 'converted_match' END AS classification, 2 AS candidate_count, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 10.0 AS DOUBLE) END AS length_mm
FROM part
""")
def part_length_facts(spark, sf):
    """Blocks of text to facts: extraction, identity, grouping and status of every part's length."""
    from factloom.plans.analysis import analyse

    done = analyse(part_blocks(spark, sf))
    facts = done.groups.filter("field = 'length'").join(done.products.select("product_id", "sku"), "product_id")
    return facts.select("sku", "fact_status", "classification", F.col("candidate_count").cast("int").alias("candidate_count"), F.round("selected_value.num", 4).alias("length_mm"))


_STATUS_TEXT = {
    # Remainder of the part's key: what its two files say of one field; the second may say nothing.
    0: ("Net weight: 300 g", ""), 1: ("Net weight: 300 g", "Net weight: 300 g"), 2: ("Net weight: 300 g", "Net weight: 0.3 kg"), 3: ("Net weight: 300 g", "Net weight: 320 g"),
    4: ("Pressure: 100 kPa", "Pressure: 160 kPa"), 5: ("Net weight: 5 stone", ""), 6: ("Net weight: 300 g", "Net weight: ≤300 g"), 7: ("Net weight: -5 g", ""),
    8: ("Material: steel", "Material: steel plate"), 9: ("Voltage: 5 V", ""),
}
_STATUS_SQL = """
SELECT p_partkey, c[1] AS field, c[2] AS classification, c[3] AS fact_status, c[4] AS review_reason, c[5] AS verification_method, CAST(c[6] AS BIGINT) AS sources
FROM (SELECT p_partkey, CASE p_partkey % 10
  WHEN 0 THEN ['net_weight', 'insufficient_evidence', 'verified', NULL, 'single_value', '1']
  WHEN 1 THEN ['net_weight', 'exact_match', 'verified', NULL, 'cross_source_exact', '2']
  WHEN 2 THEN ['net_weight', 'converted_match', 'verified', NULL, 'cross_source_converted', '2']
  WHEN 3 THEN ['net_weight', 'strong_conflict', 'conflict', NULL, NULL, '2']
  WHEN 4 THEN ['pressure', 'likely_version_update', 'pending_confirmation', 'version_unclear', NULL, '2']
  WHEN 5 THEN ['net_weight', 'insufficient_evidence', 'pending_confirmation', 'unclear_value', NULL, '1']
  WHEN 6 THEN ['net_weight', 'strong_conflict', 'pending_confirmation', 'compatible_expression', NULL, '2']
  WHEN 7 THEN ['net_weight', 'insufficient_evidence', 'pending_confirmation', 'invalid_value', NULL, '1']
  WHEN 8 THEN ['material', 'compatible_expression', 'pending_confirmation', 'compatible_expression', NULL, '2']
  ELSE ['voltage', 'insufficient_evidence', 'pending_confirmation', 'scope_unclear', NULL, '1'] END AS c FROM part)
"""


@query(_STATUS_SQL)
def fact_status_parts(spark, sf):
    """Every classification and status of a fact, from two files of text for each part, through the whole analysis."""
    from factloom.plans.analysis import analyse

    p = table(spark, sf, "part")

    def blocks(side: int) -> DataFrame:
        said = F.create_map(*[F.lit(x) for k, texts in _STATUS_TEXT.items() for x in (k, texts[side])])[(F.col("p_partkey") % 10).cast("int")]
        name = F.concat(F.lit("spec-"), "p_partkey", F.when(F.col("p_partkey") % 10 == 4, F.lit(f"_v{side + 1}.0")).otherwise(F.lit(('-a', '-b')[side])), F.lit(".txt"))
        text = F.concat(F.lit("SKU: P"), "p_partkey", F.lit("\n"), said)
        return p.filter(said != "").select(
            F.concat(name, F.lit(":0")).alias("block_id"), name.alias("source_file"), F.sha2(F.concat(F.lit(f"{side}"), text), 256).alias("file_hash"), F.lit(0).alias("position"),
            text.alias("text"), F.lit(False).alias("atomic"), F.lit(1.0).alias("recognition_confidence"),
        )

    done = analyse(blocks(0).unionAll(blocks(1)))
    facts = done.groups.filter("field <> 'sku'").join(done.products.select("product_id", "sku"), "product_id")
    return facts.select(
        F.substring("sku", 2, 20).cast("long").alias("p_partkey"), "field", "classification", "fact_status", "review_reason", "verification_method", F.col("independent_source_count").cast("long").alias("sources")
    )
