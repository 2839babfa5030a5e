"""Values as column expressions: cleaning, unit-safe normalisation, equality.

A normalised value is a struct: kind (number, range, bound, tolerance,
dimensions, count or text), num, arr, txt, unit and note.  ``value_key`` is its
canonical text for grouping and joins.  Units that aren't known are kept in the
text, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import registry
from factloom.functions.stages import stage

VALUE_TYPE = "struct<kind:string,num:double,arr:array<double>,txt:string,unit:string,note:string>"
_number = r"[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_unit = r"[A-Za-zµμ°℃℉㐀-鿿][A-Za-z0-9µμ°℃℉³·./㐀-鿿]*?"

# Words for bounds.
BOUND_BEFORE = {
    "不小于": "≥", "不大于": "≤", "不得超过": "≤", "不能超过": "≤", "no more than": "≤", "not more than": "≤", "no less than": "≥",
    "not less than": "≥", "at least": "≥", "at most": "≤", "less than": "<", "greater than": ">", "up to": "≤", "不超过": "≤",
    "不高于": "≤", "至多": "≤", "最多": "≤", "不少于": "≥", "不低于": "≥", "至少": "≥", "小于": "<", "低于": "<", "大于": ">", "高于": ">",
}
BOUND_AFTER = {"以下": "≤", "以内": "≤", "以上": "≥"}


def clean_text(c: Column) -> Column:
    """Trimmed, single-spaced, lower case, with ASCII commas and colons."""
    spaced = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.translate(F.translate(F.lower(F.upper(spaced)), "ς", "σ"), "，：", ",:")


_symbol = r"[A-Za-zµμΩω°℃℉%][A-Za-zµμΩω°℃℉%²³0-9]*"
_measured = rf"(?<![A-Za-z0-9_])[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*{_symbol}(?:\s*[/·⋅]\s*{_symbol})*"


def fact_text(c: Column) -> Column:
    """Like clean_text, but unit symbols after numbers keep their case (mW is not MW)."""
    spaced = F.translate(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), "，：", ",:")
    kept = F.transform(F.regexp_extract_all(spaced, F.lit(_measured), F.lit(0)), lambda m: F.regexp_replace(m, r"(?<=[^0-9\s])\s+|\s+(?=[/·⋅])", ""))
    gaps = F.transform(F.split(spaced, _measured, -1), lambda g: F.translate(F.lower(F.upper(g)), "ς", "σ"))
    both = F.transform(F.arrays_zip(gaps.alias("g"), kept.alias("m")), lambda p: F.concat(F.coalesce(p["g"], F.lit("")), F.coalesce(p["m"], F.lit(""))))
    return F.array_join(both, "")


def number_text(d: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    rounded = F.round(d, 9)
    return F.when((rounded == F.floor(rounded)) & (F.abs(rounded) < 1e15), F.floor(rounded).cast("bigint").cast("string")).otherwise(rounded.cast("string"))


def _grouped_digits(c: Column) -> Column:
    """Thousands commas dropped where they make groups of three."""
    marked = F.regexp_replace(c, r"(?<![0-9,.])([0-9]{1,3}(?:,[0-9]{3})+)(?![0-9,])", "<$1>")
    for _ in range(6):
        marked = F.regexp_replace(marked, r"<([0-9]+),([0-9,]+)>", "<$1$2>")
    return F.regexp_replace(marked, r"<([0-9]+)>", "$1")


def _part(pattern: str, k: int, of: str = "_text") -> Column:
    return F.nullif(F.regexp_extract(of, pattern, k), F.lit(""))


def _value(kind: str, num=None, arr=None, txt=None, unit=None, note=None) -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), lit(num, "double").alias("num"), lit(arr, "array<double>").alias("arr"),
        lit(txt, "string").alias("txt"), lit(unit, "string").alias("unit"), lit(note, "string").alias("note"),
    )


_words_before = "|".join(sorted(BOUND_BEFORE, key=len, reverse=True))
_words_after = "|".join(BOUND_AFTER)
_tolerance = rf"^({_number})\s*({_unit})?\s*(?:[(（]\s*)?(?:±|\+/-)\s*({_number})\s*({_unit})?\s*[)）]?$"
_range = rf"^({_number})\s*({_unit})?\s*(?:-|–|—|~|(?i:to)|至|到)\s*({_number})\s*({_unit})$"
_twice = rf"^({_number}\s*(?:{_unit})?\s*(?:-|–|—|~|(?i:to)|至|到)\s*{_number}\s*{_unit})\s*(?:[(（/]|=)\s*({_number}\s*(?:{_unit})?\s*(?:-|–|—|~|(?i:to)|至|到)\s*{_number}\s*{_unit})\s*[)）]?$"
_single = rf"^(?i:(≤|≥|<|>|大?约(?:为)?|≈|~|about|approx(?:imately)?\.?))?\s*({_number})\s*({_unit})$"
_sides = rf"^({_number})\s*[x×*]\s*({_number})(?:\s*[x×*]\s*({_number}))?\s*({_unit})$"
_count = rf"(?i)^({_number})\s*(?:个|件|只|套|pcs?|pieces?|pack)?$"


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _scaled_by_family(family: Column, number: Column, token: Column) -> Column:
    """A number in the base unit of its family; null for an unknown unit.  For the few values that state two units."""
    known = F.create_map(*[x for (f, t), (factor, offset) in registry.units().items() for x in (F.lit(f"{f}|{t}"), F.array(F.lit(factor), F.lit(offset)))])
    at = lambda t: F.element_at(known, F.concat(family, F.lit("|"), t))
    unit = F.coalesce(at(token), F.when(F.length(token) > 3, at(F.lower(token))))
    return F.round(number * unit[0] + unit[1], 9)


def normalise(df: DataFrame, out: str = "value") -> DataFrame:
    """Add the normalised value of the column ``raw``, by the columns field, value_type and family.

    A measurement counts only if all of its text is explained; anything else
    stays text with a note, in its own unit.  Units are found in a broadcast
    dimension of fixed size, once for each of the (up to two) unit tokens.
    """
    kept = df.columns
    spark = df.sparkSession
    step = stage(df, {"_text": _grouped_digits(F.translate(F.trim("raw"), "−﹣－＋～", "---+~"))})
    huge = r"[0-9][eE][-+]?(?:[0-9]{4,}|[2-9][0-9]{2}|1[1-9][0-9]|10[1-9])"
    step = stage(step, {"_text": F.when(~F.col("_text").rlike(rf"[0-9],[0-9]|{huge}"), F.col("_text"))})
    step = stage(step, {"_before": F.lower(_part(rf"(?i)^({_words_before})\s*(?=[-+]?(?:[0-9]|\.[0-9]))", 1))})
    step = stage(step, {"_after": _part(rf"^{_number}\s*{_unit}\s*({_words_after})$", 1)})
    sign = F.coalesce(_table(BOUND_BEFORE)[F.col("_before")], _table(BOUND_AFTER)[F.col("_after")], F.lit(""))
    bare = F.regexp_replace(F.regexp_replace("_text", rf"(?i)^(?:{_words_before})\s*(?=[-+]?(?:[0-9]|\.[0-9]))", ""), rf"(?<=[^0-9\s])\s*(?:{_words_after})$", "")
    step = stage(step, {"_text": F.concat(sign, bare)})
    tidy = F.regexp_replace(F.regexp_replace("_text", "<=", "≤"), ">=", "≥")
    tidy = F.regexp_replace(tidy, r"(?U)[\s,，;；:：.。]+$", "")
    electric = F.col("family").isin("voltage", "current")
    step = stage(step, {"_text": F.when(electric, F.regexp_replace(tidy, r"(?i)(?<=[va伏安培])\s*(?:ac|dc)$", "")).otherwise(tidy)})
    sized = F.regexp_replace("_text", r"(?i)\s*[(（]\s*L\s*[x×*]\s*W(?:\s*[x×*]\s*H)?\s*[)）]\s*$", "")
    step = stage(step, {"_text": F.when(F.col("value_type") == "dimensions", sized).otherwise(F.col("_text"))})
    quantity = F.col("value_type").isin("number", "capacity")
    # A range stated again in another unit counts once, if both agree.
    twice = quantity & F.col("_text").rlike(_twice)
    step = stage(step, {"_again": F.when(twice, _part(_twice, 2)), "_text": F.when(twice, _part(_twice, 1)).otherwise(F.col("_text"))})
    shape = (
        F.when(quantity & F.col("_text").rlike(_tolerance), "tolerance")
        .when(quantity & F.col("_text").rlike(_range), "range")
        .when(quantity & F.col("_text").rlike(_single), "single")
        .when((F.col("value_type") == "dimensions") & F.col("_text").rlike(_sides), "sides")
        .when((F.col("value_type") == "count") & F.col("_text").rlike(_count), "count")
    )
    step = stage(step, {"_shape": shape})
    got = lambda **by: F.coalesce(*[F.when(F.col("_shape") == s, _part(p, k)) for s, (p, k) in by.items()])
    step = stage(step, {
        "_sign": got(single=(_single, 1)),
        "_n1": got(tolerance=(_tolerance, 1), range=(_range, 1), single=(_single, 2), sides=(_sides, 1), count=(_count, 1)).cast("double"),
        "_u1": got(tolerance=(_tolerance, 2), range=(_range, 2), single=(_single, 3), sides=(_sides, 4)),
        "_n2": got(tolerance=(_tolerance, 3), range=(_range, 3), sides=(_sides, 2)).cast("double"),
        "_u2": got(tolerance=(_tolerance, 4), range=(_range, 4), sides=(_sides, 4)),
        "_n3": got(sides=(_sides, 3)).cast("double"),
    })
    step = stage(step, {"_u1": F.coalesce("_u1", "_u2"), "_u2": F.coalesce("_u2", "_u1")})
    step = stage(step, {"_kind": F.when(F.col("value_type") == "dimensions", "length").when(F.col("value_type") != "capacity", F.col("family"))})
    known = registry.unit_table(spark)
    words = known.select(F.col("family").alias("_fam"), F.col("unit_token").alias("_tok"), "factor", "unit_offset", "base_unit")
    for k in (1, 2):
        side = words.select(*[F.col(c).alias(f"{c}{k}") for c in words.columns])
        family = F.col(f"_fam{k}")
        fits = (family == F.col("_kind")) | (family.isin("capacity_charge", "capacity_volume") & (F.col("value_type") == "capacity"))
        token = F.when(F.length(f"_u{k}") > 3, F.lower(f"_u{k}")).otherwise(F.col(f"_u{k}"))
        tokens = registry.spellings()
        exact = F.when(F.col(f"_u{k}").isin(*tokens), F.col(f"_u{k}")).otherwise(token)
        step = stage(step, {f"_key{k}": exact})
        step = step.join(F.broadcast(side), (F.col(f"_tok{k}") == F.col(f"_key{k}")) & fits, "left")
    scaled = lambda n, k: F.round(F.col(n) * F.col(f"factor{k}") + F.col(f"unit_offset{k}"), 9)
    step = stage(step, {
        "_v1": scaled("_n1", 1), "_v2": scaled("_n2", 2), "_v3": scaled("_n3", 1), "_delta": F.round(F.col("_n2") * F.col("factor2"), 9),
    })
    step = stage(step, {"_s1": number_text(F.col("_v1")), "_sd": number_text(F.col("_delta"))})
    unit, shape = F.col("base_unit1"), F.col("_shape")
    other = lambda n, *us: _scaled_by_family(F.col("_fam1"), _part(_range, n, "_again").cast("double"), F.coalesce(*[_part(_range, u, "_again") for u in us]))
    agrees = (F.abs(other(1, 2, 4) - F.col("_v1")) <= 1e-6) & (F.abs(other(3, 4) - F.col("_v2")) <= 1e-6)
    step = stage(step, {"_agrees": F.when(F.col("_again").isNull(), True).otherwise(F.coalesce(agrees, F.lit(False)))})
    sign = F.when(F.col("_sign").isin("≤", "≥", "<", ">"), F.col("_sign")).otherwise("≈")
    sides = F.when(F.col("_n3").isNull(), F.array("_v1", "_v2")).otherwise(F.array("_v1", "_v2", "_v3"))
    unparsed = F.concat(F.lit("unparsed_"), F.when(F.col("value_type") == "number", "unit").otherwise(F.col("value_type")))
    measured = (
        F.when((shape == "tolerance") & unit.isNotNull() & (F.col("_delta") >= 0), _value("tolerance", txt=F.concat("_s1", F.lit("±"), "_sd"), unit=unit, note="qualifier_preserved"))
        .when((shape == "range") & F.col("_v1").isNotNull() & F.col("_v2").isNotNull() & F.col("_agrees"), _value("range", arr=F.array("_v1", "_v2"), unit=unit, note="range_preserved"))
        .when((shape == "single") & unit.isNotNull() & F.col("_sign").isNotNull(), _value("bound", txt=F.concat(sign, "_s1"), unit=unit, note="qualifier_preserved"))
        .when((shape == "single") & unit.isNotNull(), _value("number", num=F.col("_v1"), unit=unit))
        .when((shape == "sides") & unit.isNotNull(), _value("dimensions", arr=sides, unit=unit, note="dimension_order_preserved"))
        .when((shape == "count") & (F.col("_n1") == F.floor("_n1")), _value("count", num=F.col("_n1"), unit="count"))
        .when(F.col("value_type") != "text", _value("text", txt=F.col("_fact"), note=unparsed))
    )
    step = stage(step, {"_fact": fact_text(F.col("raw"))})
    months = F.coalesce(_part(r"^([0-9]+)\s*(?:年|years?)$", 1, "_fact").cast("long") * 12, _part(r"^([0-9]+)\s*(?:个月|月|months?)$", 1, "_fact").cast("long"))
    step = stage(step, {"_clean": clean_text(F.col("raw")), "_months": months})
    period = F.when(F.col("_months") % 12 == 0, F.concat((F.col("_months") / 12).cast("long").cast("string"), F.lit("年")))
    period = F.coalesce(period, F.concat(F.col("_months").cast("string"), F.lit("个月")))
    tight = F.regexp_replace(F.regexp_replace("_fact", r"(?<=[0-9])\s+(?=[A-Za-zµμω%°㐀-鿿])", ""), r"\s*([~±])\s*(?=[-+]?[0-9.])", "$1")
    words_ = F.when(F.col("field").startswith("custom_"), F.coalesce(period, tight)).when(F.col("field") == "color", F.coalesce(_table(registry.COLORS)[F.col("_clean")], F.col("_clean")))
    plain = F.when(F.col("field").isin("sku", "model"), F.col("_clean")).otherwise(F.col("_fact"))
    step = stage(step, {out: F.coalesce(measured, _value("text", txt=F.coalesce(words_, plain)))})
    return step.select(*kept, out)


def value_key(value: Column) -> Column:
    """Canonical text of a value with its unit."""
    list_ = F.concat(F.lit("["), F.array_join(F.transform(value["arr"], number_text), ","), F.lit("]"))
    shown = F.coalesce(F.when(value["num"].isNotNull(), number_text(value["num"])), F.when(value["arr"].isNotNull(), list_), value["txt"])
    return F.concat_ws("|", F.coalesce(value["unit"], F.lit("")), shown)


def numbers_equal(a: Column, b: Column) -> Column:
    """Equal up to computational rounding."""
    return F.abs(a - b) <= F.greatest(1e-12 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def values_equal(a: Column, b: Column) -> Column:
    """Same unit and same value: numbers and lists with rounding tolerance, text exactly."""
    lists = (F.size(a["arr"]) == F.size(b["arr"])) & F.forall(F.arrays_zip(a["arr"].alias("x"), b["arr"].alias("y")), lambda p: numbers_equal(p["x"], p["y"]))
    same = F.when(a["num"].isNotNull() & b["num"].isNotNull(), numbers_equal(a["num"], b["num"])).when(a["arr"].isNotNull() & b["arr"].isNotNull(), lists)
    return F.coalesce(a["unit"].eqNullSafe(b["unit"]) & F.coalesce(same, a["txt"] == b["txt"]), F.lit(False))


def bounds(value: Column) -> Column:
    """(low, high) that a number, bound or tolerance allows; null for all else."""
    txt = value["txt"]
    n = F.regexp_extract(txt, rf"^[≤≥<>]({_number})$", 1).cast("double")
    center = F.regexp_extract(txt, rf"^({_number})±", 1).cast("double")
    delta = F.regexp_extract(txt, rf"±({_number})$", 1).cast("double")
    inf = F.lit(float("inf"))
    pair = lambda lo, hi: F.struct(lo.alias("low"), hi.alias("high"))
    return (
        F.when(value["num"].isNotNull(), pair(value["num"], value["num"]))
        .when((value["kind"] == "bound") & txt.startswith("≤"), pair(-inf, n))
        .when((value["kind"] == "bound") & txt.startswith("≥"), pair(n, inf))
        .when(value["kind"] == "tolerance", pair(center - delta, center + delta))
    )


def review_reason(field: Column, kind: Column, family: Column, raw: Column, value: Column) -> Column:
    """invalid_value, unclear_value or null."""
    negative = (value["num"] < 0) | F.exists(F.coalesce(value["arr"], F.array().cast("array<double>")), lambda x: x < 0)
    bad = clean_text(raw).isin(*registry.MISSING_VALUES) | (F.trim(raw) == "")
    bad |= F.coalesce(negative, F.lit(False)) & ((field == "quantity") | F.coalesce(family.isin(*registry.NON_NEGATIVE_FAMILIES), F.lit(False)))
    bad |= F.coalesce((value["kind"] == "range") & (value["arr"][0] > value["arr"][1]), F.lit(False))
    unclear = F.coalesce(value["note"].startswith("unparsed_"), F.lit(False)) | ((kind != "text") & value["unit"].isNull() & ~field.startswith("custom_"))
    return F.when(bad, "invalid_value").when(unclear, "unclear_value")
