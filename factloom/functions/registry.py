"""Fields and units: small tables that expressions look values up in."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
# Unit families: name, base unit, symbols with their factor to the base unit.
UNIT_FAMILIES = """
mass | g | mg=0.001 g=1 克=1 kg=1000 千克=1000 公斤=1000 lb=453.59237 lbs=453.59237 磅=453.59237 oz=28.349523125 盎司=28.349523125
length | mm | mm=1 毫米=1 cm=10 厘米=10 m=1000 米=1000 in=25.4 英寸=25.4
current | A | uA=0.000001 µA=0.000001 μA=0.000001 ua=0.000001 µa=0.000001 μa=0.000001 微安=0.000001 mA=0.001 ma=0.001 A=1 a=1 MA=1000000 安=1 安培=1
voltage | V | mV=0.001 mv=0.001 V=1 v=1 kV=1000 kv=1000 MV=1000000 伏=1 伏特=1
power | W | mW=0.001 mw=0.001 W=1 w=1 瓦=1 kW=1000 kw=1000 千瓦=1000 MW=1000000 兆瓦=1000000
capacity_volume | mL | mL=1 ml=1 毫升=1 L=1000 l=1000 升=1000
capacity_charge | mAh | mAh=1 mah=1 毫安时=1 Ah=1000 ah=1000 安时=1000
frequency | Hz | mHz=0.001 Hz=1 hz=1 赫兹=1 kHz=1000 khz=1000 千赫兹=1000 MHz=1000000 兆赫兹=1000000 GHz=1000000000
torque | N·m | N·m=1 N.m=1 Nm=1 牛米=1 kgf·cm=0.0980665
pressure | Pa | Pa=1 pa=1 帕=1 mPa=0.001 kPa=1000 kpa=1000 千帕=1000 MPa=1000000 兆帕=1000000 bar=100000 psi=6894.757293168
flow_rate | L/min | L/min=1 l/min=1 lpm=1 升/分钟=1 mL/min=0.001 ml/min=0.001 毫升/分钟=0.001 m3/h=16.6666666667 m³/h=16.6666666667
temperature | °C | °C=1 °c=1 ℃=1 C=1 c=1 °F=0.5555555555555556 °f=0.5555555555555556 ℉=0.5555555555555556
duration | s | ms=0.001 毫秒=0.001 s=1 sec=1 秒=1 min=60 分钟=60 h=3600 hr=3600 小时=3600
"""
# What is added after the factor: only degrees Fahrenheit.
UNIT_OFFSETS = {"°F": -17.77777777777778, "°f": -17.77777777777778, "℉": -17.77777777777778}
# Unit words, singular; plurals end in s, and -meter and -liter words are also spelt -metre and -litre.
UNIT_WORDS = """
mass | milligram=mg gram=g kilogram=kg pound=lb ounce=oz
length | millimeter=mm centimeter=cm meter=m
current | microampere=uA milliampere=mA ampere=A amp=A megaampere=MA
voltage | millivolt=mV volt=V kilovolt=kV megavolt=MV
power | milliwatt=mW watt=W kilowatt=kW megawatt=MW
capacity_volume | milliliter=mL liter=L
duration | millisecond=ms second=s minute=min hour=h
"""
# Fields: name, label, type, unit family, scope, policy, confidence, aliases.
FIELDS = """
sku | SKU | text | | | | 0.99 | sku; sku id; 货号; 商品编码
model | 型号 | text | | | | 0.97 | 产品型号; 商品型号; 型号; model no; model
variant | 变体 | text | | | | 0.9 | variant; variant id; 变体; 款式; 版本
net_weight | 净重 | number | mass | net | | 0.95 | 产品净重; 商品净重; 净含量; 净重; net weight; net wt
gross_weight | 毛重/包装重量 | number | mass | gross | | 0.95 | 包装重量; 整箱重量; 毛重; gross weight; shipping weight
weight | 重量 | number | mass | unspecified | | 0.82 | 单个重量; 产品重量; 商品重量; 重量; weight
dimensions | 尺寸 | dimensions | length | | | 0.95 | 产品尺寸; 包装尺寸; 规格尺寸; 外形尺寸; 尺寸; dimensions; dimension; size
length | 长度 | number | length | | | 0.95 | 总长; 长度; length
width | 宽度 | number | length | | | 0.95 | 宽度; width
height | 高度 | number | length | | | 0.95 | 高度; height
quantity | 数量 | count | | | | 0.95 | 套装数量; 包装数量; 件数; 数量; quantity; qty; count; pack quantity
material | 材质 | text | | | | 0.95 | 主要材质; 产品材质; 材料; 材质; material
color | 颜色 | text | | | | 0.95 | 产品颜色; 颜色; colour; color
voltage | 电压 | number | voltage | | electrical | 0.95 | 额定电压; 输入电压; 输出电压; 电压; voltage; 电压规格; voltage variant
current | 电流 | number | current | | electrical | 0.95 | 额定电流; 最大电流; 输出电流; 输入电流; 电流; current
power | 功率 | number | power | | electrical | 0.95 | 额定功率; 最大功率; 输入功率; 输出功率; 功率; power
capacity_charge | 电池容量 | number | capacity_charge | | | 0.95 | 电池容量; battery capacity
capacity_volume | 容积 | number | capacity_volume | | | 0.95 | 净容量; 容积; volume capacity; volume
capacity | 容量 | capacity | | | | 0.78 | 容量; capacity
frequency | 频率 | number | frequency | | | 0.95 | 工作频率; 额定频率; 频率; frequency
torque | 扭矩 | number | torque | | | 0.95 | 最大扭矩; 额定扭矩; 扭矩; torque
pressure | 压力 | number | pressure | | | 0.95 | 工作压力; 最大压力; 压力; pressure
flow_rate | 流量 | number | flow_rate | | | 0.95 | 流速; 流量; flow rate; flow
ip_rating | 防护等级 | text | | | | 0.97 | 防护等级; ip rating; ip等级
temperature | 温度 | number | temperature | | | 0.95 | 工作温度; 运行温度; 储存温度; 温度; temperature
runtime | 续航/运行时间 | number | duration | | | 0.95 | 连续运行; 续航时间; 运行时间; runtime; battery life
charging_time | 充电时间 | number | duration | | | 0.95 | 充电时长; 充电时间; charging time; charge time
interface | 接口 | text | | | | 0.9 | 连接接口; 接口类型; 接口; interface; connector
protocol | 协议 | text | | | | 0.9 | 通信协议; 支持协议; 协议; protocol
certification | 认证 | text | | | | 0.9 | 认证标准; 通过认证; 认证; certification; certified
size_variant | 尺码 | text | | | | 0.95 | 尺码; size variant
memory_variant | 内存规格 | text | | | | 0.95 | 内存规格; memory variant
storage_variant | 存储规格 | text | | | | 0.95 | 存储规格; storage variant
"""
# Words before or after a quantity's own label, and the scope that they give it.
SCOPE_WORDS = {
    "输入": "input", "输出": "output", "input": "input", "output": "output", "额定": "rating:rated", "标称": "rating:nominal",
    "最大": "rating:max", "最小": "rating:min", "典型": "rating:typical", "最长": "rating:max", "最短": "rating:min",
    "rated": "rating:rated", "nominal": "rating:nominal", "maximum": "rating:max", "minimum": "rating:min", "typical": "rating:typical",
    "max": "rating:max", "min": "rating:min", "直流": "signal:dc", "交流": "signal:ac", "dc": "signal:dc", "ac": "signal:ac",
    "工作": "operating", "运行": "operating", "operating": "operating", "储存": "storage", "存储": "storage", "storage": "storage",
}
# Which of these scopes a field takes; electrical fields take the first group.
ELECTRICAL_SCOPES = ("input", "output", "rating:rated", "rating:nominal", "rating:max", "rating:min", "rating:typical", "signal:dc", "signal:ac")
FIELD_SCOPES = {
    "frequency": ("operating", "rating:rated", "rating:max", "rating:min", "rating:typical"),
    "torque": ("rating:rated", "rating:max", "rating:min", "rating:typical"),
    "pressure": ("operating", "rating:rated", "rating:max", "rating:min", "rating:typical"),
    "flow_rate": ("operating", "rating:rated", "rating:max", "rating:min", "rating:typical"),
    "temperature": ("operating", "storage", "rating:typical", "rating:min", "rating:max"),
    "runtime": ("rating:typical", "rating:min", "rating:max"),
    "charging_time": ("rating:typical", "rating:min", "rating:max"),
}
# Labels of dimensions that say whose they are.
DIMENSION_SCOPES = {
    "包装尺寸": "packaging", "package dimensions": "packaging", "packaging dimensions": "packaging",
    "产品尺寸": "product", "外形尺寸": "product", "product dimensions": "product",
}
# Misspelt labels, and labels that name parts of a document.
LABEL_FIXES = {"噪音": "噪声", "质保期": "保修期", "凈重": "净重", "淨重": "净重"}
STRUCTURE_LABELS = (
    "备注 说明 注 注意 提示 note notes description 参数 数值 单位 字段 值 field value parameter unit "
    "项目 内容 主产品 资料版本 文档版本 测试意图 示例 样例 example filename"
).split() + ["example only", "file name", "document version", "electrical data", "mechanical data"]
COLORS = {
    "black": "黑色", "white": "白色", "red": "红色", "blue": "蓝色", "green": "绿色", "yellow": "黄色", "orange": "橙色", "grey": "灰色", "gray": "灰色",
}
MISSING_VALUES = "待定 待确认 待补充 未知 未提供 tbd tbc n/a - -- 暂无".split()
NON_NEGATIVE_FAMILIES = ("mass", "length", "capacity_volume", "capacity_charge", "duration", "power")
# ------------------------------------------------------------ end of fixed values


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    kind: str
    family: str | None
    scope: str | None
    policy: str | None
    confidence: float
    aliases: tuple[str, ...]


def _lines(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in table.strip().splitlines()]


@lru_cache(maxsize=1)
def fields() -> tuple[Field, ...]:
    out = []
    for name, label, kind, family, scope, policy, confidence, aliases in _lines(FIELDS):
        names = tuple(a.strip() for a in aliases.split(";"))
        out.append(Field(name, label, kind, family or None, scope or None, policy or None, float(confidence), names))
    return tuple(out)


@lru_cache(maxsize=1)
def units() -> dict[tuple[str, str], tuple[float, float]]:
    """(family, symbol or lower-case word) -> (factor, offset)."""
    found: dict[tuple[str, str], tuple[float, float]] = {}
    for family, _, symbols in _lines(UNIT_FAMILIES):
        for symbol, factor in (s.rsplit("=", 1) for s in symbols.split()):
            found[family, symbol] = float(factor), UNIT_OFFSETS.get(symbol, 0.0)
    for family, words in _lines(UNIT_WORDS):
        for word, symbol in (w.split("=") for w in words.split()):
            spellings = {word, word.replace("meter", "metre").replace("liter", "litre")} if word.endswith(("meter", "liter")) else {word}
            for w in spellings:
                for form in (w, "inches" if w == "inch" else w + "s"):
                    found[family, form] = found[family, symbol]
    for form in ("inch", "inches"):
        found["length", form] = found["length", "in"]
    return found


@lru_cache(maxsize=1)
def spellings() -> tuple[str, ...]:
    """Every spelling of a unit, of any family."""
    return tuple(sorted({token for _, token in units()}))


@lru_cache(maxsize=1)
def base_units() -> dict[str, str]:
    return {family: base for family, base, _ in _lines(UNIT_FAMILIES)}


def scopes_of(field: Field) -> tuple[str, ...]:
    return ELECTRICAL_SCOPES if field.policy == "electrical" else FIELD_SCOPES.get(field.name, ())


@lru_cache(maxsize=1)
def labels() -> dict[str, tuple[str, str | None]]:
    """Lower-case label -> (field, scope that the label gives)."""
    found: dict[str, tuple[str, str | None]] = {}
    for f in fields():
        short = [a for a in f.aliases if not any(a.startswith(w) for w in SCOPE_WORDS)] + [f.name.replace("_", " ")]
        for word, scope in SCOPE_WORDS.items():
            if scope in scopes_of(f):
                for a in short:
                    if word.isascii() == a.isascii():
                        found.setdefault(f"{word} {a}" if word.isascii() else word + a, (f.name, scope))
    for f in fields():
        for a in (f.name, *f.aliases):
            found.setdefault(a.lower(), (f.name, f.scope))
            if found[a.lower()][0] == f.name and found[a.lower()][1] is None:
                found[a.lower()] = (f.name, f.scope)
    for label, scope in DIMENSION_SCOPES.items():
        found[label] = "dimensions", scope
    for wrong, right in LABEL_FIXES.items():
        if right in found:
            found[wrong] = found[right]
    return found


def field_table(spark: SparkSession) -> DataFrame:
    """One row per field: a dimension of fixed size."""
    rows = [(f.name, f.label, f.kind, f.family, f.scope, f.policy, f.confidence) for f in fields()]
    return spark.createDataFrame(rows, "field string, field_label string, value_type string, family string, default_scope string, policy string, confidence double")


def label_table(spark: SparkSession) -> DataFrame:
    """One row per label: a dimension of fixed size."""
    return spark.createDataFrame([(k, f, s) for k, (f, s) in labels().items()], "label_key string, field string, label_scope string")


def unit_table(spark: SparkSession) -> DataFrame:
    """One row per unit spelling: a dimension of fixed size."""
    base = base_units()
    rows = [(family, token, factor, offset, base[family]) for (family, token), (factor, offset) in units().items()]
    return spark.createDataFrame(rows, "family string, unit_token string, factor double, unit_offset double, base_unit string")
