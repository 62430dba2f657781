"""Values and claims in free text: quantities, geometry by the component that owns a number, battery systems, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import relational

_NUMBER = r"[0-9]+(?:\.[0-9]+)?"

# Kinds of quantity with their patterns (number, unit).
QUANTITIES: list[tuple[str, str]] = [
    ("capacity", rf"({_NUMBER})\s*(mAh/g|mAh/cm²)"),
    ("energy", rf"({_NUMBER})\s*(Wh/kg|Wh/L)"),
    ("retention", rf"({_NUMBER})\s*(%)\s*(?:capacity|容量)?.{{0,12}}?(?:retention|保持)"),
    ("conductivity", rf"({_NUMBER})\s*(mS/cm|S/cm)"),
    ("voltage", rf"({_NUMBER})\s*(V)\b"),
    ("temperature", rf"({_NUMBER})\s*(°C|℃)"),
    ("rate", rf"({_NUMBER})\s*(C)\b"),
    ("cycles", r"([0-9]+)\s*(圈|次|cycles)"),
]


def quantities(text: Column) -> Column:
    """array<struct<kind, value, unit>>: the distinct quantities of a text, by kind and value."""
    found = []
    for kind, pattern in QUANTITIES:
        values, units = (F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(g)) for g in (1, 2))
        found.append(F.transform(F.arrays_zip(values.alias("v"), units.alias("u")), _as(kind)))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def _as(kind: str):
    return lambda e: F.struct(F.lit(kind).alias("kind"), e["v"].cast("double").alias("value"), e["u"].alias("unit"))


# Words that name a component, and fields with their patterns; a range counts with its middle.
ANCHORS: list[tuple[str, str]] = [("cathode", "正极|阴极|cathode"), ("anode", "负极|阳极|anode")]
_RANGE = rf"{_NUMBER}(?:\s*[-~–—到]\s*{_NUMBER})?"
GEOMETRY: list[tuple[str, str]] = [
    ("loading_mg_cm2", rf"(?:面?载量|loading)[^0-9]{{0,8}}({_RANGE})\s*mg\s*[·/]?\s*cm(?:⁻²|²|\^2|-2)"),
    ("compaction_g_cm3", rf"(?:压实(?:密度)?|compaction)[^0-9]{{0,8}}({_RANGE})\s*g\s*[·/]?\s*cm(?:⁻³|³|\^3|-3)"),
    ("porosity_pct", rf"(?:孔隙率|porosity)[^0-9%]{{0,8}}({_RANGE})\s*%"),
    ("thickness_um", rf"(?:厚度|thickness)[^0-9]{{0,6}}({_NUMBER})\s*(?:μm|um|微米)"),
    ("R_s_um", rf"(?:颗粒半径|粒径|D50)[^0-9]{{0,6}}({_RANGE})\s*(?:μm|um|微米)"),
]


def middle(text: Column) -> Column:
    """The mean of the numbers of a range."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(numbers), F.lit(0))


def _places(rows: DataFrame, row_id: str, text: str, name: str, pattern: str) -> DataFrame:
    """row_id, pos, name, found (first group): each place of a pattern, by cutting the text at its matches."""
    marked = F.regexp_replace(F.col(text), f"(?i)({pattern})", "\x01$1\x01")
    parts = F.split(marked, "\x01")
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)))
    each = rows.select(row_id, F.posexplode(F.arrays_zip(parts.alias("p"), sizes.alias("s"))).alias("i", "e")).filter("i % 2 = 1")
    return each.select(row_id, F.col("e.s").alias("pos"), F.lit(name).alias("name"), F.regexp_extract("e.p", f"(?i){pattern}", 1).alias("found"))


def geometry(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, component, field, value: the first value of each field of each component. A number belongs to
    the component named last before it: an as-of lookup over the places in the text."""
    anchors = points = None
    for name, pattern in ANCHORS:
        found = _places(rows, row_id, text, name, f"({pattern})").select(row_id, "pos", F.col("name").alias("component"))
        anchors = found if anchors is None else anchors.unionByName(found)
    for name, pattern in GEOMETRY:
        found = _places(rows, row_id, text, name, pattern)
        points = found if points is None else points.unionByName(found)
    owned = relational.as_of(points, anchors, row_id, "pos", "component").filter("component is not null")
    return owned.groupBy(row_id, "component", F.col("name").alias("field")).agg(F.min_by(middle(F.col("found")), F.col("pos")).alias("value"))


def diffusion_m2s(text: Column) -> Column:
    """A solid diffusion coefficient in m²/s; one in cm²/s is converted. Null if none."""
    pattern = r"(?i)(?:扩散系数|D_?s)\s*(?:为|是|约|≈|=|:|：)?\s*([0-9.][^\s，,。；;]{0,24}?)\s*(cm|m)(?:²|\^2|2)\s*/\s*s"
    value = t.superscript_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
    return F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "cm", value * 1e-4).otherwise(value)


def voltage_window(text: Column) -> Column:
    """struct<v_min, v_max> of a window like ``2.8-4.3 V``, null if none."""
    pattern = rf"(?i)(?:电压窗口|工作窗口|电压范围|截止电压|voltage window|voltage range)[^0-9]{{0,10}}({_NUMBER})\s*[-~–—到]\s*({_NUMBER})\s*V"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("double").alias("v_min"), F.regexp_extract(text, pattern, 2).cast("double").alias("v_max")))


def battery_systems(text: Column) -> Column:
    """array<struct<kind, material, counter>>: half-cells, full cells ``A||B`` and comparison materials; one
    ``unknown`` with the heading if there is none."""
    def found(kind: str, pattern: str, two: bool) -> Column:
        first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if two else F.transform(first, lambda x: F.lit(""))
        return F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda e: F.struct(F.lit(kind).alias("kind"), F.trim(e["a"]).alias("material"), F.trim(e["b"]).alias("counter")))

    half = found("half-cell", r"(?i)(\w[\w.]+\s*(?:cathode|正极|positive))\s*(?:was\s+tested\s+)?in\s+(?:a\s+)?half[\s-]?cell\s+(?:with|against|vs\.?)\s+(Li(?:\s*metal)?|Na(?:\s*metal)?)", True)
    full = found("full-cell", r"(?i)full[\s-]?cell\s+(?:with|using|of)\s+(\w[\w.]*)\s*\|\|\s*(\w[\w.]*)", True)
    other = found("comparison", r"(?i)((?:commercial|bare|pristine|conventional|unmodified|standard)\s+\w[\w.]*)", False)
    all_ = F.concat(half, full, other)
    heading = F.array(F.struct(F.lit("unknown").alias("kind"), F.substring(F.regexp_extract(text, r"#\s+([^\n]+)", 1), 1, 80).alias("material"), F.lit("").alias("counter")))
    return F.when(F.size(all_) > 0, all_).otherwise(heading)


def seed_problems(sentence: Column, quote: Column, value: Column, relation: Column, allowed: list[str], conditions: Column | None = None) -> Column:
    """What is wrong with an extracted relation: its quote is not in the sentence, its value's digits are not, its kind is unknown, or, with
    ``conditions`` (map<string,string>), some condition is neither there nor has all of its numbers there; one without numbers is not judged."""
    digits = F.regexp_extract(value, _NUMBER, 0)
    return F.array_compact(F.array(
        F.when(~F.contains(t.bare(sentence), t.bare(quote)), "quote"),
        F.when((digits != "") & ~F.contains(sentence, digits), "value"),
        F.when(~relation.isin(*allowed), "relation"),
        F.lit(None).cast("string") if conditions is None else F.when(F.exists(F.map_values(conditions), lambda v: _untold(v, sentence)), "condition")))


def _untold(value: Column, sentence: Column) -> Column:
    numbers = F.regexp_extract_all(value, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.coalesce(~F.contains(sentence, value) & ~F.forall(numbers, lambda n: F.contains(sentence, n)), F.lit(False))


def strict_number(json: Column) -> Column:
    """A JSON number as a double; null for booleans, texts, NaN and infinities."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(kind.rlike("BIGINT|DOUBLE|DECIMAL|FLOAT|INT"), json.try_cast("double"))


def follow_up_queries(issue: Column) -> Column:
    """Up to three searches from a review: 30 characters after each word that says what is missing."""
    found = F.regexp_extract_all(issue, F.lit(r"(?i)(?:缺少|缺乏|补充|missing|lacks|need)[:：\s]*([^。；;\n]{1,30})"), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"[\"'“”()（）\[\]]", ""))), lambda x: x != ""), 1, 3)
