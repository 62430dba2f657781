"""Extracted facts: condition keys, near-duplicate merging, cells, flattening, entity normalisation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t
from . import relational
from .storage import small

#: Relative difference up to which two values of one property are the same.
SAME_VALUE = 0.02


def with_form(rows: DataFrame, column: str, form: Callable[[Column], Column], name: str) -> DataFrame:
    """``name``: the form of each value. Only the different values are brought into form; they are joined back."""
    forms = rows.select(F.col(column).alias("__v")).distinct().withColumn(name, form(F.col("__v")))
    return rows.join(small(forms), F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")


def condition_id(fields: dict[str, Column], forms: dict[str, Column] | None = None) -> Column:
    """``HASH_`` and eight digits of a SHA-256 over the present fields by name; NO_CONDITION if none is.
    An ``electrolyte`` counts in its one form. forms: those that are there already, as ``with_form`` gives them."""
    parts = []
    for name in sorted(fields):
        value = fields[name].cast("string")
        shown = forms[name] if name in (forms or {}) else t.electrolyte(value) if name == "electrolyte" else value
        parts.append(F.when(~p.is_absent(value), F.concat(F.lit(f"{name}="), shown)))
    text = F.concat_ws("|", *parts)
    return F.when(text == "", "NO_CONDITION").otherwise(F.concat(F.lit("HASH_"), F.substring(F.sha2(text, 256), 1, 8)))


def document_id(*parts: Column) -> Column:
    return F.concat(F.lit("para-"), F.sha1(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])))


def cell_id(*parts: Column) -> Column:
    return F.concat(F.lit("CELL_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts]), 256), 1, 8))


def merged_values(rows: DataFrame, keys: list[str], value: str, order: str, source: str | None = None) -> DataFrame:
    """One row of each group of near-equal values: keys, ``value``, ``members`` and, with ``source``, the sources joined by ``+``.

    In order, a value within SAME_VALUE of a kept one (relative to it, and the first kept that fits) joins it, else
    it is kept. A group's rows are folded in its array; keys here are one property of one material, so groups stay small."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), (F.col(source) if source else F.lit("")).alias("s"))))
    kept_type = "array<struct<v:double,members:int,s:array<string>>>"

    def add(kept: Column, x: Column) -> Column:
        fits = F.transform(kept, lambda k: F.coalesce((k["v"] == x["v"]) | ((k["v"] != 0) & (F.abs(F.try_divide(x["v"] - k["v"], k["v"])) < SAME_VALUE)), k["v"].isNull() & x["v"].isNull()))
        at = F.array_position(fits, True)
        joined = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["v"].alias("v"), (k["members"] + 1).alias("members"), F.array_union(k["s"], F.array(x["s"])).alias("s"))).otherwise(k))
        return F.when(at > 0, joined).otherwise(F.concat(kept, F.array(F.struct(x["v"].alias("v"), F.lit(1).alias("members"), F.array(x["s"]).alias("s")))))

    folded = rows.groupBy(*keys).agg(F.aggregate(items, F.array().cast(kept_type), add).alias("kept"))
    out = folded.select(*keys, F.explode("kept").alias("k")).select(*keys, F.col("k.v").alias(value), F.col("k.members").alias("members"), F.array_join(F.array_sort("k.s"), "+").alias("sources"))
    return out if source else out.drop("sources")


def flattened(rows: DataFrame, name: str, value: str, unit: str) -> DataFrame:
    """One row a scalar: a JSON object gives a row for each key but ``unit`` (``name_key``), a list of
    rates a row for each point (``prop_c_rate``), anything else one row. Other columns stay."""
    text = F.trim(F.col(value))
    text = F.when(text.rlike(r"^\{.*'.*\}$") & ~F.contains(text, F.lit('"')), F.translate(text, "'", '"')).otherwise(text)
    rest = [c for c in rows.columns if c not in (name, value, unit)]
    none, kept = F.lit(None).cast("string"), [F.col(c) for c in (*rest, name, value, unit)]
    # each form of value is parsed by itself, and only where it can be of that form
    shaped = rows.select(*kept, text.alias("__text")).withColumn("__form", F.when(F.col("__text").rlike(r"^\{"), 1).when(F.col("__text").rlike(r"^\[\s*\{"), 2).otherwise(0))
    shaped = shaped.withColumn("__object", F.when(F.col("__form") == 1, F.from_json("__text", "map<string,string>"))).withColumn("__points", F.when(F.col("__form") == 2, F.from_json("__text", "array<map<string,string>>")))
    parsed = F.col("__object")
    shaped = shaped.withColumn("__inner", F.when(F.map_contains_key(parsed, F.lit("value")) & parsed["value"].rlike(r"^\s*\{"), F.from_json(parsed["value"], "map<string,string>")).otherwise(parsed))
    inner = F.col("__inner")
    own_unit = F.coalesce(parsed["unit"], inner["unit"], F.col(unit))
    entry = lambda n, v, u, r: F.struct(n.alias("n"), v.alias("v"), u.alias("u"), r.alias("r"))
    plain = F.map_filter(inner, lambda k, v: k != "unit")
    scalar = F.map_contains_key(plain, F.lit("value")) & (F.size(plain) == 1)
    by_key = F.transform(F.array_sort(F.map_entries(plain)), lambda e: entry(F.when(scalar, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), e["key"])), e["value"], own_unit, none))
    by_rate = F.transform("__points", lambda m: entry(F.col(name), F.coalesce(m["capacity"], m["value"]), F.coalesce(m["unit"], F.col(unit)), m["rate"]))
    rows_of = F.when(parsed.isNotNull(), by_key).when(F.col("__points").isNotNull(), by_rate).otherwise(F.array(entry(F.col(name), F.col(value), F.col(unit), none)))
    out = shaped.select(*rest, F.explode(F.array_distinct(rows_of)).alias("e"))
    return out.select(*rest, F.col("e.n").alias(name), F.col("e.v").alias(value), F.col("e.u").alias(unit), F.col("e.r").alias("prop_c_rate")).distinct()


def flattened_components(components: dict[str, DataFrame], name: str, value: str, unit: str) -> DataFrame:
    """``flattened`` rows of several components' tables, each with its ``component``; columns that some of them lack are null."""
    tagged = [rows.withColumn("component", F.lit(c)) for c, rows in components.items()]
    return flattened(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), name, value, unit)


def grouped_papers(rows: DataFrame) -> DataFrame:
    """doi, material_id, conditions array<struct<condition_id, properties>>: rows (doi, material_id,
    condition_id, name, value, seq) nested twice, in order of first appearance."""
    inner = rows.groupBy("doi", "material_id", "condition_id").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "name", "value"))).alias("properties"))
    return inner.groupBy("doi", "material_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "condition_id", "properties"))), lambda c: F.struct(c["condition_id"].alias("condition_id"), c["properties"].alias("properties"))).alias("conditions"))


def merged_components(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """doi, condition, material, name, value, members, sources: the properties of all components of a paper under their canonical conditions, near-equal
    ones of a material and condition merged (``merged_values``), with the components that they come from.

    rows: doi, component, condition_id (null: intrinsic, kept without a condition), material, name, value, seq. remap: doi, condition_id,
    canonical_id; a condition without one is its own."""
    known = remap.groupBy("doi", "condition_id").agg(F.min("canonical_id").alias("canonical_id"))
    joined = rows.join(known, ["doi", "condition_id"], "left").withColumn("condition", F.coalesce("canonical_id", "condition_id"))
    return merged_values(joined, ["doi", "condition", "material", "name"], "value", "seq", "component")


def without_orphans(rows: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a condition, rows without)."""
    absent = p.is_absent(F.col(condition))
    return rows.filter(~absent), rows.filter(absent)


def cells(materials: DataFrame) -> DataFrame:
    """One cell for each condition of each material (material_id, doi, conditions as in
    ``grouped_papers``)."""
    each = materials.select("doi", "material_id", F.explode("conditions").alias("c"))
    return each.select(cell_id(F.col("material_id"), F.col("c.condition_id")).alias("cell_id"), "doi", F.col("material_id").alias("working_material"), F.col("c.condition_id").alias("condition_id"), F.size("c.properties").alias("n_properties"))


def compatible(a: str, b: str, fields: list[str]) -> Column:
    """Fields are equal wherever both sides have one, and at least one is."""
    fits, same = F.lit(True), F.lit(False)
    for f in fields:
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        fits = fits & (x.isNull() | y.isNull() | (x == y))
        same = same | F.coalesce(x == y, F.lit(False))
    return fits & same


def resolved(rows: DataFrame, name: str, aliases: DataFrame, formulas: DataFrame) -> DataFrame:
    """``base_id`` and ``norm_method`` (exact, formula or none): aliases (alias_key, id) and formulas (formula_key, id)
    are vocabularies; both are equi-joins."""
    exact = rows.withColumn("__k", t.key(F.col(name))).withColumn("__f", t.formula_key(F.col(name)))
    one = exact.join(small(aliases.select(F.col("alias_key").alias("__k"), F.col("id").alias("__exact"))), "__k", "left")
    two = one.join(small(formulas.select(F.col("formula_key").alias("__f"), F.col("id").alias("__formula"))), "__f", "left")
    method = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__formula").isNotNull(), "formula").otherwise("none")
    return two.withColumn("base_id", F.coalesce("__exact", "__formula")).withColumn("norm_method", method).drop("__k", "__f", "__exact", "__formula")


def formulation_id(text: Column) -> Column:
    """``1M LiPF6 in EC/DEC + 1% VC`` as ``LIPF6_DEC-EC_VC``: salts, solvents, additives in order; a single salt's
    concentration stands first unless it is 1 M. Null if it is no such text."""
    whole = r"(?i)^\s*([0-9.]+\s*M?\s+[A-Za-z0-9]+(?:\s*\+\s*[0-9.]+\s*M?\s+[A-Za-z0-9]+)*)\s+in\s+([A-Za-z0-9/:,\- ]+?)(?:\s*\([^)]*\))?(?:\s*(?:\+|with)\s*(.+))?\s*$"
    names = lambda c, pattern: F.array_sort(F.array_distinct(F.transform(F.filter(F.split(c, pattern), lambda x: F.trim(x) != ""), lambda x: F.upper(F.regexp_replace(F.trim(x), r"^(?:[0-9.]+\s*(?:M\b|(?:wt|vol)?%|M)?\s*)", "")))))
    salts, solvents, additives = names(F.regexp_extract(text, whole, 1), r"\+"), names(F.regexp_extract(text, whole, 2), r"[/:,\-]| and "), names(F.regexp_extract(text, whole, 3), r"\+|,| and ")
    amount = F.regexp_extract(text, r"^\s*([0-9.]+)", 1)
    odd = (F.size(salts) == 1) & (F.abs(F.coalesce(amount.try_cast("double"), F.lit(1.0)) - 1) >= 1e-6)
    base = F.concat(F.array_join(salts, "-"), F.lit("_"), F.array_join(solvents, "-"), F.when(F.size(additives) > 0, F.concat(F.lit("_"), F.array_join(additives, "-"))).otherwise(""))
    return F.when(text.rlike(whole), F.concat(F.when(odd, F.concat(amount, F.lit("M_"))).otherwise(""), base))


def formulation_of(salts: Column, solvents: Column, additives: Column, diluents: Column) -> Column:
    """The id of a formulation that is given in parts: ``LIFSI_DME_LINO3_dil-TTE``. salts: array<struct<name, concentration>>; the others are names.

    Names are upper-cased, each once and in order; blank ones are left out. The concentration of a single salt stands first, without spaces, unless it is
    1 M. Null without a salt or without a solvent."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x != ""))), "-")
    named = F.filter(salts, lambda x: F.trim(x["name"]) != "")
    s, v, a, d = names(F.transform(named, lambda x: x["name"])), names(solvents), names(additives), names(diluents)
    amount = F.regexp_replace(F.get(F.filter(F.transform(salts, lambda x: x["concentration"]), lambda x: F.trim(x) != ""), F.lit(0)), r"\s+", "")
    usual = F.abs(F.regexp_extract(amount, r"(?i)^([0-9.]+)m$", 1).try_cast("double") - 1) < 1e-6
    first = F.when((F.size(named) == 1) & amount.isNotNull() & ~F.coalesce(usual, F.lit(False)), F.concat(amount, F.lit("_"))).otherwise("")
    after = lambda x, mark: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
    return F.when((F.coalesce(s, F.lit("")) != "") & (v != ""), F.concat(first, s, F.lit("_"), v, after(a, "_"), after(d, "_dil-")))


# Words that say how a material is made up or was treated.
MORPHOLOGY = [
    "nanoparticles", "nanowires", "nanosheets", "nanofibers", "nanoparticle", "nanowire", "nanosheet", "nanofiber", "microspheres", "microsphere",
    "nanocrystals", "nanocrystal", "single-crystal", "single crystal", "nanostructured", "porous", "hollow", "nano-structured", "nano",
]
TREATMENT = ["prelithiated", "pre-lithiated", "prelithiation", "pre-lithiation", "activated", "pre-treated", "pretreated"]


def modifications(name: Column) -> Column:
    """struct<base, coating, dopants, morphology, treatment> of an electrode material's name."""
    word = r"([A-Za-z][A-Za-z0-9()\-]*?)"
    after_at = F.regexp_extract(name, r"@\s*\(?([^()]+)\)?\s*$", 1)
    left = F.trim(F.regexp_replace(name, r"@.*$", ""))
    coat = rf"(?i){word}[\s-]*(?:coated|wrapped|encapsulated)\b"
    coating = F.filter(F.array(after_at, F.regexp_extract(left, coat, 1)), lambda x: x != "")
    left = F.trim(F.regexp_replace(left, coat, " "))
    together = r"(?i)([A-Za-z]+(?:\s*,\s*[A-Za-z]+)*)\s+co-doped\b"
    dope = rf"(?i){word}[\s-]*(?:doped|substituted)\b"
    many = F.filter(F.split(F.regexp_extract(left, together, 1), r"[,\s]+"), lambda x: x != "")
    left = F.trim(F.regexp_replace(left, together, " "))
    dopants = F.concat(many, F.filter(F.array(F.regexp_extract(left, dope, 1)), lambda x: x != ""))
    left = F.trim(F.regexp_replace(left, dope, " "))
    left = F.regexp_replace(left, rf"(?i){word}[\s-]*based\b", "$1 ")
    pattern = lambda words: r"(?i)\b(?:" + "|".join(words) + r")\b"
    morphology = F.transform(F.regexp_extract_all(left, F.lit(pattern(MORPHOLOGY)), F.lit(0)), lambda x: F.lower(x))
    left = F.regexp_replace(left, pattern(MORPHOLOGY), " ")
    treatment = F.transform(F.regexp_extract_all(left, F.lit(pattern(TREATMENT)), F.lit(0)), lambda x: F.lower(x))
    left = F.regexp_replace(left, pattern(TREATMENT), " ")
    return F.struct(F.trim(F.regexp_replace(left, r"\s+", " ")).alias("base"), coating.alias("coating"), dopants.alias("dopants"), morphology.alias("morphology"), treatment.alias("treatment"))


def variant_id(base: Column, mods: Column) -> Column:
    """Base and suffixes: ``NCM811_Al2O3-coated_Nd-doped_nano``."""
    tagged = lambda c, tag: F.transform(c, lambda x: F.concat(x, F.lit(tag)))
    return F.array_join(F.concat(F.array(base), tagged(mods["coating"], "-coated"), tagged(mods["dopants"], "-doped"), mods["morphology"], mods["treatment"]), "_")


def same_goal(a: Column, b: Column) -> Column:
    """Whether two short texts mean one goal: equal when bare; else by equal Wh/kg figures if both have one;
    else one inside the other, a common formula, or half of the shorter one's trigrams."""
    clean = lambda x: F.regexp_replace(F.lower(x), r"[\s_，。、：:；;（）()【】\[\]·\-]+", "")
    x, y = clean(a), clean(b)
    energy = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]+wh/?kg)", 1), F.lit(""))
    formulas = lambda c: F.regexp_extract_all(c, F.lit(r"(?:li|na)[0-9]*(?:\.[0-9]+)?(?:[a-z]{1,2}[0-9]*(?:\.[0-9]+)?){2,}"), F.lit(0))
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(short) - 2, F.lit(1))), lambda i: F.substr(short, i, F.lit(3))))
    share = F.size(F.filter(grams, lambda g: F.contains(long, g))) / F.greatest(F.size(grams), F.lit(1))
    both = energy(x).isNotNull() & energy(y).isNotNull()
    rest = F.contains(x, y) | F.contains(y, x) | F.arrays_overlap(formulas(x), formulas(y)) | ((F.length(short) >= 8) & (share >= 0.5))
    return F.when(x == y, True).when((F.length(x) < 6) | (F.length(y) < 6), False).when(both, energy(x) == energy(y)).otherwise(rest)


def labelled_properties(rows: DataFrame, name: str, component: str, vocabulary: DataFrame) -> DataFrame:
    """``standard_label`` and ``label_method`` (exact, normalized, none) of a property's name within its component's
    vocabulary (component, label)."""
    known = vocabulary.select(F.col("component").alias("__c"), F.col("label").alias("__label"), t.key(F.col("label")).alias("__k"))
    joined = rows.withColumn("__key", t.key(F.col(name))).join(small(known), (F.col("__k") == F.col("__key")) & (F.col("__c") == F.col(component)), "left")
    method = F.when(F.col("__label") == F.col(name), "exact").when(F.col("__label").isNotNull(), "normalized").otherwise("none")
    return joined.withColumn("label_method", method).withColumnRenamed("__label", "standard_label").drop("__key", "__k", "__c")


def full_cell(config: Column) -> Column:
    """struct<cathode, anode> of ``A||B``, null for other configurations."""
    parts = F.split(config, r"\s*(?:\|\||‖)\s*")
    return F.when(F.size(parts) == 2, F.struct(F.trim(parts[0]).alias("cathode"), F.trim(parts[1]).alias("anode")))


def batches(rows: DataFrame, order: str, size: int = 40) -> DataFrame:
    """``batch`` numbers of a queue of different names, ``size`` to a batch. The queue is what no vocabulary resolves."""
    return relational.in_order(rows, [order], "__place").withColumn("batch", (F.floor(F.col("__place") / size) + 1).cast("int")).drop("__place")
