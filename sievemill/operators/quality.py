"""Numeric data quality: unit conversion and range rules, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small

# Fixed values: (unit in lower case without spaces, base unit, factor). Milliohm and megohm differ by case and are
# told apart before lower-casing; Wh/L is a base unit of its own; mAh/kg is a thousandth of mAh/g.
UNITS: list[tuple[str, str, float]] = [
    ("mah/g", "mAh/g", 1.0), ("ah/kg", "mAh/g", 1.0), ("mah/kg", "mAh/g", 0.001), ("wh/kg", "Wh/kg", 1.0), ("wh/l", "Wh/L", 1.0), ("%", "%", 1.0), ("ratio", "%", 100.0),
    ("mah/cm2", "mAh/cm2", 1.0), ("mah/cm^2", "mAh/cm2", 1.0), ("ah/m2", "mAh/cm2", 0.1), ("v", "V", 1.0), ("mv", "V", 0.001), ("vvs.li/li+", "V", 1.0), ("vvs.li/li⁺", "V", 1.0), ("vvsli/li+", "V", 1.0),
    ("ms/cm", "mS/cm", 1.0), ("s/cm", "mS/cm", 1000.0), ("s/m", "mS/cm", 10.0), ("cm2/s", "cm2/s", 1.0), ("cm²/s", "cm2/s", 1.0), ("m2/s", "cm2/s", 10000.0), ("m²/s", "cm2/s", 10000.0),
    ("ω", "ohm", 1.0), ("ohm", "ohm", 1.0), ("ωcm2", "ohm", 1.0), ("ohmcm2", "ohm", 1.0), ("kω", "ohm", 1000.0), ("kohm", "ohm", 1000.0), ("mω", "ohm", 0.001), ("megohm", "ohm", 1000000.0),
    ("mg/cm2", "mg/cm2", 1.0), ("mg/cm^2", "mg/cm2", 1.0), ("kg/m2", "mg/cm2", 100.0), ("nm", "nm", 1.0), ("μm", "nm", 1000.0), ("um", "nm", 1000.0), ("å", "nm", 0.1), ("a", "nm", 0.1), ("mm", "nm", 1000000.0),
    ("°c", "C", 1.0), ("c", "C", 1.0), ("g/cm3", "g/cm3", 1.0), ("g/cm³", "g/cm3", 1.0), ("ma/g", "mA/g", 1.0), ("ma/cm2", "mA/cm2", 1.0), ("a/m2", "mA/cm2", 0.1),
    ("ev", "eV", 1.0), ("kj/mol", "eV", 0.010364), ("mev", "eV", 0.001), ("mpa·s", "mPa.s", 1.0), ("mpa.s", "mPa.s", 1.0), ("cp", "mPa.s", 1.0),
    ("cycles", "cycles", 1.0), ("cycle", "cycles", 1.0), ("molefraction", "frac", 1.0), ("molfraction", "frac", 1.0), ("weightratio", "frac", 1.0), ("wt%", "frac", 0.01),
]

# Fixed values: (pattern of the property, base unit, least, most, component or none), in order; the first that fits counts.
RULES: list[tuple[str, str, float, float, str | None]] = [
    ("Discharge_Specific_Capacity|Rate_Capability|First_Lithiation|Specific_Capacity|Charge_Specific_Capacity|Reversible_Capacity", "mAh/g", 0, 600, "cathode"),
    ("Discharge_Specific_Capacity|Rate_Capability|First_Lithiation|Specific_Capacity|Charge_Specific_Capacity|Reversible_Capacity", "mAh/g", 0, 5000, "anode"),
    ("Discharge_Specific_Capacity|Rate_Capability|First_Lithiation|Specific_Capacity|Charge_Specific_Capacity|Reversible_Capacity", "mAh/g", 0, 5000, None),
    ("Theoretical_Specific_Capacity", "mAh/g", 0, 5000, None),
    ("Energy_Density|Gravimetric_Energy|Volumetric_Energy", "Wh/kg", 0, 2000, None),
    ("Capacity_Retention|Retention", "%", 0, 100, None),
    ("Coulombic_Efficiency|Initial_Coulombic", "%", 0, 120, None),
    ("Rate_Recovery", "%", 0, 120, None),
    ("Pseudocapacitive_Contribution", "%", 0, 100, None),
    ("Unit_Cell_Volume_Change", "%", 0, 100, None),
    ("Areal_Capacity|Deposition_Capacity", "mAh/cm2", 0, 100, None),
    ("Stability_Window|Onset_Potential|Potential_of_Zero", "V", -3, 6, None),
    ("Voltage_Hysteresis|Overpotential|Phase_Transition_Voltage|Open_Circuit_Voltage|Nominal_Discharge_Voltage|Voltage|Potential|Operating_Voltage|Charge_Plateau|Discharge_Plateau", "V", 0, 6, None),
    ("Ionic_Conductivity|Conductivity", "mS/cm", 1e-4, 500, None),
    ("Diffusion_Coefficient", "cm2/s", 1e-12, 1e-8, None),
    ("Resistance|Impedance", "ohm", 0, 10000, None),
    ("Mass_Loading", "mg/cm2", 0.1, 50, None),
    ("Coating_Thickness", "nm", 1000, 500000, None),
    ("Electrode_Thickness", "nm", 1000, 500000, None),
    ("Porosity", "frac", 0, 1, None),
    ("N_P_Ratio|NP_Ratio", "frac", 0, 10, None),
    ("Active_Material_Mass_Fraction", "frac", 0, 1, None),
    ("Compacted_Density", "g/cm3", 0, 10, None),
    ("Particle_Size|Crystallite_Size|Interlayer_Spacing|SEI_Thickness|CEI_Thickness|Surface_.*Layer", "nm", 0.01, 1e5, None),
    ("Secondary_Particle_Size", "nm", 10, 1e5, None),
    ("Cycle_Life|Cycle_Number|cycle_number", "cycles", 0, 100000, None),
    ("Exchange_Current_Density", "mA/cm2", 1e-6, 1e4, None),
    ("Thermal_Runaway|Maximum.*Temperature|Self_Heating", "C", 0, 800, None),
    ("Temperature|thermal.*Temperature|Onset_Temperature", "C", -50, 200, None),
    ("c_rate|C_rate|Rate", "C", 0, 1000, None),
    ("current_density", "mA/g", 0, 1e6, None),
    ("Band_Gap|Migration_Barrier|Binding_Energy|Formation_Energy|HOMO_LUMO|Activation_Energy|Vacancy_Formation", "eV", -30, 30, None),
    ("Viscosity", "mPa.s", 1e-3, 1e5, None),
]


def unit_key(unit: Column) -> Column:
    """A unit as it stands in UNITS."""
    squeezed = F.regexp_replace(F.coalesce(unit, F.lit("")), r"\s", "")
    return F.lower(F.regexp_replace(squeezed, "^M[ΩΩ]$", "megohm"))


def to_base(rows: DataFrame, value: str, unit: str, base: str, key: str | None = None) -> DataFrame:
    """``value_base`` in the unit that ``base`` asks for, null if the unit is unknown or of another kind; ``unit_warning``
    says so. No unit: the value itself. K is converted to C, % to a fraction. key: a column with the units' ``unit_key``, if there is one."""
    table = rows.sparkSession.createDataFrame(UNITS, "__unit string, __base string, __factor double")
    joined = rows.withColumn("__unit", unit_key(F.col(unit)) if key is None else F.col(key)).join(F.broadcast(table), "__unit", "left")
    k, want = F.col("__unit"), F.col(base)
    converted = (
        F.when(F.col("__base") == want, F.col(value) * F.col("__factor"))
        .when(k.isin("k", "kelvin") & (want == "C"), F.col(value) - 273.15)
        .when((k == "%") & (want == "frac"), F.col(value) / 100)
        .when(k == "", F.col(value))
    )
    warning = F.when(converted.isNotNull() | F.col(value).isNull(), F.lit(None).cast("string")).when(F.col("__base").isNotNull(), "other unit").otherwise("unknown unit")
    return joined.withColumns({"value_base": converted, "unit_warning": warning}).drop("__unit", "__base", "__factor")


def rule_of(name: Column, component: Column) -> Column:
    """struct<rule, base, low, high> of the first rule that fits, null if none."""
    out = None
    for i, (pattern, base, low, high, only) in enumerate(RULES):
        fits = name.rlike(pattern) & (F.lit(True) if only is None else F.coalesce(component == only, F.lit(False)))
        found = F.struct(F.lit(i).alias("rule"), F.lit(base).alias("base"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def checked(rows: DataFrame, name: str, value: str, unit: str, component: str) -> DataFrame:
    """``value_base``, ``unit_warning``, ``rule`` and ``ok``: out of range only if a rule fits and the unit is known.

    Patterns meet each different (name, component, unit) once, not each row."""
    kinds = rows.select(F.col(name).alias("__n"), F.col(component).alias("__c"), F.col(unit).alias("__u")).distinct()
    kinds = small(kinds.withColumns({"__rule": rule_of(F.col("__n"), F.col("__c")), "__key": unit_key(F.col("__u"))}))
    same = F.col(name).eqNullSafe(F.col("__n")) & F.col(component).eqNullSafe(F.col("__c")) & F.col(unit).eqNullSafe(F.col("__u"))
    ruled = rows.join(kinds, same, "left").drop("__n", "__c", "__u").withColumn("__want", F.col("__rule.base"))
    based = to_base(ruled, value, unit, "__want", "__key").drop("__key")
    inside = F.col("value_base").between(F.col("__rule.low"), F.col("__rule.high"))
    value_base = F.when(F.col("__rule").isNotNull(), F.col("value_base"))
    return based.withColumns({"ok": F.coalesce(inside, F.lit(True)), "rule": F.col("__rule.rule"), "value_base": value_base, "unit_warning": F.when(F.col("__rule").isNotNull(), F.col("unit_warning"))}).drop("__rule", "__want")


def report(checked_rows: DataFrame, name: str) -> DataFrame:
    """Property, rows checked, rows out of range, rows whose unit is not known."""
    return checked_rows.groupBy(name).agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("dropped"), F.count("unit_warning").alias("unknown_unit"))


def relation_problems(relation: Column, required: dict[str, list[str]]) -> Column:
    """The required fields that a JSON relation lacks for its type; null if it cannot be parsed."""
    parsed = F.from_json(relation, "map<string,string>")
    need = F.create_map(*[x for k, fs in required.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in fs]))])
    return F.when(parsed.isNotNull(), F.filter(F.coalesce(F.try_element_at(need, parsed["type"]), F.array(F.lit("type"))), lambda f: F.coalesce(parsed[f], F.lit("")) == ""))
