"""Declarative rules over schemes, energy estimates and geometry: column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small

# Triggers and second conditions (field, operator, value), action, target and mitigations of the rules.
RULES: list[dict] = [
    {"id": "C1", "trigger": ("voltage_limit", "gt", 4.3), "condition": ("electrolyte", "contains", "carbonate"), "action": "challenge",
     "whitelist": ["additive:FEC", "additive:LiPO2F2", "additive:VC", "additive:DTD", "coating:LPO", "coating:Al2O3", "morphology:single_crystal"]},
    {"id": "C2", "trigger": ("voltage_limit", "gt", 4.6), "condition": ("electrolyte", "eq", "carbonate_ec"), "action": "challenge",
     "whitelist": ["additive:FEC", "additive:LiPO2F2", "additive:DTD", "coating:LPO", "coating:Al2O3"]},
    {"id": "C3", "trigger": ("anode", "eq", "li_metal"), "condition": ("electrolyte", "contains", "carbonate"), "action": "challenge",
     "whitelist": ["anode_mod:artificial_sei", "anode_mod:alloy_li_ag", "anode_mod:lithiophilic_framework", "anode:las", "anode:li-ag", "additive:FEC", "additive:LiNO3", "electrolyte:lhce"]},
    {"id": "C5", "trigger": ("anode", "eq", "si_base"), "action": "recommend", "target": "additive:FEC"},
    {"id": "C6", "trigger": ("cathode", "in", ["LNMO", "LRMO"]), "action": "audit_note"},
    {"id": "C7", "trigger": ("target_energy", "gte", 400.0), "action": "coin_cell_eval"},
    {"id": "C8", "trigger": ("target_energy", "gte", 500.0), "action": "flag_frontier"},
]
ACTIVE_RATIOS = {"graphite": 0.50, "si_base": 0.45, "li_metal": 0.50}
DEFAULT_RATIO, ENERGY_TOLERANCE = 0.48, 0.35

#: Materials to enumerate, our own values from common literature: id, voltage, limit, mAh/g.
CATHODES = [("NCM811", 3.8, 4.3, 200.0), ("LFP", 3.4, 3.8, 160.0), ("LNMO", 4.7, 4.9, 135.0), ("LRMO", 3.6, 4.8, 250.0), ("LCO", 3.9, 4.45, 170.0)]
ANODES = [("graphite",), ("si_base",), ("li_metal",)]
ELECTROLYTES = [("carbonate_ec",), ("carbonate_fec",), ("lhce",), ("ether",)]


def matches(rule: tuple, fields: dict[str, Column]) -> Column:
    """Whether a field fulfils (field, operator, value); a null one never does."""
    name, op, value = rule
    x = fields[name]
    if op in ("gt", "gte", "lt", "lte"):
        y = F.lit(float(value))
        found = {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]
    elif op == "eq":
        found = x.cast("string") == str(value)
    elif op == "in":
        found = x.isin(*value)
    elif op == "not_in":
        found = ~x.isin(*value)
    else:
        found = F.contains(F.lower(x.cast("string")), F.lit(str(value).lower()))
    return F.coalesce(found, F.lit(False))


def evaluated(schemes: DataFrame, fields: dict[str, Column], additives: Column, known: Column) -> DataFrame:
    """``hits`` array<struct<rule, outcome>> and ``feasible``. Outcomes: violation, mitigated, recommend, audit_note,
    energy_ok, frontier, unverified. A challenge is mitigated by any additive or change on its list."""
    hits = [F.when(~known, F.struct(F.lit("C0").alias("rule"), F.lit("unverified").alias("outcome")))]
    for rule in RULES:
        fires = matches(rule["trigger"], fields)
        if "condition" in rule:
            fires = fires & matches(rule["condition"], fields)
        if rule["action"] == "challenge":
            names = [w.split(":")[1].lower() for w in rule["whitelist"]]
            eased = F.arrays_overlap(F.transform(additives, lambda a: F.lower(a)), F.array(*[F.lit(n) for n in names])) | F.lower(fields["electrolyte"]).isin(*names) | F.lower(fields["anode"]).isin(*names)
            outcome = F.when(eased, "mitigated").otherwise("violation")
        elif rule["action"] == "coin_cell_eval":
            outcome = F.when(F.coalesce(fields["anode"] == "graphite", F.lit(False)), "violation").otherwise("energy_ok")
        else:
            outcome = F.lit({"flag_frontier": "frontier"}.get(rule["action"], rule["action"]))
        hits.append(F.when(fires, F.struct(F.lit(rule["id"]).alias("rule"), outcome.alias("outcome"))))
    out = schemes.withColumn("hits", F.array_compact(F.array(*hits)))
    return out.withColumn("feasible", ~F.exists("hits", lambda h: h["outcome"].isin("violation", "unverified")))


def enumerated(spark) -> DataFrame:
    """All combinations of the small tables above: cathode, anode, electrolyte and what is known of them."""
    c = spark.createDataFrame(CATHODES, "cathode string, voltage double, voltage_limit double, capacity double")
    a, e = spark.createDataFrame(ANODES, "anode string"), spark.createDataFrame(ELECTROLYTES, "electrolyte string")
    return c.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(e))


def cell_energy(voltage: Column, capacity: Column, anode: Column) -> Column:
    """Wh/kg of a cell: the material's V times mAh/g, by the anode's share of active mass."""
    ratio = F.lit(DEFAULT_RATIO)
    for name, x in ACTIVE_RATIOS.items():
        ratio = F.when(anode == name, F.lit(x)).otherwise(ratio)
    return voltage * capacity * ratio


def claim_check(claimed: Column, estimated: Column) -> Column:
    off = F.try_divide(F.abs(claimed - estimated), estimated)
    return F.when((estimated > 0) & (off <= ENERGY_TOLERANCE), "ok").otherwise("energy_mismatch")


def range_check(value: Column, low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "unknown").when(value < low, "below_range").when(value > high, "above_range").otherwise("ok")


def targets(text: Column) -> Column:
    """``cat:[a, b]`` or ``cat:a`` as struct<category, names>."""
    names = F.regexp_replace(F.regexp_extract(text, r"^[^:]*:(.*)$", 1), r"[\[\]]", "")
    return F.struct(F.regexp_extract(text, r"^([^:]*):", 1).alias("category"), F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "").alias("names"))


def energy_claim(text: Column) -> Column:
    """Wh/kg after an expected-metrics heading, else after a word of claim, else anywhere; null if none."""
    get = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double")
    number = r"([0-9]+(?:\.[0-9]+)?)\s*Wh/?kg"
    return F.coalesce(get(rf"(?is)expected metrics.{{0,200}}?{number}"), get(rf"(?is)(?:reach|achieve|target|deliver)[^.]{{0,80}}?{number}"), get(rf"(?i){number}"))


def thickness(given: Column, loading: Column, compaction: Column, baseline: float) -> Column:
    """struct<um, source>: a given thickness, else loading / compaction * 10, else the baseline."""
    derived = F.when((loading > 0) & (compaction > 0), loading / compaction * 10)
    return F.struct(F.coalesce(given, derived, F.lit(baseline)).alias("um"), F.when(given.isNotNull(), "explicit").when(derived.isNotNull(), "derived").otherwise("baseline").alias("source"))


def geometry_violations(np_ratio: Column, v_min: Column, v_max: Column, porosity: Column) -> Column:
    """Names of the values that are out of bounds."""
    return F.array_compact(F.array(F.when(~np_ratio.between(1.0, 2.5), "n_p_ratio"), F.when(~v_min.between(1.0, 5.5) | ~v_max.between(1.0, 5.5) | (v_min >= v_max), "voltage"), F.when(~porosity.between(0.0, 0.9), "porosity")))


def electrode_capacity(area: Column, length: Column, active: Column, c_max: Column, stoi0: Column, stoi1: Column, faraday: float = 96485.33212) -> Column:
    """Charge of an electrode in coulombs from its geometry and stoichiometry window."""
    return area * faraday * length * active * c_max * F.abs(stoi1 - stoi0)


def pore_metrics(thickness_um: Column, porosity: Column, area_cm2: Column, electrolyte_ul: Column) -> Column:
    """struct<pore_ul, ep_ratio> of an electrode: its pore volume and the electrolyte's ratio to it; null unless all are positive."""
    pore = thickness_um * 1e-4 * area_cm2 * porosity * 1000
    ok = (thickness_um > 0) & (porosity > 0) & (area_cm2 > 0)
    return F.when(ok, F.struct(pore.alias("pore_ul"), F.try_divide(electrolyte_ul, pore).alias("ep_ratio")))


def confidence(feasible: Column, warnings: Column) -> Column:
    """low if a scheme is not feasible, medium with warnings, else high."""
    return F.when(~feasible, "low").when(warnings > 0, "medium").otherwise("high")


def consistency(tasks: DataFrame, expected: str, found: str, kind: str) -> DataFrame:
    """Tasks, consistent ones and their share, by kind."""
    same = F.count_if(F.col(expected) == F.col(found))
    return tasks.groupBy(kind).agg(F.count("*").alias("n"), same.alias("consistent"), F.round(same / F.count("*"), 6).alias("rate"))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null, in order."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in fields.items()]))


def registry_match(specs: DataFrame, registry: DataFrame) -> DataFrame:
    """Specs (cathode, anode) with the system whose lists (cathodes, anodes) hold both."""
    return specs.join(small(registry), F.array_contains(registry["cathodes"], specs["cathode"]) & F.array_contains(registry["anodes"], specs["anode"]), "left")


def revised(base: DataFrame, changes: DataFrame, key: str, budget: int) -> DataFrame:
    """``base`` (key, version, value) with the changes (key, version, value) that were made on its version and fit the budget; all
    of a key's changes or none."""
    ok = changes.groupBy(key).agg(F.count("*").alias("__n"), F.max("version").alias("__version"), F.min("version").alias("__oldest"), F.max_by("value", "seq").alias("__value"))
    joined = base.join(ok, key, "left")
    fits = (F.col("__n") <= budget) & (F.col("__version") == F.col("version")) & (F.col("__oldest") == F.col("version"))
    return joined.select(key, F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(fits, F.col("__value")).otherwise(F.col("value")).alias("value"), F.when(fits, "applied").when(F.col("__n").isNotNull(), "rejected").otherwise("kept").alias("status"))


# Words of an answer that says that a design is not feasible, and how near energies have to be: those of a task to the
# estimate, and those of an answer.
INFEASIBLE_WORDS = ["不可行", "不适用", "无法实现", "难以达到", "超出", "排除", "不兼容", "violat"]
TASK_TOLERANCE, ANSWER_TOLERANCE = 0.01, 0.30


def task_consistent(kind: Column, expected: Column, found: Column, energy: Column, estimate: Column) -> Column:
    """Whether a task agrees with the rules: a constraint check by its feasibility (expected unless it says otherwise), a recommendation by its energy
    within 1 % of the estimate, or by expecting none; other kinds are not checked and count as consistent."""
    off = F.abs(estimate - F.coalesce(energy, F.lit(0.0))) / F.greatest(estimate, F.lit(1e-9))
    by_energy = F.when(~F.coalesce(expected, F.lit(False)), True).otherwise(F.coalesce(off < TASK_TOLERANCE, F.lit(False)))
    return F.when(kind == "constraint_check", F.coalesce(found == F.coalesce(expected, F.lit(True)), F.lit(False))).when(kind == "combination_recommendation", by_energy).otherwise(True)


def answer_hit(kind: Column, answer: Column, expected: Column, estimate: Column) -> Column:
    """struct<hit, strict, error> of an answer to a task. A constraint check is hit if the answer says that it is not feasible when it is not,
    or says so at all (``strict``: only the former, which is what an accuracy may be made of); a recommendation if its first energy is within 30 % of the
    estimate; null for other kinds and where either energy is absent."""
    infeasible = F.lit(False)
    for w in INFEASIBLE_WORDS:
        infeasible = infeasible | F.contains(answer, F.lit(w))
    strict = (~F.coalesce(expected, F.lit(False))) == infeasible
    claimed = F.nullif(F.regexp_extract(answer, r"([0-9]+(?:\.[0-9]+)?)\s*Wh/kg", 1), F.lit("")).cast("double")
    error = F.round(F.try_divide(F.abs(F.nullif(claimed, F.lit(0.0)) - estimate), estimate), 3)
    of = lambda a, b: F.when(kind == "constraint_check", a).when(kind == "combination_recommendation", b)
    return F.struct(of(strict | infeasible, error <= ANSWER_TOLERANCE).alias("hit"), of(strict, error <= ANSWER_TOLERANCE).alias("strict"), of(F.lit(None).cast("double"), error).alias("error"))


# The density of lithium in g/cm3, and how far a foil's loading may be from its thickness times that.
FOIL_DENSITY, FOIL_TOLERANCE = 0.534, 0.25


def foil_violations(compaction: Column, porosity: Column, thickness_um: Column, loading: Column) -> Column:
    """array<string>: what cannot be of a lithium foil: a density over the metal's (compaction), or, where it is dense, a loading in
    mg/cm2 over 25 % off its thickness (loading). Nulls, NaN and infinities are not judged."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    expected = thickness_um * (FOIL_DENSITY / 10)
    dense = (porosity == 0) & finite(thickness_um) & (thickness_um > 0) & finite(loading)
    return F.array_compact(F.array(
        F.when(finite(compaction) & (compaction > FOIL_DENSITY), "compaction"), F.when(dense & (F.try_divide(F.abs(loading - expected), expected) > FOIL_TOLERANCE), "loading"),
    ))


def doping_question(host: Column, dopants: Column, prop: Column, condition: Column) -> Column:
    """The question of a doping task; a blank host or property has a common name. condition: map<string,string>, shown in order of its names."""
    named = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    return F.concat(named(host, "材料"), F.lit("经"), F.array_join(dopants, ","), F.lit("掺杂后，"), named(prop, "性能"), F.lit("达到多少？（条件："), _conditions(condition, F.lit("无")), F.lit("）"))


def parameter_question(material: Column, condition: Column, prop: Column) -> Column:
    """The question of a parameter task."""
    return F.concat(material, F.lit("在"), _conditions(condition, F.lit("无额外条件")), F.lit("下的"), prop, F.lit("是多少？"))


def _conditions(condition: Column, none: Column) -> Column:
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(condition)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "、")
    return F.when(F.coalesce(F.size(condition), F.lit(0)) > 0, shown).otherwise(none)


def design_questions(relations: DataFrame) -> DataFrame:
    """task_type, question, expected, unit: tasks of relations (kind, host, dopants, property, value, unit, condition): doping ones that have a value,
    performance ones always; other kinds give none."""
    doping = relations.filter("kind = 'doping' and value is not null").select(F.lit("doping_design").alias("task_type"), doping_question(F.col("host"), F.col("dopants"), F.col("property"), F.col("condition")).alias("question"), F.col("value").alias("expected"), "unit")
    plain = relations.filter("kind = 'performance'").select(F.lit("parameter_design").alias("task_type"), parameter_question(F.col("host"), F.col("condition"), F.col("property")).alias("question"), F.col("value").alias("expected"), "unit")
    return doping.unionByName(plain)
