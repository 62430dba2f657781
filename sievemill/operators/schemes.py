"""Design schemes against declarative rules, and the enumeration of schemes from tables of materials.

A rule has a trigger and perhaps a second condition, each (field, operator, value), and an action. Fields are columns of a scheme,
``component.attribute`` of the material that its text resolves to, or the energy aimed at, which goes by several names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as p
from . import matching, rules
from .storage import small, stored

COMPONENTS = ("cathode", "anode", "electrolyte")
# Names of the energy aimed at, in order; other words for measures that ease a challenge; the energies of tasks.
ENERGY_FIELDS = ["target_energy", "target_energy_wh_kg", "target_energy_density", "claimed_energy", "energy_density_wh_kg", "theoretical_energy_density"]
OTHER_WORDS = {
    "fec": ["氟代碳酸乙烯酯", "fluoroethylene carbonate"], "vc": ["碳酸亚乙烯酯", "vinylene carbonate"], "lipo2f2": ["二氟磷酸锂", "difluorophosphate"],
    "single_crystal": ["单晶", "sc-", "single crystal"], "artificial_sei": ["人工sei", "人工界面", "保护层", "artificial sei"],
    "alloy_li_ag": ["li-ag", "las", "合金", "亲锂"], "li-ag": ["li-ag", "las", "合金", "亲锂"], "las": ["li-ag", "las", "合金", "亲锂"],
    "lithiophilic_framework": ["亲锂", "三维", "3d", "骨架"], "lpo": ["包覆", "coating", "快离子"], "al2o3": ["包覆", "coating", "快离子"],
}
ENERGY_TARGETS = [300, 350, 400, 450]
#: Columns of a scheme in which measures are looked for.
MEASURE_FIELDS = ("cathode", "anode", "electrolyte", "additives", "notes", "strategy", "modifications", "user_locked")
#: The rules with the limit taken from the cathode that a scheme resolves to.
RULES = [r | ({"trigger": ("cathode.voltage_limit", *r["trigger"][1:])} if r["trigger"][0] == "voltage_limit" else {}) for r in rules.RULES]
#: Outcomes with which a scheme is not feasible.
FATAL = ("rejected", "violation", "unverified")


def with_materials(schemes: DataFrame, materials: DataFrame) -> DataFrame:
    """``schemes`` and for each component ``<component>_attrs``: the material (id, aliases and any attributes) whose longest alias, or id,
    stands in the component's text, in any case; null without one. Each different text is resolved once."""
    materials = stored(materials)
    names = materials.select("id", F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("id", F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= 2)
    texts = reduce(DataFrame.union, [schemes.select(F.lower(F.trim(c)).alias("__text")) for c in COMPONENTS]).filter("__text <> ''").distinct()
    known = matching.longest_contained(texts, "__text", names).join(small(materials.select(F.col("id").alias("hit"), F.struct(*materials.columns).alias("__attrs"))), "hit")
    known = small(stored(known.select("__text", "__attrs")))
    out = schemes
    for c in COMPONENTS:
        one = known.select(F.col("__text").alias("__t"), F.col("__attrs").alias(f"{c}_attrs"))
        out = out.join(one, F.lower(F.trim(F.col(c))) == F.col("__t"), "left").drop("__t")
    return out


def field(schemes: DataFrame, path: str) -> Column:
    """The value of a rule's field, null where a scheme has no such column or attribute."""
    if "." in path:
        head, attribute = path.split(".", 1)
        kind = schemes.schema[f"{head}_attrs"].dataType
        return F.col(f"{head}_attrs").getField(attribute) if attribute in kind.names else F.lit(None)
    if path in ("target_energy", "target_energy_density"):
        return F.coalesce(*[F.col(n).cast("double") for n in ENERGY_FIELDS if n in schemes.columns], F.lit(None).cast("double"))
    if path in COMPONENTS:
        return F.coalesce(F.col(f"{path}_attrs")["id"], F.col(path))
    return F.col(path) if path in schemes.columns else F.lit(None)


def fulfilled(schemes: DataFrame, rule: tuple) -> Column:
    """Whether (field, operator, value) holds; never for a null field. ``contains`` looks into each entry of a list, in any case."""
    path, op, value = rule
    x = field(schemes, path)
    is_list = path in schemes.columns and isinstance(schemes.schema[path].dataType, T.ArrayType)
    if op == "contains" and is_list:
        return F.coalesce(F.exists(x, lambda e: F.contains(F.lower(e), F.lit(str(value).lower()))), F.lit(False))
    return rules.matches(("x", op, value), {"x": x})


def wanted(target: str) -> tuple[str, list[str]]:
    """(category, ids) of ``category:[a, b]`` or ``category:a``."""
    category, _, rest = target.partition(":")
    return category, [x.strip() for x in rest.strip("[]").split(",") if x.strip()]


def has_target(schemes: DataFrame, target: str) -> Column:
    """Whether a scheme has any of a target's ids in its category; additives are a list."""
    category, ids = wanted(target)
    x = field(schemes, "additives" if category == "additive" else category)
    if category == "additive" and "additives" in schemes.columns:
        return F.coalesce(F.arrays_overlap(x, F.array(*[F.lit(i) for i in ids])), F.lit(False))
    return F.coalesce(x.cast("string").isin(*ids), F.lit(False))


def eased(schemes: DataFrame, measures: list[str]) -> Column:
    """Whether a scheme names any of the measures (``category:word``) or another word for it anywhere, or keeps a locked electrolyte
    with some modification of its own."""
    parts = []
    for f in MEASURE_FIELDS:
        if f in schemes.columns:
            parts.append(F.concat_ws(" ", f) if isinstance(schemes.schema[f].dataType, T.ArrayType) else F.col(f))
    parts += [F.col(f"{c}_attrs")["id"] for c in COMPONENTS]
    words = [w for m in measures for token in [m.partition(":")[2].lower() or m.lower()] for w in [token, *OTHER_WORDS.get(token, [])]]
    locked = F.lit(False)
    if {"user_locked", "modifications"} <= set(schemes.columns):
        locked = F.coalesce(F.array_contains("user_locked", "electrolyte") & (F.size("modifications") > 0), F.lit(False))
    return p.contains_any(F.lower(F.concat_ws(" ", *parts)), list(dict.fromkeys(words))) | locked


def evaluated(schemes: DataFrame, materials: DataFrame, given: list[dict] = RULES) -> DataFrame:
    """``schemes`` and hits array<struct<rule, outcome, missing>>, feasible boolean. schemes: the components' texts and any of additives
    array<string>, notes, strategy, modifications array<string>, user_locked array<string> and the energies' names. materials: id, aliases and attributes.

    Outcomes: unverified (rule C0: a component that no material resolves), rejected, violation (an excluded target is there; a
    challenge that nothing eases; graphite where 400 Wh/kg are aimed at), eased, missing and recommended (``missing`` names what
    the scheme lacks), warning, audit_note, material_energy, frontier. A scheme with a rejection, a violation or something
    unverified is not feasible."""
    s = with_materials(schemes, materials)
    hit = lambda rule, outcome, missing=None: F.struct(F.lit(rule).alias("rule"), outcome.alias("outcome"), (F.lit(None).cast("string") if missing is None else missing).alias("missing"))
    unverified = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.col(f"{c}_attrs").isNull() for c in COMPONENTS])
    hits = [F.when(unverified, hit("C0", F.lit("unverified")))]
    for rule in given:
        fires = fulfilled(s, rule["trigger"])
        if "condition" in rule:
            fires = fires & fulfilled(s, rule["condition"])
        action, target = rule["action"], rule.get("target")
        there = has_target(s, target) if target else None
        lacks = None if target is None else F.when(~there, F.lit(wanted(target)[0] + ":" + "/".join(wanted(target)[1])))
        if action == "exclude":
            fires, outcome = fires & there, F.lit("violation")
        elif action == "include":
            fires, outcome = fires & ~there, F.lit("missing")
        elif action == "challenge":
            outcome = F.when(eased(s, rule["whitelist"]), "eased").otherwise("violation")
        elif action == "coin_cell_eval":
            graphite = F.coalesce(field(s, "anode") == "graphite", F.lit(False)) & (field(s, "target_energy") >= 400)
            outcome = F.when(graphite, "violation").otherwise("material_energy")
        else:
            outcome = F.lit({"reject": "rejected", "warn": "warning", "recommend": "recommended", "flag_frontier": "frontier"}.get(action, action))
        hits.append(F.when(fires, hit(rule["id"], outcome, lacks)))
    s = s.withColumn("hits", F.array_compact(F.array(*hits)))
    return s.withColumn("feasible", ~F.exists("hits", lambda h: h["outcome"].isin(*FATAL))).drop(*[f"{c}_attrs" for c in COMPONENTS])


def enumerated(cathodes: DataFrame, anodes: DataFrame, electrolytes: DataFrame) -> DataFrame:
    """All combinations of three vocabularies (id, place; of the cathodes voltage and capacity too): cathode, anode, electrolyte, energy, and
    place, which tells the first of them."""
    a = small(anodes.select(F.col("id").alias("anode"), F.col("place").alias("__a")))
    e = small(electrolytes.select(F.col("id").alias("electrolyte"), F.col("place").alias("__e")))
    every = cathodes.select(F.col("id").alias("cathode"), F.col("place").alias("__c"), "voltage", "capacity").crossJoin(a).crossJoin(e)
    energy = rules.cell_energy(F.col("voltage"), F.col("capacity"), F.col("anode"))
    return every.select("cathode", "anode", "electrolyte", energy.alias("energy"), F.struct("__c", "__a", "__e").alias("place"))


def combination_tasks(every: DataFrame, materials: DataFrame, targets: list[int] = ENERGY_TARGETS) -> DataFrame:
    """target, n_feasible, feasible, cathode, anode, electrolyte, energy: for each energy aimed at the best combination that reaches it
    (a tie: the first), or feasible false with nulls if none does. One pass over combinations x targets."""
    aimed = every.withColumn("target_energy", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    judged = evaluated(aimed, materials).filter("feasible")
    reach = F.col("energy") >= F.col("target_energy")
    best = F.min_by(F.struct("cathode", "anode", "electrolyte", "energy"), F.when(reach, F.struct(-F.col("energy"), F.col("place")))).alias("best")
    found = judged.groupBy("target_energy").agg(F.count("*").alias("n_feasible"), best)
    asked = every.sparkSession.createDataFrame([(float(t),) for t in targets], "target_energy double")
    out = asked.join(found, "target_energy", "left")
    return out.select(F.col("target_energy").cast("int").alias("target"), F.coalesce("n_feasible", F.lit(0)).alias("n_feasible"), F.col("best").isNotNull().alias("feasible"), "best.*")


def violating_tasks(every: DataFrame, materials: DataFrame, given: list[dict] = RULES) -> DataFrame:
    """rule, cathode, anode, electrolyte: the first combination that violates each rule; no row for a rule that none does. A rule
    about the energy aimed at is tried at its own value."""
    own = {r["id"]: float(r["trigger"][2]) if r["trigger"][0] == "target_energy" else None for r in given}
    energies = F.array(*[F.lit(x).cast("double") for x in sorted(set(own.values()), key=lambda x: (x is not None, x))])
    judged = evaluated(every.withColumn("target_energy", F.explode(energies)), materials, given)
    hits = judged.select("cathode", "anode", "electrolyte", "place", "target_energy", F.explode(F.filter("hits", lambda h: h["outcome"] == "violation")).alias("h"))
    at = F.create_map(*[F.lit(x) for rule, energy in own.items() if energy is not None for x in (rule, energy)]) if any(own.values()) else F.create_map()
    mine = hits.filter(F.col("target_energy").eqNullSafe(at[F.col("h.rule")]))
    return mine.groupBy(F.col("h.rule").alias("rule")).agg(F.min_by(F.struct("cathode", "anode", "electrolyte"), "place").alias("first")).select("rule", "first.*")
