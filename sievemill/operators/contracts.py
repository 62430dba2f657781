"""Contracts of electrode geometry: evidence for diffusion coefficients, declared values and their origins, revisions under a lock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extraction, gates
from .storage import merged_by_sort, small

# What a geometry declares, the scales of units, what evidence has to say, how near numbers have to be, and which ranges are possible.
FIELDS = ("L_um", "porosity", "R_s_um", "D_s_m2s")
COMPONENTS = ("cathode", "anode")
PATHS = [f"{c}.{f}" for c in COMPONENTS for f in FIELDS]
SCALES = {"m2/s": 1.0, "cm2/s": 1e-4}
MODEL_KELVIN, KELVIN_OFF, SAME = 298.15, 0.1, 1e-9
CLAIM_FIELDS = ("passage_id", "quote", "material_id", "parameter", "value", "unit", "temperature_K", "applicability", "method")
BUDGET = 3


def near(a: Column, b: Column, share: float = SAME) -> Column:
    """Whether two numbers differ by at most a share of the larger one."""
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))


def evidence_codes(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``claims`` and code: the first of ten checks that a claim about a diffusion coefficient fails, or OK; source_hash of the passage if OK.

    claims: CLAIM_FIELDS (value and temperature_K as JSON text), material (that the scheme uses) and used double (the value in m2/s that the
    scheme takes). passages: passage_id, text. Value and unit have to stand together in the quote, and the quote word for word in the passage."""
    texts = passages.select(F.col("passage_id").alias("__pid"), F.col("text").alias("__text")).groupBy("__pid").agg(F.min("__text").alias("__text"))
    rows = claims.join(texts, F.col("passage_id") == F.col("__pid"), "left")
    quote, low = F.col("quote"), F.lower("quote")
    value, kelvin = extraction.strict_number(F.col("value")), extraction.strict_number(F.col("temperature_K"))
    scale = F.lit(None).cast("double")
    for unit, x in SCALES.items():
        scale = F.when(F.col("unit") == unit, F.lit(x)).otherwise(scale)
    plain = F.replace(F.replace(quote, F.lit("²"), F.lit("2")), F.lit("^2"), F.lit("2"))
    pattern = F.lit(r"([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(cm2/s|m2/s)")
    pairs = F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("u"))
    together = F.exists(pairs, lambda p: (p["u"] == F.col("unit")) & near(p["n"].cast("double"), value))
    given = F.lit(True)
    for f in CLAIM_FIELDS:
        given = given & F.col(f).isNotNull()
    checks = [
        ("FIELDS_MISSING", given), ("QUOTE_NOT_IN_PASSAGE", (F.trim(quote) != "") & F.contains("__text", quote)),
        ("OTHER_MATERIAL", (F.col("material_id") == F.col("material")) & F.contains(low, F.lower("material"))),
        ("NOT_SOLID_DIFFUSION", (F.col("parameter") == "solid_diffusion_coefficient") & quote.rlike(r"(?is)solid[ -]?(?:phase|state).*?diffus|固相.*?扩散")),
        ("NOT_CONSTANT", (F.col("applicability") == "constant_full_soc") & quote.rlike(r"(?i)constant|full SOC|恒定|全\s*SOC")),
        ("OTHER_TEMPERATURE", F.abs(kelvin - MODEL_KELVIN) <= KELVIN_OFF), ("TEMPERATURE_NOT_QUOTED", quote.rlike(r"(?i)298\.15\s*K|25\s*(?:°\s*C|℃)")),
        ("METHOD_NOT_QUOTED", (F.col("method") != "") & F.contains(low, F.lower("method"))), ("BAD_VALUE_OR_UNIT", scale.isNotNull() & (value > 0)),
        ("VALUE_NOT_BESIDE_UNIT", together), ("OTHER_VALUE_USED", near(value * scale, F.col("used"))),
    ]
    judged = rows.withColumn("code", F.coalesce(gates.ladder(checks), F.lit("OK")))
    return judged.withColumn("source_hash", F.when(F.col("code") == "OK", F.sha2("__text", 256))).drop("__pid", "__text")


def geometry_hash(geometry: Column) -> Column:
    """SHA-256 over the entries of map<string,double> in order of their names; the same for any order of entries."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(geometry)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null")))), ";"), 256)


def contract_problems(schemes: DataFrame, values: DataFrame, baseline: DataFrame) -> DataFrame:
    """scheme_id, problems array<string> (``path:problem`` in order of the paths) of every scheme (scheme_id, cathode, anode).

    values: scheme_id, path, value (JSON text, null if not given), origin. baseline: material, field, value double. Each path of each component
    needs a row (``no_source``). A missing value is allowed for a radius or a diffusion coefficient of origin ``missing`` without a
    baseline, or of a lithium anode where it does not apply (else ``not_allowed_missing``). Others: ``not_a_number``, ``not_the_baseline``, and
    ``unknown_origin`` (not llm_design, model_baseline or literature; a diffusion coefficient needs one of the latter two)."""
    wanted = schemes.select("scheme_id", "cathode", "anode", F.explode(F.array(*[F.lit(p) for p in PATHS])).alias("path"))
    wanted = wanted.withColumn("__component", F.substring_index("path", ".", 1)).withColumn("__field", F.substring_index("path", ".", -1))
    wanted = wanted.withColumn("__material", F.when(F.col("__component") == "cathode", F.col("cathode")).otherwise(F.col("anode")))
    first = values.groupBy("scheme_id", "path").agg(F.min(F.struct(F.col("origin").isNull().alias("x"), "origin", "value")).alias("v"))
    known = small(baseline.select(F.col("material").alias("__m"), F.col("field").alias("__f"), F.col("value").alias("__base")))
    rows = wanted.join(merged_by_sort(first), ["scheme_id", "path"], "left").join(known, (F.col("__material") == F.col("__m")) & (F.col("__field") == F.col("__f")), "left")
    value, origin = F.col("v.value"), F.col("v.origin")
    number = extraction.strict_number(value)
    optional = F.col("__field").isin("R_s_um", "D_s_m2s")
    lithium = (F.col("__component") == "anode") & (F.col("anode") == "li_metal")
    absent = optional & ((F.col("__base").isNull() & (origin == "missing")) | (F.coalesce(lithium, F.lit(False)) & (origin == "not_applicable")))
    problem = (
        F.when(F.col("v").isNull() | origin.isNull(), "no_source")
        .when(value.isNull(), F.when(F.coalesce(absent, F.lit(False)), None).otherwise("not_allowed_missing"))
        .when(number.isNull(), "not_a_number")
        .when(origin == "model_baseline", F.when(optional & F.coalesce(number == F.col("__base"), F.lit(False)), None).otherwise("not_the_baseline"))
        .when(F.col("__field") == "D_s_m2s", F.when(origin == "literature", None).otherwise("unknown_origin"))
        .when(origin != "llm_design", "unknown_origin")
    )
    place = F.array_position(F.array(*[F.lit(p) for p in PATHS]), F.col("path"))
    found = F.when(problem.isNotNull(), F.struct(place.alias("n"), F.concat(F.col("path"), F.lit(":"), problem).alias("p")))
    return rows.groupBy("scheme_id").agg(F.transform(F.array_sort(F.array_compact(F.collect_list(found))), lambda x: x["p"]).alias("problems"))


def revised(schemes: DataFrame, requests: DataFrame, ranges: dict[str, tuple[float, float]], budget: int = BUDGET) -> DataFrame:
    """scheme_id, revision, geometry map<string,double>, log array<struct<request_id, code>>: the requests of each scheme applied in order.

    schemes: scheme_id, revision int, geometry. requests: request_id, scheme_id, base_revision, base_hash, changes map<string,string> (path to a
    JSON number). A request is applied as a whole or not at all; it has to name the revision and the hash that the scheme has at its turn, so of two
    made on one state the second is stale. Codes in order: STALE, BUDGET_EXHAUSTED, EMPTY, FIELD_UNKNOWN, VALUE_ILLEGAL, OUT_OF_RANGE, OK.
    A request that is there twice counts once; a null request_id comes first. A scheme's requests are folded in its row: BUDGET is small, requests few."""
    kinds = "struct<revision:int,used:int,geometry:map<string,double>,log:array<struct<request_id:bigint,code:string>>>"
    ordered = requests.dropDuplicates(["scheme_id", "request_id"]).groupBy("scheme_id").agg(F.array_sort(F.collect_list(F.struct(F.col("request_id").cast("long").alias("request_id"), F.col("base_revision").cast("int").alias("base_revision"), "base_hash", F.map_entries("changes").alias("changes")))).alias("__requests"))
    rows = schemes.join(merged_by_sort(ordered), "scheme_id", "left")
    paths = F.array(*[F.lit(p) for p in ranges])
    low, high = (F.create_map(*[F.lit(x) for p, r in ranges.items() for x in (p, float(r[i]))]) for i in (0, 1))

    def step(s: Column, r: Column) -> Column:
        numbers = F.transform(r["changes"], lambda c: F.struct(c["key"].alias("key"), extraction.strict_number(c["value"]).alias("value")))
        checks = [
            ("STALE", (r["base_revision"] == s["revision"]) & (r["base_hash"] == geometry_hash(s["geometry"]))), ("BUDGET_EXHAUSTED", s["used"] < budget), ("EMPTY", F.size(r["changes"]) > 0),
            ("FIELD_UNKNOWN", F.forall(r["changes"], lambda c: F.array_contains(paths, c["key"]))), ("VALUE_ILLEGAL", F.forall(numbers, lambda c: c["value"].isNotNull())),
            ("OUT_OF_RANGE", F.forall(numbers, lambda c: c["value"].between(low[c["key"]], high[c["key"]]))),
        ]
        code = F.coalesce(gates.ladder(checks), F.lit("OK"))
        kept = F.map_filter(s["geometry"], lambda k, v: ~F.exists(numbers, lambda c: c["key"] == k))
        done = code == "OK"
        return F.struct(
            F.when(done, s["revision"] + 1).otherwise(s["revision"]).alias("revision"), F.when(done, s["used"] + 1).otherwise(s["used"]).alias("used"),
            F.when(done, F.map_concat(kept, F.map_from_entries(numbers))).otherwise(s["geometry"]).alias("geometry"),
            F.concat(s["log"], F.array(F.struct(r["request_id"].alias("request_id"), code.alias("code")))).alias("log"),
        ).cast(kinds)

    start = F.struct(F.col("revision").cast("int").alias("revision"), F.lit(0).alias("used"), F.col("geometry").alias("geometry"), F.array().cast("array<struct<request_id:bigint,code:string>>").alias("log")).cast(kinds)
    none = F.array().cast(ordered.schema["__requests"].dataType)
    return rows.select("scheme_id", F.aggregate(F.coalesce("__requests", none), start, step).alias("s")).select("scheme_id", "s.revision", "s.geometry", "s.log")
