"""Quality gates: one row (gate, passed, code, observed) for each assertion over a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, name: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """checks: (code of the failure, aggregate condition), in order. One row: the first that fails, or code OK."""
    code = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks], F.lit("OK"))
    out = rows.agg(F.count("*").alias("observed"), code.alias("code"))
    return out.select(F.lit(name).alias("gate"), (F.col("code") == "OK").alias("passed"), "code", "observed")


def ingestion(documents: DataFrame, component: str, text: str, required: list[str], least: int = 50) -> DataFrame:
    """Documents of every component, none shorter than ``least``."""
    present = F.collect_set(component)
    return gate(documents, "ingestion", [("NO_DOCUMENTS", F.count("*") > 0), ("COMPONENT_MISSING", F.size(F.array_except(F.array(*[F.lit(c) for c in required]), present)) == 0), ("CORRUPT_DOCUMENTS", F.count_if(F.length(text) < least) == 0)])


def index(passages: DataFrame, passage_id: str, label: str, labels: list[str]) -> DataFrame:
    """Passages with ids of their own and known labels."""
    return gate(passages, "index", [("EMPTY_INDEX", F.count("*") > 0), ("DUPLICATE_IDS", F.countDistinct(passage_id) == F.count("*")), ("UNKNOWN_LABELS", F.count_if(~F.col(label).isin(*labels)) == 0)])


def physics(rounds: DataFrame, energy: str, voltage: str, most: float = 2000.0) -> DataFrame:
    """Simulated rounds within physical bounds."""
    return gate(rounds, "physics", [("NO_ROUNDS", F.count("*") > 0), ("ENERGY_OUT_OF_BOUNDS", F.count_if(~F.col(energy).between(0, most)) == 0), ("VOLTAGE_OUT_OF_BOUNDS", F.count_if(~F.col(voltage).between(1.0, 5.5)) == 0)])


def all_passed(gates: list[DataFrame]) -> DataFrame:
    """The gates' rows, and whether each stands behind none that failed."""
    from pyspark.sql import Window

    numbered = [g.withColumn("step", F.lit(i)) for i, g in enumerate(gates)]
    rows = reduce(DataFrame.unionByName, numbered)
    return rows.withColumn("reached", F.coalesce(F.min(F.col("passed").cast("int")).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)) == 1)


def ladder(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first condition that does not hold (a null one does not), null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks], F.lit(None).cast("string"))


def row_gate(rows: DataFrame, name: str, key: str, checks: list[tuple[str, Column]], table_checks: list[tuple[str, Column]] | None = None, notes: Column | None = None) -> DataFrame:
    """One row: gate, passed, code, observed long, failing long, evidence array<struct<code, rows, first, notes>>, in one pass over ``rows``.

    checks: conditions that every row has to meet, in order; a row fails by the first that it does not. table_checks: aggregate conditions of
    the whole table, which come first. code: the first of all of them that fails, OK without any. evidence: for each code that rows
    fail by, how many do, the least ``key`` among them as text and its ``notes``."""
    notes = F.lit(None).cast("string") if notes is None else notes
    judged = rows.select("*", ladder(checks).alias("__code"), F.col(key).cast("string").alias("__key"), notes.alias("__notes"))
    # an id can be missing: such rows come first by their notes
    first = lambda k: F.min(F.when(F.col("__code") == k, F.struct(F.coalesce("__key", F.lit("")).alias("key"), F.coalesce("__notes", F.lit("")).alias("notes"))))
    found = judged.agg(
        F.count("*").alias("observed"), F.count("__code").alias("failing"), ladder(table_checks or [("OK", F.lit(True))]).alias("__table"),
        *[F.count_if(F.col("__code") == k).alias(f"__n{i}") for i, (k, _) in enumerate(checks)], *[first(k).alias(f"__first{i}") for i, (k, _) in enumerate(checks)],
    )
    evidence = [F.when(F.col(f"__n{i}") > 0, F.struct(F.lit(k).alias("code"), F.col(f"__n{i}").alias("rows"), F.col(f"__first{i}.key").alias("first"), F.col(f"__first{i}.notes").alias("notes"))) for i, (k, _) in enumerate(checks)]
    code = F.coalesce("__table", *[F.when(F.col(f"__n{i}") > 0, F.lit(k)) for i, (k, _) in enumerate(checks)], F.lit("OK"))
    return found.select(F.lit(name).alias("gate"), (code == "OK").alias("passed"), code.alias("code"), "observed", "failing", F.array_compact(F.array(*evidence)).alias("evidence"))


def _given(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0


# What an assembled cell has to have, and the sections of a design and of a report by words in their headings.
CELL_FIELDS = ["cell_id", "cathode", "anode", "electrolyte", "provenance"]
REPORT_SECTIONS = [
    ("研发摘要", ["研发摘要", "执行摘要", "总体概览", "summary"]),
    ("文献与电芯数据概况", ["文献", "数据概况", "电芯挖掘", "literature", "mining", "stage journal", "阶段履历"]),
    ("电池体系设计方案", ["体系设计方案", "设计方案", "正极", "负极", "电解液", "design", "方案"]),
    ("物理仿真与验证", ["仿真与优化分析", "物理仿真", "pinn", "pybamm", "仿真验证", "跳过说明", "simulation", "物理"]),
    ("实验配方与落地建议", ["实验路线与验证计划", "实验配方", "落地建议", "制备工艺", "研发路线", "recipe", "roadmap", "后续建议", "结论"]),
]
DESIGN_SECTIONS = [
    ("目标与设计路线", ["目标", "设计路线", "能量目标", "target", "路线"]),
    ("推荐组合", ["推荐材料组合", "推荐组合", "正极", "负极", "电解液", "combination", "配方"]),
    ("预期关键指标", ["预期指标", "关键指标", "能量密度", "比容量", "metrics", "性能指标"]),
    ("可行性依据", ["可行性依据", "文献证据", "机理支撑", "feasibility", "evidence", "依据"]),
    ("风险与数据缺口", ["风险与数据缺口", "风险分析", "数据缺口", "risks", "gaps", "风险评估"]),
]


def missing_sections(text: Column, sections: list[tuple[str, list[str]]]) -> Column:
    """array<string>: the sections of which no heading (of one to four marks) of a markdown text has a word, nor any bold line of one."""
    headings = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,4}[ \t]+(.+)$"), F.lit(1)), "\n"))

    def lacks(words: list[str]) -> Column:
        bold = text.rlike(r"(?i)\*\*\s*[0-9]?\.?\s*(?:" + "|".join(words) + r")\s*\*\*")
        return ~(reduce(lambda a, b: a | b, [F.contains(headings, F.lit(w.lower())) for w in words]) | bold)

    return F.array_compact(F.array(*[F.when(F.coalesce(lacks(words), F.lit(True)), F.lit(name)) for name, words in sections]))


def cell_assembly(materials: DataFrame, cells: DataFrame) -> DataFrame:
    """Gate of the cells (cell_id, cathode, anode, electrolyte, provenance) assembled of materials (material_id): there are some of both,
    materials have ids, every cell has all of its fields, no cell_id comes twice, and each component is one of the materials."""
    known = materials.filter(_given("material_id")).select(F.col("material_id").cast("string").alias("__part")).distinct()
    components = [c for c in CELL_FIELDS if c in ("cathode", "anode", "electrolyte")]
    keyed = cells.select(F.xxhash64(*CELL_FIELDS).alias("__row"), *[F.col(c).cast("string").alias(c) for c in CELL_FIELDS])
    parts = keyed.select("__row", F.explode(F.array_distinct(F.array(*components))).alias("__part")).filter(F.length(F.trim("__part")) > 0)
    dangling = parts.distinct().join(known, "__part", "left_anti").groupBy("__row").agg(F.min("__part").alias("__dangling"))
    twice = keyed.filter(_given("cell_id")).groupBy("cell_id").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("cell_id").alias("__id"), F.lit(True).alias("__twice"))
    checked = keyed.join(dangling, "__row", "left").join(twice, F.col("cell_id") == F.col("__id"), "left")
    lacking = F.array_join(F.array_compact(F.array(*[F.when(~_given(c), F.lit(c)) for c in CELL_FIELDS])), ",")
    out = row_gate(
        checked, "cell_assembly", "cell_id", [("CELL_SPEC_INCOMPLETE", lacking == ""), ("CELL_ID_REPEATED", F.col("__twice").isNull()), ("UNKNOWN_COMPONENT", F.col("__dangling").isNull())],
        [("NO_CELLS_ASSEMBLED", F.count("*") > 0)], F.when(lacking != "", lacking).otherwise(F.col("__dangling")),
    )
    totals = materials.agg(F.count("*").alias("__materials"), F.count_if(_given("material_id")).alias("__with_id"))
    code = F.when(F.col("__materials") == 0, "NO_MATERIALS_EXTRACTED").when(F.col("code").isin("NO_CELLS_ASSEMBLED", "CELL_SPEC_INCOMPLETE"), F.col("code")).when(F.col("__with_id") == 0, "MISSING_NORMALIZED_IDS").otherwise(F.col("code"))
    return out.crossJoin(totals).withColumn("code", code).withColumn("passed", F.col("code") == "OK").drop("__materials", "__with_id")  # one row each


def design(judged: DataFrame, evidence: DataFrame, least: int = 200) -> DataFrame:
    """Gate of design schemes: (scheme_id, markdown, cathode, anode, electrolyte, reviewed boolean, and of ``schemes.evaluated`` feasible)
    with their evidence (scheme_id, is_evidence, is_foreign as ``labels.foreign_evidence`` gives them)."""
    found = evidence.groupBy("scheme_id").agg(F.count_if("is_evidence").alias("__valid"), F.count_if(F.col("is_evidence") & ~F.col("is_foreign")).alias("__relevant"))
    rows = judged.join(found, "scheme_id", "left")
    text = F.coalesce("markdown", F.lit(""))
    missing = F.array_join(missing_sections(text, DESIGN_SECTIONS), ",")
    valid, relevant = F.coalesce("__valid", F.lit(0)), F.coalesce("__relevant", F.lit(0))
    return row_gate(
        rows, "design", "scheme_id",
        [("DESIGN_SCHEME_MD_TOO_SHORT", F.length(F.trim(text)) >= least), ("DESIGN_SCHEME_SECTIONS_INCOMPLETE", missing == ""), ("EVIDENCE_MISSING", valid > 0), ("EVIDENCE_CHEMISTRY_MISMATCH", relevant > 0),
         ("REVIEWER_RESPONSE_FAILED", F.coalesce("reviewed", F.lit(True))), ("STRUCTURED_SCHEME_INCOMPLETE", _given("cathode") & _given("anode") & _given("electrolyte")), ("RELATION_ENGINE_VIOLATION", F.col("feasible"))],
        [("DESIGN_SCHEME_FILE_MISSING", F.count("*") > 0)], F.nullif(missing, F.lit("")),
    )


def report(reports: DataFrame, stages: DataFrame, journals: DataFrame, needed: int = 5, least: int = 400) -> DataFrame:
    """Gate of final reports (goal, markdown): their goal's stages (goal, stage int, status, allow_skip, skip) up to ``needed`` are all there and passed,
    skipped where that is allowed, or the last of them a fallback; the text is long enough and has its sections; the goal has
    journal entries (goal, delivers_simulation boolean, has_simulation boolean), none of which claims a simulation that is not there."""
    done = (F.col("status") == "PASSED") | ((F.col("status") == "SKIPPED") & F.col("allow_skip") & F.col("skip")) | ((F.col("stage") == needed) & (F.col("status") == "FALLBACK"))
    passed = stages.filter(F.col("stage").between(1, needed) & done).groupBy("goal").agg(F.countDistinct("stage").alias("__passed"))
    false_claim = F.coalesce(F.col("delivers_simulation") & ~F.col("has_simulation"), F.lit(False))
    entries = journals.groupBy("goal").agg(F.count("*").alias("__entries"), F.count_if(false_claim).alias("__claims"))
    rows = reports.join(passed, "goal", "left").join(entries, "goal", "left")
    text = F.coalesce("markdown", F.lit(""))
    missing = F.array_join(missing_sections(text, REPORT_SECTIONS), ",")
    return row_gate(
        rows, "report", "goal",
        [("REPORT_PREREQUISITES_INCOMPLETE", F.col("__passed") == needed), ("SYNTHESIS_REPORT_MISSING", F.col("markdown").isNotNull()), ("SYNTHESIS_REPORT_TOO_SHORT", F.length(F.trim(text)) >= least),
         ("SYNTHESIS_REPORT_SECTIONS_INCOMPLETE", missing == ""), ("STAGE_JOURNAL_MISSING", F.col("__entries") > 0), ("STAGE_JOURNAL_PINN_MISMATCH", F.coalesce("__claims", F.lit(0)) == 0)],
        [("SYNTHESIS_REPORT_MISSING", F.count("*") > 0)], F.nullif(missing, F.lit("")),
    )
