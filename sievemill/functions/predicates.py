"""Row predicates over lines, paragraphs and numeric claims: Column -> boolean Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_reference_line(line: Column) -> Column:
    """A numbered line with a year of this century or a mark of a journal."""
    numbered = line.rlike(r"^(?:\[[0-9]+\]|\([0-9]+\)|[0-9]+\.|[0-9]+\))\s")
    return numbered & (line.rlike("20[0-9]{2}") | contains_any(line, vocab.JOURNALS))


def is_chart_line(line: Column) -> Column:
    low, out = F.lower(line), F.lit(False)
    for start in vocab.CHART_STARTS:
        out = out | F.startswith(low, F.lit(start))
    return out | low.rlike(r"^`{3,}\s*(?:mermaid|flowchart)\b")


def noise_rule(line: Column, extract: bool = True) -> Column:
    """Name of the first rule that makes a line noise, null if none does."""
    s = F.trim(line)
    low = F.lower(s)
    return (
        F.when(F.startswith(s, F.lit("<!--")) & F.endswith(s, F.lit("-->")), "comment")
        .when(contains_any(low, vocab.NOISE + (vocab.NOISE_IN_EXTRACTS if extract else [])), "keyword")
        .when(s.rlike(r"^\(?[a-zA-Z][0-9]?\)?$"), "letter")
        .when(low.rlike(r"^(?:fig\.?|figure|tab\.?|table|scheme)\s*"), "caption")
        .when(s.rlike(r"^!\[.*\]\(.*\)$"), "image")
        .when(s.rlike(r"^[\s|:-]+$"), "rule")
        .when(s.rlike(r"^https?://"), "url")
        .when(low.rlike(r"^(?:received|revised|accepted|published)\s*:"), "date")
        .when(s.rlike(r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"), "mail")
        .when(is_reference_line(s), "reference")
        .when(low.rlike(r"^\s*</?(?:details|summary)>\s*$"), "details")
        .when(is_chart_line(s), "chart")
    )


def is_noise(line: Column, extract: bool = True) -> Column:
    return noise_rule(line, extract).isNotNull()


def is_caption(line: Column) -> Column:
    """A figure, table or scheme caption."""
    return F.lower(F.trim(line)).rlike(r"^(?:fig\.?|figure|tab\.?|table|scheme)\s*[s]?[0-9]+")


def is_address(line: Column) -> Column:
    """A short line that names an institution."""
    low = F.lower(line)
    return (F.length(line) <= 80) & contains_any(low, ["university", "institute", "department", "laboratory", "college", "school of"])


def is_table_line(line: Column) -> Column:
    """A row of a table in HTML or with three bars or more."""
    return contains_any(F.lower(line), ["</table>", "<td>", "<tr>", "<th>", "<tbody>", "<thead>"]) | (F.regexp_count(line, F.lit("\\|")) >= 3)


def is_reference_text(text: Column) -> Column:
    return text.rlike(r"^[0-9]+\.\s+[A-Z]|^\[[0-9]+\]\s")


def is_absent(value: Column) -> Column:
    """Null, blank, or zero as text: what counts as no value."""
    s = F.trim(value.cast("string"))
    return F.coalesce((s == "") | s.rlike(r"^[-+]?(?:0+\.?0*|\.0+)(?:[eE][-+]?[0-9]+)?$"), F.lit(True))


def has_core_value(json: Column) -> Column:
    """Whether a JSON value holds something: its ``value`` if it is an object, any item that is not empty if a
    list, a text that is not blank; numbers and booleans always do."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    core = F.get_json_object(json, "$.value")
    items = F.from_json(json, "array<string>")
    return F.coalesce(
        F.when(F.trim(json).rlike(r"^\{"), F.coalesce(~core.isin("", "{}", "[]"), F.lit(False)))
        .when(F.trim(json).rlike(r"^\["), F.exists(items, lambda x: x.isNotNull() & (x != "")))
        .when(kind == "VOID", F.lit(False))
        .otherwise(F.trim(F.translate(json, '"', "")) != ""),
        F.lit(False),
    )


def claim_without_condition(text: Column) -> Column:
    """A number in mAh/g, Wh/kg or percent, and no word of a test condition anywhere."""
    number = text.rlike(r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:mAh/g|mAh g|Wh/kg|Wh kg|%)")
    condition = text.rlike(r"(?i)[0-9]+(?:\.[0-9]+)?\s*C\b|°C|温度|[0-9]+(?:\.[0-9]+)?\s*V\b|cycle|循环|倍率|rate|窗口")
    return number & ~condition


def has_number_with_unit(text: Column) -> Column:
    return text.rlike(r"[0-9]\s*[mnckKA°VCΩSgW%]")


def has_word(text: Column, word: str) -> Column:
    """Short ASCII words stand alone, others anywhere; without regard to case."""
    low, w = F.lower(text), word.lower()
    if len(w) <= 2 and w.isascii():
        return low.rlike(rf"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)")
    return F.contains(low, F.lit(w))


def is_seed_sentence(text: Column) -> Column:
    """30 to 600 characters, not a caption, no digit first."""
    return F.length(text).between(30, 600) & ~text.rlike(r"(?:Figure|Table|Fig\.)") & ~text.rlike(r"^[0-9]")


#: The paragraph ladder: (rule, most characters or none, pattern), in order; the first that fits counts. The patterns have no
#: look-around, so that other engines run them too.
PARAGRAPH_LADDER: list[tuple[str, int | None, str]] = [
    ("caption", None, r"^(?i:fig(?:ure)?|tab(?:le)?|scheme)\.?\s*[Ss]?[0-9]+"),
    ("heading", None, r"^#{1,6}\s"),
    ("section", 120, r"^[0-9]+(?:\.[0-9]+)+\.?\s+[A-Z]"),
    ("comment", None, r"^<!--"),
    ("image", None, r"^!\[[^\]]*\]\([^)]*\)\s*$"),
    ("citation", None, r"^(?i:cite this|how to cite)"),
    ("doi", 200, r"(?i:https?://(?:dx\.)?doi\.org/|orcid\.org|doi\s*:\s*10\.)"),
    ("references", 5000, r"(?:\[[0-9]+\][^\[]{10,200}(?:19|20)[0-9]{2}[^\[]*){3,}"),
    ("address", 120, r"(?i:university|institute of|department of|laboratory|academy of sciences)"),
    ("numbers", 60, r"^[0-9\s.,%()\-]+$"),
    ("mail", 120, r"@[a-zA-Z0-9.-]+\.(?:com|org|edu|gov|cn|net)"),
    ("authors", 250, r"^(?:[A-Z][a-z]+(?:-[A-Z][a-z]+)?\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]+[0-9*†,\s]*(?:and\s+)?){3,}$"),
    ("initials", 150, r"^(?:[A-Z]\.\s+[A-Z][a-z]+(?:-[A-Z][a-z]+)?,?\s*){3,}$"),
    ("supplement", 100, r"(?i:supplementary|supporting)\s+(?i:information)"),
    ("dates", 200, r"^\s*(?i:received|revised|accepted|published)\s*(?i:online)?\s*:"),
    ("keywords", None, r"^(?:Keywords|关键词)\s*[:：]"),
    ("abstract", None, r"^(?:摘[\s　]*要|提要)\s*[:：]?"),
    ("fragment", 20, r"^[^a-zA-Z\x{4e00}-\x{9fff}]*$"),
]


def paragraph_rule(text: Column) -> Column:
    """Name of the first rule of the ladder that makes a paragraph noise; ``blank`` for none at all; null if it stays."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = F.when(s == "", "blank")
    for name, most, pattern in PARAGRAPH_LADDER:
        fits = s.rlike(pattern)
        out = out.when(fits if most is None else fits & (F.length(s) < most), name)
    return out
