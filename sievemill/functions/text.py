"""Scalar text functions: Column -> Column, built-in expressions only.

Patterns without look-around are kept where the same pattern has to run in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: A word with digits and points, a number with its unit, or one CJK character.
TOKEN = "[a-zA-Z]+(?:[0-9.][a-zA-Z]*)*|[0-9]+(?:[.][0-9]+)?(?:[a-zA-Z/%°℃²³⁺⁻]+)?|[\u4e00-\u9fff]"
CJK = "[\u4e00-\u9fff]"


def tokens(text: Column) -> Column:
    """Mixed-language tokens; those of ASCII only are lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(t))


def source_path(path: Column) -> Column:
    """Forward slashes, and nothing before the first ``database/`` or ``papers/``."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(F.nullif(F.regexp_substr(forward, F.lit("(?:database|papers)/.*$")), F.lit("")), forward)


def plain_latex(text: Column) -> Column:
    """LaTeX without dollars, commands, sub- and superscript marks."""
    out = F.regexp_replace(text, r"\$", "")
    out = F.regexp_replace(out, r"\\(?:mathrm|text|mathbf|mathit|rm)\{([^}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[_{}|^]", ""), r"\s+", " "))


def estimated_tokens(text: Column) -> Column:
    """0.6 a CJK character and 0.3 any other, whole part, at least 1; 0 for an empty text."""
    zh = F.regexp_count(text, F.lit(CJK))
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(zh * 0.6 + (F.length(text) - zh) * 0.3).cast("int"))).otherwise(0)


def is_zh(text: Column, share: float = 0.05) -> Column:
    """True if at least ``share`` of the characters are CJK."""
    return F.coalesce(F.regexp_count(text, F.lit(CJK)) / F.nullif(F.length(text), F.lit(0)) >= share, F.lit(False))


def without_links(text: Column) -> Column:
    """No URLs, no runs of two or more single letters, no tokens like ``(a)``."""
    out = F.regexp_replace(text, r"https?://[^\s]+", "")
    out = F.regexp_replace(out, r"(?i)(?:^|\s)(?:[a-z]\.?\s){2,}", " ")
    words = F.filter(F.split(out, r"\s+"), lambda w: (w != "") & ~w.rlike(r"(?i)^\([a-z]\)[.,]?$"))
    return F.array_join(words, " ")


def clean_paragraph(text: Column) -> Column:
    """Text of one paragraph without tags and most punctuation, split numbers joined again."""
    out = F.regexp_replace(text, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"[^\w\s:/.\-,#%]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"([0-9])\s*\.\s*([0-9])", "$1.$2"), r"\s+", " ")
    return F.trim(out)


def joined_digits(text: Column) -> Column:
    """``1 0 0 0`` as ``1000`` (single digits between single spaces), ``2 . 9 4`` as ``2.94``."""
    point = F.regexp_replace(text, r"([0-9])\s*\.\s*([0-9])", "$1.$2")
    return F.regexp_replace(point, r"(?<=\b[0-9]) (?=[0-9]\b)", "")


def key(text: Column) -> Column:
    """Lower case without white space, hyphens, underscores, slashes, points and commas."""
    return F.lower(F.regexp_replace(text, r"[\s\-_/.,]", ""))


def bare(text: Column) -> Column:
    """Lower case without white space and punctuation, that of CJK text included."""
    return F.lower(F.regexp_replace(text, r"[\s!-/:-@\[-`{-~，。；：、（）《》“”‘’？！【】·—…]", ""))


def doi_name(doi: Column) -> Column:
    """A DOI as a file name: no slashes, no punctuation at the end."""
    return F.replace(F.regexp_replace(doi, r"[.,;:)\]}>]+$", ""), F.lit("/"), F.lit("_"))


def name_doi(name: Column) -> Column:
    """The DOI that a file name stands for, null if it is none."""
    doi = F.replace(F.regexp_replace(name, r"\.md$", ""), F.lit("_"), F.lit("/"))
    return F.when(doi.rlike(r"^10\.[0-9]{4,}/[a-zA-Z0-9._()/%\-]+$"), doi)


def without_valence(text: Column) -> Column:
    """``Ni2+`` forms (superscripts, ``^4+``, ``<sup>``) as the element; subscripts as digits."""
    out = F.regexp_replace(text, r"<sup>[^<]*</sup>", "")
    out = F.regexp_replace(out, r"\^\{?[0-9]*[+\-]\}?", "")
    out = F.regexp_replace(out, r"[⁰¹²³⁴⁵⁶⁷⁸⁹]*[⁺⁻]", "")
    return F.translate(out, "₀₁₂₃₄₅₆₇₈₉", "0123456789")


_ELEMENT = "([A-Z][a-z]?)([0-9]*\\.?[0-9]*)"


def formula_counts(formula: Column) -> Column:
    """Element counts of a chemical formula as a map, repeated elements summed; null unless
    elements and numbers make up all of it."""
    text = F.trim(formula)
    names, counts = (F.regexp_extract_all(text, F.lit(_ELEMENT), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(names, counts, lambda n, c: F.struct(n.alias("n"), F.when(c == "", F.lit(1.0)).otherwise(c.try_cast("double")).alias("c")))
    whole = F.array_join(F.zip_with(names, counts, lambda n, c: F.concat(n, c)), "") == text
    known = F.forall(names, lambda n: F.array_contains(F.array(*[F.lit(e) for e in vocab.ELEMENTS]), n))
    summed = F.transform(F.array_distinct(names), lambda n: F.struct(n, F.aggregate(F.filter(pairs, lambda p: p["n"] == n), F.lit(0.0), lambda a, p: a + p["c"])))
    return F.when(whole & known & (F.size(names) > 0), F.map_from_entries(summed))


def short_number(x: Column) -> Column:
    """A double in its shortest form, without a needless ``.0``."""
    return F.regexp_replace(F.round(x, 6).cast("string"), r"\.0$", "")


def formula_key(formula: Column) -> Column:
    """Elements in order with their counts: equal for formulas of one composition."""
    entries = F.array_sort(F.map_entries(formula_counts(formula)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], short_number(e["value"]))), "")


def number_in(text: Column) -> Column:
    """The first number of a text: ``a×10^b``, else ``10^b``, else a plain number; null if none."""
    s = F.replace(text, F.lit(","), F.lit(""))
    get = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    sci = r"([-+]?[0-9]*\.?[0-9]+)\s*[×x*]\s*10\s*\^\s*\{?([-+]?[0-9]+)\}?"
    power = r"10\s*\^\s*\{?([-+]?[0-9]+)\}?"
    base, exponent = get(sci, 1).cast("double"), get(sci, 2).cast("double")
    return F.coalesce(base * F.pow(F.lit(10.0), exponent), F.pow(F.lit(10.0), get(power, 1).cast("double")), get(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).cast("double"))


def superscript_number(text: Column) -> Column:
    """``5.1×10⁻⁷`` and the like as a double, null if the text holds no number."""
    plain = F.translate(text, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
    return number_in(F.regexp_replace(plain, r"([×x*]\s*10)\^?([-+]?[0-9]+)", "$1^$2"))


def loose_number(text: Column) -> Column:
    """A number with commas or a percent sign, null for anything else."""
    return F.translate(F.trim(text), ",%", "").try_cast("double")


_SOLUTION = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*M?\s*([A-Za-z][A-Za-z0-9]*)\s+in\s+([^()]+?)\s*(?:\(([^)]*)\))?\s*$"


def electrolyte(text: Column) -> Column:
    """One form for a salt solution: concentration, salt in lower case, sorted solvents and ratio;
    anything else in lower case with single spaces."""
    part = lambda g: F.regexp_extract(text, _SOLUTION, g)
    solvents = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(part(3), "[/:,，、-]"), lambda x: F.trim(x)), lambda s: s != "")))
    ratio = F.regexp_replace(F.regexp_replace(F.lower(part(4)), r"\s+", ""), "(?:vol%|v/v|wt%|wt|体积比|质量比)", "")
    form = F.concat(part(1), F.lit("M "), F.lower(part(2)), F.lit(" in "), F.array_join(solvents, "/"), F.when(ratio != "", F.concat(F.lit("("), ratio, F.lit(")"))).otherwise(""))
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"([0-9])\s+m\b", "$1m")
    return F.when(text.rlike(_SOLUTION), form).otherwise(F.coalesce(plain, F.lit("")))


def without_thinking(text: Column) -> Column:
    """A model's answer without its ``<think>`` blocks."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def json_in(text: Column) -> Column:
    """The outermost JSON object or array of a fenced or chatty answer, null if there is none."""
    bare_text = F.regexp_replace(text, r"(?s)```(?:json)?", "")
    return F.nullif(F.trim(F.regexp_extract(bare_text, r"(?s)(\{.*\}|\[.*\])", 1)), F.lit(""))


def page_range(name: Column) -> Column:
    """struct<first, last> of names like ``x_p0001-0040.md``, null for others. Pages from 10,000 on have more than four digits, as who writes
    the names pads them to four and cuts none; a number beyond an int is null."""
    pattern = r"_p([0-9]{4,})-([0-9]{4,})\.md$"
    return F.when(name.rlike(pattern), F.struct(*[F.regexp_extract(name, pattern, i).try_cast("int").alias(c) for i, c in ((1, "first"), (2, "last"))]))


def short_label(label: Column) -> Column:
    """A label without parentheses, what follows a colon, and a last number with unit."""
    out = F.regexp_replace(F.regexp_replace(label, r"\([^)]*\)", ""), r"[:：].*$", "")
    return F.trim(F.regexp_replace(out, r"\s+[-+]?[0-9.]+\s*[A-Za-z%°/]*\s*$", ""))


def source_display(title: Column, doi: Column) -> Column:
    """``title (DOI: doi)``."""
    return F.concat(title, F.lit(" (DOI: "), doi, F.lit(")"))


def electrode_config(text: Column) -> Column:
    """The canonical name of an electrode configuration."""
    low = F.lower(F.trim(text))
    out = F.when(low == "", F.lit(None).cast("string"))
    for name, canonical in vocab.ELECTRODE_CONFIGS:
        out = out.when(low == name, canonical)
    return out.when(F.endswith(low, F.lit("half cell")) | F.endswith(low, F.lit("half-cell")), "half-cell").when(F.endswith(low, F.lit("full cell")) | F.endswith(low, F.lit("full-cell")), "full-cell").otherwise(F.trim(text))


def is_supplement_name(name: Column) -> Column:
    """Whether a file name says that it is supplementary information."""
    low, out = F.lower(name), F.lit(False)
    for part in vocab.SUPPLEMENT_NAMES:
        out = out | F.contains(low, F.lit(part))
    return out


def additive_name(name: Column) -> Column:
    """An additive as it is written, others as they are."""
    out = None
    for low, shown in vocab.ADDITIVES:
        hit = F.lower(F.trim(name)) == low
        out = F.when(hit, shown) if out is None else out.when(hit, shown)
    return out.otherwise(F.trim(name))


def one_line_math(text: Column) -> Column:
    """``$$`` blocks on one line, no images, a blank line before each pipe table."""
    parts = F.split(text, r"\$\$", -1)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.trim(F.regexp_replace(x, r"\s+", " "))).otherwise(x)), "$$")
    plain = F.regexp_replace(F.regexp_replace(joined, r"!\[([^\]]*)\]\([^)]+\)", "$1"), r"(?i)<img[^>]+>", "")
    return F.regexp_replace(plain, r"(\|[^\n]+\|)[ \t]*\n[ \t]*(\|[-\s|]+\|)", "\n\n$1\n$2")


def term_pattern(term: str) -> str:
    """A pattern for a term that does not match inside longer words; some terms may go on."""
    edge = lambda c: c.isascii() and c.isalnum()
    after = {"ncm": "(?![A-Za-z])", "celgard": "(?![A-Za-z])", "li1.2": "(?![0-9])", "separator": "", "current collector": ""}.get(term.lower(), "(?![A-Za-z0-9])" if edge(term[-1]) else "")
    return "(?i)" + ("(?<![A-Za-z0-9])" if edge(term[0]) else "") + "\\Q" + term + "\\E" + after


def filled(template: str, values: dict[str, Column]) -> Column:
    """A text with ``{NAME}`` replaced by columns."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v.cast("string"))
    return out
