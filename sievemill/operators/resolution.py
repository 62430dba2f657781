"""Names of materials resolved against a vocabulary: a chain of six ways, in which only what is left goes on.

A formulation's text is resolved as a whole or not at all. Other names are first looked up by a given hint, then without what
describes their treatment; each by an alias, by the given formula, by being a formula, and by the longest alias in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import facts, matching
from .storage import small, stored

#: An alias has to be that long, without marks, to be looked for inside a name.
LEAST_CONTAINED = 3
#: What makes a name the text of a formulation: a concentration, a plus, a percentage, brackets, or ``in`` between words.
FORMULATION = r"[0-9]\s*[Mm]\b|\s\+|[0-9]+\s*%|\(|\)|(?:\s[iI][nN]\s)"


def is_formulation(name: Column) -> Column:
    return name.rlike(FORMULATION)


def indexes(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias_key, id), (formula_key, id) of a vocabulary (id, formula, aliases array<string>, rank): ids are aliases of their own; of
    several ids with one key the first by rank counts, and aliases before formulas of their own column."""
    each = vocabulary.select("id", "rank", F.posexplode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "alias"))
    each = each.filter(F.trim("alias") != "")
    first = lambda keyed, key: keyed.filter(F.length(key) > 0).groupBy(key).agg(F.min_by("id", F.struct("rank", "at", "id")).alias("id"))
    aliases = first(each.withColumn("alias_key", t.key(F.col("alias"))), "alias_key")
    own = vocabulary.select("id", "rank", F.lit(1 << 30).alias("at"), F.col("formula").alias("alias"))
    formulas = first(each.filter("at > 0").select("id", "rank", "at", "alias").unionByName(own).withColumn("formula_key", t.formula_key(F.col("alias"))), "formula_key")
    return aliases, formulas


def resolve_base(rows: DataFrame, text: str, formula: str, vocabulary: DataFrame) -> DataFrame:
    """``rows`` and base_id, method (alias, formula, alias-contains; null if none): of ``text`` with the ``formula`` given beside it.

    The rows should be different; aliases and formulas are equi-joins, and only what they leave is searched for contained aliases."""
    aliases, formulas = indexes(vocabulary)
    keyed = rows.withColumns({"__alias": t.key(F.col(text)), "__given": t.formula_key(F.col(formula)), "__own": t.formula_key(F.col(text))})
    found = keyed.join(small(aliases.select(F.col("alias_key").alias("__alias"), F.col("id").alias("__by_alias"))), "__alias", "left")
    for key in ("__given", "__own"):
        found = found.join(small(formulas.select(F.col("formula_key").alias(key), F.col("id").alias(f"{key}_id"))), key, "left")
    by_formula = F.coalesce("__given_id", "__own_id")
    found = stored(found.withColumns({
        "base_id": F.coalesce("__by_alias", by_formula), "method": F.when(F.col("__by_alias").isNotNull(), "alias").when(by_formula.isNotNull(), "formula"),
    }))
    done = found.filter("base_id is not null")
    left = matching.longest_contained(found.filter("base_id is null"), "__alias", aliases.filter(F.length("alias_key") >= LEAST_CONTAINED).select(F.col("alias_key").alias("name"), "id"))
    left = left.withColumns({"base_id": F.col("hit"), "method": F.when(F.col("hit").isNotNull(), "alias-contains")})
    return done.select(*rows.columns, "base_id", "method").unionByName(left.select(*rows.columns, "base_id", "method"))


def resolved(rows: DataFrame, vocabulary: DataFrame, name: str = "name", formula: str = "formula", hint: str = "hint") -> DataFrame:
    """``rows`` and base_id, variant_id, norm_method: formulation, alias, formula, alias-contains, the last three with ``+hint`` if
    found by the hint, or none. A blank or null name is none. variant_id has the name's modifications, but for one found by the hint.

    Each different (name, formula, hint) is resolved once, whatever its number of rows."""
    asked = rows.select(F.trim(name).alias("__name"), F.col(formula).alias("__formula"), F.nullif(F.trim(hint), F.lit("")).alias("__hint")).distinct()
    asked = stored(asked.filter("__name <> ''").withColumns({"__whole": is_formulation(F.col("__name")), "__mods": facts.modifications(F.col("__name"))}))
    whole = asked.filter("__whole").withColumn("__id", facts.formulation_id(F.col("__name")))
    known = small(vocabulary.select(F.col("id").alias("__id")).distinct())
    mixed = whole.join(known.withColumn("__known", F.lit(True)), "__id", "left").withColumns({
        "base_id": F.when(F.col("__known"), F.col("__id")), "variant_id": F.when(F.col("__known"), F.col("__id")), "norm_method": F.when(F.col("__known"), "formulation").otherwise("none"),
    })
    texts = asked.filter("not __whole").select("__name", "__formula", "__hint", "__mods", F.explode(F.array(F.struct(F.lit(1).alias("turn"), F.col("__hint").alias("text")), F.struct(F.lit(2).alias("turn"), F.col("__mods.base").alias("text")))).alias("q"))
    texts = texts.select("__name", "__formula", "__hint", "__mods", "q.turn", "q.text").filter("text <> ''")
    answers = resolve_base(texts.select("text", F.col("__formula").alias("given")).distinct(), "text", "given", vocabulary).filter("base_id is not null")
    met = texts.join(answers, (F.col("__formula").eqNullSafe(F.col("given"))) & (texts["text"] == answers["text"])).select("__name", "__formula", "__hint", "turn", "base_id", "method")
    best = met.groupBy("__name", "__formula", "__hint").agg(F.min_by(F.struct("turn", "base_id", "method"), "turn").alias("a"))
    same = lambda b: F.col("__name").eqNullSafe(b["n"]) & F.col("__formula").eqNullSafe(b["f"]) & F.col("__hint").eqNullSafe(b["h"])
    best = best.select(F.col("__name").alias("n"), F.col("__formula").alias("f"), F.col("__hint").alias("h"), "a")
    plain = asked.filter("not __whole").join(best, same(best), "left").withColumns({
        "base_id": F.col("a.base_id"), "variant_id": F.when(F.col("a.turn") == 1, F.col("a.base_id")).when(F.col("a").isNotNull(), facts.variant_id(F.col("a.base_id"), F.col("__mods"))),
        "norm_method": F.when(F.col("a").isNull(), "none").otherwise(F.concat(F.col("a.method"), F.when(F.col("a.turn") == 1, "+hint").otherwise(""))),
    })
    answer = mixed.select("__name", "__formula", "__hint", "base_id", "variant_id", "norm_method").unionByName(plain.select("__name", "__formula", "__hint", "base_id", "variant_id", "norm_method"))
    answer = answer.withColumnsRenamed({"__name": "__n", "__formula": "__f", "__hint": "__h"})
    on = F.trim(F.col(name)).eqNullSafe(F.col("__n")) & F.col(formula).eqNullSafe(F.col("__f")) & F.nullif(F.trim(F.col(hint)), F.lit("")).eqNullSafe(F.col("__h"))
    kept = rows.drop("base_id", "variant_id", "norm_method")
    return kept.join(small(answer), on, "left").select(*kept.columns, "base_id", "variant_id", F.coalesce("norm_method", F.lit("none")).alias("norm_method"))


def unresolved(rows: DataFrame, name: str = "name", formula: str = "formula") -> DataFrame:
    """name, formula, n long: what ``resolved`` left, each once with its number of rows; the queue that registration works off."""
    return rows.filter((F.col("norm_method") == "none") & (F.trim(name) != "")).groupBy(F.trim(name).alias("name"), F.col(formula).alias("formula")).agg(F.count("*").alias("n"))
