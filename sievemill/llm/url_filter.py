"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the
URLs that no rule fits. DataFrame functions and the JVM's tree learner only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_rows, stored

#: Different labelled URLs that the trees are fitted on at most (the first by a hash of the URL).
FIT_ROWS = 20_000
#: Host suffixes up to which their rates are broadcast.
BROADCAST_SUFFIXES = 50_000
#: Labels that a suffix needs to outweigh the mean rate.
SMOOTHING = 10.0
#: Parts of the labelled URLs; the trees are fitted on rates of the other parts, which do not know a URL's own label.
FOLDS = 5
#: Rules up to which they stand in the expression itself; more are joined.
INLINE_RULES = 256
TREES, DEPTH, SEED = 15, 4, 42

_FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_labels", "f_hyphens", "f_fragment", "f_scheme", "f_last", "f_last2"]

Rule = tuple[str, str, str]  # verdict, host, path


def _part(url: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(_part(url, 1), upper, upper.lower())


def path_of(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return _part(url, 2)


def _fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; of equally long ones the one with
    the longer host, then the first by text and verdict. Null if none fits."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    out = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rules(urls: DataFrame, rules: Sequence[Rule], url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` with url_host, url_path and url_rule struct<rule, verdict>."""
    out = urls.drop("url_host", "url_path", "url_rule").withColumns({"url_host": host_of(url), "url_path": path_of(url)})
    if len(set(rules)) <= inline:
        return out.withColumn("url_rule", _fitting(rules, F.col("url_host"), F.col("url_path")))
    table = urls.sparkSession.createDataFrame(sorted(set(rules)), "verdict string, rule_host string, rule_path string")
    labels = F.split("url_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = out.select("url_host", "url_path").distinct().withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").filter(F.startswith("url_path", "rule_path"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"))
    first = F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict")), F.struct(-rank["col1"], -rank["col2"], F.concat("rule_host", "rule_path"), F.col("verdict")))
    best = each.groupBy("url_host", "url_path").agg(first.alias("url_rule"))
    return out.join(best, ["url_host", "url_path"], "left").select(*[F.col(f"`{c}`") for c in out.columns], "url_rule")


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Lexical features of each URL; a null one is read as empty. Needs url_host and url_path."""
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("url_host"), F.col("url_path")
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / F.greatest(size, F.lit(1))
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    last2 = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return urls.withColumns({
        "f_length": size.cast("double"),
        "f_host": F.length(host).cast("double"),
        "f_path": F.length(path).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "f_digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(size, F.lit(1)),
        "f_entropy": F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "f_labels": F.size(labels).cast("double"),
        "f_hyphens": F.length(F.regexp_replace(host, "[^-]", "")).cast("double"),
        "f_fragment": F.contains(text, F.lit("#")).cast("double"),
        "f_scheme": F.startswith(text, F.lit("https")).cast("double"),
        "f_suffix": F.element_at(labels, -1),
        "f_suffix2": last2,
    })


class Filter:
    """Trees and suffix rates fitted on labelled URLs; ``constant`` where one label is all there is."""

    def __init__(self, labelled: DataFrame, url: str = "url", blocked: str = "blocked", fit_rows: int = FIT_ROWS):
        rows = labelled.select(F.col(url).alias("url"), F.col(blocked).cast("double").alias("y")).filter("url is not null and y is not null")
        fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold")
        suffixes = with_features(with_rules(rows, []), "url").groupBy("f_suffix2", "f_suffix", fold)
        counts = stored(suffixes.agg(F.count("*").alias("n"), F.sum("y").alias("total")))  # of all labelled rows
        n, total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0.0))).first()
        self.constant = None if 0 < total < n else float(n > 0 and total == n)
        if self.constant is not None:
            return
        self.rates, self.mean, others = [], total / n, []
        rate = lambda n, total: (total + SMOOTHING * self.mean) / (n + SMOOTHING)
        for suffix, name in (("f_suffix", "f_last"), ("f_suffix2", "f_last2")):
            every = counts.groupBy(suffix).agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"))
            self.rates.append((suffix, name, stored(every.select(suffix, rate(F.col("all_n"), F.col("all_total")).alias(name)))))
            part = counts.groupBy(suffix, "fold").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(every, suffix)
            others.append((suffix, name, stored(part.select(suffix, "fold", rate(F.col("all_n") - F.col("n"), F.col("all_total") - F.col("total")).alias(name)))))
        # at most fit_rows short rows: one scan of the URLs for all trees
        rows = stored(with_features(with_rules(rows.distinct().orderBy(F.xxhash64("url"), "url", "y").limit(fit_rows), []), "url"))
        learner = GBTClassifier(featuresCol="f_all", labelCol="y", predictionCol="f_verdict", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        self.model = learner.fit(self._assembled(rows.withColumn("fold", fold), others, ["fold"]).select("f_all", "y"))

    def _assembled(self, rows: DataFrame, rates: list[tuple[str, str, DataFrame]], keys: Sequence[str] = ()) -> DataFrame:
        for suffix, name, table in rates:
            rows = rows.join(small_rows(table, BROADCAST_SUFFIXES), [suffix, *keys], "left").fillna({name: self.mean})
        return VectorAssembler(inputCols=_FEATURES, outputCol="f_all").transform(rows)

    def judge(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """``urls`` (with url_host and url_path) and f_verdict double: 1 to block."""
        if self.constant is not None:
            return urls.withColumn("f_verdict", F.lit(self.constant))
        done = self.model.transform(self._assembled(with_features(urls, url), self.rates))
        return done.select(*[F.col(f"`{c}`") for c in urls.columns], "f_verdict")


def judge(urls: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, url: str = "url", **options) -> DataFrame:
    """All columns of ``urls`` and url_host, url_path, url_rule (struct<rule, verdict>, null if
    none fits) and url_verdict (allow or block): the longest fitting rule's, else the trees'.

    labelled: url, blocked (0 or 1); left out, the URLs that a rule fits are the labelled
    ones. Without labels, or with one label only, the trees' verdict is that label, else
    allow. A null URL or one without ``://`` has an empty host and path, and the trees judge it by its
    text (a null as empty). URLs of any length are read whole; equal rules of both verdicts allow. Repeated rows are judged alike; no rows: no rows. Columns with the added names are replaced."""
    ruled = with_rules(urls.drop("url_verdict"), rules, url)
    if labelled is None:
        labelled = ruled.filter("url_rule is not null").select(F.col(url).alias("url"), (F.col("url_rule.verdict") == "block").cast("int").alias("blocked"))
    judged = Filter(labelled, **options).judge(ruled, url)
    verdict = F.coalesce(F.col("url_rule.verdict"), F.when(F.col("f_verdict") == 1.0, "block").otherwise("allow"))
    return judged.withColumn("url_verdict", verdict).drop("f_verdict")
