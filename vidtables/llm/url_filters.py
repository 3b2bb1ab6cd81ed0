"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything is built-in functions and the ml library's boosted trees, in the JVM. The trees
learn from labelled URLs: in judge(), those that a rule decides; in train(), any. The sample
for training is bounded by `most` rows, taken in the order of a hash of the URL.

Features: lengths of URL, host and path, depth, digit ratio, entropy of characters, hyphens,
host labels, query parameters, scheme, and for the host's last label, its last two labels and
the path's first segment the smoothed share of blocked URLs and the count. These statistics
come from all labelled URLs and keep all values, in a table in the shared folder; URLs are
joined with it by value, which SALTS parts of each value share. A URL that the trees learn from
has the statistics without those of its own fold, one of FOLDS by a hash of the URL, so that its
own label is no input.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there
up to "?", "#" or the end. A null URL, or one without "://", has both empty. A rule "host/path"
fits its host and all subdomains if the path starts with its path; the longest rule that fits
wins, ties by text. Without labelled URLs of both kinds the verdict without a rule is allow.
Repeated rows are judged alike; ids may be null. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidtables.llm.scratch import Scratch

SALTS, FOLDS = 16, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("last_label", "last_two", "head")


def parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host and path."""
    at = F.expr(f"locate('://', `{url_col}`)")
    rest = F.when(at > 0, F.expr(f"substr(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    out = urls.withColumn("_rest", rest)
    out = out.withColumn("host", F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), UPPER, LOWER))
    return out.withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that wins for host and path, and its verdict; rules are (verdict, "host/path")."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        host, slash, tail = text.partition("/")
        host = host.translate(str.maketrans(UPPER, LOWER))
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls (with host and path) with the features that need no statistics, and the values of KINDS."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    count = lambda of, what: (F.length(of) - F.length(F.replace(of, F.lit(what), F.lit("")))).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: F.greatest(F.length(u) - F.length(F.replace(u, c, F.lit(""))), F.lit(1)) / n
    columns = {
        "f_length": F.length(u).cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_path": F.length("path").cast("double"),
        "f_depth": count(F.col("path"), "/"),
        "f_digits": F.length(F.regexp_replace(u, "[^0-9]+", "")) / n,
        "f_entropy": F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.ln(share(c))),
        "f_hyphens": count(F.col("host"), "-"),
        "f_labels": count(F.col("host"), "."),
        "f_parameters": F.size(F.filter(F.split(F.regexp_extract(u, "^[^?#]*[?]([^#]*)", 1), "&"), lambda p: p != "")).cast("double"),
        "f_secure": F.lower(u).startswith("https://").cast("double"),
        "last_label": F.substring_index("host", ".", -1),
        "last_two": F.substring_index("host", ".", -2),
        "head": F.regexp_extract("path", "^/([^/]*)", 1),
    }
    return urls.select("*", *[c.alias(k) for k, c in columns.items()])


FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_hyphens", "f_labels", "f_parameters", "f_secure"]


@dataclass
class UrlModel:
    """Suffix statistics (kind, value, share blocked, count) and the trees; None: always allow."""

    statistics: DataFrame | None
    trees: GBTClassificationModel | None

    def features(self, urls: DataFrame) -> DataFrame:
        """urls from lexical() with the statistics and their vector."""
        salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_part")
        return with_statistics(urls.withColumn("_part", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")), self.statistics.select("*", salts))

    def score(self, urls: DataFrame) -> DataFrame:
        """urls (with url, host and path) with score, the probability of being blocked."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(0.0))
        found = self.trees.transform(self.features(lexical(urls)))
        return found.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def with_statistics(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    """urls (with _part) with the statistics (kind, value, _part, share, n) of their values, and the vector of all features."""
    names = list(FEATURES)
    for kind in KINDS:
        share, count = f"f_{kind}_share", f"f_{kind}_count"
        known = statistics.where(F.col("kind") == kind).select(F.col("value").alias(kind), "_part", F.col("share").alias(share), F.col("n").alias(count))
        urls = urls.join(known, [kind, "_part"], "left").fillna({share: 0.5, count: 0.0})
        names += [share, count]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(urls)


def train(labelled: DataFrame, most: int = 10_000, iterations: int = 8, depth: int = 4) -> UrlModel:
    """A model from labelled URLs (url, host, path, blocked): statistics of all, trees from at most `most` of them."""
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("_part")
    rows = labelled.where("blocked is not null").select("url", "host", "path", F.col("blocked").cast("double").alias("label"), fold)
    values = lexical(rows).select("label", "_part", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])).alias("v")).select("label", "_part", "v.*")
    sums = [F.count("*").cast("double").alias("n"), F.sum("label").alias("k")]
    counts = Scratch(labelled.sparkSession, "url-statistics").save(values.groupBy("kind", "value", "_part").agg(*sums))
    rate = counts.where(F.col("kind") == KINDS[0]).agg(F.sum("k") / F.sum("n")).first()[0]
    if rate is None or not 0 < rate < 1:
        return UrlModel(None, None)
    share = ((F.col("k") + 2 * rate) / (F.col("n") + 2)).alias("share")
    whole = counts.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    folds = F.explode(F.array(*map(F.lit, range(FOLDS)))).alias("_part")
    own = counts.select("kind", "value", "_part", F.col("n").alias("own_n"), F.col("k").alias("own_k"))
    others = whole.select("kind", "value", folds, "n", "k").join(own, ["kind", "value", "_part"], "left").fillna(0.0, ["own_n", "own_k"])
    others = others.select("kind", "value", "_part", (F.col("n") - F.col("own_n")).alias("n"), (F.col("k") - F.col("own_k")).alias("k")).where("n > 0")
    sample = with_statistics(lexical(rows.orderBy(F.xxhash64("url"), "url").limit(most)), others.select("kind", "value", "_part", share, "n"))
    model, sample = UrlModel(whole.select("kind", "value", share, "n"), None), sample.select("_features", "label").cache()
    try:
        if 0 < sample.agg(F.avg("label")).first()[0] < 1:
            model.trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=iterations, maxDepth=depth, seed=7).fit(sample)
        return model
    finally:
        sample.unpersist()


def judge(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", model: UrlModel | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each URL. Without a model, one learns from the URLs that rules decide."""
    rule, verdict = rule_of(rules)
    rows = parts(urls.select(F.col(id_col), F.col(url_col).alias("url"))).withColumn("rule", rule).withColumn("by_rule", verdict)
    if model is None:
        model = train(rows.where("by_rule is not null").withColumn("blocked", F.col("by_rule") == "block"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return model.score(rows).select(id_col, "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")
