"""URL filters: rules on host and path, and boosted trees on lexical features for the URLs that no rule fits.

Everything is a DataFrame expression: parsing, rule matching, features, suffix statistics, and Spark ML's gradient-boosted trees. They are trained on
labelled URLs: those that a rule decides, or those of a table of labels. The training rows are a bounded sample, ``per_class`` of each verdict;
each weighs as many labelled rows as it stands for, so the share of either verdict is the true one at every size.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased. Path: from there up to ``?``, ``#`` or the end. A
rule ``host/path`` fits its host and all subdomains if the path begins with the rule's; of fitting rules the longest wins.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule. Without labelled rows of both verdicts
every URL without a rule gets the verdict of those there are, ``allow`` if there are none. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_sample
from veilframe.session import materialize

BLOCK, ALLOW = "block", "allow"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURES = [
    "length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "hyphens", "parameters", "query_length",
    "percent", "entropy", "host_entropy", "fragment", "secure", "longest_label", "vowels", "suffix_rate", "domain_rate",
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, *LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. Rules: ``host/path`` to verdict."""
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at, _, below = rule.partition("/")
        fits = (F.concat(F.lit("."), host).endswith(f".{at}")) & path.startswith(f"/{below}") & (host != "")
        chosen = F.when(fits, rule) if chosen is None else chosen.when(fits, rule)
    return F.lit(None).cast("string") if chosen is None else chosen.otherwise(F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    if not rules:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[rule]


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character of a text's character distribution."""
    signs = F.split(text, "")
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(signs, lambda s: s == c)) / size
    return F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def featured(pages: DataFrame) -> DataFrame:
    """``pages`` with a struct ``lexical`` of numbers, and the host's last label and last two labels."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    lexical = F.struct(
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(labels).cast("double").alias("labels"),
        F.length(F.regexp_replace(path, "[^/]", "")).cast("double").alias("depth"),
        _share(url, "[^0-9]").alias("digits"),
        _share(host, "[^0-9]").alias("host_digits"),
        F.length(F.regexp_replace(host, "[^-]", "")).cast("double").alias("hyphens"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        _share(url, "[^%]").alias("percent"),
        _entropy(url).alias("entropy"),
        _entropy(host).alias("host_entropy"),
        url.contains("#").cast("double").alias("fragment"),
        url.startswith("https:").cast("double").alias("secure"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        _share(host, "[^aeiou]").alias("vowels"),
    )
    return pages.withColumns(
        {
            "lexical": lexical,
            "suffix": F.element_at(labels, -1),
            "domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        }
    )


def _rates(labelled: DataFrame, name: str, weight: float = 20.0) -> DataFrame:
    """Block rate of each value of ``name`` among labelled URLs, drawn towards a half where there are few."""
    blocked = F.sum(F.col("label"))
    return labelled.groupBy(name).agg(((blocked + weight / 2) / (F.count("*") + weight)).alias(f"{name}_rate"))


def _vectors(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for name, rate in rates.items():
        rows = rows.join(rate, name, "left").fillna(0.5, [f"{name}_rate"])
    flat = rows.select("*", *[F.col(f"lexical.{f}").alias(f) for f in FEATURES if not f.endswith("_rate")])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(flat).drop("lexical", *FEATURES)


def train(labelled: DataFrame, per_class: int = 5000, rounds: int = 12, depth: int = 3) -> tuple[GBTClassificationModel, dict[str, DataFrame]] | str:
    """Trees and suffix statistics from rows of (page, url, host, path, label 1 to block); a verdict if there is only one.

    The statistics cover all labelled rows, the trees a sample of at most ``per_class`` rows of each label.
    """
    there = dict(labelled.groupBy("label").count().collect())
    if len(there) < 2:
        return BLOCK if 1 in there else ALLOW
    rates = {name: materialize(_rates(labelled, name), "rates") for name in ("suffix", "domain")}
    # The sample is bounded, so a few partitions hold it.
    sample = materialize(bounded_sample(labelled.select("page", "label", "lexical", "suffix", "domain"), "label", "page", per_class), "sample")
    taken = dict(sample.groupBy("label").count().collect())
    scale = sum(taken.values()) / sum(there.values())
    weight = F.when(F.col("label") == 1, there[1] / taken[1] * scale).otherwise(there[0] / taken[0] * scale)
    data = _vectors(sample, rates).select("label", "features", weight.alias("weight")).coalesce(8)
    trees = GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7, subsamplingRate=1.0, cacheNodeIds=False)
    return trees.fit(data), rates


def judge(
    pages: DataFrame, rules: dict[str, str], labels: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url",
    per_class: int = 5000,
) -> DataFrame:
    """One row per page: id, host, path, rule and verdict.

    ``labels``: optional rows (id, verdict) of pages to learn from; if not given, the pages that a rule decides are learned from.
    """
    named = pages.select(F.col(id_column).alias("page"), F.col(url_column).alias("url"))
    parsed = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = featured(ruled.withColumn("by_rule", verdict_of(F.col("rule"), rules)))
    known = ruled.withColumn("known", F.col("by_rule"))
    if labels is not None:
        given = labels.select(F.col(id_column).alias("page"), F.col("verdict").alias("known"))
        known = ruled.join(given, "page")
    labelled = known.where(F.col("known").isNotNull()).withColumn("label", (F.col("known") == BLOCK).cast("int"))
    model = train(labelled, per_class)
    if isinstance(model, str):
        judged = ruled.withColumn("guess", F.lit(model))
    else:
        trees, rates = model
        judged = trees.transform(_vectors(ruled, rates)).withColumn("guess", F.when(F.col("prediction") == 1, BLOCK).otherwise(ALLOW))
    return judged.select(F.col("page").alias(id_column), "host", "path", "rule", F.coalesce("by_rule", "guess").alias("verdict"))
