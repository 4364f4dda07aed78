"""URL filters: stated rules first, mined association rules for the rest.

A stated rule names a host and the start of a path; it fits the host and its subdomains, and the longest
fitting rule decides. Urls that no stated rule fits are judged by rules mined from labelled urls: Spark's
FP-growth finds the combinations of url tokens that go with a label often enough (support) and nearly
always (confidence). A mined rule that a shorter one with no less confidence covers is dropped. The rest
are matched through an inverted index: a rule is filed under its rarest token only, a url looks up its
own tokens, and what is found is checked for the rule's other tokens. The most confident rule decides,
then the longest, then the best supported; a url that no rule matches is allowed.

Everything is DataFrame work. Urls are judged once each, so a url that a third of all pages share is
matched once.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="  # no token starts so: tokens start with the part of the url they come from


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: str) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without :// or url."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(F.col(url)), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """From the host's end up to ? or #."""
    return F.coalesce(F.regexp_extract(_rest(F.col(url)), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: str) -> Column:
    """Distinct tokens: labels of the host, path segments and extension (digits as #), query keys."""
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    rest = _rest(F.col(url))
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    parts = [
        F.transform(F.filter(F.split(host_of(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), shape(x))),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), shape(F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", "")))),
        F.transform(F.filter(F.transform(segments, lambda x: F.regexp_extract(x, r"\.([A-Za-z0-9]{1,5})$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("ext:"), x)),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1))),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def stated(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) columns for a list of (host, path, verdict): the longest rule that fits, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, tokens: str, label: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, label, confidence, support, anchor): association rules token combination -> label.

    `anchor` is the antecedent's rarest token among the labelled rows. Rows without a label or without
    tokens teach nothing; without any other row there is no rule.
    """
    rows = materialize(labelled.where(F.col(label).isNotNull() & (F.size(tokens) > 0)).select(F.col(tokens).alias("tokens"), F.concat(F.lit(_LABEL), label).alias("label")))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "antecedent array<string>, label string, confidence double, support double, anchor string")
    items = rows.select(F.concat("tokens", F.array("label")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    is_label = lambda x: F.startswith(x, F.lit(_LABEL))
    rules = materialize(
        found.where(is_label(F.col("consequent")[0]) & ~F.exists("antecedent", is_label))
        .select(F.array_sort("antecedent").alias("antecedent"), F.col("consequent")[0].alias("label"), "confidence", "support")
    )
    shorter = rules.select(F.explode("antecedent").alias("without"), "antecedent", "label", "confidence").select("antecedent", "label", "confidence", F.array_remove("antecedent", F.col("without")).alias("rest"))
    covered = shorter.join(rules.select(F.col("antecedent").alias("rest"), "label", F.col("confidence").alias("at_least")), ["rest", "label"]).where("at_least >= confidence").select("antecedent", "label").distinct()
    kept = rules.join(covered, ["antecedent", "label"], "left_anti")
    often = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    named = kept.select("*", F.explode("antecedent").alias("token")).join(often, "token")
    anchored = named.groupBy("antecedent", "label").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min(F.struct("count", "token"))["token"].alias("anchor"))
    return anchored.withColumn("label", F.substring("label", len(_LABEL) + 1, 1000))


def match(urls: DataFrame, key: str, tokens: str, rules: DataFrame, prefer: str = "allow") -> DataFrame:
    """(key, mined): the deciding rule's label for every row of `urls` that a rule matches."""
    looked_up = urls.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"), F.explode(tokens).alias("anchor")).join(rules, "anchor")
    holds = looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", F.size("antecedent"), "support", F.col("label") == prefer, "antecedent")
    return holds.groupBy("key").agg(F.max_by("label", order).alias("mined")).withColumnRenamed("key", key)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], id: str = "page_id", url: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per row: id, host, path, rule, verdict and by (stated, mined or default).

    Stated rules label the urls they fit, and the mined rules carry their verdicts on to the others. A null
    url, or one without ://, has an empty host and path and no tokens, and is allowed; repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored.
    """
    rule, verdict = stated(rules)
    slim = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"))
    parsed = slim.select("id", "url", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    with_tokens = parsed.withColumn("tokens", tokens_of("url"))
    found = mine(with_tokens.where("rule is not null"), "tokens", "verdict", min_support, min_confidence)
    open_ = with_tokens.where(F.col("rule").isNull() & (F.size("tokens") > 0)).select("url", "tokens").dropDuplicates(["url"])
    mined = match(open_, "url", "tokens", found)
    out = parsed.join(mined, "url", "left")
    by = F.when(F.col("rule").isNotNull(), "stated").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return out.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"), by.alias("by"))
