"""Operator 1, URL filters: host and path rules, then gradient-boosted trees.

A URL that a rule fits takes the rule's verdict (the longest rule wins). The
others are judged by boosted trees over lexical features: length, path depth,
digit ratio, character entropy, parameter count, host labels, and statistics
of the host's suffix (its last two labels): how many URLs of the table have it and the
smoothed share of its ruled URLs that are blocked. The labels are the verdicts
of the rules; the trees are fitted on the ``fit_rows`` labelled URLs of smallest
hash (a bounded sample), the suffix statistics cover the whole table. A ruled URL's
share is that of the other FOLDS - 1 folds (by the URL's hash), so no label is
seen in its own feature.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and the features of an empty text; when fewer than two verdicts occur
among the labels the method's verdict is that of all labels, or allow without
any; repeated rows stay; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import written

FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_labels", "suffix_log_urls", "suffix_blocked"]
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def best_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (a block among equals), else null."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith(F.lit(f".{r.host}"))) & path.startswith(F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits a character of a text's character distribution."""
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c))) / n
    seen = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(seen, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the features that need no other row."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return urls.withColumns({
        "length": F.char_length(url).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": F.coalesce(entropy(url), F.lit(0.0)),
        "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "host_labels": F.size(F.filter(F.split("host", "\\."), lambda x: x != "")).cast("double"),
        "suffix": F.substring_index("host", ".", -2),
    })


def judge(pages: DataFrame, rules: list[Rule], fit_rows: int = 20_000, trees: int = 12, depth: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, blocked_score) of each row."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = parse(F.col("url"))
    parsed = slim.withColumns({"host": host, "path": path})
    text, ruled = best_rule(rules, F.col("host"), F.col("path"))
    rows = written(features(parsed.withColumns({"rule": text, "ruled": ruled})), "url-features")

    blocked = F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    of_fold = lambda f: F.when(fold == f, blocked)
    suffixes = rows.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_log_urls"),
        F.array(*(F.coalesce(F.sum(of_fold(f)), F.lit(0.0)) for f in range(FOLDS))).alias("blocked_by_fold"),
        F.array(*(F.count(of_fold(f)) for f in range(FOLDS))).alias("labels_by_fold"),
    )
    # written: Spark can split a hot suffix's rows only where both sides are plain
    suffixes = written(suffixes, "url-suffixes").withColumnRenamed("suffix", "of_suffix")
    others = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) - F.when(blocked.isNotNull(), c[fold]).otherwise(0.0)
    share = (others(F.col("blocked_by_fold")) + 1) / (others(F.col("labels_by_fold")) + 2)
    full = rows.join(suffixes, F.col("suffix").eqNullSafe(F.col("of_suffix"))).withColumns({"suffix_blocked": share, "label": blocked}).drop("of_suffix", "blocked_by_fold", "labels_by_fold")
    labels = {r["ruled"]: r["count"] for r in rows.where("ruled is not null").groupBy("ruled").count().collect()}  # two verdicts
    if len(labels) < 2:
        score = F.lit(1.0 if "block" in labels else 0.0)
        judged = full.withColumn("blocked_score", score)
    else:
        sample = full.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(fit_rows).select("label", *FEATURES)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        fit = written(sample, "url-sample").coalesce(2)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=1, cacheNodeIds=False).fit(vectors.transform(fit))
        scored = model.transform(vectors.transform(full))
        judged = scored.withColumn("blocked_score", vector_to_array("probability")[1])
    method = F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "blocked_score")
