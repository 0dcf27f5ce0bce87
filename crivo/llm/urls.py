"""URL filter: host and path rules, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo.session import drop_stored, stored

#: Lengths of the character n-grams and buckets they are hashed to.
SIZES, BUCKETS = (3, 4, 5), 1 << 14
#: Most labelled URLs a model is fitted on.
SAMPLE = 2000


@dataclass(frozen=True)
class Rule:
    """`allow` or `block` for a host with all its subdomains and paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _cut(url: Column, ends: str) -> Column:
    return F.regexp_extract(url, f"^[^{ends}]*", 0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; both empty for null and without `://`."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = _cut(rest, "/?#")
    path = _cut(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """Struct `rule`, `verdict` of the longest fitting rule, null without one.

    Of rules of one length the first in text order wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        inside = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        fits = inside & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of `host` and `path` between edge signs, marked by where they stand.

    One pass of a pattern finds the n-grams of a length, so the work is linear in the text. Pairs of
    surrogates count as two characters there.
    """

    def grams(mark: str, value: Column, n: int) -> Column:
        text = F.concat(F.lit("^"), value, F.lit("$"))
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda gram: F.concat(F.lit(mark), gram))

    return F.concat(*[grams(mark, value, n) for mark, value in (("h", host), ("p", path)) for n in SIZES])


def _features(urls: DataFrame, url: str) -> DataFrame:
    host, path = url_parts(F.col(url))
    return urls.withColumn("__llm_grams", ngrams(host, path))


def fit_url_model(labelled: DataFrame, sample: int = SAMPLE) -> PipelineModel:
    """Fits on `url`, `block` (0 or 1) of at most `sample` labelled rows.

    Half of them are of either class, the first by URL hash, and more of one only where the other
    has no more, so a rare class is not missed. Rows without a label are left out; one class, or no
    rows, gives a model of that class or one that blocks nothing. The sample is stored once, in one
    file, and the passes of the fit read that.
    """
    rows = labelled.filter("block is not null").select("url", F.col("block").cast("double").alias("label")).distinct()
    order = [F.xxhash64("url"), "url"]
    first = [rows.filter(F.col("label") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    rows = first[0].unionByName(first[1]).withColumn("__llm_turn", turn)
    rows = stored(rows.orderBy("__llm_turn", "label").limit(sample).drop("__llm_turn").coalesce(1), "url-sample")
    kept = rows
    if rows.isEmpty():
        rows = labelled.sparkSession.createDataFrame([("", 0.0)], "url string, label double")
    stages = [
        HashingTF(inputCol="__llm_grams", outputCol="__llm_features", numFeatures=BUCKETS, binary=True),
        LogisticRegression(
            featuresCol="__llm_features", labelCol="label", probabilityCol="__llm_probability",
            rawPredictionCol="__llm_raw", predictionCol="__llm_prediction", regParam=0.001, maxIter=100, standardization=False,
        ),
    ]
    model = Pipeline(stages=stages).fit(_features(rows.coalesce(1), "url"))
    drop_stored(kept)
    return model


def block_probability(urls: DataFrame, model: PipelineModel, name: str, url: str = "url") -> DataFrame:
    """Adds the model's probability that a URL is to be blocked."""
    scored = model.transform(_features(urls, url))
    sizes = F.size(vector_to_array("__llm_probability"))
    both = vector_to_array("__llm_probability")
    return scored.withColumn(name, F.when(sizes > 1, F.element_at(both, 2)).otherwise(0.0)).drop(
        "__llm_grams", "__llm_features", "__llm_raw", "__llm_probability", "__llm_prediction"
    )


def filter_urls(pages: DataFrame, rules: Iterable[Rule], model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """One row per page: `page_id`, `host`, `path`, `rule`, `verdict`, `probability`.

    The longest rule that fits decides; without one the model blocks from `threshold` on. Null URLs
    and URLs without `://` have an empty host and path, fit no rule with a host and are judged by
    the model. Repeated rows are judged alike, an empty table gives no rows, columns other than
    page_id and url are ignored. Very long URLs are judged whole, in time linear in their length. The
    judging is one narrow stage.
    """
    host, path = url_parts(F.col("url"))
    scored = block_probability(pages.select("page_id", "url"), model, "probability")
    judged = scored.select("page_id", host.alias("host"), path.alias("path"), "probability")
    found = matching_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return judged.withColumn("__llm_found", found).select(
        "page_id", "host", "path",
        F.col("__llm_found.rule").alias("rule"),
        F.coalesce("__llm_found.verdict", by_model).alias("verdict"),
        "probability",
    )
