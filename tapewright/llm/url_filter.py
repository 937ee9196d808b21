"""URL filtering: listed rules first, a classifier of character n-grams for the rest.

The classifier is a logistic regression on hashed character n-grams of host and
path, trained on a small labelled table of URLs that is made by a rule: words of
unwanted and of wanted sites in usual places of a URL, and plain made-up names.
The rules of the query are no labels: where one fits, it decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest first: the first rule that fits is the longest.
RULES = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))
# The words that the labelled table is made of.
UNWANTED = "casino poker jackpot slots betting lottery roulette gambling cheap-pills pharma-sale meds-online weight-loss miracle-cure replica-watches payday-loan quick-cash free-money get-rich giveaway spam link-farm seo-boost adult xxx nude hookup escorts warez cracked keygen torrents malware phishing verify-account adserver clicktrack popup-ads banner-ads tracking-pixel fake-news".split()
WANTED = "library university museum journal news weather recipes garden school science history travel maps docs wiki blog forum health clinic hospital council parliament music theatre cinema sports cycling chess linux python kernel mathematics physics biology archive encyclopedia dictionary bakery research static".split()
TAILS = "com org info example.com example.org site.net".split()
PATHS = ("/", "/en/12", "/index.html", "/de/3.html", "", "/fr/a/b", "/2/page")


def labelled_urls(names: int = 400) -> list[tuple[str, str, int]]:
    """``host, path, block`` rows: every word in seven places, and ``names`` hosts of syllables without a meaning, which are wanted."""
    rows = []
    for words, block in ((UNWANTED, 1), (WANTED, 0)):
        for i, word in enumerate(words):
            tail = lambda j, i=i: TAILS[(i + j) % len(TAILS)]
            path = lambda j, i=i: PATHS[(i + 2 * j) % len(PATHS)]
            hosts = [f"{word}.{tail(0)}", f"www.{word}.{tail(1)}", f"{word}{i}.{tail(2)}", f"my-{word}.{tail(3)}", f"m.{word}-shop.{tail(4)}", f"best{word}.{tail(5)}"]
            rows += [(host, path(j), block) for j, host in enumerate(hosts)] + [(f"www.{tail(1)}", f"/{word}{path(2)}", block)]
    consonants, vowels = "bcdfghklmnprstvw", "aeiou"
    for i in range(names):
        name = "".join(consonants[(7 * i + 5 * k + i // 16) % 16] + vowels[(3 * i + 2 * k + i // 5) % 5] + ("n" if (i + k) % 3 == 0 else "") for k in range(2 + i % 4))
        rows.append((("", "www.", "m.", "blog.")[i % 4] + f"{name}.{TAILS[i % len(TAILS)]}", PATHS[i % len(PATHS)], 0))
    return rows


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two parts, without a pattern's backtracking; both empty for null or a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, UPPER, LOWER), path


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        hit = fits(host, path, rule_host, rule_path)
        name, verdict = F.when(hit, rule_host + rule_path).otherwise(name), F.when(hit, says).otherwise(verdict)
    return name, verdict


def char_grams(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """N-grams of both parts, marked by the part they come from."""

    def cut(chars: Column, mark: str, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat_ws("", F.lit(mark), *[F.get(chars, i + j) for j in range(n)]))

    def grams(part: Column, mark: str) -> Column:
        # The characters are bound by a lambda: split once, and no substring counts its way from the start.
        chars = F.array(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""))
        return F.flatten(F.transform(chars, lambda c: F.concat(*[cut(c, mark, n) for n in sizes])))

    return F.concat(grams(host, "h:"), grams(path, "p:"))


@dataclass
class UrlClassifier:
    """Verdicts for (host, path) by hashed n-grams; with no usable labels everything is allowed."""

    buckets: int = 1 << 15
    model: LogisticRegressionModel | None = None

    def features(self, urls: DataFrame) -> DataFrame:
        return HashingTF(numFeatures=self.buckets, inputCol="grams", outputCol="features", binary=True).transform(
            urls.withColumn("grams", char_grams(F.col("host"), F.col("path")))
        )

    def fit(self, spark: SparkSession, labelled: Sequence[tuple[str, str, int]]) -> UrlClassifier:
        """Train on a small table of ``host, path, block`` rows."""
        table = spark.createDataFrame(list(labelled), "host string, path string, label int").select("host", "path", F.col("label").cast("double"))
        rows = self.features(table.coalesce(1)).select("features", "label").cache()  # one order makes the fit repeatable
        if len({block for _, _, block in labelled}) == 2:
            self.model = LogisticRegression(regParam=0.01, maxIter=30).fit(rows)
        rows.unpersist()
        return self

    def verdicts(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``by_model``: block or allow. Urls without a host are allowed."""
        if self.model is None:
            return urls.withColumn("by_model", F.lit("allow"))
        scored = self.model.transform(self.features(urls)).withColumn(
            "by_model", F.when((F.col("prediction") == 1.0) & (F.col("host") != ""), "block").otherwise("allow")
        )
        return scored.select(*urls.columns, "by_model")


def op9_url_filter(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; rows that repeat a url get equal verdicts, null urls are allowed."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    ruled = parts.withColumn("rule", rule).withColumn("verdict", verdict)
    classifier = UrlClassifier().fit(pages.sparkSession, labelled_urls())
    return classifier.verdicts(ruled).select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_model").alias("verdict"))
