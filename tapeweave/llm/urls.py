"""URL filters: listed rules first, then association rules mined from labels; expressions only.

A listed rule (verdict, host, path prefix) fits its host and all subdomains if the path starts with
the rule's; the longest wins. URLs that no rule fits are judged by rules that FP-growth mines: the
transactions are token sets of labelled URLs with their label, and of the association rules those
that conclude a label are kept, pruned by support and confidence and by whether a part of a rule
already says the same as surely. An inverted index files each rule under its rarest token; a URL
looks its tokens up there, and the rules whose tokens it holds all vote: the surest wins, then the
better supported, then the longer, then block. No rule: allow.

A URL's label is its listed verdict if it has one, else block where `labels` say that the page is of
low quality or toxic, else allow; pages without either are not mined. URLs are judged once for each
distinct set of tokens, so that a host with a third of all pages costs one lookup.

Null or odd URLs: empty host and path, no tokens, allow. Repeated rows are judged each. Empty tables
give no rules and all-allow.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
LISTED = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SUPPORT, CONFIDENCE = 0.002, 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def listed(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest listed rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        text, verdict = F.when(fits, F.lit(of + prefix)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens with their place: host labels from the right, words in them, path segments, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    # numbers go by their first digit: single pages make no rules
    shapes = F.transform(segments, lambda x: F.when(x.rlike("^[0-9]+"), F.concat(F.lit("#"), F.substring(x, 1, 1))).otherwise(F.lower(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    marked = [F.transform(x, _mark(m)) for m, x in (("d:", F.slice(F.reverse(labels), 1, 2)), ("w:", words), ("p:", shapes), ("q:", keys))]
    return F.array_sort(F.array_distinct(F.concat(*marked)))


def _mark(prefix: str):
    return lambda t: F.concat(F.lit(prefix), t)


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, label) of pages (page_id, tokens, listed) with a listed verdict or a row in `labels`."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    both = pages.join(bad, "page_id", "left")
    label = F.coalesce(F.col("listed"), F.when(F.col("bad") == 1, "block").when(F.col("bad") == 0, "allow"))
    return both.select("tokens", label.alias("label")).where("label is not null and size(tokens) > 0")


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from `rows` (tokens, label)."""
    baskets = rows.select(F.array_append("tokens", F.concat(F.lit("="), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=common.shuffle_partitions(rows.sparkSession)).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("="))
    rules = rules.where(~F.exists("antecedent", lambda t: t.startswith("=")))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 2)").alias("verdict"), "confidence", "support")
    # a rule goes if leaving out one token gives one that concludes the same at least as surely
    shorter = rules.select("tokens", "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))).alias("part"))
    better = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("sure"))
    idle = shorter.join(better, ["part", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    return rules.join(idle, ["tokens", "verdict"], "left_anti")


def index(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """The inverted index: each rule under the token of it that the fewest labelled URLs hold."""
    parts = rules.select("*", F.explode("tokens").alias("token"))
    seen = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return parts.join(seen, "token").groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def matched(sets: DataFrame, filed: DataFrame) -> DataFrame:
    """`sets` (tokens) with the verdict, tokens and confidence of the rule that wins, where one fits."""
    looked = sets.select(F.col("tokens").alias("of"), F.explode("tokens").alias("token"))
    fits = looked.join(filed, "token").where(F.size(F.array_except("tokens", "of")) == 0)
    order = F.struct("confidence", "support", F.size("tokens").alias("size"), (F.col("verdict") == "block").alias("b"), F.array_join("tokens", " ").alias("t"))
    best = fits.groupBy("of").agg(F.max_by(F.struct("verdict", "confidence", F.col("tokens").alias("because")), order).alias("r"))
    return best.select(F.col("of").alias("tokens"), F.col("r.verdict").alias("mined"), "r.confidence", "r.because")


def judged(pages: DataFrame, labels: DataFrame, rules=LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, because (tokens of the mined rule), confidence."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    text, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("listed"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    training = common.stored(labelled(rows, labels).groupBy("tokens", "label").count(), "labelled-urls").select("tokens", "label", F.explode(F.array_repeat(F.lit(1), F.col("count").cast("int")))).select("tokens", "label")
    filed = common.stored(index(mine(training, support, confidence), training), "url-rules")
    sets = rows.where("listed is null").select("tokens").distinct()
    found = rows.join(matched(sets, filed), "tokens", "left")
    mined = F.when(F.col("listed").isNull(), F.col("because"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), mined.alias("because"), F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"))


def op2_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.read(spark, sf_dir, "pages"), common.read(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")
