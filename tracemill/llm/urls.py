"""URL filters: a list of host and path rules, and association rules mined from the urls that the list judges.

A url becomes a set of tokens: its host labels, path segments and parameter names, digits replaced by #. FP-growth over
a bounded sample of labelled urls, their label among the tokens, gives rules from token combinations to a label; of tokens
that always stand together one is mined. Rules below the confidence or support limit go, and so does a rule if one with a token less is as sure. An inverted index
holds each rule under its rarest token; distinct token sets look their tokens up there, and a rule fires if the set
has all its tokens. The surest rule decides (then the longer, the better supported, block before allow); without one a url is allowed.

Cases: a null url, or one without ://, has an empty host and path and is judged by the method, which allows it; repeated rows
have equal results; an empty table, or no labelled url, mines no rules; very long urls are read whole, all their tokens; other columns are left
out, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS, MIN_SUPPORT, MIN_CONFIDENCE = 20_000, 0.01, 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK, ALLOW = "=block", "=allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of (verdict, host/path) as struct(rule, verdict), else null. The list is part of the program."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens of a url."""
    plain = lambda kind: lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "#"))
    names = F.transform(F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit("([^=&]+)=?[^&]*"), 1), plain("q:"))
    found = F.concat(F.transform(F.split(host, r"\."), plain("h:")), F.transform(F.split(path, "/"), plain("p:")), names)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 2)))


def leading(labelled: DataFrame, min_support: float) -> list[str]:
    """The tokens to mine: those with enough support, and of tokens that stand in the very same token sets the first alone,
    for the others give the same rules once more. Each has a share of all rows, so they are few."""
    h = F.pmod(F.xxhash64("tokens"), F.lit(1 << 46))
    per = labelled.select(F.explode("tokens").alias("token"), h.alias("h")).groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("where"))
    often = per.join(labelled.agg((F.count("*") * F.lit(min_support)).alias("least")), F.col("n") >= F.col("least"))
    return sorted(r.token for r in often.groupBy("n", "where").agg(F.min("token").alias("token")).select("token").collect())


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules anchor, needs, verdict, confidence, support from rows tokens, verdict of bounded number."""
    labelled = common.checkpoint(labelled.select("tokens", "verdict"))
    known = F.array(*map(F.lit, leading(labelled, min_support))).cast("array<string>")
    items = labelled.select(F.concat(F.array_intersect("tokens", known), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    goal = F.col("consequent")[0]
    rules = model.associationRules.where(goal.isin(BLOCK, ALLOW) & ~F.arrays_overlap("antecedent", F.array(F.lit(BLOCK), F.lit(ALLOW)))).select(F.array_sort("antecedent").alias("needs"), F.substr(goal, F.lit(2)).alias("verdict"), "confidence", "support")
    rules = common.checkpoint(rules)
    shorter = rules.select("needs", "verdict", F.col("confidence").alias("_sure"))
    less = rules.where(F.size("needs") > 1).select(F.col("needs").alias("_full"), "verdict", "confidence", F.explode("needs").alias("_out")).withColumn("needs", F.array_remove("_full", F.col("_out")))
    worse = less.join(shorter, ["needs", "verdict"]).where("_sure >= confidence").select(F.col("_full").alias("needs"), "verdict").distinct()
    rules = rules.join(worse, ["needs", "verdict"], "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("_item"), "freq")
    rare = rules.select("*", F.explode("needs").alias("_item")).join(often, "_item").groupBy("needs", "verdict").agg(F.min(F.struct("freq", "_item"))["_item"].alias("anchor"))
    return rules.join(rare, ["needs", "verdict"]).select("anchor", "needs", "verdict", "confidence", "support")


def judge(pages: DataFrame, rules: list[tuple[str, str]], rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, and the mined tokens and confidence where these decided."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.select("page_id", "host", "path", listed(F.col("host"), F.col("path"), rules).alias("_list"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    sample = urls.where("_list is not null").select("tokens", F.col("_list.verdict").alias("verdict"), "page_id").orderBy(F.xxhash64("page_id", "tokens"), "tokens", "verdict").limit(rows)
    index = common.checkpoint(mine(sample))
    n = index.count()
    sets = urls.where("_list is null").select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("anchor")).join(common.small(index, n, 400), "anchor").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.size("needs").alias("n"), "support", "verdict", "needs"))
    found = common.checkpoint(hits.groupBy("tokens").agg(best.alias("_best")))
    out = urls.join(common.small(found, found.count(), 600), "tokens", "left")
    verdict = F.coalesce(F.col("_list.verdict"), F.when(F.col("_list").isNull(), F.col("_best.verdict")), F.lit("allow"))
    mined = F.when(F.col("_list").isNull(), F.col("_best"))
    return out.select("page_id", "host", "path", F.col("_list.rule").alias("rule"), verdict.alias("verdict"), mined["needs"].alias("mined"), mined["confidence"].alias("confidence"))
