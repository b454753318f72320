"""URL filtering with a rule list and mined association rules, on DataFrame
functions alone.

A list rule is (host, path, verdict); it fits its host and all subdomains if the
URL's path starts with the rule's, and the longest fitting rule decides (host and path
together; of equally long ones the first in the list). What no
rule fits is judged by rules that Spark's FP-growth mines from labelled URLs: token
combinations whose confidence for a verdict and whose support are high enough. Mined
rules are matched by an inverted index on the rarest token of their antecedent.
Where none matches, `default` holds.

Defined results: a null URL, or one without '://', has an empty host and path and
gets the default; rows that repeat are judged each; extra columns are ignored; with
no labelled URLs nothing is mined; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalframe.llm import common

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict): the fixed list of the op5 query.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: A list of up to this many rules is a literal of the plan; a longer one is joined.
LITERAL_RULES = 200
#: Labels of the longest host name (253 characters).
HOST_LABELS = 127
#: Items of a row up to which FP-growth mines all their subsets.
FP_ITEMS = 12


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _listed(pages: DataFrame, rules: list[tuple[str, str, str]], spark: SparkSession) -> DataFrame:
    """Adds rule (host and path of the longest fitting rule) and its verdict, both null without
    one. Of equally long rules the first in the list counts, however long the list is."""
    places = range(len(rules))
    if len(rules) <= LITERAL_RULES:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        # What counts most is asked first, so it comes last here.
        for i in sorted(places, key=lambda i: (len(rules[i][0] + rules[i][1]), -i)):
            host, path, verdict = rules[i]
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
        return pages.withColumn("hit", best).withColumns({"rule": F.col("hit.rule"), "listed": F.col("hit.verdict")}).drop("hit")
    # One row for each suffix of a host, joined to the rules on it.
    table = spark.createDataFrame([(*rules[i], len(rules[i][0] + rules[i][1]), -i) for i in places], "rule_host string, rule_path string, verdict string, size int, place int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = pages.select("host", "path").distinct()
    hits = distinct.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("size", "place", F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("hit"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("hit.rule"), "listed": F.col("hit.verdict")}).drop("hit")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, every label and suffix of the host, every part of
    the path without its digits, its depth and ending, every query key, whether there is a
    fragment. Suffixes go up to `HOST_LABELS` labels, more than a host name can have."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(HOST_LABELS))), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -k, k), ".")))
    each = F.transform(labels, lambda x: F.concat(F.lit("l:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    places = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    depth = F.concat(F.lit("d:"), F.least(F.size(parts), F.lit(9)).cast("string"))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    keys = F.transform(query, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    more = F.array_compact(F.array(F.when(ending != "", F.concat(F.lit("e:"), F.lower(ending))), F.when(F.contains(url, F.lit("#")), F.lit("f:"))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)), depth), ends, each, places, keys, more))


def frequent_items(spark: SparkSession, labelled: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame]:
    """Of labelled (tokens, label): (token, item) of the tokens that reach min_support, and
    (items, label), one row for each row. Tokens of exactly the same rows are one item, named
    by the smallest: rules with either have the same figures, and rules with both are pruned.
    Same rows are told by their number and 128 bits."""
    rows = common.store(spark, labelled.withColumn("rid", F.monotonically_increasing_id()), "labelled")
    least = max(1, math.ceil(min_support * rows.count()))
    each = rows.select("rid", F.explode("tokens").alias("token"))
    place = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    tokens = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *place).where(F.col("n") >= least)
    known = common.store(spark, tokens.select("token", F.min("token").over(Window.partitionBy("n", "x0", "x1")).alias("item")), "items")
    held = each.join(known, "token").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return known, common.store(spark, rows.select("rid", "label").join(held, "rid", "left").select(F.coalesce("items", none).alias("items"), "label"), "baskets")


def mine_rules(spark: SparkSession, rows: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules of rows (items, label): antecedent, verdict, confidence, support.
    A row of more than `FP_ITEMS` items has too many subsets for FP-growth; with one, rules
    are mined size by size, which leaves out only what `pruned` would drop."""
    width = common.tune(spark)
    if (rows.agg(F.max(F.size("items"))).first()[0] or 0) > FP_ITEMS:
        return _mine_by_size(spark, rows, min_support, min_confidence)
    items = rows.select(F.concat("items", F.array(F.concat(F.lit("="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=width).fit(items)
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("=")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("="))))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substr(F.col("consequent")[0], F.lit(2)).alias("verdict"), "confidence", "support")
    return common.store(spark, rules, "rules")


def _mine_by_size(spark: SparkSession, rows: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules of any size, smaller antecedents first. One grows only while it is in fewer rows
    than each of its subsets and its rows differ in label: otherwise a smaller antecedent
    decides all that a larger one could."""
    total = rows.count()
    least = max(1, math.ceil(min_support * total))
    rows = common.store(spark, rows.groupBy("items", "label").agg(F.count(F.lit(1)).alias("w")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    held = rows.select("rid", "label", "w", F.explode("items").alias("x")).select("rid", "label", "w", F.array("x").alias("items"))
    rules = smaller = None
    while True:
        held = common.store(spark, held, "held")
        if not held.head(1):
            return rules if rules is not None else spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
        per = held.groupBy("items", "label").agg(F.sum("w").alias("both"))
        sizes = per.groupBy("items").agg(F.sum("both").alias("n"), F.max("both").alias("most")).where(F.col("most") >= least)
        if smaller is not None:
            less = sizes.select("items", "n", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("less")).join(smaller, "less")
            whole = less.groupBy("items").agg(F.count(F.lit(1)).alias("k"), F.min("less_n").alias("less_n"))
            sizes = sizes.join(whole, "items").where("k = size(items) and n < less_n").select("items", "n", "most")
        sizes = common.store(spark, sizes, "sizes")
        sure = per.join(sizes, "items").where((F.col("both") >= least) & (F.col("both") / F.col("n") >= min_confidence))
        found = common.store(spark, sure.select(F.col("items").alias("antecedent"), F.col("label").alias("verdict"), (F.col("both") / F.col("n")).alias("confidence"), (F.col("both") / F.lit(total)).alias("support")), "rules")
        rules = found if rules is None else rules.unionByName(found)
        grow = sizes.where("most < n")
        smaller = grow.select(F.col("items").alias("less"), F.col("n").alias("less_n"))
        stem = held.join(grow.select("items"), "items").select("rid", "label", "w", F.expr("slice(items, 1, size(items) - 1)").alias("stem"), F.element_at("items", -1).alias("x"))
        other = stem.select("rid", "stem", F.col("x").alias("y"))
        held = stem.join(other, ["rid", "stem"]).where("x < y").select("rid", "label", "w", F.concat("stem", F.array("x", "y")).alias("items"))


def pruned(rules: DataFrame) -> DataFrame:
    """Drops rules that a subset of one token less already decides as well."""
    smaller = rules.select(F.col("antecedent").alias("less"), "verdict", F.col("confidence").alias("less_confidence"))
    widened = rules.withColumn("less", F.explode(F.transform("antecedent", lambda x: F.array_sort(F.array_remove("antecedent", x)))))
    weak = widened.join(smaller, ["less", "verdict"]).where(F.col("less_confidence") >= F.col("confidence")).select("antecedent", "verdict").distinct()
    return rules.join(weak, ["antecedent", "verdict"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens), distinct: url, mined (verdict of the most confident rule, then the
    best supported, then block), mined_rule. The index has each rule once, under the token
    that fewest rules' antecedents and pages share."""
    use = rules.select(F.explode("antecedent").alias("key"), "support", "antecedent", "verdict", "confidence")
    common_in = rules.select(F.explode("antecedent").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("antecedent", "verdict").orderBy("n", "key")
    index = use.join(common_in, "key").withColumn("r", F.row_number().over(rarest)).where("r = 1").drop("r", "n")
    hits = urls.withColumn("key", F.explode("tokens")).join(index, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "verdict", "antecedent")).alias("best")
    return hits.groupBy("url").agg(best).select("url", F.col("best.verdict").alias("mined"), F.concat_ws(" ", "best.antecedent").alias("mined_rule"))


def url_filter(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = ALLOW) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, mined_rule.
    labels: (url, label), label allow or block, as many rows as wanted for a URL."""
    common.tune(spark)
    host, path = host_path(F.col("url"))
    parts = {"host": host, "path": path}
    judged = _listed(pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns(parts), rules, spark)
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    known = labels.select("url", "label").where("url is not null and contains(url, '://') and label is not null").withColumns(parts).select(tokens.alias("tokens"), "label")
    # A decided rule list needs no mining; what is open is matched once per distinct URL.
    open_urls = judged.where("listed is null and url is not null and contains(url, '://')").select("url", "host", "path").distinct().select("url", tokens.alias("tokens"))
    known, rows = frequent_items(spark, known, min_support)
    # What a URL has of the items; tokens that are in no rule need no look.
    open_urls = open_urls.select("url", F.explode("tokens").alias("token")).join(known, "token").groupBy("url").agg(F.collect_set("item").alias("tokens"))
    mined = match_rules(open_urls, pruned(mine_rules(spark, rows, min_support, min_confidence)))
    return judged.join(mined, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"), "mined_rule")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. URLs are labelled by the quality of the document whose number ends their path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    _, path = host_path(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})[^/0-9]*/?$", 1)
    labels = pages.withColumn("doc_id", F.when(number != "", number).cast("long")).join(quality, "doc_id").select("url", F.when(F.col("quality") == 0, BLOCK).otherwise(ALLOW).alias("label"))
    # What the list decides is labelled too.
    host, path = host_path(F.col("url"))
    listed = _listed(pages.withColumns({"host": host, "path": path}), RULES, spark).where("listed is not null").select("url", F.col("listed").alias("label"))
    return url_filter(spark, pages, RULES, labels.unionByName(listed))


def op5_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_url_filter finds by the list alone: page_id, host, path, rule, and the rule's verdict."""
    found = op5_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("listed"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}', {len(h + p)}, {i})" for i, (h, p, v) in enumerate(RULES))
LISTED_ORACLE = f"""
WITH r(rule_host, rule_path, verdict, size, place) AS (VALUES {_VALUES}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT host, path, arg_max(rule_host || rule_path, size * 1000 - place) AS rule, arg_max(verdict, size * 1000 - place) AS listed
 FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, listed FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
"""
