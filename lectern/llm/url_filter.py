"""Operator 1: url filters by rules and a tree of path templates.

*Rules.* A rule is a host and a path prefix with a verdict; it fits the host and its subdomains. The longest
rule that fits decides.

*Templates.* What rules decide also labels the tree, which judges the other urls. Of each host's paths the
segments form a tree, as deep as two different paths share a node. Segments that all paths of a node share are
passed at once (they are the common prefix of the least and the greatest of its paths), so that rounds follow branchings and not depth. Branching by branching,

* segments that look like identifiers (digits, hex, dates) and have ``many`` different values or more behind what goes before them, and children of few pages each where a node has
  many such, become the wildcard ``*`` (an extension is kept); others stay literal whatever their share or number;
* literal siblings whose shares of blocked pages do not differ significantly (two-proportion z-test
  between neighbours in the order of the shares) are merged into one branch ``{a|b}`` (of more than ``shown``
  segments the first, the last, their number and a hash); siblings without labels stay apart;
* a template is rejected if its smoothed purity ``(blocked + strength * prior) / (labelled + strength)`` is at least
  ``purity``; the prior is the share of blocked among all labelled urls, and no more than one half, so that
  a template without labels is allowed.

The tree works on counts by (host, generalised path), combined before each shuffle, so that a host with a
third of all pages is a few rows; only built-in expressions are used.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is judged by the
template of that host; a null ``page_id`` stays null; repeated rows each count and each give a row; other
columns are ignored, whatever their names; siblings of equal shares are ordered by their names; a very long url is a row like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import checkpoints

#: (verdict, rule)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_IDENTIFIER = r"^(?:[^.]*[0-9][^.]*|[0-9a-fA-F-]{16,})(\.[A-Za-z]{1,5})?$"


def host_of(url: F.Column) -> F.Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def template_verdicts(paths: DataFrame, purity: float, strength: float, few: float = 4.0, many: int = 8, z: float = 1.96, shown: int = 20) -> DataFrame:
    """For (host, path, n, labelled, blocked) with generalised paths as arrays: each with its ``template``, and ``rejected``."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    now = paths.withColumn("node", F.lit("")).withColumn("d", F.lit(0)).withColumn("open", F.lit(True)).checkpoint()
    total = now.agg(*sums).first()
    prior = min(0.5, (total["blocked"] or 0) / max(total["labelled"] or 0, 1))
    share = (F.col("blocked") + strength * prior) / (F.col("labelled") + strength)
    of = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    ahead = F.slice("path", F.col("d") + 1, F.greatest(F.size("path"), F.lit(1)))
    same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")
    while now.where("open").head(1):
        left = now.where("open")
        bounds = left.groupBy("host", "node").agg(F.min(ahead).alias("low"), F.max(ahead).alias("high")).select("host", "node", shared.alias("jump"))
        passed = F.slice("path", F.col("d") + 1, F.col("jump"))
        left = left.join(bounds, ["host", "node"]).withColumn("node", F.when(F.col("jump") > 0, F.concat("node", F.lit("/"), F.array_join(passed, "/"))).otherwise(F.col("node"))).withColumn("d", F.col("d") + F.col("jump"))
        # read by what follows many times, so that its plan is cut here
        at = left.drop("jump").withColumn("seg", F.get("path", F.col("d"))).checkpoint()
        child = at.where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(*sums)
        whole = child.groupBy("host", "node").agg(F.count(F.when(F.col("n") < few, 1)).alias("rare"))
        literal = child.join(whole, ["host", "node"]).where(~F.col("seg").startswith("*") & ((F.col("n") >= few) | (F.col("rare") < many)))
        # siblings of the same counts do not differ, so that the order holds each pair of counts once
        level = literal.where("labelled > 0").groupBy("host", "node", "labelled", "blocked").agg(F.min("seg").alias("least")).withColumn("share", share)
        order = Window.partitionBy("host", "node").orderBy("share", "least")
        blocked, labelled = F.lag("blocked").over(order), F.lag("labelled").over(order)
        pooled = of(F.col("blocked") + blocked, F.col("labelled") + labelled)
        rate, last = of(F.col("blocked"), F.col("labelled")), of(blocked, labelled)
        error = F.sqrt(pooled * (1 - pooled) * (of(F.lit(1), F.col("labelled")) + of(F.lit(1), labelled)))
        marked = level.withColumn("apart", F.when(F.coalesce(F.abs(rate - last) <= z * error, F.lit(False)), 0).otherwise(1))
        branches = marked.withColumn("branch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("host", "node", "labelled", "blocked", "branch")
        grouped = literal.join(branches, ["host", "node", "labelled", "blocked"]).select("host", "node", "branch", "seg")
        spread = grouped.groupBy("host", "node", "branch").agg(F.count("*").alias("segs"), F.min("seg").alias("first"), F.max("seg").alias("final"), F.bit_xor(F.xxhash64("seg")).alias("hash"))
        sized = grouped.join(spread, ["host", "node", "branch"])
        listed = sized.where(F.col("segs") <= shown).groupBy("host", "node", "branch").agg(F.array_join(F.sort_array(F.collect_list("seg")), "|").alias("all"))
        called = spread.join(listed, ["host", "node", "branch"], "left").select("host", "node", "branch", F.when(F.col("segs") == 1, F.col("first")).otherwise(F.concat(F.lit("{"), F.coalesce("all", F.concat_ws("|", "first", F.lit("..."), "final", F.col("segs").cast("string"), F.hex("hash"))), F.lit("}"))).alias("name"))
        named = grouped.join(called, ["host", "node", "branch"]).select("host", "node", "seg", "name").unionByName(literal.where("labelled = 0").select("host", "node", "seg", F.col("seg").alias("name")))
        step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("name", F.when(F.col("seg").startswith("*"), F.col("seg")), F.lit("*"))))
        moved = at.join(named, ["host", "node", "seg"], "left").withColumn("node", F.concat("node", step)).withColumn("d", F.col("d") + 1).select("host", "path", "n", "labelled", "blocked", "node", "d")
        # the only path of a node is its template from there on
        alone = moved.groupBy("host", "node").agg((F.count("*") == 1).alias("alone"))
        rest = F.concat(F.lit("/"), F.array_join(F.slice("path", F.col("d") + 1, F.greatest(F.size("path"), F.lit(1))), "/"))
        ends = F.size("path") <= F.col("d")
        moved = moved.join(alone, ["host", "node"]).withColumn("node", F.when(F.col("alone") & ~ends, F.concat("node", rest)).otherwise(F.col("node"))).withColumn("open", ~F.col("alone") & ~ends).drop("alone")
        now = now.where("NOT open").unionByName(moved).checkpoint()
    judged = now.groupBy("host", "node").agg(*sums).select("host", "node", ((F.col("blocked") + strength * prior) / (F.col("labelled") + strength) >= purity).alias("rejected"))
    return now.join(judged, ["host", "node"]).select("host", "path", F.col("node").alias("template"), "rejected")


def with_variable_identifiers(rows: DataFrame, many: int) -> DataFrame:
    """``rows`` (host, segments, and ``general``, in which identifiers are wildcards) with identifiers put back where fewer than ``many`` different ones follow the same path.
    Different values are counted by sketches, combined in each task, so that a host with a third of all pages is a few rows."""
    wild = F.filter(F.sequence(F.lit(0), F.size("general") - 1), lambda i: F.get("general", i).startswith("*"))
    paths = rows.where(F.exists("general", lambda g: g.startswith("*")))
    places = paths.select("host", "general", "segments", F.explode(wild).alias("i")).withColumn("prefix", F.slice("general", 1, F.col("i") + 1))
    kinds = places.groupBy("host", "prefix").agg(F.approx_count_distinct(F.get("segments", F.col("i")), 0.02).alias("kinds")).where(F.col("kinds") < many)
    back = places.select("host", "general", "i", "prefix").distinct().join(kinds, ["host", "prefix"], "left_semi").groupBy("host", "general").agg(F.collect_set("i").alias("back"))
    restored = F.transform("general", lambda g, i: F.when(F.array_contains("back", i), F.get("segments", i)).otherwise(g))
    return rows.join(back, ["host", "general"], "left").withColumn("general", F.when(F.col("back").isNull(), F.col("general")).otherwise(restored)).drop("back")


def filter_urls(pages: DataFrame, rules=RULES, purity: float = 0.8, strength: float = 4.0, many: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict and template."""
    checkpoints.ensure(pages.sparkSession)
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    general = F.transform("segments", lambda s: F.when(s.rlike(_IDENTIFIER), F.concat(F.lit("*"), F.regexp_extract(s, _IDENTIFIER, 1))).otherwise(s))
    rows = with_variable_identifiers(base.withColumn("rule", rule).withColumn("given", verdict).withColumn("segments", segments).withColumn("general", general), many)
    counted = rows.groupBy("host", "general").agg(F.count("*").alias("n"), F.count("given").alias("labelled"), F.count(F.when(F.col("given") == "block", 1)).alias("blocked"))
    templates = template_verdicts(counted.withColumnRenamed("general", "path"), purity, strength, many=many).withColumnRenamed("path", "general")
    out = rows.join(templates, ["host", "general"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
