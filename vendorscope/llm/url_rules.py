"""URL rules as a sort-merge range join over reversed-host keys (DataFrame only).

A host's canonical key is its labels in reverse, each followed by a dot
(``blog.example.net`` -> ``net.example.blog.``), so a rule's host and all its
subdomains are exactly the keys that start with the rule's key: an interval
[key, key + U+10FFFF). Intervals of two rules are nested or disjoint. Sorted
sweep: at each interval's start or end the stack of active rules is known from
the rules alone (the rules whose intervals hold that point); sorted together
with the distinct hosts' keys, a running ``last`` hands every host the stack
left by the latest event. Of the rules on the stack, those whose path starts
the URL's path remain, and the longest (host plus path characters) wins;
equally long ones go to the larger host, then the larger path.

The sweep runs over range-partitioned events and distinct hosts (stored, so
the partitions are fixed); the stack that enters a partition is the last one
left by the partitions before it, found from one row per partition. A host
with a third of all rows is one row in the sweep; the join that hands the
stacks back to the URLs is an ordinary equi-join that AQE can split.

Defined cases: a null URL, or one without ``://``, has empty host and path
and no rule; the empty host has no labels; A-Z only are lower-cased; repeated
rows stay; repeated rules count once (``allow`` before ``block``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorscope.llm.common import shuffle_partitions, stored

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT_VERDICT = "allow"
AFTER = "\U0010FFFF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    frame = spark.createDataFrame(list(rules) or [("", "", "")], "verdict string, host string, path string")
    frame = frame.filter(F.lit(bool(rules))).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    return frame.select("verdict", "host", "path", host_key(F.col("host")).alias("lo"))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on, the rules on the stack are active."""
    entry = F.struct((F.length("host") + F.length("path")).alias("size"), F.col("host"), F.col("path"),
                     F.col("verdict"))
    own = rules.groupBy("lo").agg(F.collect_list(entry).alias("own"))
    # the ancestors of a rule's key are its own prefixes of whole labels: an equi-join
    labels = F.split(F.expr("substring(lo, 1, length(lo) - 1)"), r"\.")
    chain = own.select("lo", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))).alias("at"))
    held = own.select(F.col("lo").alias("at"), "own")
    stacks = chain.join(held, "at").groupBy("lo").agg(
        F.flatten(F.collect_list("own")).alias("stack"),
        F.flatten(F.collect_list(F.when(F.col("at") != F.col("lo"), F.col("own")))).alias("below"))
    # where an interval ends, its parent's stack is active again; of ends at
    # one point the outermost (shortest lo) counts, and a start there wins
    starts = stacks.select(F.col("lo").alias("key"), "stack")
    ends = stacks.select(F.concat("lo", F.lit(AFTER)).alias("key"), F.col("below").alias("stack"))
    return starts.unionByName(ends)


def sweep(hosts: DataFrame, events: DataFrame) -> DataFrame:
    """(host, stack) for every distinct host."""
    spark = hosts.sparkSession
    none = F.lit(None)
    points = (hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host",
                           none.cast(events.schema["stack"].dataType).alias("stack"))
              .unionByName(events.select("key", F.lit(0).alias("kind"), none.cast("string").alias("host"), "stack")))
    cut = stored(points.repartitionByRange(shuffle_partitions(spark), "key")
                 .withColumn("part", F.spark_partition_id()), "url-points")
    order = ["key", "kind"]
    left = cut.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("leaves"))
    entering = (cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(left, "part", "left")
                .select("part", F.last("leaves", ignorenulls=True).over(
                    Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("enters")))
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = cut.withColumn("active", F.last("stack", ignorenulls=True).over(run)).filter("kind = 1")
    return active.join(entering, "part").select("host", F.coalesce("active", "enters").alias("stack"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict."""
    spark = pages.sparkSession
    split = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = split.select("host").distinct()
    swept = sweep(hosts, rule_events(rule_frame(spark, rules)))
    # hosts without an active rule need no join partner
    judged = split.join(swept.filter(F.size("stack") > 0), "host", "left")
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return (judged.withColumn("best", best)
            .select(id_col, "host", "path", F.concat(F.col("best.host"), F.col("best.path")).alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
