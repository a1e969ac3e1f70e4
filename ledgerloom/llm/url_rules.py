"""Operator 3: allow and block rules for urls, as a sort-merge range join. DataFrame functions only.

A rule is a host and a path: it fits that host and all its subdomains where the url's path starts with the rule's.
The longest fitting rule wins (host and path together; of two as long, the longer host).

Canonical keys reverse the host's labels: `example.org` + `/es/1` gives `org.example//es/1`, in UTF-8 bytes. All keys
that start with a rule's key form one interval: from the key itself up to the key and a byte 0xFF, which UTF-8 never
holds. A url is probed once for each number of labels that any rule's host has, under that suffix of its host. Two
intervals are nested or apart, so in a sweep over the sorted bounds and probes the active rules form a stack: a start
pushes its rule, an end pops it. The stack at each bound is worked out from the rules alone; the sweep carries the
latest one to each probe with a window function.

The sweep runs in many groups at once. Up to `FEW_RULES` rules, groups are dealt out by row and each has all the
bounds, so no host, however common, makes a group large. Beyond, groups are made by hashed host, each with `SALTS`
shares, and bounds go to the shares of their own host.

Urls that are null, empty or without `://` have an empty host and path and fit no rule, and an empty path starts with
no rule's path but an empty one. Equal rules count once, and block wins over allow. Repeated rows and null ids come
back as often as they went in; other columns are ignored; empty tables give empty results, and no rules the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower

#: So many rules at most go to every group; their bounds then are a few thousand rows a group.
FEW_RULES = 1000
SALTS = 32

RULES = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(reversed_host: Column, path: Column) -> Column:
    return F.encode(F.concat(reversed_host, F.lit("/"), path), "UTF-8")


def bounds(rules: DataFrame) -> DataFrame:
    """The sweep's events: (rhost, labels, key, kind 0 or 2, stack), the stack as it is from there on, innermost first."""
    rules = rules.select(ascii_lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    one = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    one = one.select(_reversed(F.col("host")).alias("rhost"), F.size(F.split("host", r"\.")).alias("labels"), "path", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict")).alias("own"))
    outer = one.select(F.col("rhost"), F.col("path").alias("prefix"), F.col("own").alias("active"))
    nested = one.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", 1, n)))).join(outer, ["rhost", "prefix"])
    stacks = nested.groupBy("rhost", "labels", "path").agg(F.reverse(F.array_sort(F.collect_list("active"))).alias("stack"))
    key = _key(F.col("rhost"), F.col("path"))
    begin = stacks.select("rhost", "labels", key.alias("key"), F.lit(0).alias("kind"), "stack")
    end = stacks.select("rhost", "labels", F.concat(key, F.expr("X'FF'")).alias("key"), F.lit(2).alias("kind"), F.slice("stack", 2, F.greatest(F.size("stack") - 1, F.lit(0))).alias("stack"))
    return begin.union(end)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", few: bool | None = None) -> DataFrame:
    """`pages` (page_id, url), `rules` (host, path, verdict): rows (page_id, host, path, rule, verdict).

    A url without a fitting rule gets rule null and the verdict `default`. few: whether all groups get all bounds;
    None: as the number of rules says.
    """
    spark = pages.sparkSession
    levels = sorted(r.n for r in rules.where("host <> ''").select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES if few is None else few
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = 8 * parts if few else SALTS

    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    count = F.size(F.split("host", r"\."))
    wanted = F.filter(F.array(*map(F.lit, levels)) if levels else F.lit(None).cast("array<int>"), lambda n: (n <= count) & (F.col("host") != ""))
    probes = urls.withColumn("labels", F.explode_outer(wanted))
    # only the last labels go into a probe's key
    probes = probes.withColumn("rhost", F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, F.coalesce("labels", F.lit(1))), "."))
    probes = probes.select("page_id", "host", "path", "row", "rhost", F.when(F.col("labels").isNotNull(), _key(F.col("rhost"), F.col("path"))).alias("key"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    events = bounds(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bucket = F.lit(0) if few else F.pmod(F.xxhash64("rhost"), F.lit(4 * parts)).cast("int")
    both = probes.unionByName(events, allowMissingColumns=True).withColumn("bucket", bucket)
    # an end may come after keys of other hosts in the bucket, never inside another host's interval
    sweep = Window.partitionBy("bucket", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    top = F.when(F.size("active") > 0, F.get("active", F.lit(0)))
    best = swept.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(top).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)
