"""Allow and block rules on URLs, as a range join by sorted keys.

A rule names a host and a path prefix; it fits the host, all its subdomains, and every path that
starts with its own. Turning the labels of a host round makes each rule a prefix of a key, and a
prefix is an interval of the sorted keys: any two intervals are nested or apart. All keys, of
rules and of URLs, are sorted together and swept once. The sweep keeps a stack of the rules that
are open: an interval's start puts its rule on top, its end brings back the rule beneath (each
rule holds the link to it). The top of the stack at a URL's key is the longest rule that fits.

A subdomain stands elsewhere in the order than the host itself, so a URL has one key for each
host that its own host belongs to, as far as rules have that many labels.

The sweep runs on range partitions. Ranges are cut by (key, position, hash of the URL), so that
one URL or host that holds most rows still spreads; and a range starts with the stack that is
open at its first key. Equal URLs are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlab.llm.common import shuffle_partitions
from itemlab.plans.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "struct<rule:string,action:string,size:int>"
START, PROBE = 0, 1


def url_host(url: Column) -> Column:
    """The part after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Labels from the last to the first, a zero byte, the path: bytes that sort as rules nest."""
    return F.encode(F.concat(F.concat_ws(".", labels), F.lit("\0"), path), "utf-8")


def rules_from(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, allow or block)."""
    quoted = ", ".join(
        "(" + ", ".join("'" + part.replace("\\", "\\\\").replace("'", "\\'") + "'" for part in rule) + ")"
        for rule in rules
    )
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS rules(host, path, action)")


def _prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """One row for each way to cut `key` short, up to the length of the longest rule."""
    lengths = F.sequence(F.lit(1), F.least(F.octet_length("key"), F.lit(longest)))
    cut = F.explode(F.filter(lengths, lambda n: n > 0))
    return rows.withColumn("_n", cut).withColumn("_prefix", F.substring("key", F.lit(1), F.col("_n")))


def _innermost(rows: DataFrame, by: str, ruled: DataFrame, longest: int, fits: Column) -> DataFrame:
    """For each `by`, the longest rule whose key is a prefix of the row's `key`."""
    held = ruled.select(F.col("key").alias("_prefix"), F.col("top").alias("_top"))
    found = _prefixes(rows, longest).join(held, "_prefix").where(fits)
    return found.groupBy(by).agg(F.max_by("_top", "_n").alias("_top"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", id: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of `pages`.

    `rules` has (host, path, action). The longest fitting rule decides; a rule given with both
    actions blocks. `rule` is the host and path of that rule, NULL where none fits, and the
    verdict is then `allow`. A NULL url, or one without `://`, has an empty host and path.
    Other columns of `pages` are not read; repeated rows are all returned.
    """
    spark = pages.sparkSession
    judged = pages.select(
        F.col(id).alias("_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )

    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    ruled = (
        rules.select(
            _key(_labels(host), path).alias("key"),
            F.size(_labels(host)).alias("labels"),
            F.concat(host, path).alias("rule"),
            "action",
        )
        .groupBy("key")
        .agg(F.max("labels").alias("labels"), F.max("rule").alias("rule"), F.max("action").alias("action"))
        .withColumn("top", F.struct("rule", "action", F.length("rule").alias("size")).cast(RULE))
    )
    deepest, longest = ruled.agg(F.max("labels"), F.max(F.octet_length("key"))).first()
    if deepest is None:
        unruled = [F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")]
        return judged.select(F.col("_id").alias(id), "host", "path", *unruled)

    nothing = F.lit(None).cast(RULE)
    empty = F.struct(*[F.lit(None).alias(c) for c in ("rule", "action", "size")]).cast(RULE)
    beneath = _innermost(ruled, "key", ruled, longest, F.col("_n") < F.octet_length("key"))
    beneath = ruled.select("key").join(beneath, "key", "left")

    labels = _labels(F.col("host"))
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))),
        lambda n: F.slice(labels, F.lit(1), n),
    )
    probes = (
        judged.select("host", "path")
        .distinct()
        .withColumn("_labels", F.explode(hosts))
        .select(
            _key(F.col("_labels"), F.col("path")).alias("key"),
            F.lit(PROBE).alias("at"),
            F.xxhash64("host", "path").alias("salt"),
            nothing.alias("top"),
            "host",
            "path",
        )
    )
    absent = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    starts = ruled.select("key", F.lit(START).alias("at"), F.lit(0).cast("long").alias("salt"), "top", *absent)
    ends = beneath.select(
        F.concat("key", F.lit(b"\xff")).alias("key"),
        F.lit(START).alias("at"),
        F.lit(0).cast("long").alias("salt"),
        F.coalesce("_top", empty).alias("top"),
        *absent,
    )
    order = ["key", "at", "salt"]
    events = stage(
        probes.unionByName(starts)
        .unionByName(ends)
        .repartitionByRange(shuffle_partitions(spark), *order)
        .withColumn("part", F.spark_partition_id()),
        "url-events",
    )

    firsts = events.groupBy("part").agg(F.min(F.struct("key", "at")).alias("_first"))
    firsts = firsts.select("part", "_first.key", "_first.at")
    open_there = (F.col("_n") < F.octet_length("key")) | (F.col("at") == PROBE)
    carried = _innermost(firsts, "part", ruled, longest, open_there).select(
        F.lit(b"").alias("key"),
        F.lit(-1).alias("at"),
        F.lit(0).cast("long").alias("salt"),
        F.col("_top").alias("top"),
        *absent,
        "part",
    )
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fitting = (
        events.unionByName(carried)
        .withColumn("_open", F.last("top", ignorenulls=True).over(sweep))
        .where((F.col("at") == PROBE) & F.col("_open.rule").isNotNull())
        .groupBy("host", "path")
        .agg(F.max_by("_open", F.struct("_open.size", "_open.rule")).alias("_rule"))
    )
    return judged.join(fitting, ["host", "path"], "left").select(
        F.col("_id").alias(id),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.action", F.lit("allow")).alias("verdict"),
    )
