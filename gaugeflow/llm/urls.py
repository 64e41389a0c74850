"""URL filters by a sort-merge range join.

A rule's host is reversed and followed by a slash, which no host has, and its
path (``www.example.com`` and ``/en/`` give ``com.example.www//en/``). The rule then is the interval of all
keys with this prefix. A url has one such key for each suffix of its host, so
that a rule for a host also covers the subdomains. Keys and interval ends are
sorted together; a sweep over them keeps a stack of the open rules.

Two windows are the sweep: the running sum of +1 and -1 is the height of the
stack, and the top of a stack of height h is the rule that was opened last
among those that raised it to h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.llm.common import ascii_lower

#: Least keys that one sweep sorts, and how many times the number of rules it has at least.
SWEEP_ROWS, ROWS_PER_RULE = 500, 4


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return ascii_lower(host)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per row of ``pages``: its id, host, path, the longest fitting rule and the verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its
    host and all subdomains if the url's path starts with the rule's. The rule
    with the longest text wins, of equally long ones the one with the longer
    host; of two verdicts for one rule, block. Without a rule the verdict is
    ``default``. Rules with a NULL in host or path, or whose host is empty or
    has ``/``, ``?`` or ``#``, fit nothing. NULL urls and urls without ``://`` have an empty host and path
    and fit nothing. Other columns of ``pages`` are not carried.

    Each sweep is one slice of the pages and all rules. A slice holds several
    times as many keys as there are rules, so copies of the rules stay below
    the keys, and slices are dealt by row, so no host is hot. Rows are told
    apart by their place in the input, which therefore has to be a table or
    another input with a fixed order.
    """
    rules = (
        rules.where((F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("path").isNotNull())
        .groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .select("r_host", "r_path", "r_verdict", F.split("r_host", r"\.").alias("labels"))
    )
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size("labels")).alias("labels"), F.max(F.length("r_path")).alias("path")).first()
    n_rules, most_labels, path_length = shape["n"], shape["labels"] or 0, shape["path"] or 0
    slices = max(1, -(-pages.count() // max(ROWS_PER_RULE * n_rules, SWEEP_ROWS)))

    sites = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("page_id"),
        url_host(F.col(url_column)).alias("host"),
        url_path(F.col(url_column)).alias("path"),
    )
    # No rule looks at more labels or a longer path than the longest rule.
    labels = F.slice(F.split("host", r"\."), -F.least(F.size(F.split("host", r"\.")), F.lit(most_labels)), F.lit(most_labels)) if most_labels else F.array()
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("labels")), lambda k: F.concat(_reversed(F.slice("labels", -k, k)), F.lit("/"), F.substring("path", 1, path_length))
    )
    keys = (
        sites.withColumn("labels", labels)
        .select("row", "page_id", "host", "path", F.explode(F.when(F.size("labels") > 0, suffixes).otherwise(F.array(F.lit("")))).alias("key"))
        .select(
            F.pmod(F.xxhash64("row"), F.lit(slices)).alias("slice"),
            F.col("key").cast("binary").alias("key"),
            F.lit(1).alias("turn"),
            F.lit(0).alias("step"),
            F.lit(None).cast("struct<length:int,labels:int,rule:string,verdict:string>").alias("opened"),
            "row",
            "page_id",
            "host",
            "path",
        )
    )
    start = F.concat(_reversed(F.col("labels")), F.lit("/"), F.col("r_path")).cast("binary")
    name = F.concat("r_host", "r_path")
    opened = F.struct(F.length(name).alias("length"), F.size("labels").alias("labels"), name.alias("rule"), F.col("r_verdict").alias("verdict"))
    ends = rules.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        F.col("slice").cast("long").alias("slice"),
        # UTF-8 has no byte FF: the end of a rule lies behind all its keys.
        F.explode(
            F.array(
                F.struct(start.alias("key"), F.lit(0).alias("turn"), F.lit(1).alias("step"), opened.alias("opened")),
                F.struct(F.concat(start, F.lit(b"\xff")).alias("key"), F.lit(2).alias("turn"), F.lit(-1).alias("step"), F.lit(None).alias("opened")),
            )
        ).alias("e"),
    ).select("slice", "e.*")

    sweep = Window.partitionBy("slice").orderBy("key", "turn", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("slice", "height").orderBy("key", "turn", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        keys.unionByName(ends, allowMissingColumns=True)
        .withColumn("height", F.sum("step").over(sweep))
        .withColumn("top", F.when(F.col("height") > 0, F.last("opened", ignorenulls=True).over(level)))
    )
    best = (
        swept.where(F.col("turn") == 1)
        .groupBy("row")
        .agg(F.max("top").alias("top"), F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"))
    )
    return best.select(
        F.col("page_id").alias(id_column), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
