"""URL rules by hashed expressions.

Each URL is expanded into host suffixes (one for each number of labels that any rule host has), which meet the rules'
hosts, and these times path prefixes (one for each length that a rule path of that host has). An expression's digest is cut to a short prefix, equi-joined with the rules'
prefixes, and only then confirmed on the full digest; of the confirmed rules the longest decides. Work is done once for
each distinct (host, start of the path), so a host that holds a third of all rows costs what it has of distinct starts.
Rules are a DataFrame of any size: Spark broadcasts it only where its size is known to be small.

Defined results: a null URL, or one without ``://``, has an empty host and path; rules with a null part are ignored; of
rules with the same host and path, block wins; of different rules with the same total length, the longer host wins; an
empty table gives an empty result; repeated rows are each judged; further columns are neither read nor touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.call_function("substring", rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, CAPITALS, SMALL), path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _suffixes(host: Column, labels: list[int]) -> Column:
    """The last so many labels of a host, for each number of labels that it has."""
    fitting = F.filter(F.array(*map(F.lit, labels)).cast("array<int>"), lambda n: n <= F.size(F.split(host, r"\.")))
    return F.transform(fitting, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict. ``rules``: host, path, verdict (allow or block). ``prefix_chars``: hex digits of the short hash."""
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("longest")).first()
    labels, longest = sorted(shape["labels"]), shape["longest"] or 0

    host, path = host_and_path(pages["url"])
    judged = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("start", F.substring("path", 1, longest))

    full = _digest(F.concat("host", "path"))
    stored = rules.select(
        F.substring(full, 1, prefix_chars).alias("short"), full.alias("digest"), F.concat("host", "path").alias("rule"), "verdict",
        F.struct(F.length("host") + F.length("path"), F.length("host")).alias("rank"),
    )
    # of each host, the suffixes that rules have, and only the lengths of those rules' paths
    by_host = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths")).withColumn("host_digest", _digest(F.col("rule_host")))
    by_host = by_host.select("lengths", "host_digest", F.substring("host_digest", 1, prefix_chars).alias("host_short"))
    suffixes = judged.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"), labels)).alias("suffix")).withColumn("suffix_digest", _digest(F.col("suffix")))
    known = suffixes.withColumn("host_short", F.substring("suffix_digest", 1, prefix_chars)).join(by_host, "host_short").where("suffix_digest = host_digest")
    starts = judged.select("host", "start").distinct().join(known.select("host", "suffix", "lengths"), "host")
    prefixes = F.filter("lengths", lambda n: n <= F.length("start"))
    asked = starts.select("host", "start", "suffix", F.explode(prefixes).alias("length")).select(
        "host", "start", _digest(F.concat("suffix", F.call_function("substring", F.col("start"), F.lit(1), F.col("length")))).alias("asked")
    )
    fits = asked.withColumn("short", F.substring("asked", 1, prefix_chars)).join(stored, "short").where("asked = digest")
    # as a table of its own, so that both sides of the last join are dealt anew and a frequent start can be split
    best = shared.table(fits.groupBy("host", "start").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best")), "verdicts")
    return judged.join(best, ["host", "start"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
