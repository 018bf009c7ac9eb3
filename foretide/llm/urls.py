"""URL filters by a sort-merge range join over reversed-host keys; DataFrame functions only.

A key is a host's labels in reverse order, each followed by U+0001, and then U+0002 and a path; so a rule for a host and
the beginnings of its paths fills one interval of keys, [key, key followed by the byte FF), and the intervals of any set of rules
are nested or disjoint. As a rule also holds for subdomains, a url is looked up under its own host and under each parent
domain that has rules. A sweep goes through the ends of intervals and the urls in order of their keys. What is active
after an end is the rule it opens, or else the rule around the one it closes, which is the deepest rule whose path is a
proper beginning of that one's; so a running `last` hands each url the top of the stack of nested rules, and no row holds
more than one rule. The longest of what the levels of its host give is the url's rule. The sweep is split by host and,
where a host has many urls, by salt: the ends of its rules go to each salt.

Rows: a null url, or one without `://`, has an empty host and an empty path and meets no rule. Repeated rows are
judged each on its own; each different host and path is swept once. A host of any number of labels is looked up under as
many parent domains as the longest host of a rule has labels. Rules with equal host and path: the one that blocks
wins. An empty rule table leaves every page to the default verdict. Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END, PAST = "\u0001", "\u0002"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Urls of one host and salt, about, or as many as the host has ends of rules: then rules at most double the rows.
SWEEP_ROWS = 200


def key_of(host: Column, path: Column) -> Column:
    """a.example.org, /x -> org U+0001 example U+0001 a U+0001 U+0002 /x, as bytes."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END + PAST), path), "UTF-8")


def rule_ends(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) -> ends of intervals: host, key, and the rule that is active from there on (null: none)."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    r = r.withColumn("rule", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "host", "path", "verdict"))
    # the rule around each: of the proper beginnings of its path that are rules of that host, the longest
    begun = r.where("path != ''").select("host", "path", F.explode(F.expr("transform(sequence(0, length(path) - 1), n -> substring(path, 1, n))")).alias("beginning"))
    around = begun.join(r.select("host", F.col("path").alias("beginning"), F.col("rule").alias("outer")), ["host", "beginning"]).groupBy("host", "path").agg(F.max("outer").alias("outer"))
    both = r.join(around, ["host", "path"], "left").withColumn("key", key_of(F.col("host"), F.col("path")))
    # a struct around each, as "no rule" must be told from no event
    opens = both.select("host", "key", F.struct("rule").alias("active"))
    return opens.unionByName(both.select("host", F.concat("key", F.lit(b"\xff")).alias("key"), F.struct(F.col("outer").alias("rule")).alias("active")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    p = p.withColumn("rest", F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"))
    p = p.select("page_id", F.translate(F.regexp_extract("rest", r"\A([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"))

    # the levels of each url's host that have rules
    ends = rule_ends(rules)
    ruled = ends.groupBy(F.col("host").alias("level")).agg(F.count("*").alias("n_ends"))
    # a parent domain of more labels than any rule's host has no rules
    deepest = ends.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("deepest"))  # one row
    asked_hosts = p.select("host", "path").where("host != ''").distinct().crossJoin(F.broadcast(deepest)).withColumn("labels", F.split("host", r"\."))
    levels = F.expr("transform(filter(sequence(0, least(size(labels), deepest)), n -> n > 0), n -> array_join(slice(labels, size(labels) - n + 1, n), '.'))")
    urls = asked_hosts.select("host", "path", F.explode(levels).alias("level")).join(ruled, "level")
    salts = urls.groupBy("level").agg(F.ceil(F.count("*") / F.greatest(F.lit(sweep_rows), F.max("n_ends"))).alias("salts"))
    asked = urls.join(salts, "level").select(F.col("level"), F.pmod(F.xxhash64("host", "path"), "salts").alias("salt"), key_of(F.col("level"), F.col("path")).alias("key"), F.lit(True).alias("is_url"), "host", "path")
    swept = asked.unionByName(
        ends.withColumnRenamed("host", "level").join(salts, "level").select("level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "key", F.lit(False).alias("is_url"), "active"),
        allowMissingColumns=True,
    )
    sweep = Window.partitionBy("level", "salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = swept.withColumn("top", F.last("active", ignorenulls=True).over(sweep)).where("is_url AND top.rule IS NOT NULL")
    judged = met.groupBy("host", "path").agg(F.max("top.rule").alias("best"))
    # pages of one url may be many: a merge join can be split
    best = p.join(judged.hint("merge"), ["host", "path"], "left")
    return best.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
