"""URL filters by a temporal list join: DataFrame operations only.

Dated list entries (add or remove a pattern for a category) become validity intervals. An as-of join then evaluates every
capture against the intervals that hold at its fetch date. Captures and patterns meet by equality of keys: a capture has
its host, the host's parent domains, and host with leading path segments as keys, no longer than the list's longest patterns. So that a pattern listed and delisted
many times does not multiply captures, closed intervals are stored by month and captures look up their own month; an
interval that is still open is stored once. The list is broadcast only if Spark finds it below the session's threshold;
else both sides are shuffled by key and month, and skewed keys are split by adaptive execution.

Defined results: of entries for the same pattern, category and date, removal wins; entries with a null field take no part;
captures with a null URL, without a host, or without a date match nothing and are allowed; rows that repeat id, URL and
date are reported once; the longest matching pattern decides, and of equally long ones a blocking one; an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, rule, since, until): from an addition to the next entry of its pattern and category."""
    one = entries.dropna(subset=["pattern", "category", "rule", "action", "day"]).groupBy("pattern", "category", "rule", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("pattern", "category", "rule").orderBy("day")
    return one.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("pattern", "category", "rule", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "day") -> DataFrame:
    """page_id, host, day, n_active, categories and verdict of every capture. entries: pattern, category, rule (block or allow), action (add or remove), day."""
    held = intervals(entries)
    months = F.when(F.col("until").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(_month(F.col("since")), _month(F.col("until"))))
    listed = held.withColumn("month", F.explode(months))
    rows = captures.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(day).alias("day")).withColumns({"host": host(F.col("url")), "path": F.regexp_extract("url", PATH, 1)})
    # no key is longer than the list's longest pattern of its kind, so that long URLs do not make long lists of long keys
    on_host, slashes = F.substring_index("pattern", "/", 1), F.length("pattern") - F.length(F.replace("pattern", F.lit("/")))
    deep = held.select((F.size(F.split(on_host, r"\.")) - 1).alias("dots"), slashes.alias("slashes")).agg(F.coalesce(F.max("dots"), F.lit(0)).alias("dots"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes"))
    dots, depth = (deep.select(c).scalar() for c in ("dots", "slashes"))
    rows = rows.withColumns({"dots": dots, "depth": depth})
    labels = F.split("host", r"\.")
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    first = F.greatest(F.lit(1), F.size(labels) - F.col("dots"))
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = F.least(F.size(segments), F.col("depth"))
    paths = F.when(some > 0, F.transform(F.sequence(F.lit(1), some), lambda i: F.concat("host", F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    keys = F.when(F.coalesce(F.col("host"), F.lit("")) == "", F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.concat(domains, paths)))
    asked = rows.withColumn("pattern", F.explode(keys)).withColumn("month", F.explode(F.array(F.lit(-1), _month(F.col("day")))))
    live = (F.col("c.pattern") == F.col("l.pattern")) & (F.col("c.month") == F.col("l.month")) & (F.col("c.day") >= F.col("l.since")) & (F.col("l.until").isNull() | (F.col("c.day") < F.col("l.until")))
    met = asked.select("page_id", "url", "host", "day", "pattern", "month").alias("c").join(listed.alias("l"), live, "left")
    entry = F.struct(F.length("l.pattern").alias("n"), F.col("l.rule").alias("rule"), F.col("l.pattern").alias("pattern"), F.col("l.category").alias("category"))
    found = met.groupBy("page_id", "url", "c.host", "c.day").agg(F.collect_set(F.when(F.col("l.rule").isNotNull(), entry)).alias("live"))
    categories = F.array_join(F.array_sort(F.array_distinct(F.transform("live", lambda e: e["category"]))), ",")
    longest = F.array_max(F.transform("live", lambda e: F.struct(e["n"].alias("n"), e["rule"].alias("rule"))))["rule"]  # allow < block
    return found.select("page_id", F.coalesce("host", F.lit("")).alias("host"), "day", F.size("live").cast("long").alias("n_active"), categories.alias("categories"), F.coalesce(longest, F.lit("allow")).alias("verdict"))
