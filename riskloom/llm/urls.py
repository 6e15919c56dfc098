"""URL filter lists as a temporal join.

Dated list entries (list, kind, value, day, action) become validity intervals; each capture is judged
by the entries active on the day it was fetched. An entry of kind `host` names one host, one of kind
`domain` a domain with all hosts under it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import free_names

#: Days of one time bucket of the join.
BUCKET = 32
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host, NULL where the URL has none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until): an `add` holds until the next entry for the same value.

    Of several entries on one day a `remove` wins. `until` is exclusive and NULL while open. Entries
    with a NULL in any of the five columns are ignored, as are actions other than add and remove.
    """
    daily = (entries.where("list IS NOT NULL AND kind IN ('host', 'domain') AND value IS NOT NULL "
                           "AND day IS NOT NULL AND action IN ('add', 'remove')")
             .groupBy("list", "kind", F.lower("value").alias("value"), "day")
             .agg(F.max("action").alias("action")))
    later = F.lead("day").over(Window.partitionBy("list", "kind", "value").orderBy("day"))
    return (daily.withColumn("until", later).where("action = 'add'")
            .select("list", "kind", "value", F.col("day").alias("since"), "until"))


def judge(captures: DataFrame, intervals: DataFrame, url: str = "url", day: str = "fetched",
          into: str = "filter") -> DataFrame:
    """Add a struct (host, blocked, lists, since): the lists that held the capture's host that day.

    `lists` are the distinct names in order, joined by commas, and `since` the earliest day from
    which one of the matching entries holds. A capture without host or day is not blocked. Each
    distinct pair of host and day is judged once, and its intervals are met in buckets of `BUCKET`
    days, so neither a busy host nor a long history makes one task heavy. All rows and columns stay;
    one called `into` is replaced.
    """
    own_host, own_day, own_lists, own_since = free_names(captures, "_host", "_day", "_lists", "_since")
    named = captures.withColumn(own_host, host_of(F.col(url))).withColumn(own_day, F.unix_date(F.to_date(day)))
    pairs = (named.select(F.col(own_host).alias("_host"), F.col(own_day).alias("_day"))
             .where("_host IS NOT NULL AND _day IS NOT NULL").distinct())
    span = pairs.agg(F.min("_day"), F.max("_day")).first()
    first, last = (span[0], span[1]) if span[0] is not None else (0, 0)
    held = intervals.select(
        "list", "kind", "value", F.greatest(F.unix_date("since"), F.lit(first)).alias("low"),
        F.coalesce(F.least(F.unix_date("until"), F.lit(last + 1)), F.lit(last + 1)).alias("high"), "since",
    ).where("low < high")
    cells = held.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / BUCKET), F.floor((F.col("high") - 1) / BUCKET))))
    labels = F.split("_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("_host").alias("value"))), parents)
    asked = pairs.select("_host", "_day", F.floor(F.col("_day") / BUCKET).alias("cell"),
                         F.explode(keys).alias("k")).select("_host", "_day", "cell", "k.kind", "k.value")
    found = (asked.join(cells, ["kind", "value", "cell"]).where("low <= _day AND _day < high")
             .groupBy("_host", "_day")
             .agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("_lists"),
                  F.min("since").alias("_since")))
    found = found.withColumnsRenamed(
        {"_host": own_host, "_day": own_day, "_lists": own_lists, "_since": own_since})
    return (named.join(found, [own_host, own_day], "left")
            .withColumn(into, F.struct(
                F.col(own_host).alias("host"), F.col(own_lists).isNotNull().alias("blocked"),
                F.coalesce(own_lists, F.lit("")).alias("lists"), F.col(own_since).alias("since")))
            .drop(own_host, own_day, own_lists, own_since))
