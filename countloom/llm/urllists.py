"""Filtering captures by dated URL lists.

List entries say that a domain joins or leaves a list on a day. They become validity intervals [day, next entry of the same list and domain).
A capture meets the intervals of its host and of each parent domain, so the join is on equality of the domain,
with the day of the fetch inside the interval: an as-of join that finds the one entry in force for every list and domain. Captures of one host are many, the
intervals of a domain are few; adaptive execution splits hot hosts.

Defined results: a capture without host, or without a fetch day, meets no list. Entries without list, domain, day or action do not count. Of entries of the
same day, leaving wins. Repeated entries change nothing; repeated captures are all returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, domain, valid_from, valid_to): when a domain is on a list; ``valid_to`` is null while it stays.

    ``entries``: list_name, domain, day, listed (boolean).
    """
    given = entries.select("list_name", F.lower("domain").alias("domain"), F.col("day").cast("date").alias("day"), "listed").dropna()
    days = given.groupBy("list_name", "domain", "day").agg(F.min("listed").alias("listed"))
    history = Window.partitionBy("list_name", "domain").orderBy("day")
    spans = days.withColumn("valid_to", F.lead("day").over(history)).filter("listed")
    return spans.select("list_name", "domain", F.col("day").alias("valid_from"), "valid_to")


def host_of(url):
    """Lower-case host of a URL column; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, lists): the lists that each capture (page_id, url, fetched) was on when it was fetched, sorted."""
    rows = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"))
    labels = F.split(host_of(F.col("url")), r"\.")
    own = rows.select("url", "fetched").distinct().withColumn("labels", labels)
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    asked = own.filter("labels IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched", F.explode(parents).alias("domain"))
    active = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = asked.join(intervals(entries), "domain").filter(active)
    found = met.groupBy("url", "fetched").agg(F.array_sort(F.collect_set("list_name")).alias("lists"))
    return rows.join(found, ["url", "fetched"], "left").select(
        "page_id", "url", "fetched", F.coalesce("lists", F.array().cast("array<string>")).alias("lists")
    )
