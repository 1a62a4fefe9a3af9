"""Operator 3, URL filters: a temporal join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a last dot, an IPv6 address with its brackets; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """A host and all its parent domains, the most specific first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of dated entries (domain, listed_on, category).

    An entry holds until the next one of its domain; a null category takes the domain off the list from that date
    on.  Of several entries of one domain and date the greatest category counts (nulls least).  Entries without domain or
    date are no entries.
    """
    days = entries.select(F.lower("domain").alias("domain"), F.col("listed_on").alias("valid_from"), "category").dropna(subset=["domain", "valid_from"])
    days = days.groupBy("domain", "valid_from").agg(F.max("category").alias("category"))
    following = F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from"))
    return days.withColumn("valid_to", following).where("category is not null")


def as_of(times: DataFrame, spans: DataFrame) -> DataFrame:
    """Of each (domain, at) the interval that holds then, if one does: domain, at, category.

    Times and beginnings of intervals are one table, in which the last beginning is carried forward: inside a day by rows, and over days by
    the last of each, so that a domain with very many times is as many window partitions as it has days.
    """
    span = F.struct("valid_from", "valid_to", "category")
    asked = times.select("domain", "at", F.lit(1).alias("kind"), F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType).alias("span"))
    both = spans.select("domain", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), span.alias("span")).unionByName(asked).withColumn("day", F.to_date("at"))
    inside = Window.partitionBy("domain", "day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("domain").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("domain", "day").agg(F.max_by("span", F.when(F.col("kind") == 0, F.col("at"))).alias("newest"))
    days = days.select("domain", "day", F.last("newest", ignorenulls=True).over(earlier).alias("before"))
    held = both.withColumn("own", F.last("span", ignorenulls=True).over(inside)).where("kind = 1").join(days, ["domain", "day"])
    found = held.select("domain", "at", F.coalesce("own", "before").alias("s"))
    return found.where(F.col("s").isNotNull() & (F.col("s.valid_to").isNull() | (F.col("at") < F.col("s.valid_to")))).select("domain", "at", "s.category")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """Judge every capture against the entries active when it was fetched: id, host, domain, category, blocked.

    The entry of the most specific domain decides.  Captures are first reduced to distinct hosts and times, and these to distinct times of
    the domains on the list, so a host or domain that holds a third of all captures is few rows in the as-of join and its text never moves;
    verdicts go back by domain and time, then by host and time.  A null URL, time or host matches nothing and is not blocked;
    a very long URL is parsed whole; repeated rows are judged alike; an empty list or table blocks nothing; other columns, whatever their names, are not read.
    """
    slim = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("at"))
    asked = slim.dropna(subset=["host", "at"]).select("host", "at").distinct()
    spans = intervals(entries)
    keys = asked.select("host", "at", F.posexplode(domains_of(F.col("host"))).alias("depth", "domain")).join(spans.select("domain").distinct(), "domain", "left_semi")
    active = as_of(keys.select("domain", "at").distinct(), spans)
    verdict = keys.join(active, ["domain", "at"]).groupBy("host", "at").agg(F.min_by(F.struct("domain", "category"), "depth").alias("hit"))
    judged = slim.join(verdict, ["host", "at"], "left")
    return judged.select(F.col("id").alias(id_col), "host", F.col("hit.domain").alias("domain"), F.col("hit.category").alias("category"), F.col("hit").isNotNull().alias("blocked"))
