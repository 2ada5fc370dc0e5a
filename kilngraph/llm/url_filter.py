"""URL filters by a temporal list join: dated list entries become validity intervals, and an as-of join evaluates every
capture against the entries that were active when it was fetched.

Intervals are dealt to the months they share with the captures' span of dates, so the join is an equality on entry and month
with a check of the dates behind it: no range join, and a host with many captures is an ordinary skewed key that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, value, since, until): when entries were active, from dated events (list, kind, value, action, at).

    kind: domain (with its subdomains) or prefix (host and path directory, as host/a/).  action: add or remove; of events
    of one day the removal comes first.  An addition while active and a removal while not change nothing.  Events with
    a null are ignored.  until is exclusive, null while still active.
    """
    events = events.select("list", "kind", "value", "action", "at").na.drop().distinct()
    order = Window.partitionBy("list", "kind", "value").orderBy("at", F.desc("action"))  # an entry's own events
    before = F.lag("action", 1, "remove").over(order)
    turns = events.withColumn("before", before).where(F.col("before") != F.col("action"))
    turns = turns.withColumn("until", F.lead("at").over(order))
    return turns.where("action = 'add'").select("list", "kind", "value", F.col("at").alias("since"), "until").where("until is null or until > since")


def month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def candidates(url: Column, host: Column) -> Column:
    """The entries that would match a URL: its host and all parent domains, and its directories."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")).alias("value")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.concat(domains, F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))))


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Per row of captures (page_id, url, fetched): page_id, url, host, fetched, blocked, n_entries (active entries that
    match), list and entry (of the longest entry, ties by list), since.

    A null or malformed URL has host '' and is not blocked, nor is a capture without a date.  Rows that repeat give a
    row each.
    """
    rows = captures.groupBy(F.col("page_id").cast("long").alias("page_id"), "url", "fetched").agg(F.count("*").alias("rows"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    asked = rows.select("page_id", "url", "fetched", F.inline(candidates(F.col("url"), F.col("host"))), month(F.col("fetched")).alias("month"))
    seen = captures.agg(F.min("fetched"), F.max("fetched")).first()
    low, high = (F.lit(x).cast("date") for x in seen)  # null without captures: no interval then
    active = intervals(events).where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    active = active.withColumn("month", F.explode(F.sequence(month(F.greatest("since", low)), month(F.least("until", high)))))
    hit = asked.join(active, ["kind", "value", "month"]).where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = F.min(F.struct((-F.char_length("value")).alias("l"), "list", "value", "since"))
    hit = hit.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n"), best.alias("best"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("page_id", "url", "fetched")]
    out = rows.alias("r").join(hit.alias("h"), same[0] & same[1] & same[2], "left").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select(
        "r.page_id", "r.url", "host", F.date_format("r.fetched", "yyyy-MM-dd").alias("fetched"), F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.col("best.list").alias("list"), F.col("best.value").alias("entry"), F.date_format("best.since", "yyyy-MM-dd").alias("since"),
    )


def draw(key: Column, n: int) -> Column:
    """A number below n that follows from a string, the same in any engine with MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(n))


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch date: a day of 2024 by page_id."""
    day = F.pmod(F.col("page_id").cast("long"), F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def sample_lists(pages: DataFrame) -> DataFrame:
    """Dated events over the hosts that pages has: hosts and directories that are added, removed and added again."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(F.col("url"), PATH, 1).alias("path")).where("host <> ''")
    start = F.lit("2024-01-01").cast("date")

    def events(values: DataFrame, kind: str, name: str, share: int) -> DataFrame:
        values = values.distinct().where(draw(F.concat(F.lit(f"{name}|"), "value"), 10) < share)
        first = draw(F.concat(F.lit(f"{name}|1|"), "value"), 200).cast("int")
        second = first + 1 + draw(F.concat(F.lit(f"{name}|2|"), "value"), 90).cast("int")
        third = second + 1 + draw(F.concat(F.lit(f"{name}|3|"), "value"), 60).cast("int")
        rows = F.array(*[F.struct(F.lit(a).alias("action"), F.date_add(start, d).alias("at")) for a, d in (("add", first), ("remove", second), ("add", third))])
        return values.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "value", F.inline(rows))

    parent = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("value"))
    directory = hosts.where(F.regexp_extract("path", r"^(/[^/]*/)", 1) != "").select(F.concat("host", F.regexp_extract("path", r"^(/[^/]*/)", 1)).alias("value"))
    return events(hosts.select(F.col("host").alias("value")), "domain", "spam", 5).unionByName(events(parent, "domain", "phishing", 2)).unionByName(events(directory, "prefix", "adult", 4))
