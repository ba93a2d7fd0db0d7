"""URL filters by temporal list join: a capture is judged by the entries active when it was fetched.

A list is a log of dated changes: an entry - a host, which covers its
subdomains, or a host with a path - is added or removed on a day.  Changes
become validity intervals, from the day of an addition to the day of the next
removal.  Each capture is looked up under its host, every parent domain and its
host with path; the as-of join then keeps the interval that holds the fetch
day, and of several entries the longest decides.

Only matches are grouped, by row, so a host with a third of all captures isn't
one group.  The list is broadcast up to ``BROADCAST_ENTRIES`` entries; a longer
one is joined by a shuffle, where adaptive execution splits hot hosts.

Defined results: a null or unreadable url has a null host and is not blocked; a
capture without a fetch day is not blocked; the first of changes on the same day
is overruled by the last one in (action, category) order, so an addition
and a removal on one day leave the entry removed; a repeated addition changes
nothing; repeated rows give repeated rows; an empty table or list gives an empty
result or blocks nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import durable

#: Entries that are broadcast at most.
BROADCAST_ENTRIES = 200_000

#: The default list: entry, action, day, category.
CHANGES = [
    *[(f"{name}.example.{top}", "add", day, category) for name, category, day in (("spam-farm", "spam", "2023-02-01"), ("cheap-pills", "spam", "2023-03-15"), ("casino-win", "gambling", "2023-01-10"), ("free-bets", "gambling", "2023-06-01"), ("adult-x", "adult", "2023-01-01"), ("ads-track", "ads", "2023-09-01")) for top in ("com", "net", "org")],
    ("casino-win.example.com", "remove", "2023-08-01", "gambling"),
    ("casino-win.example.com", "add", "2024-02-01", "gambling"),
    ("m.casino-win.example.com", "add", "2023-07-01", "gambling"),
    ("free-bets.example.net", "remove", "2024-01-01", "gambling"),
    ("ads-track.example.org", "remove", "2023-09-01", "ads"),
    ("ads-track.example.org", "add", "2024-05-01", "ads"),
    ("tionble.example.org/en", "add", "2023-04-01", "mirror"),
]


def host_of(url: Column) -> Column:
    """The host of an http or https url in lower case, without user, port and last dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def keys_of(host: Column, url: Column) -> Column:
    """What a capture is looked up under: host, parent domains, and host with each leading part of the path."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+/([^?#]*)", 1), r"/+$", "")
    steps = F.split(path, "/+")
    under = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), k), "/")))
    return F.when(path == "", parents).otherwise(F.concat(parents, under))


def intervals(changes: DataFrame) -> DataFrame:
    """entry and history, an array of (since, until, category), from entry, action, day, category; until is null while it lasts."""
    day = W.partitionBy("entry", "day").orderBy(F.col("action").desc(), F.col("category").desc_nulls_last())
    entry = W.partitionBy("entry").orderBy("day")
    last = changes.where("entry IS NOT NULL AND day IS NOT NULL").withColumn("n", F.row_number().over(day)).where("n = 1")
    turns = last.withColumn("before", F.lag("action").over(entry)).where("before IS NULL OR before <> action")
    spans = turns.withColumn("until", F.lead("day").over(entry)).where("action = 'add'")
    return spans.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct(F.col("day").alias("since"), "until", "category"))).alias("history"))


def judge(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """captures with host, entry, listed_on, category and blocked, which replace columns of these names."""
    kept = [c for c in captures.columns if c not in ("host", "entry", "listed_on", "category", "blocked")]
    rows = durable(captures.select(*kept, F.monotonically_increasing_id().alias("__row"), host_of(F.col(url)).alias("__host")))
    spans = durable(intervals(changes)).select(F.col("entry").alias("__entry"), F.col("history").alias("__history"))
    if spans.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        spans = F.broadcast(spans)
    keys = F.explode(F.array_distinct(keys_of(F.col("__host"), F.col(url))))
    looked = rows.where(F.col("__host").isNotNull()).select("__row", F.col(fetched).alias("__on"), keys.alias("__entry"))
    active = F.filter("__history", lambda x: (x["since"] <= F.col("__on")) & (x["until"].isNull() | (F.col("__on") < x["until"])))
    found = looked.join(spans, "__entry").select("__row", "__entry", F.explode(active).alias("span"))
    named = F.struct(F.col("__entry").alias("entry"), F.col("span.since").alias("listed_on"), F.col("span.category").alias("category"))
    longest = found.groupBy("__row").agg(F.max_by(named, F.struct(F.length("__entry"), "__entry")).alias("__best"))
    out = rows.join(longest, "__row", "left")
    return out.select(*kept, F.col("__host").alias("host"), *[F.col(f"__best.{c}").alias(c) for c in ("entry", "listed_on", "category")], F.col("__best").isNotNull().alias("blocked"))


def default_changes(spark) -> DataFrame:
    return spark.createDataFrame(CHANGES, "entry string, action string, day string, category string").withColumn("day", F.to_date("day"))


def with_fetch_day(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched_on: the pages table has no fetch time, so captures are spread over two years by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")).alias("fetched_on"))
