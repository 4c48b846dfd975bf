"""URL filters as of the fetch time: dated list entries as validity intervals.

List entries say that a pattern (a host or domain) was added to or removed from a list on a day. Successive entries of
a pattern become intervals of validity. A capture matches a pattern if it is its host or a parent domain and an interval
holds its fetch day; the longest pattern decides, then the interval that began last, then the list's name. Captures are
first reduced to distinct (host, day) pairs, so that a host with a third of all captures is looked up once per day, and
the verdicts are joined back.

Nulls: a capture with a null or hostless url, or a null day, matches nothing and is not blocked; entries with a null
field are ignored. Of several entries of a pattern in one list and on one day, a removal wins. Repeated captures come
back as often as they occur, with equal verdicts. With no entries nothing is blocked; no captures give no rows. Extra
columns of the captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to) from entries (list_name, pattern, action, on); valid_to null: still valid."""
    daily = (
        entries.where("list_name is not null and pattern is not null and action in ('add', 'remove') and `on` is not null")
        .groupBy("list_name", F.lower("pattern").alias("pattern"), "on")
        .agg(F.max("action").alias("action"))
    )
    times = Window.partitionBy("list_name", "pattern").orderBy("on")
    return daily.withColumn("valid_to", F.lead("on").over(times)).where("action = 'add'").select("list_name", "pattern", F.col("on").alias("valid_from"), "valid_to")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels at least (a single label: itself)."""
    labels = F.split(host, r"\.")
    count = F.greatest(F.lit(1), F.size(labels) - 1)
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_on) with host, list_name, pattern and blocked, as of their fetch days."""
    rows = captures.select("page_id", "url", "fetched_on").withColumn("host", host_of(F.col("url")))
    asked = rows.where("host is not null and fetched_on is not null").select("host", "fetched_on").distinct()
    valid = intervals(entries).withColumnRenamed("pattern", "valid_pattern")
    found = asked.select("host", "fetched_on", F.explode(suffixes(F.col("host"))).alias("suffix")).join(
        valid,
        (F.col("suffix") == F.col("valid_pattern")) & (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))),
    )
    # the greatest of (length, begin, name) decides; the name only breaks ties
    order = F.struct(F.length("suffix").alias("length"), "valid_from", "list_name", F.col("suffix").alias("pattern"))
    verdicts = found.groupBy(F.col("host").alias("at_host"), F.col("fetched_on").alias("at_day")).agg(F.max(order).alias("best"))
    joined = rows.join(verdicts, (F.col("host") == F.col("at_host")) & (F.col("fetched_on") == F.col("at_day")), "left")
    return joined.select(
        "page_id", "url", "host", "fetched_on", F.col("best.list_name").alias("list_name"), F.col("best.pattern").alias("pattern"), F.col("best").isNotNull().alias("blocked")
    )


#: Entries of a curated list, (list, pattern, action, day).
CURATED = (
    ("gambling", "casino-win.example.com", "add", "2024-02-01"),
    ("gambling", "free-bets.example.com", "add", "2024-01-15"),
    ("gambling", "free-bets.example.com", "remove", "2024-07-01"),
    ("pharma", "cheap-pills.example.com", "add", "2024-03-10"),
    ("network", "example.net", "add", "2024-06-01"),
    ("network", "example.net", "remove", "2024-09-01"),
    ("network", "example.net", "add", "2024-11-01"),
    ("network", "example.org", "add", "2024-12-01"),
)


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day; the table has none, so page_id stands for one of 2024's days."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """The curated entries, and by rule entries for a third of the hosts: added, removed 60 days later, added again after 150."""
    spark = pages.sparkSession
    curated = spark.createDataFrame(list(CURATED), "list_name string, pattern string, action string, day string").select("list_name", "pattern", "action", F.col("day").cast("date").alias("on"))
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("host")).where(F.length("host") % 3 == 0).distinct()
    added = F.date_add(F.lit("2024-01-01").cast("date"), (F.length("host") * 17 % 200).cast("int"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.date_add(added, d).alias("on")) for a, d in (("add", 0), ("remove", 60), ("add", 150))])).alias("step")
    return curated.unionByName(hosts.select(F.lit("reported").alias("list_name"), F.col("host").alias("pattern"), steps).select("list_name", "pattern", "step.action", "step.on"))


_CURATED_SQL = ",\n  ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in CURATED)
ORACLE = f"""
WITH captures AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched_on
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE length(host) % 3 = 0),
entries(list_name, pattern, action, day) AS (
  SELECT * FROM (VALUES {_CURATED_SQL}) t
  UNION ALL
  SELECT 'reported', host, s.action, CAST(DATE '2024-01-01' + CAST(length(host) * 17 % 200 + s.days AS INTEGER) AS DATE)
  FROM hosts, (VALUES ('add', 0), ('remove', 60), ('add', 150)) s(action, days)),
daily AS (SELECT list_name, pattern, day, max(action) AS action FROM entries GROUP BY ALL),
timed AS (SELECT *, lead(day) OVER (PARTITION BY list_name, pattern ORDER BY day) AS valid_to FROM daily),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM captures),
suffixed AS (
  SELECT page_id, host, fetched_on, array_to_string(labels[k:], '.') AS suffix
  FROM labelled, generate_series(1, 12) g(k) WHERE k <= greatest(1, len(labels) - 1)),
ranked AS (
  SELECT s.page_id, t.list_name, t.pattern,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(t.pattern) DESC, t.day DESC, t.list_name DESC) AS r
  FROM suffixed s JOIN timed t ON t.pattern = s.suffix AND t.action = 'add' AND t.day <= s.fetched_on
       AND (t.valid_to IS NULL OR s.fetched_on < t.valid_to))
SELECT c.page_id, c.url, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, r.list_name, r.pattern, r.page_id IS NOT NULL AS blocked
FROM captures c LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON c.page_id = r.page_id
"""
