"""Temporal list join: captures against the list entries that were active when they were fetched.

A dated entry says that a list names a domain from then on, or no longer.  The entries of a domain become validity
intervals.  Each distinct host and fetch time is joined, as of that time, with the intervals of its own name and of
every parent domain; the longest domain counts, and every capture of that host and time gets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_IDS, cut, prepare


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port or trailing dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(host, r"\.+$", "")), F.lit(""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, domain, valid_from, valid_to) from dated entries (list_name, domain, at, active).

    An entry holds until the next of the same list and domain; ``valid_to`` is null while it still holds.  Of
    entries at one time an active one wins.  Entries with a null in any column are void; repeats of a state
    extend it.
    """
    e = entries.select("list_name", F.lower("domain").alias("domain"), "at", "active").dropna()
    one = e.groupBy("list_name", "domain", "at").agg(F.max("active").alias("active"))
    line = Window.partitionBy("list_name", "domain").orderBy("at")
    changed = one.withColumn("was", F.lag("active").over(line)).where("was is null or was <> active")
    ends = changed.withColumn("valid_to", F.lead("at").over(line))
    return ends.where("active").select("list_name", "domain", F.col("at").alias("valid_from"), "valid_to")


def temporal_list_join(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Add ``host``, ``blocked``, ``list_name``, ``domain`` and ``since`` to every capture.

    Interval ends are open: an entry removed at the fetch time is no longer active.  Of several active entries the
    longest domain counts, then the first list name, then the latest start.  A capture with null url, host or fetch
    time is not blocked; rows, repeated ones too, stay as they are.
    """
    prepare(captures.sparkSession)
    new = ["host", "blocked", "list_name", "domain", "since"]
    if set(new) & set(captures.columns):
        raise ValueError(f"columns {new} must be new")
    spans = cut(validity_intervals(entries))
    t = F.col(f"`{fetched}`")
    # the caller's columns travel in one struct, so that no name of theirs can meet one of these
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns])
    seen = captures.select(row.alias("row"), host_of(F.col(f"`{url}`")).alias("host"), t.alias("at"))
    probes = seen.select("host", "at").dropna().distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    asked = probes.select("host", "at", F.explode(parents).alias("domain"))
    active = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    # a top-level label is a parent of most hosts: it is no key of a shuffle while the entries that name one are few
    bare = ~F.col("domain").contains(".")
    hits = _sized(spans.where(bare), asked.where(bare), active).unionByName(asked.where(~bare).join(spans.where(~bare), "domain").where(active))
    found = F.struct((-F.length("domain")).alias("rank"), "list_name", F.negative(F.unix_micros(F.col("valid_from").cast("timestamp"))).alias("newest"), "domain", "valid_from")
    best = cut(hits.groupBy("host", "at").agg(F.min(found).alias("hit")))
    if best.count() <= BROADCAST_IDS:
        best = F.broadcast(best)
    # captures without a host or a time match nothing; in the join they would all be one key
    whole = F.col("host").isNotNull() & F.col("at").isNotNull()
    joined = seen.where(whole).join(best, ["host", "at"], "left").select("row", "host", "hit")
    joined = joined.unionByName(seen.where(~whole).select("row", "host", F.lit(None).cast(best.schema["hit"].dataType).alias("hit")))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in captures.columns],
        "host",
        F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.list_name").alias("list_name"),
        F.col("hit.domain").alias("domain"),
        F.col("hit.valid_from").alias("since"),
    )


def _sized(spans: DataFrame, asked: DataFrame, active: Column) -> DataFrame:
    """The probes with their active intervals; these are broadcast if counted to be few, else the join shuffles."""
    return asked.join(F.broadcast(spans) if spans.count() <= BROADCAST_IDS else spans, "domain").where(active)


def example_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures.  The table has no fetch time; page_id stands for one, spread over 2024."""
    day = (F.pmod(F.col("page_id"), F.lit(365)) * 37 % 365).cast("int")  # the product of a large id would overflow
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def example_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages and their parents: named, dropped and named again, by their digest."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domain = host.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]+\.", ""))).alias("domain")).distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.col("domain").cast("binary")), at, 4), 16, 10).cast("int")
    seeds = domain.select("domain", number(1).alias("a"), number(5).alias("b"), number(9).alias("c")).where("a % 3 = 0")
    steps = F.array(
        F.struct((F.col("b") % 200).alias("day"), F.lit(True).alias("active")),
        F.struct((F.col("b") % 200 + 20 + F.col("c") % 60).alias("day"), F.lit(False).alias("active")),
        F.struct((F.col("b") % 200 + 110 + F.col("c") % 90).alias("day"), F.lit(True).alias("active")),
    )
    name = F.when(F.col("a") % 2 == 0, "spam").otherwise("adult")
    line = seeds.select("domain", name.alias("list_name"), F.explode(steps).alias("s"))
    return line.select("list_name", "domain", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s.day")).alias("at"), "s.active")


def op4_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as of its fetch day, against a dated domain list."""
    pages = prepare(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return temporal_list_join(example_captures(pages), example_entries(pages))


QUERIES = {"op4_temporal_lists": op4_temporal_lists}
ORACLES = {
    "op4_temporal_lists": r"""
with cap as (
  select page_id, url, date '2024-01-01' + cast((page_id * 37) % 365 as integer) as fetched,
    nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', '')), '') as host
  from pages
),
dom as (
  select host as domain from cap where host is not null
  union select regexp_replace(host, '^[^.]+\.', '') from cap where host is not null
),
seed as (
  select domain, ('0x' || substr(md5(domain), 1, 4))::int as a, ('0x' || substr(md5(domain), 5, 4))::int as b,
    ('0x' || substr(md5(domain), 9, 4))::int as c from dom
),
spans as (
  select domain, case when a % 2 = 0 then 'spam' else 'adult' end as list_name,
    date '2024-01-01' + b % 200 as valid_from, date '2024-01-01' + (b % 200 + 20 + c % 60) as valid_to from seed where a % 3 = 0
  union all
  select domain, case when a % 2 = 0 then 'spam' else 'adult' end,
    date '2024-01-01' + (b % 200 + 110 + c % 90), null from seed where a % 3 = 0
),
hit as (
  select page_id, fetched, s.*, row_number() over (partition by page_id order by length(s.domain) desc, list_name, valid_from desc, s.domain) as r
  from cap join spans s
    on (cap.host = s.domain or ends_with(cap.host, '.' || s.domain)) and s.valid_from <= fetched and (s.valid_to is null or fetched < s.valid_to)
)
select cap.page_id, url, cap.fetched, host, r is not null as blocked, list_name, domain, valid_from as since
from cap left join hit on cap.page_id = hit.page_id and r = 1
""",
}
