"""URL filters by dated lists: validity intervals, joined as of each fetch.

A list is a history: dated entries block or allow a host, a domain with all below
it, or a path prefix, or lift such an entry. Each entry holds until the next entry of the
same list for the same pattern. A capture meets the patterns of its URL (its host,
every parent domain, every prefix of its path) and is judged by the entries that
held when it was fetched: the longest pattern wins, and of equal patterns `block`.

A pattern's intervals form one array, so the join is an equality on the pattern
with one row on the list's side: a host with a third of all captures can be split, and
no capture is joined with intervals that the pattern does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import saved


def host_of(url: Column) -> Column:
    """Lower-cased host: without scheme, user, port and final dot; empty if there is none."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    authority = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$|\.+$|\.+:[0-9]*$", "")


def path_of(url: Column) -> Column:
    """The path without query and fragment; at least a slash."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def patterns_of(url: Column) -> Column:
    """All patterns that the URL meets: `=host`, `.domain` for it and its parents, `host/path` prefixes by whole segments."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), host)), domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, from, until) of `entries` (list, pattern, day, action: block, allow or lift).

    Of entries of one list, pattern and day the last in the order allow, block,
    lift holds. `until` is excluded and null while the entry still holds. Entries
    with a null list, pattern, day or action are left out.
    """
    order = F.when(F.col("action") == "lift", 2).when(F.col("action") == "block", 1).otherwise(0)
    known = entries.filter(F.col("action").isin("block", "allow", "lift")).dropna(subset=["list", "pattern", "day"])
    one = known.groupBy("list", "pattern", "day").agg(F.max_by("action", order).alias("action"))
    until = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return one.select("list", "pattern", "action", F.col("day").alias("from"), until.alias("until")).filter("action != 'lift'")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched): page_id, n_active, pattern, action, blocked.

    n_active: entries that held at the fetch. pattern and action: of the winning
    one, null if none held. A null URL or fetch time meets no entry. Repeated
    captures are judged each. An empty list blocks nothing.
    """
    held = F.collect_list(F.struct("list", "action", "from", "until")).alias("held")
    by_pattern = intervals(entries).groupBy(F.col("pattern").alias("_p")).agg(held)  # a pattern's own history
    rows = saved(captures.select("page_id", F.col("url").cast("string").alias("url"), "fetched").withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", "fetched", F.explode(patterns_of(F.col("url"))).alias("_p")).join(by_pattern, "_p")
    active = F.filter("held", lambda e: (e["from"] <= F.col("fetched")) & (e["until"].isNull() | (F.col("fetched") < e["until"])))
    met = met.select("row", "_p", active.alias("active")).filter(F.size("active") > 0)
    block = F.exists("active", lambda e: e["action"] == "block")
    rank = F.struct(F.length("_p"), F.col("_p"), F.when(block, "block").otherwise("allow").alias("action"))
    best = met.groupBy("row").agg(F.sum(F.size("active")).cast("bigint").alias("n_active"), F.max(rank).alias("best"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best._p").alias("pattern"), F.col("best.action").alias("action"), F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"))


#: The query's captures were fetched on days of 2024 that follow from page_id; the tables have no dates.
EPOCH = "2024-01-01"


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(f"date_add(date'{EPOCH}', cast(pmod(page_id * 37, 365) as int))").alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the table: of every host (by its length) a ban, a pardon, or a ban of its domain, and bans of first path segments."""
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("h")).filter("h != ''").distinct()
    day = lambda e: F.expr(f"date_add(date'{EPOCH}', cast({e} as int))")
    n = "length(h)"
    parts = [
        hosts.filter(f"{n} % 3 = 0").select(F.lit("abuse").alias("list"), F.concat(F.lit("="), "h").alias("pattern"), day(f"{n} * 5 % 200").alias("day"), F.lit("block").alias("action")),
        hosts.filter(f"{n} % 3 = 0").select(F.lit("abuse"), F.concat(F.lit("="), "h"), day(f"{n} * 5 % 200 + 60"), F.lit("lift")),
        hosts.filter(f"{n} % 2 = 0").select(F.lit("spam"), F.concat(F.lit("."), F.substring_index("h", ".", -3)), day(f"{n} * 11 % 150"), F.lit("block")),
        hosts.filter(f"{n} % 4 = 0").select(F.lit("spam"), F.concat(F.lit("="), "h"), day(f"{n} * 11 % 150 + 30"), F.lit("allow")),
        hosts.filter(f"{n} % 5 = 0").select(F.lit("adult"), F.concat("h", F.lit("/fr")), day(f"{n} * 3 % 300"), F.lit("block")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


SQL = rf"""with p as (select page_id, cast(date '{EPOCH}' + cast(page_id * 37 % 365 as int) as date) as fetched,
    regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$|\.+$|\.+:[0-9]*$', '') as h,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as seg from pages),
  hosts as (select distinct h, length(h) as n from p where h <> ''),
  e as (select 'abuse' as list, '=' || h as pattern, n * 5 % 200 as d, 'block' as action from hosts where n % 3 = 0
    union select 'abuse', '=' || h, n * 5 % 200 + 60, 'lift' from hosts where n % 3 = 0
    union select 'spam', '.' || array_to_string(list_reverse(list_reverse(string_split(h, '.'))[1:3]), '.'), n * 11 % 150, 'block' from hosts where n % 2 = 0
    union select 'spam', '=' || h, n * 11 % 150 + 30, 'allow' from hosts where n % 4 = 0
    union select 'adult', h || '/fr', n * 3 % 300, 'block' from hosts where n % 5 = 0),
  o as (select list, pattern, cast(date '{EPOCH}' + cast(d as int) as date) as since, max(case action when 'lift' then 2 when 'block' then 1 else 0 end) as a from e group by all),
  i as (select list, pattern, a, since, lead(since) over (partition by list, pattern order by since) as until from o),
  met as (select distinct page_id, fetched, pattern from (
    select page_id, fetched, '=' || h as pattern from p where h <> ''
    union all select page_id, fetched, '.' || array_to_string(string_split(h, '.')[k:], '.') from (select *, unnest(range(1, len(string_split(h, '.')) + 1)) as k from p where h <> '')
    union all select page_id, fetched, h || '/' || array_to_string(seg[1:k], '/') from (select *, unnest(range(1, len(seg) + 1)) as k from p where h <> ''))),
  act as (select page_id, pattern, count(*) as n, max(a) as a from met join i using (pattern) where a < 2 and since <= fetched and (until is null or fetched < until) group by page_id, pattern),
  best as (select page_id, sum(n)::bigint as n_active, arg_max(struct_pack(pattern := pattern, a := a), (length(pattern), pattern)) as b from act group by page_id)
  select page_id, coalesce(n_active, 0) as n_active, b.pattern as pattern, case b.a when 1 then 'block' when 0 then 'allow' end as action, coalesce(b.a = 1, false) as blocked from p left join best using (page_id)"""
