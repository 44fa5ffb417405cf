"""URL filters by dated lists: an as-of join of captures with the entries active when they were fetched.

A list is a log of dated entries that add a domain or remove it. Each addition becomes an interval that
ends with the domain's next entry in the same list. Intervals are cut at the borders of time cells and
joined with captures on (domain, cell), so a domain with a third of all captures is spread over its
cells, and what is left of it in one cell is split by adaptive execution; the join never compares a
capture with more intervals than one domain has in one cell. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm.common import keep, same, table

#: Seconds of a time cell.
CELL = 86_400
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]*\]|[^/:?#\[\]]+)"
#: Hosts that are addresses and have no domains above them.
ADDRESS = r"^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$"


def host(url: Column) -> Column:
    """Host of an absolute URL in lower case, without dots at its end; empty for anything else. An IPv6
    address keeps its brackets."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1), "\\.+$", ""))


def domains(name: Column) -> Column:
    """A host and the domains above it, of two labels at least; a single label and an address stand for
    themselves."""
    labels = F.when(name.rlike(ADDRESS), F.array(name)).otherwise(F.split(name, "\\."))
    above = F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0)))
    return F.array_distinct(F.transform(above, lambda i: F.array_join(F.slice(labels, i + 1, F.greatest(F.size(labels) - i, F.lit(1))), ".")))


def intervals(entries: DataFrame, cell: int = CELL) -> DataFrame:
    """``(list, domain, since, until)`` from ``entries(list, domain, action, at)``, seconds as whole
    numbers: an ``add`` holds from its time up to the next entry of its list and domain (``until`` null:
    for good). Of entries at the same time removal wins; entries without a time, list or domain, or
    with another action, are ignored, and repeated ones count once.

    The next entry is found within the cell, and by one row for each cell across cells, so a domain
    with very many entries is not sorted in one task.
    """
    log = same(entries, ["list", "domain", "action", "at"]).where("list is not null and domain is not null and at is not null and action in ('add', 'remove')")
    log = log.groupBy("list", F.lower(F.regexp_replace("domain", "\\.+$", "")).alias("domain"), F.col("at").cast("long").alias("at")).agg(F.max("action").alias("action"))
    log = keep(log.withColumn("cell", F.floor(F.col("at") / cell)), "entries")
    first = log.groupBy("list", "domain", "cell").agg(F.min("at").alias("first"))
    follow = first.withColumn("after", F.lead("first").over(Window.partitionBy("list", "domain").orderBy("cell"))).drop("first")
    inside = log.withColumn("next", F.lead("at").over(Window.partitionBy("list", "domain", "cell").orderBy("at")))
    whole = inside.join(follow, ["list", "domain", "cell"])
    return whole.where("action = 'add'").select("list", "domain", F.col("at").alias("since"), F.coalesce("next", "after").alias("until"))


def active_entries(captures: DataFrame, entries: DataFrame, cell: int = CELL) -> DataFrame:
    """``(page_id, host, fetched, n_active, lists, blocked)`` for every row of ``captures(page_id, url,
    fetched)``: how many entries for its host or a domain above it were active when it was fetched, and
    the lists they are in, by name and joined by commas. ``fetched`` counts seconds; an entry is active
    from its own second to the one before it ends.

    A null or malformed URL has an empty host, and a null time no active entries; both are kept. Rows
    that repeat give a row each. Other columns are ignored; no captures give an empty result, and no
    entries block nothing.
    """
    rows = same(captures, ["page_id", "url", "fetched"]).select("page_id", host(F.col("url")).alias("host"), F.col("fetched").cast("long").alias("fetched"))
    rows = rows.withColumn("copy", F.xxhash64("page_id", "host", "fetched"))
    rows = keep(rows, "captures")
    spans = keep(intervals(entries, cell), "intervals")
    border = rows.agg(F.min("fetched"), F.max("fetched")).first()
    asked = rows.where("host <> '' and fetched is not null").distinct()
    asked = asked.select("page_id", "host", "fetched", F.explode(domains(F.col("host"))).alias("domain"), F.floor(F.col("fetched") / cell).alias("cell"))
    low, high = (0, -1) if border[0] is None else border
    spans = spans.where((F.col("since") <= high) & (F.coalesce("until", F.lit(high + 1)) > low))
    begin, end = F.greatest("since", F.lit(low)), F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high))
    cells = spans.where(begin <= end).withColumn("cell", F.explode(F.sequence(F.floor(begin / cell), F.floor(end / cell))))
    met = asked.join(cells, ["domain", "cell"]).where("fetched >= since and (until is null or fetched < until)")
    names = F.array_join(F.array_sort(F.collect_set("list")), ",")
    found = met.groupBy("page_id", "host", "fetched").agg(F.count("*").alias("n_active"), names.alias("lists"))
    found = found.select(F.xxhash64("page_id", "host", "fetched").alias("copy"), *[F.col(c).alias(f"m_{c}") for c in ("page_id", "host", "fetched")], "n_active", "lists")
    alike = F.expr("copy = m_copy and page_id <=> m_page_id and host = m_host and fetched = m_fetched")
    joined = rows.join(found.withColumnRenamed("copy", "m_copy"), alike, "left")
    count = F.coalesce("n_active", F.lit(0).cast("long"))
    return joined.select("page_id", "host", "fetched", count.alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), (count > 0).alias("blocked"))


# -- the query: captures and lists that follow from the pages -----------------------------------

#: Lists, the remainder of a domain's number that puts it there, and the days after which it goes and comes again.
FEEDS = {"adult": (3, 0, 9, 4), "malware": (4, 1, 5, 6), "spam": (5, 2, 12, 3)}


def _number(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetch in January 2024 that follows from their number."""
    return pages.select("page_id", "url", (F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(43_200)) * 60).alias("fetched"))


def feeds_of(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts and domains of the pages: each list adds those whose number leaves its
    remainder, removes two thirds of them some days later and adds half of those again."""
    names = pages.select(F.explode(domains(host(F.col("url")))).alias("domain")).where("domain <> ''").distinct().withColumn("x", _number(F.col("domain")))
    steps = []
    for name, (modulus, rest, stay, away) in FEEDS.items():
        at = F.lit(1_704_067_200) + F.col("x") % 20 * 86_400 + F.col("x") % 1_440 * 60
        out = at + stay * 86_400
        item = lambda action, when: F.struct(F.lit(action).alias("action"), when.cast("long").alias("at"))
        log = F.array(item("add", at), F.when(F.col("x") % 9 < 6, item("remove", out)), F.when(F.col("x") % 9 < 3, item("add", out + away * 86_400)))
        steps.append(names.where(F.col("x") % modulus == rest).select(F.lit(name).alias("list"), "domain", F.inline(F.array_compact(log))))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return active_entries(captures_of(pages), feeds_of(pages))


_FEED = " UNION ALL ".join(
    f"SELECT '{name}' AS list, domain, x, {stay} AS stay, {away} AS away FROM n WHERE x % {modulus} = {rest}" for name, (modulus, rest, stay, away) in FEEDS.items()
)
SQL = rf"""
WITH c AS (
  SELECT page_id, lower(regexp_replace(regexp_extract(coalesce(url, ''),
      '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]*\]|[^/:?#\[\]]+)', 1), '\.+$', '')) AS host,
    1704067200 + (page_id * 7919 % 43200) * 60 AS fetched
  FROM pages
), l AS (
  SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^(\[.*\]|\d{{1,3}}(\.\d{{1,3}}){{3}})$') THEN [host] ELSE string_split(host, '.') END AS p
  FROM c WHERE host <> ''
), h AS (
  SELECT DISTINCT host, array_to_string(p[i + 1:], '.') AS domain FROM (SELECT *, unnest(range(greatest(len(p) - 1, 1))) AS i FROM l)
), n AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 7))::BIGINT AS x FROM (SELECT DISTINCT domain FROM h)
), f AS ({_FEED}), t AS (
  SELECT *, 1704067200 + x % 20 * 86400 + x % 1440 * 60 AS came FROM f
), e AS (
  SELECT list, domain, came AS since, CASE WHEN x % 9 < 6 THEN came + stay * 86400 END AS until FROM t
  UNION ALL SELECT list, domain, came + (stay + away) * 86400, NULL FROM t WHERE x % 9 < 3
), m AS (
  SELECT page_id, host, fetched, count(*) AS n_active, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists
  FROM (SELECT DISTINCT * FROM c) c JOIN h USING (host) JOIN e USING (domain)
  WHERE fetched >= since AND (until IS NULL OR fetched < until) GROUP BY ALL
)
SELECT page_id, host, fetched, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(n_active, 0) > 0 AS blocked
FROM c LEFT JOIN m USING (page_id, host, fetched)
"""
