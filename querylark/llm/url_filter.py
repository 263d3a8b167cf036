"""URL filters as a temporal join: dated entries of block lists become validity intervals, and each capture is judged by the entries
that were active when it was fetched, for its host and every parent domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylark.llm.common import BROADCAST_ROWS, materialize

#: Copies of a table that is too large to broadcast, so that a key with a third of all rows isn't one task.
SALT = 16
#: Longest interval piece: an entry that is active for long is cut by months, and captures meet only the pieces of their month.
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and a trailing dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(found) > 0, F.regexp_replace(found, r"\.$", ""))


def suffixes(name: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, since, until (exclusive; null: still active) from entries (list, pattern, effective date, action add or remove).

    Entries of one day count as one, in which remove wins. Rows with a null in any of the four are no entries; a repeated add
    goes on, a remove without an add does nothing. An empty table gives no intervals; other columns are left out."""
    own = entries.select("list", F.lower("pattern").alias("pattern"), F.col("effective").cast("date").alias("effective"), (F.col("action") == "add").alias("active"))
    daily = own.dropna().groupBy("list", "pattern", "effective").agg(F.min("active").alias("active"))
    following = F.lead("effective").over(Window.partitionBy("list", "pattern").orderBy("effective"))
    return daily.withColumn("until", following).filter("active").select("list", "pattern", F.col("effective").alias("since"), "until")


def salted(many: DataFrame, few: DataFrame, on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """A join whose left side may have any share of its rows in one key. The right side is broadcast if counted to be at most
    BROADCAST_ROWS; else it is copied SALT times, and rows of keys that it doesn't have don't meet in one task either: a domain such as
    com is asked for by every capture, yet in no list."""
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), on, how)
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("salt", F.pmod(by, F.lit(SALT)).cast("int")).join(copies, [*on, "salt"], how).drop("salt")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """page_id, host, fetched (date), blocked, lists (names of the lists with an active entry, sorted, comma-joined; '' if none).

    A null or relative URL, or a null date, is blocked by nothing. Repeated captures are judged each, null ids are carried, other
    columns are left out; without captures there are no rows, without entries nothing is blocked. Captures are reduced to
    distinct (host, day) before the join, so a host with any share of the captures adds one row a day."""
    own = captures.select(captures[id_col].alias("page_id"), host(captures[url_col]).alias("host"), captures[fetched_col].cast("date").alias("fetched"))
    valid = intervals(entries)
    last = own.agg(F.max("fetched")).first()[0]
    ends = F.least(F.coalesce(F.date_sub("until", 1), F.lit(FOREVER).cast("date")), F.lit(last).cast("date"))
    pieces = valid.filter(F.col("since") <= F.lit(last).cast("date")).select("list", "pattern", "since", "until", F.explode(F.sequence(F.trunc("since", "month"), ends, F.expr("interval 1 month"))).alias("month"))
    days = own.dropna(subset=["host", "fetched"]).select("host", "fetched").distinct()
    asked = days.select("host", "fetched", F.trunc("fetched", "month").alias("month"), F.explode(suffixes(F.col("host"))).alias("pattern"))
    active = salted(asked, materialize(pieces), ["pattern", "month"], F.xxhash64("host", "fetched")).filter((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    verdicts = materialize(active.groupBy("host", "fetched").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")))
    joined = salted(own, verdicts, ["host", "fetched"], F.xxhash64("page_id"), "left")
    return joined.select("page_id", "host", "fetched", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for half of the domains in pages, by digits of the domain's MD5: added, mostly removed, some added again."""
    name = host(F.col("url"))
    labels = F.split(name, r"\.")
    domain = F.when(F.size(labels) >= 4, F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")).otherwise(name)
    part = lambda i: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 4 * i + 1, 4), 16, 10).cast("int")
    known = pages.select(domain.alias("pattern")).distinct().dropna().select("pattern", *[part(i).alias(f"b{i}") for i in range(4)]).filter("b0 % 2 = 0")
    added = F.col("b1") % 200
    removed = added + 1 + F.col("b2") % 100
    events = F.array(
        F.struct(added.alias("day"), F.lit("add").alias("action")),
        F.when(F.col("b2") % 4 != 0, F.struct(removed.alias("day"), F.lit("remove").alias("action"))),
        F.when((F.col("b2") % 4 != 0) & (F.col("b3") % 3 == 0), F.struct((removed + 1 + F.col("b3") % 60).alias("day"), F.lit("add").alias("action"))),
    )
    named = F.element_at(F.array(*map(F.lit, ("adult", "gambling", "malware"))), F.col("b0").bitwiseAND(6) % 3 + 1)
    one = known.select(named.alias("list"), "pattern", F.explode(F.array_compact(events)).alias("x"))
    return one.select("list", "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("x.day")).alias("effective"), F.col("x.action").alias("action"))


SQL = r"""
WITH captures AS (
  SELECT page_id, regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), '\.$', '') AS host,
    DATE '2024-01-01' + CAST(page_id * 7 % 366 AS INTEGER) AS fetched FROM pages),
domains AS (
  SELECT DISTINCT CASE WHEN len(string_split(host, '.')) >= 4 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS pattern FROM captures WHERE host IS NOT NULL),
hashed AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS b0, CAST('0x' || substr(md5(pattern), 5, 4) AS INTEGER) AS b1,
    CAST('0x' || substr(md5(pattern), 9, 4) AS INTEGER) AS b2, CAST('0x' || substr(md5(pattern), 13, 4) AS INTEGER) AS b3 FROM domains),
chosen AS (SELECT *, CASE (b0 & 6) % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'gambling' ELSE 'malware' END AS list, b1 % 200 AS a, b1 % 200 + 1 + b2 % 100 AS r FROM hashed WHERE b0 % 2 = 0),
spans AS (
  SELECT list, pattern, a AS since, CASE WHEN b2 % 4 <> 0 THEN r END AS until FROM chosen
  UNION ALL SELECT list, pattern, r + 1 + b3 % 60, NULL FROM chosen WHERE b2 % 4 <> 0 AND b3 % 3 = 0),
asked AS (
  SELECT page_id, fetched - DATE '2024-01-01' AS day, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM captures, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS i) WHERE host IS NOT NULL),
hits AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM asked JOIN spans USING (pattern)
  WHERE since <= day AND (until IS NULL OR day < until) GROUP BY page_id)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists FROM captures LEFT JOIN hits USING (page_id)
"""
