"""URL filtering against dated lists by a temporal join, in DataFrame operations only.

Dated list entries (added, removed) become validity intervals. A capture is
looked up under all names that cover it, its host's suffixes and the prefixes
of its path, and an as-of join finds the entries that were valid when it was
fetched. Intervals and captures meet on name and period, so a name with many
entries or captures is spread over its periods; names without a dot, which may
cover a large part of all captures, are dealt into further parts. Nothing is
sorted by name in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let

#: Days of one period of the as-of join.
PERIOD = 32
FOREVER = "DATE'9999-12-31'"
#: Parts into which captures under a name without a dot, such as a top-level domain, are dealt.
DEALT = 64
#: With or without a scheme; user information up to the last @; a bracketed address or a name.
HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@\\[\\]]+)"
PATH = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def names(url: Column) -> Column:
    """All list names that cover a URL: suffixes of its host by label, and its host with prefixes of its path by segment."""

    def of(h: Column) -> Column:
        labels, parts = F.split(h, "\\."), F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")
        suffixes = let(labels, lambda x: F.when(h.startswith("["), F.array(h)).otherwise(F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), "."))))
        prefixes = let(parts, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(x, 1, i), "/")))).otherwise(F.array().cast("array<string>")))
        return F.when(h != "", F.concat(suffixes, prefixes)).otherwise(F.array().cast("array<string>"))

    return let(host(url), of)


def intervals(events: DataFrame) -> DataFrame:
    """(list, entry, valid_from, valid_to) from (list, entry, action, day): from an ``add`` up to the next event of the entry.

    Of several events on one day ``remove`` wins. Events without list, entry or
    day count for nothing.
    """
    once = events.where("list is not null and entry is not null and day is not null").groupBy("list", F.lower("entry").alias("entry"), F.col("day").cast("date").alias("day")).agg(F.max("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("list", "entry").orderBy("day"))
    return once.withColumn("next", following).where("action = 'add'").select("list", "entry", F.col("day").alias("valid_from"), F.coalesce("next", F.expr(FOREVER)).alias("valid_to"))


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """Per capture: page_id, url, fetched, n_active, entry, list, valid_from, keep.

    The longest active entry decides, and of equals ``allow`` comes before any
    other list; a capture under no active entry, with a null or unreadable URL
    or without a day is kept. URLs may lack a scheme (``//host/``), and the host
    may be a bracketed address. Repeated captures are looked up once. Empty lists
    keep all. Other columns are ignored.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("fetched"))
    span = rows.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi"))  # one row, joined below as scalars
    valid = intervals(events).join(F.broadcast(span), (F.col("valid_from") <= F.col("hi")) & (F.col("valid_to") > F.col("lo")))
    period = lambda day: F.floor(F.datediff(day, F.lit("2000-01-01")) / PERIOD)
    valid = valid.withColumn("period", F.explode(F.sequence(period(F.greatest("valid_from", "lo")), period(F.least("valid_to", "hi"))))).select("entry", "period", "list", "valid_from", "valid_to")
    looked = rows.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    looked = looked.withColumn("entry", F.explode(F.array_distinct(names(F.col("url"))))).withColumn("period", period(F.col("fetched")))
    dot = F.instr("entry", ".") > 0  # a name without one may cover a large part of all captures
    looked = looked.withColumn("deal", F.when(dot, F.lit(0)).otherwise(F.pmod(F.xxhash64("url", "fetched"), F.lit(DEALT)).cast("int")))
    valid = valid.withColumn("deal", F.explode(F.when(dot, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(DEALT - 1)))))
    active = looked.join(valid, ["entry", "period", "deal"]).where((F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")))
    order = F.struct(F.length("entry").alias("n"), (F.col("list") == "allow").alias("allow"), "entry", "list", "valid_from")
    best = active.groupBy(F.col("url").alias("u"), F.col("fetched").alias("f")).agg(F.count(F.lit(1)).alias("n_active"), F.max(order).alias("best"))
    out = rows.join(best, (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
    return out.select("page_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).alias("n_active"), "best.entry", "best.list", "best.valid_from", F.coalesce(F.col("best.list") == "allow", F.lit(True)).alias("keep"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of the year 2024, a day for each page by its number."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def sample_events(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts, domains and path prefixes of ``pages``, drawn from a hash of their names."""
    h = host(F.col("url"))
    labels = F.split(h, "\\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    first = F.concat(h, F.lit("/"), F.regexp_extract("url", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)", 1))
    entry = pages.where(h != "").select(F.explode(F.array(h, domain, first)).alias("entry")).where(~F.col("entry").endswith("/")).distinct()
    digit = lambda i, n: F.conv(F.substring(F.md5("entry"), i, n), 16, 10).cast("int")
    entry = entry.where(digit(1, 1) < 12).withColumn("list", F.when(digit(2, 1) < 5, F.lit("allow")).otherwise(F.lit("block")))
    begin = F.date_add(F.lit("2023-11-01").cast("date"), F.pmod(digit(3, 4), F.lit(400)))
    again = F.date_add(begin, 40 + F.pmod(digit(7, 3), F.lit(150)))
    events = F.array(F.struct(F.lit("add").alias("action"), begin.alias("day")), F.struct(F.lit("remove").alias("action"), F.date_add(begin, 10 + F.pmod(digit(10, 3), F.lit(90))).alias("day")), F.struct(F.lit("add").alias("action"), again.alias("day")))
    return entry.select("list", "entry", F.explode(events).alias("e")).select("list", "entry", "e.action", "e.day")


SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched, rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)', 1)), '.') AS h,
    list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
e AS (SELECT DISTINCT entry FROM (SELECT unnest([h, array_to_string(string_split(h, '.')[greatest(len(string_split(h, '.')) - 2, 1):], '.'), h || '/' || regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)', 1)]) AS entry FROM c WHERE h <> '') WHERE NOT ends_with(entry, '/')),
d AS (SELECT entry, md5(entry) AS m FROM e WHERE ('0x' || substr(md5(entry), 1, 1))::INT < 12),
b AS (SELECT entry, CASE WHEN ('0x' || substr(m, 2, 1))::INT < 5 THEN 'allow' ELSE 'block' END AS list, DATE '2023-11-01' + ('0x' || substr(m, 3, 4))::INT % 400 AS begin, m FROM d),
ev AS (SELECT list, entry, 'add' AS action, begin AS day FROM b UNION ALL SELECT list, entry, 'remove', begin + 10 + ('0x' || substr(m, 10, 3))::INT % 90 FROM b UNION ALL SELECT list, entry, 'add', begin + 40 + ('0x' || substr(m, 7, 3))::INT % 150 FROM b),
once AS (SELECT list, lower(entry) AS entry, day, max(action) AS action FROM ev GROUP BY ALL),
iv AS (SELECT list, entry, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY list, entry ORDER BY day), DATE '9999-12-31') AS valid_to, action FROM once),
n AS (SELECT DISTINCT url, fetched, unnest(list_concat(list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')), list_transform(range(1, len(parts) + 1), lambda i: h || '/' || array_to_string(parts[1:i], '/')))) AS entry FROM c WHERE h <> ''),
a AS (SELECT url, fetched, entry, list, valid_from, count(*) OVER (PARTITION BY url, fetched) AS n_active, row_number() OVER (PARTITION BY url, fetched ORDER BY length(entry) DESC, list = 'allow' DESC, entry DESC, list DESC, valid_from DESC) AS r
    FROM n JOIN iv USING (entry) WHERE action = 'add' AND valid_from <= fetched AND fetched < valid_to)
SELECT page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(entry, '') AS entry, coalesce(list, '') AS list, coalesce(strftime(valid_from, '%Y-%m-%d'), '') AS valid_from, coalesce(list = 'allow', true) AS keep
FROM c LEFT JOIN a ON c.url = a.url AND c.fetched = a.fetched AND r = 1
"""
