"""URL filters by dated lists: which entries were active when a page was fetched. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that each list entry is copied to, and captures are dealt over, so that one key's captures are spread over as many tasks.
PARTS = 16


def intervals(entries: DataFrame) -> DataFrame:
    """entries(kind, pattern, dated, listed) -> kind, pattern, since, until (null: still listed): when each pattern was listed.

    An entry holds from its date until the next date of its pattern. Of several of one date, a listing wins over a delisting.
    Entries that repeat the state before them change nothing. Null kinds, patterns, dates or states are left out."""
    whole = entries.where("kind is not null and pattern is not null and dated is not null and listed is not null")
    days = whole.groupBy("kind", F.lower("pattern").alias("pattern"), "dated").agg(F.max("listed").alias("listed"))
    own = Window.partitionBy("kind", "pattern").orderBy("dated")
    turns = days.withColumn("before", F.coalesce(F.lag("listed").over(own), F.lit(False))).where("listed <> before")
    return turns.withColumn("until", F.lead("dated").over(own)).where("listed").select("kind", "pattern", F.col("dated").alias("since"), "until")


def parsed(url):
    """The host (lower case, without user, port and final dot) and the path (from its slash to before query and fragment) of a URL."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def keys(host, path):
    """What list patterns can match a URL: ('host', its host), ('domain', each suffix of it), ('prefix', host and each leading part of the path)."""
    labels = F.split(host, r"\.")
    pair = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: pair("prefix", F.concat_ws("/", F.concat(F.array(host), F.slice(steps, F.lit(1), i)))))
    return F.array_distinct(F.concat(F.array(pair("host", host)), domains, prefixes))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched) and entries(kind, pattern, dated, listed) -> for each capture: page_id, host, fetched,
    n_rules (entries active when it was fetched), rule (the least of them, 'kind:pattern', else null), rule_since, blocked.

    kind 'host' matches that host, 'domain' it and what lies below it, 'prefix' a host and leading whole parts of its path;
    matches ignore case. An entry is active from its date on, until before the next date that delists it. A null url has the
    host "" and is matched by entries of the empty pattern only; a null fetched is matched by none. Repeated rows get each
    their own row; captures that share page_id, url and fetched are told apart by nothing else, and a null page_id goes through.
    Other columns are ignored; no captures give no rows, and no entries block nothing.
    """
    host, path = parsed(F.col("url"))
    own = captures.select("page_id", "url", "fetched").groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("rows"))
    own = own.select("page_id", "fetched", "rows", host.alias("host"), path.alias("path"), F.xxhash64("url").alias("tag"))
    part = F.pmod(F.xxhash64("page_id", "tag", "fetched"), F.lit(PARTS)).cast("int")
    asked = own.select("page_id", "fetched", "tag", part.alias("part"), F.inline(keys(F.col("host"), F.col("path"))))
    lists = intervals(entries).withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    # The entry in force at a time is the one interval of its pattern that holds the time.
    hit = asked.join(lists, ["kind", "pattern", "part"]).where("fetched >= since and (until is null or fetched < until)")
    rule = F.min(F.struct(F.concat_ws(":", "kind", "pattern").alias("rule"), "since"))
    found = hit.groupBy("page_id", "tag", "fetched").agg(F.count(F.lit(1)).alias("n"), rule.alias("r"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "tag", "fetched")]
    out = own.alias("a").join(found.alias("b"), same[0] & same[1] & same[2], "left")
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("a.rows"))))
    n = F.coalesce("b.n", F.lit(0)).cast("long")
    return out.select("a.page_id", "a.host", "a.fetched", n.alias("n_rules"), F.col("b.r.rule").alias("rule"), F.col("b.r.since").alias("rule_since"), (n > 0).alias("blocked"))


#: The tables hold no lists and no fetch dates. The query makes both from hashes of what is there: a page was fetched on one of
#: 1000 days; of hosts, of what their first label stands before, and of hosts with the first part of a path, some are listed on
#: one of 800 days, and half of those delisted within 200.
def _number(text, digits: int):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("int")


def _made_captures(pages: DataFrame) -> DataFrame:
    day = _number(F.concat(F.lit("fetched:"), F.col("page_id").cast("string")), 6) % 1000
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), day).alias("fetched"))


def _made_entries(pages: DataFrame) -> DataFrame:
    host, path = parsed(F.col("url"))
    at = pages.select(host.alias("host"), F.regexp_extract(path, "^/([^/]+)", 1).alias("first")).distinct()
    kinds = [("host", F.col("host")), ("domain", F.regexp_replace("host", r"^[^.]*\.", "")), ("prefix", F.concat_ws("/", "host", "first"))]
    made = at.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("pattern")) for k, p in kinds])).alias("e")).select("e.*").distinct()
    name = F.concat_ws(":", "kind", "pattern")
    made = made.where(_number(name, 2) < 64).withColumn("start", F.date_add(F.lit("2020-01-01").cast("date"), _number(F.concat(F.lit("on:"), name), 6) % 800))
    made = made.withColumn("length", 1 + _number(F.concat(F.lit("off:"), name), 6) % 400)
    on = made.select("kind", "pattern", F.col("start").alias("dated"), F.lit(True).alias("listed"))
    off = made.where("length <= 200").select("kind", "pattern", F.date_add("start", F.col("length")).alias("dated"), F.lit(False).alias("listed"))
    return on.unionByName(off)


def op8_url_lists(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = verdicts(_made_captures(pages), _made_entries(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched", "rule_since")})


SQL = r"""
WITH parsed AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages)),
captures AS (
  SELECT *, DATE '2020-01-01' + (('0x' || substr(md5('fetched:' || page_id::VARCHAR), 1, 6))::INT % 1000) AS fetched FROM parsed),
patterns AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM parsed
  UNION SELECT 'domain', regexp_replace(host, '^[^.]*\.', '') FROM parsed
  UNION SELECT 'prefix', host || '/' || regexp_extract(path, '^/([^/]+)', 1) FROM parsed),
made AS (
  SELECT kind, lower(pattern) AS pattern, DATE '2020-01-01' + (('0x' || substr(md5('on:' || kind || ':' || pattern), 1, 6))::INT % 800) AS start,
         1 + ('0x' || substr(md5('off:' || kind || ':' || pattern), 1, 6))::INT % 400 AS length
  FROM patterns WHERE ('0x' || substr(md5(kind || ':' || pattern), 1, 2))::INT < 64),
entries AS (
  SELECT kind, pattern, dated, max(listed) AS listed FROM (
    SELECT kind, pattern, start AS dated, 1 AS listed FROM made
    UNION ALL SELECT kind, pattern, start + length, 0 FROM made WHERE length <= 200) GROUP BY ALL),
asked AS (
  SELECT DISTINCT * FROM (
    SELECT page_id, fetched, 'host' AS kind, host AS pattern FROM captures
    UNION ALL
    SELECT page_id, fetched, 'domain', array_to_string(l[i:], '.')
    FROM (SELECT *, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures)
    UNION ALL
    SELECT page_id, fetched, 'prefix', array_to_string(list_prepend(host, s[1:i]), '/')
    FROM (SELECT page_id, host, fetched, s, unnest(range(0, len(s) + 1)) AS i
          FROM (SELECT *, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS s FROM captures)))),
states AS (
  SELECT a.page_id, a.kind, a.pattern, e.dated, e.listed
  FROM asked a ASOF JOIN entries e ON a.kind = e.kind AND a.pattern = e.pattern AND a.fetched >= e.dated),
turned AS (
  SELECT kind, pattern, dated, listed, coalesce(lag(listed) OVER (PARTITION BY kind, pattern ORDER BY dated), 0) AS before FROM entries),
since AS (
  SELECT s.page_id, s.kind || ':' || s.pattern AS rule, max(t.dated) AS since
  FROM states s JOIN turned t ON s.kind = t.kind AND s.pattern = t.pattern AND t.dated <= s.dated AND t.listed = 1 AND t.before = 0
  WHERE s.listed = 1 GROUP BY ALL),
found AS (SELECT page_id, count(*) AS n, min(rule) AS rule, arg_min(since, rule) AS since FROM since GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched::VARCHAR AS fetched, coalesce(n, 0) AS n_rules, rule, since::VARCHAR AS rule_since, n IS NOT NULL AS blocked
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id
"""
