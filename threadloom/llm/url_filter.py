"""URL filters by dated lists: a temporal list join in plain DataFrame operations.

A list entry says that from some moment on a pattern (a host or a parent domain) is on a list or off it. Each pattern's
entries become validity intervals. A capture is held against the entries that were in force when it was fetched, for
its host and every parent domain.

Captures are looked up by host: hosts are made distinct first, so the explosion into parent domains and the join with
the patterns see each host once, and the one join that sees all captures gives one row for each. A host that has more
than 1 / HOT_SHARES of all captures (there are fewer than HOT_SHARES of these, so they may be broadcast) is salted: its
captures are dealt over as many salts as it takes to bring them below that share, and its few periods are copied to each.
Parent domains that so many hosts have (`com`) are salted likewise, or dropped before they are shuffled if on no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARES, salted_join


def host(url: Column) -> Column:
    """Lower-case host of a URL, whole, without user, port and trailing dot; null if there is none.

    As browsers read it: blanks around it and line breaks and tabs within don't count, a backslash ends the authority as a
    slash does, a user may hold `@`, so the last one counts, and an IPv6 address is everything in its brackets.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    authority = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}([^/\\?#]*)", 1)
    own = F.regexp_extract(F.regexp_replace(authority, r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(own), r"\.$", ""), F.lit(""))


def domains(h: Column, longest: int) -> Column:
    """Of the host and its parent domains those of at most `longest` characters, longest first. Their number and length
    don't grow with the host's, so an overlong host costs no more than any other."""
    tail = F.right(h, F.lit(longest + 1))
    whole = F.regexp_replace(F.nullif(F.regexp_extract(tail, r"\..*", 0), F.lit("")), r"^\.", "")
    labels = F.split(F.when(F.length(h) <= longest, h).otherwise(whole), r"\.")
    return F.when(labels.isNotNull(), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: still) of each period in which a pattern is on a list.

    `entries`: list, pattern, at (timestamp), seq (order within a moment), listed (boolean). Of several entries of one
    list, pattern and moment the one with the largest seq counts; then the history of a pattern is no longer than the
    moments of its list. Rows with a null list, pattern, moment or verdict are ignored.
    """
    good = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND listed IS NOT NULL")
    last = good.groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.max_by("listed", F.struct("seq", "listed")).alias("listed"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    return last.withColumn("valid_to", F.lead("at").over(w)).where("listed").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def on_lists(parents: DataFrame, periods: DataFrame, hot_shares: int) -> DataFrame:
    """parents (host, captures, pattern) with the periods of their patterns, whatever share of all hosts has one."""
    labels = parents.groupBy("pattern").agg(F.count(F.lit(1)).alias("hosts"))
    total = labels.agg(F.sum("hosts")).first()[0] or 0
    each = periods.groupBy("pattern").agg(F.collect_list(F.struct("valid_from", "valid_to", "list")).alias("_of"))
    listed = each.join(labels, "pattern")
    no_use = labels.where(F.col("hosts") > max(1, total // hot_shares)).join(each, "pattern", "left_anti").select("pattern")  # fewer than hot_shares
    rest = parents.join(F.broadcast(no_use), "pattern", "left_anti")
    found = salted_join(rest, listed, ["pattern"], rows="hosts", total=total, shares=hot_shares, least=0)
    return found.select("host", "captures", "pattern", F.explode("_of").alias("_p")).select("host", "captures", "pattern", "_p.*")


def filter_urls(captures: DataFrame, entries: DataFrame, *, key: str = "page_id", url: str = "url", at: str = "fetched_at", hot_shares: int = HOT_SHARES) -> DataFrame:
    """Per capture: key, url, at, host, n_active (entries in force), lists (their names, sorted), pattern (the longest
    one), blocked.

    A capture without host or time matches nothing and isn't blocked. Hosts of any length are taken whole. Repeated rows
    stay; other columns aren't read. Without captures or entries there is nothing to match. What a task holds of a host
    are its periods: as many as the lists' changes for it and its parent domains.
    """
    longest = entries.agg(F.max(F.length(F.lower("pattern")))).first()[0] or 0
    seen = captures.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.col(at).alias("_t"), host(F.col(url)).alias("host"))
    hosts = seen.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("captures"))
    parents = hosts.select("host", "captures", F.explode(domains(F.col("host"), longest)).alias("pattern"))
    matched = on_lists(parents, validity(entries), hot_shares)
    periods = matched.groupBy("host").agg(F.max("captures").alias("captures"), F.collect_list(F.struct("valid_from", "valid_to", "list", "pattern")).alias("periods"))
    found = salted_join(seen, periods, ["host"], rows="captures", total=captures.count(), how="left", shares=hot_shares, least=0)
    active = F.filter(F.coalesce("periods", F.array().cast(periods.schema["periods"].dataType)), lambda p: (p["valid_from"] <= F.col("_t")) & (p["valid_to"].isNull() | (p["valid_to"] > F.col("_t"))))
    longest_first = F.array_max(F.transform(F.col("_a"), lambda p: F.struct(F.length(p["pattern"]), p["pattern"])))
    return found.withColumn("_a", F.when(F.col("_t").isNotNull(), active).otherwise(F.filter(active, lambda p: F.lit(False)))).select(
        F.col("_k").alias(key), F.col("_u").alias(url), F.col("_t").alias(at), "host",
        F.size("_a").cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_a", lambda p: p["list"]))), ",").alias("lists"),
        longest_first["pattern"].alias("pattern"),
        (F.size("_a") > 0).alias("blocked"),
    )
