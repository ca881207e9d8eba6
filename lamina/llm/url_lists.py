"""URL filters as a temporal list join, in DataFrame operations.

A list is a log of dated entries (list, pattern, action, dated): from its date on, until
the next entry of the same list and pattern, an entry holds. Entries thus become validity
intervals. A capture meets the entries whose pattern is its host or a parent domain and
whose interval holds its fetch time. In each list the longest such pattern decides; the
capture is blocked if any list says so.

Captures are reduced to distinct hosts and fetch times before the join, so a host with a
third of all captures is looked up once for each time, and the verdicts are joined back.

Defined results: a null or malformed URL has the empty host and meets nothing; a null
fetch time meets nothing; both are not blocked. Entries with a null part are ignored. Of
entries with the same list, pattern and date the last action in alphabetical order holds.
Repeated captures come out as often as they went in. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.session import cut_lineage

#: Askers from which a pattern's entries are sent to them, and patterns or entries that are sent at most.
FREQUENT, SENT_ROWS = 10_000, 200_000

#: Scheme, optional user, host; a port, path, query or fragment ends the host.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def parents(name: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, action, valid_from, valid_to (null: still holds) of dated entries."""
    log = entries.select("list", "pattern", "action", "dated").dropna().groupBy("list", "pattern", "dated").agg(F.max("action").alias("action"))
    following = F.lead("dated").over(W.partitionBy("list", "pattern").orderBy("dated"))
    return log.select("list", "pattern", "action", F.col("dated").alias("valid_from"), following.alias("valid_to"))


def met_entries(asked: DataFrame, holds: DataFrame) -> DataFrame:
    """host, fetched, list, action, long of asked(host, fetched, pattern) and the intervals that hold.

    A pattern under which a large share of all hosts ask, such as a top-level domain, would put them into one task. There
    are at most as many of those as asked rows / FREQUENT. Their entries, mostly none, are sent to the rows instead
    while they are few; the rows of all other patterns are joined by a shuffle.
    """

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        on = (left["pattern"] == right["pattern"]) & (left["fetched"] >= right["valid_from"]) & (right["valid_to"].isNull() | (left["fetched"] < right["valid_to"]))
        return left.join(right, on).select("host", "fetched", "list", "action", F.length(left["pattern"]).alias("long"))

    frequent = cut_lineage(asked.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") > FREQUENT).select("pattern"))
    number = frequent.count()
    if not 0 < number <= SENT_ROWS:
        return join(asked, holds)
    few = F.broadcast(frequent)
    sent = cut_lineage(holds.join(few, "pattern", "left_semi"))
    often = asked.join(few, "pattern", "left_semi")
    often = join(often, F.broadcast(sent) if sent.count() <= SENT_ROWS else sent)
    return often.unionByName(join(asked.join(few, "pattern", "left_anti"), holds))


def evaluate(captures: DataFrame, entries: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` with host, fetched, blocked and lists (those that block, comma-joined) of captures(url, fetched)."""
    if clash := sorted(set(keep) & {"host", "fetched", "blocked", "lists"}):
        raise ValueError(f"columns to keep have names of the result: {clash}")
    seen = captures.select(*keep, host(F.col("url")).alias("host"), "fetched")
    moments = seen.select("host", "fetched").filter("host <> '' and fetched is not null").distinct()
    asked = moments.select("host", "fetched", F.explode(parents(F.col("host"))).alias("pattern"))
    holds = intervals(entries).filter("action <> 'remove'")
    met = met_entries(asked, holds)
    said = met.groupBy("host", "fetched", "list").agg(F.max_by("action", "long").alias("action"))
    blocked = said.filter("action = 'block'").groupBy("host", "fetched").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    out = seen.join(blocked, ["host", "fetched"], "left")
    return out.select(*keep, "host", "fetched", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"))
