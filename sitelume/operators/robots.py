"""Robots rules as rows, and their longest match by a join.

``rules`` takes robots files apart into one row for each rule and agent, with functions on columns alone: lines
become (agent or rule, value), and a running count numbers the groups in which agents are followed by rules.
``applying`` keeps the rules of a host's group for one agent: that of the longest name that the agent begins
with, else the group of everyone. ``allowed`` joins URLs with their host's rules.

A rule's pattern is the beginning of a path with query; * stands for any characters, $ at its end for the end.
Of all rules that match, the one of the longest pattern decides, allowing ones before forbidding ones of one
length; without a match everything is allowed.

A host may hold a third of all URLs, and thousands of rules. Rules without * or $ are looked up by what they
are: an URL's prefixes of the lengths that its host's rules have are joined with the rules by equality, salted by the
URL for hosts with many URLs, so a host's URLs are dealt to many tasks and none meets all rules. Patterns are
few (MOST_PATTERNS of a host in its row, the longest ones first; a host with more has several rows) and tested
one after the other.

Defined cases: a file without a good status has no rules; rules before any agent don't count; an empty Disallow
is no rule; an URL without a path has the path /; a path in percent signs is compared as it is written. Null URLs
and hosts are allowed, as hosts without a file are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a robots file that count.
FIELDS = ("user-agent", "allow", "disallow", "crawl-delay")
SALTS = 16
MOST_PATTERNS = 200
MOST_BYTES = 512_000  # of a file are read, as crawlers do


def rules(files: DataFrame) -> DataFrame:
    """host, agent (lower-case), pos, kind (allow, disallow, crawl-delay; null: a group without rules) and value of robots files (host, status_code, body)."""
    body = F.regexp_replace(F.left("body", F.lit(MOST_BYTES)), "^﻿", "")
    bare = F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*", ""), r"\s", " ")))
    field = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    parts = F.transform(F.filter(bare, lambda x: F.contains(x, F.lit(":")) & field(x).isin(*FIELDS)), lambda x: F.struct(field(x).alias("kind"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    listed = files.filter((F.col("status_code") == 200) & F.col("host").isNotNull()).select("host", F.explode(F.array(F.struct(parts.alias("lines")))).alias("l")).select("host", "l.lines")  # exploded, so that the lines are computed once
    agent = lambda i: (i >= 0) & (F.get("lines", i)["kind"] == "user-agent")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    starts = F.filter(places, lambda i: agent(i) & ~F.coalesce(agent(i - 1), F.lit(False)))  # of groups
    ends = F.transform(F.sequence(F.lit(1), F.size("starts")), lambda k: F.coalesce(F.get("starts", k), F.size("lines")))
    grouped = listed.filter(F.size("lines") > 0).withColumn("starts", starts).filter(F.size("starts") > 0)
    groups = grouped.select("host", F.explode(F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("z")), lambda g: F.struct(g["a"].alias("at"), F.slice("lines", g["a"] + 1, g["z"] - g["a"]).alias("lines")))).alias("g"))
    of = lambda c, want: F.filter(c, lambda x: (x["kind"] == "user-agent") == F.lit(want))
    numbered = F.transform(of(F.col("g.lines"), False), lambda x, i: F.struct((F.col("g.at") + i).alias("pos"), x["kind"].alias("kind"), x["value"].alias("value")))
    agents = groups.select("host", F.explode(of(F.col("g.lines"), True)["value"]).alias("agent"), numbered.alias("rules"))
    rows = agents.select("host", F.lower("agent").alias("agent"), F.explode_outer("rules").alias("r")).select("host", "agent", "r.*")
    return rows.filter((F.col("kind") != "disallow") | (F.col("value") != "") | F.col("kind").isNull())


def applying(found: DataFrame, agent: str) -> DataFrame:
    """The rows of rules() that hold for an agent."""
    name = F.lower(F.lit(agent.split("/", 1)[0].strip()))
    fits = found.filter((F.col("agent") == "*") | (F.col("agent") != "") & F.startswith(name, F.col("agent")))
    rank = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = fits.groupBy("host").agg(F.max(F.struct(rank.alias("rank"), "agent")).alias("b")).select("host", F.col("b.agent").alias("agent"))
    return fits.join(best, ["host", "agent"], "left_semi")


def delays(found: DataFrame) -> DataFrame:
    """host, crawl_delay (seconds, the first that is a number) of applying()'s rows."""
    said = found.filter("kind = 'crawl-delay'").select("host", "pos", F.col("value").try_cast("double").alias("delay")).filter("delay >= 0")
    return said.groupBy("host").agg(F.min_by("delay", "pos").alias("crawl_delay"))


def _place(url: Column | str) -> Column:
    """An URL's path and query, as rules see them."""
    rest = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def _regex(pattern: Column) -> Column:
    """A pattern with * and $ as a regular expression."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\^$.|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))


def judged(asked: DataFrame, found: DataFrame, salts: int = SALTS) -> DataFrame:
    """asked (host, url, each once) with allowed, by applying()'s rows; rule: the pattern that decided."""
    paths = found.filter("kind in ('allow', 'disallow') and value <> ''").select("host", F.col("value").alias("rule"), (F.col("kind") == "allow").alias("allow")).groupBy("host", "rule").agg(F.max("allow").alias("allow"))
    special = F.col("rule").rlike(r"[*]|\$$")
    plain = paths.filter(~special)
    patterns = paths.filter(special).select("host", F.struct(F.length("rule").alias("length"), "allow", "rule", _regex(F.col("rule")).alias("regex")).alias("p"))

    # plain rules: the URL's prefixes of the lengths that its host's rules have
    lengths = plain.groupBy("host").agg(F.collect_set(F.length("rule")).alias("lengths"))
    salt = F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int").alias("salt")
    everywhere = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = asked.select("host", "url", salt, _place("url").alias("place"))
    prefixed = salted.join(everywhere(lengths), ["host", "salt"]).select("host", "url", F.explode(F.filter("lengths", lambda n: n <= F.length("place"))).alias("n"), "place")
    hits = prefixed.select("host", "url", F.left("place", F.col("n")).alias("rule")).join(plain, ["host", "rule"]).select("host", "url", F.struct(F.length("rule").alias("length"), "allow", "rule").alias("best"))

    # patterns: a row of them at a time
    listed = patterns.groupBy("host", F.pmod(F.xxhash64("p.rule"), F.lit(8)).alias("part")).agg(F.sort_array(F.collect_set("p"), asc=False).alias("ps"))
    rows = listed.select("host", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ps") - 1) / MOST_PATTERNS).cast("int")), lambda k: F.slice("ps", k * MOST_PATTERNS + 1, F.lit(MOST_PATTERNS)))).alias("ps"))
    tried = salted.join(everywhere(rows), ["host", "salt"]).select("host", "url", F.get(F.filter("ps", lambda p: F.call_function("regexp_like", F.col("place"), p["regex"])), F.lit(0)).alias("p"))  # the longest one first
    more = tried.filter("p is not null").select("host", "url", F.struct("p.length", "p.allow", "p.rule").alias("best"))

    decided = hits.unionByName(more).groupBy("host", "url").agg(F.max("best").alias("best"))
    return asked.select("host", "url").join(decided, ["host", "url"], "left").select("host", "url", F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.col("best.rule").alias("rule"))


def allowed(asked: DataFrame, files: DataFrame, agent: str, salts: int = SALTS) -> DataFrame:
    """asked (host, url) with allowed, crawl_delay and the rule that decided, by the hosts' robots files (host, status_code, body); each URL once."""
    found = applying(rules(files), agent)
    known = judged(asked.select("host", "url").distinct(), found, salts)
    delay = delays(found)
    return known.join(delay, "host", "left").select("host", "url", "allowed", "crawl_delay", "rule")
