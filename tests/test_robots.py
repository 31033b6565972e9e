"""Robots rules as rows: groups, longest match, patterns, hosts with very many URLs."""

import re

import pytest

from sitelume.operators import robots

BODY = """﻿# a comment
Disallow: /before-any-agent
User-agent: Alpha
User-Agent : beta # two names
Disallow: /a
allow: /a/b
Crawl-delay: 1.5
Crawl-delay: 9
Sitemap: https://x/s.xml
User-agent: *
Disallow: /*.pdf$
Disallow: /q?*x=1
Disallow:
Allow: /z.pdf
Disallow: /tie
Allow: /tie
Disallow: /(odd)[1]+.^
Disallow: *mid*
Crawl-delay: none

User-agent: alphabet
Disallow: /
User-agent: quiet
"""
URLS = ["https://h/a", "https://h/a/b/c", "https://h/ab", "https://h", "https://h/z.pdf", "https://h/y.pdf", "https://h/y.pdf?x", "https://h/q?y=2&x=1", "https://h/tie/1", "https://h/(odd)[1]+.^2", "https://h/odd1", "https://h/x/mid/y", "https://h/before-any-agent", "/a", "https://h?mid", "https://h/A", "https://h/#mid"]


def plainly(body, agent, url):
    """The same in plain Python: (allowed, rule)."""
    groups, agents, last = [], [], None
    for line in re.split(r"\r\n|\r|\n", body.removeprefix("﻿")):
        line = re.sub(r"\s", " ", re.sub("#.*", "", line)).strip()
        field, mark, value = line.partition(":")
        field, value = field.strip().lower(), value.strip()
        if not mark or field not in robots.FIELDS:
            continue
        if field == "user-agent":
            if last != "user-agent":
                agents = []
                groups.append((agents, []))
            agents.append(value.lower())
        elif groups:
            groups[-1][1].append((field, value))
        last = field
    name = agent.split("/")[0].strip().lower()
    names = [n for names, _ in groups for n in names if n == "*" or n and name.startswith(n)]
    if not names:
        return True, None
    best = max(names, key=lambda n: (n != "*", len(n), n))
    rest = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)", url)[1]
    place = rest if rest.startswith("/") else "/" + rest
    matching = []
    for names, rules in groups:
        for kind, value in rules if best in names else ():
            body = value.removesuffix("$")
            regex = ".*".join(map(re.escape, re.split(r"\*+", body))) + ("$" if value.endswith("$") else "")
            if kind != "crawl-delay" and value and re.match(regex, place):
                matching.append((len(value), kind == "allow", value))
    return max(matching)[1:] if matching else (True, None)


@pytest.mark.parametrize("agent", ["alpha", "Beta/2.0", "alphabetical", "other", "quiet", ""])
def test_longest_match(spark, agent):
    files = spark.createDataFrame([("h", 200, BODY), ("gone", 404, "User-agent: *\nDisallow: /"), ("none", 200, ""), ("null", 200, None), ("odd", 200, "Disallow: /\nx")], "host string, status_code int, body string")
    asked = spark.createDataFrame([(h, u) for h in ("h", "gone", "none", "null", "odd", "unknown", None) for u in [*URLS, None]] + [("h", URLS[0])], "host string, url string")
    rows = robots.allowed(asked, files, agent).collect()
    got = {(r.host, r.url): (r.allowed, r.rule) for r in rows}
    assert len(rows) == len(got)
    assert all(v == (True, None) for (h, u), v in got.items() if h != "h" or u is None)
    assert {u: got["h", u] for u in URLS} == {u: plainly(BODY, agent, u) for u in URLS}
    assert {r.crawl_delay for r in rows if r.host == "h"} == {1.5 if agent in ("alpha", "Beta/2.0") else None}


def test_rules_are_rows(spark):
    files = spark.createDataFrame([("h", 200, "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: c\n")], "host string, status_code int, body string")
    got = sorted((r.agent, r.kind, r.value) for r in robots.rules(files).collect() if r.kind)
    assert got == [("a", "disallow", "/x"), ("b", "disallow", "/x")] and {r.agent for r in robots.rules(files).collect()} == {"a", "b", "c"}


def test_one_host_of_all_urls_and_very_many_rules(spark):
    """4,000 URLs of one host against 3,000 rules and 250 patterns: the same as one by one, dealt by salt."""
    body = "User-agent: *\n" + "".join(f"{'Allow' if k % 3 == 0 else 'Disallow'}: /s{k % 50}/{'x' * (k % 7)}{k}\n" for k in range(3000)) + "".join(f"Disallow: /t/*{k}$\n" for k in range(250))
    files = spark.createDataFrame([("h", 200, body)], "host string, status_code int, body string")
    asked = spark.range(4000).selectExpr("'h' host", "if(id % 2 = 0, concat('https://h/s', id % 50, '/', repeat('x', cast(id % 7 as int)), id % 3500, '/p', id), concat('https://h/t/', id)) url")
    rows = robots.allowed(asked, files, "me")
    got = {r.url: (r.allowed, r.rule) for r in rows.collect()}
    assert len(got) == 4000
    some = sorted(got)[::19]
    assert {u: got[u] for u in some} == {u: plainly(body, "me", u) for u in some} and 0 < sum(not a for a, _ in got.values()) < 4000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
