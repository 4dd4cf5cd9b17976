import random

import numpy as np
import pytest

from netbehave.llm import linkgraph
from netbehave.llm.skew import attach

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PAGES = "page_id long, url string, html string"


def page_rows(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def plain_scores(pages, rules=RULES, damping=linkgraph.DAMPING, rounds=linkgraph.ROUNDS):
    """Hosts' scores by dense matrices, from (host, verdict by rule or None, linked hosts)."""
    hosts = sorted({host for host, _, _ in pages} | {to for _, _, links in pages for to in links})
    at = {host: n for n, host in enumerate(hosts)}
    edges = np.zeros((len(hosts), len(hosts)))
    seeds = np.zeros((2, len(hosts)))
    for host, verdict, links in pages:
        for to in set(links) - {host}:
            edges[at[host], at[to]] += 1
        if verdict:
            seeds[0 if verdict == "allow" else 1, at[host]] += 1
    out, into = edges.sum(1, keepdims=True), edges.sum(0, keepdims=True)
    forward = np.divide(edges, out, where=out > 0, out=np.zeros_like(edges)).T
    backward = np.divide(edges, into, where=into > 0, out=np.zeros_like(edges))
    found = []
    for way, seed in zip((forward, backward), seeds):
        term, total = seed, seed.copy()
        for _ in range(rounds):
            term = damping * way @ term
            total += term
        found.append(total)
    return {host: (found[0][n], found[1][n]) for host, n in at.items()}


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("HTTP://A.Example.COM/x?y#z", "a.example.com", "/x"),
        ("http://a.b?x/y", "a.b", ""),
        ("http://a.b#x", "a.b", ""),
        ("http://a.b", "a.b", ""),
        ("x://y://z/w", "y:", "//z/w"),
        ("//a.b/c", "", ""),
        ("http:///c", "", "/c"),
        ("http://ÄB.net/\nx", "Äb.net", "/\nx"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_place(spark, url, host, path):
    row = linkgraph.with_place(page_rows(spark, [(1, url, None)])).first()
    assert (row["host"], row["path"]) == (host, path)


@pytest.mark.parametrize(
    ("url", "rule"),
    [
        ("http://example.net/en/1", "example.net/en/"),
        ("http://a.example.net/en/", "example.net/en/"),
        ("http://a.example.net/en", "net/"),
        ("http://anexample.net/en/1", "net/"),
        ("http://x.net", None),
        ("http://net/", "net/"),
        ("http://xnet/", None),
        ("http://example.com/de/1", "example.com/de/"),
        ("http://example.com/fr/1", None),
        ("http://a.org/fr/1", "org/fr/"),
    ],
)
def test_longest_rule(spark, url, rule):
    placed = linkgraph.with_place(page_rows(spark, [(1, url, None)]))
    assert (placed.select(linkgraph.rule_of(RULES)["rule"]).first()[0]) == rule


def test_links(spark):
    html = (
        '<a href="http://B.com/x">x</a> <a HREF = \'//c.com?y\'>y</a> <a href=https://d.com#z>'
        '<a href="/own/http"> <a href="http://b.com/again"> <a href="http://a.com/self"> <img src="http://e.com">'
    )
    rows = [(1, "http://a.com/", html), (2, "http://a.com/2", html), (3, "no host", html), (4, "http://f.com/", None)]
    found = linkgraph.host_links(linkgraph.with_place(page_rows(spark, rows))).collect()
    assert sorted(map(tuple, found)) == [("a.com", "b.com", 2), ("a.com", "c.com", 2), ("a.com", "d.com", 2)]


@pytest.fixture
def web(spark):
    """Pages of a random web with one host that has a third of all pages and links."""
    draw = random.Random(5)
    hosts = [f"h{n}.com" for n in range(30)] + [f"bad{n}.net" for n in range(4)] + ["good.org", "x.example.net"]
    rows, plain = [], []
    for page in range(400):
        host = "h0.com" if page % 3 == 0 else draw.choice(hosts)
        path = draw.choice(["/en/1", "/fr/1", "/de/1", ""])
        links = [draw.choice(hosts) for _ in range(draw.randrange(4))]
        html = "".join(f'<a href="http://{to.upper()}/p">' for to in links)
        rows.append((page, f"http://{host}{path}", html))
        verdict = None
        if host.endswith(".net") and path:
            verdict = "allow" if host == "x.example.net" and path == "/en/1" else "block"
        if host.endswith(".org") and path == "/fr/1":
            verdict = "allow"
        plain.append((host, verdict, links))
    return rows, plain


def test_scores_equal_dense_matrices(spark, web):
    rows, plain = web
    scores = plain_scores(plain)
    sizes = {host: sum(1 for one in plain if one[0] == host) for host, _, _ in plain}
    found = linkgraph.judged_pages(page_rows(spark, rows).repartition(5), RULES).collect()
    assert len(found) == len(rows)
    verdicts = set()
    for row in found:
        host, by_rule, _ = plain[row["page_id"]]
        trust, distrust = scores[host]
        assert row["host"] == host
        assert row["trust"] == pytest.approx(trust, abs=1e-5)
        assert row["distrust"] == pytest.approx(distrust, abs=1e-5)
        blocked = distrust > trust and distrust > linkgraph.MAX_DISTRUST * sizes[host]
        assert row["verdict"] == (by_rule or ("block" if blocked else "allow"))
        verdicts.add((by_rule is None, row["verdict"]))
    # Hosts without a rule are blocked for whom they link to.
    assert verdicts == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def test_links_to_blocked_hosts_block_a_host_and_trusted_links_save_it(spark):
    spam = '<a href="http://s1.net/"><a href="http://s2.net/">'
    rows = [(n, f"http://s{1 + n % 2}.net/x", None) for n in range(20)]
    rows += [(100, "http://farm.com/", spam), (101, "http://saved.com/", spam)]
    rows += [(200 + n, "http://o.org/fr/x", '<a href="http://saved.com/">') for n in range(30)]
    found = {row["page_id"]: row for row in linkgraph.judged_pages(page_rows(spark, rows), RULES).collect()}
    assert found[100]["verdict"] == "block" and found[100]["rule"] is None
    assert found[101]["verdict"] == "allow" and found[101]["trust"] > found[101]["distrust"]


def test_no_python_on_the_main_path(spark, web):
    plan = linkgraph.judged_pages(page_rows(spark, web[0]), RULES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_odd_pages(spark):
    rows = [
        (1, None, None, "x", 1),
        (1, None, None, "x", 1),
        (2, "", "", None, None),
        (3, "nowhere", "<a href='http://b.net/'>", "y", 2),
        (4, "http://b.net/x", "<" * 300_000, "y", 3),
        (None, "http://b.net/x", "no link", "y", 3),
    ]
    pages = spark.createDataFrame(rows, PAGES + ", host string, trust int")
    found = linkgraph.judged_pages(pages, RULES).collect()
    assert len(found) == 6
    by_id = {row["page_id"]: row for row in found}
    for page in (1, 2, 3):
        assert tuple(by_id[page])[1:] == ("", "", None, "allow", None, None)
    assert by_id[4]["verdict"] == by_id[None]["verdict"] == "block" and by_id[4]["distrust"] == 2.0
    assert linkgraph.judged_pages(pages.limit(0), RULES).collect() == []


def test_attach_splits_hot_keys(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 1500)) AS key")
    facts = rows.groupBy("key").count().selectExpr("key", "count AS n", "count * 2 AS twice")
    found = attach(rows, facts, "key", "n").collect()
    assert len(found) == 3000 and all(row["twice"] == 2 * row["n"] for row in found)
