"""URL rules, and verdicts for hosts from trust and distrust that spread over links.

A rule names a host and the start of a path (``example.com/de/``). It fits a page on that
host or a subdomain whose path starts so; the longest fitting rule decides, of equally long
ones the one that is listed first. Pages without a rule get the verdict of their host:

* An edge goes from a host to another one that its pages link to (``href`` with a host in
  it), and counts the pages with such a link. Links of a host to itself are no edges.
* Trust starts at hosts with one for each page that a rule allows and follows the links; a
  host hands on ``DAMPING`` of what it gets, shared out by the counts of its edges. Distrust
  starts with the pages that a rule blocks and goes against the links, to those who link
  there, shared out by the counts of the edges that come in. These are personalised
  PageRanks, up to a constant factor, of walks of at most ``ROUNDS`` links.
* A host is blocked if its distrust is above its trust and above ``MAX_DISTRUST`` for each
  of its pages; else it is allowed. Without links the two are the host's own counts.

Everything is Spark SQL. What a host hands on is a sparse table of one row for each host that
was reached; tables go to the shared folder once a round and nothing of them reaches the
driver. Edges are dealt out once, by source and a part of their target, so that a host with
a third of all edges fills no task and no round moves edges again. Page rows meet the
verdicts through ``skew.attach``.

Odd rows: a null URL or one without ``://`` has an empty host and path, fits no rule and is
allowed; such pages are no part of the graph. A null ``html`` has no links. Repeated pages
count once each and are each answered. Columns other than ``page_id``, ``url`` and ``html``
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netbehave.llm.skew import attach
from netbehave.llm.words import shared_folder, stored

DAMPING = 0.85
ROUNDS = 20
MAX_DISTRUST = 0.5  # distrust for each page, from which a host is blocked
PARTS = 64  # parts of the edges of one host

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# An attribute with a host in it; the class of characters ends a host like a page's own.
LINK = r"""[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\x20\x09-\x0D]+)"""

Rule = tuple[str, str]  # verdict, host and start of the path


def lower(name: Column) -> Column:
    return F.translate(name, UPPER, LOWER)


def with_place(pages: DataFrame) -> DataFrame:
    """``pages`` with the host and path of their URL."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns(
        {
            "host": lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""

    def fitting(verdict: str, rule: str) -> Column:
        host, slash, path = rule.partition("/")
        on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
        return F.when(
            on_host & F.col("path").startswith(slash + path),
            F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")),
        )

    longest_first = sorted(rules, key=lambda one: -len(one[1]))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[fitting(*one) for one in longest_first], none)


def host_links(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, n): pages of one host that link to another."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    return (
        pages.where("host <> '' AND html IS NOT NULL")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, lower))).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def spread(
    links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """Rows (host, trust, distrust) of every host that is a seed or was reached.

    ``links`` are (src, dst, n) without repeated pairs, ``seeds`` are (host, trust, distrust).
    """
    spark = links.sparkSession
    links = stored(links, "links")
    way = F.col("kind") == "trust"
    kinds = F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind")
    start, end = F.when(way, F.col("src")).otherwise(F.col("dst")), F.when(way, F.col("dst")).otherwise(F.col("src"))
    ways = links.select("*", kinds).select("kind", start.alias("host"), end.alias("to"), "n")
    ways = ways.withColumn("part", F.pmod(F.xxhash64("to"), F.lit(PARTS)).cast("int"))
    # One row for each host: what it shares out in all, and the parts its edges lie in.
    outs = stored(
        ways.groupBy("kind", "host", "part").agg(F.sum("n").alias("n"))
        .groupBy("kind", "host").agg(F.sum("n").alias("total"), F.collect_list("part").alias("parts")),
        "outs",
    )
    values = F.stack(F.lit(2), F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))
    own = seeds.select("host", values.alias("kind", "value")).select("kind", "host", F.col("value").cast("double"))
    terms = [stored(own.where("value <> 0"), "spread")]
    keys = ["kind", "host", "part"]
    name = f"ways_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ways.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
    dealt.option("path", shared_folder(spark, "ways")).saveAsTable(name)
    try:
        for _ in range(rounds):
            given = terms[-1].join(outs, ["kind", "host"]).select(
                "kind", "host", F.explode("parts").alias("part"), (F.lit(damping) * F.col("value") / F.col("total")).alias("each")
            )
            new = (
                spark.table(name).join(given, keys)
                .groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("each") * F.col("n")).alias("value"))
            )
            terms.append(stored(new, "spread"))
            if terms[-1].isEmpty():
                break
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay, for tasks that are run again

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)

    return reduce(DataFrame.union, terms).groupBy("host").agg(total("trust"), total("distrust"))


def judged_pages(pages: DataFrame, rules: Sequence[Rule], max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust) for every page.

    The two scores are the host's, rounded to six digits; null for an empty host.
    """
    placed = with_place(pages.select("page_id", "url", "html"))
    ruled = placed.select("page_id", "host", "path", rule_of(rules).alias("found"))
    ruled = ruled.select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("by_rule"))
    hosts = stored(
        ruled.groupBy("host").agg(
            F.count("*").alias("n_pages"),
            F.count_if(F.col("by_rule") == "allow").alias("trust"),
            F.count_if(F.col("by_rule") == "block").alias("distrust"),
        ),
        "hosts",
    )
    named = hosts.where("host <> ''")
    scores = spread(host_links(placed), named.select("host", "trust", "distrust"))
    facts = hosts.select("host", "n_pages").join(scores, "host", "left")
    known = F.when(F.col("host") != "", F.lit(0.0))
    facts = stored(
        facts.select(
            "host",
            "n_pages",
            F.coalesce("trust", known).alias("trust"),
            F.coalesce("distrust", known).alias("distrust"),
        ),
        "host-scores",
    )
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > F.lit(max_distrust) * F.col("n_pages"))
    verdict = F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow"))
    return attach(ruled, facts, "host", "n_pages").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"),
        F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"),
    )
