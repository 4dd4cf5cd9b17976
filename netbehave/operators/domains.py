"""Parent domains: how many names, and how evenly asked for, lie below each domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.functions.columns import has
from netbehave.operators import schemas
from netbehave.operators.connections import address, empty
from netbehave.operators.dns import three_places

# A name of 255 bytes has no more labels.
MAX_LEVELS = 127


def parent_domain_features(
    dns: DataFrame, min_share: float = 0.01, levels: int = MAX_LEVELS
) -> DataFrame:
    """Per domain of up to ``levels`` labels that ``min_share`` of all queries or more lie in.

    A name lies in each domain that is its last labels, itself included. ``queries`` counts
    rows, ``names`` distinct names and ``entropy`` is that of the queries over the names, in
    bits to three places: a tunnel has many names below one domain, each asked for once.
    Names are compared without the case of A-Z and without one dot at their end. Rows without
    a query are not counted; an empty name counts among all queries and lies in no domain.
    A log without queries, or with no rows, gives no rows.

    Rows are counted by whole name first and names by domain then. Both counts are combined
    before their shuffle, so a domain with a third of all rows reaches its task as one row
    from each task before, and no set of names is held anywhere.
    """
    if not has(dns, "query"):
        return empty(dns, schemas.PARENTS)
    query = address(dns, "query")
    plain = F.translate(query, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = dns.where(query.isNotNull()).select(F.regexp_replace(plain, r"\.$", "").alias("name"))
    counted = rows.groupBy("name").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    labels = F.when(F.col("name") != "", F.size(F.split("name", r"\."))).otherwise(0)
    depth = F.least(labels, F.lit(levels))
    deep = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    below = counted.select("name", "n", F.explode(deep).alias("level"))
    n = F.col("n")
    domains = (
        below.withColumn("domain", F.expr("substring_index(name, '.', -level)"))
        .groupBy("domain", "level")
        .agg(
            F.sum("n").alias("queries"),
            F.count("*").alias("names"),
            F.sum(n * F.log2(n.cast("double"))).alias("weighted"),
        )
    )
    queries = F.col("queries")
    spread = F.log2(queries.cast("double")) - F.col("weighted") / queries
    return domains.where(queries >= F.lit(float(min_share)) * total).select(
        "domain",
        "level",
        "queries",
        "names",
        three_places(F.greatest(spread, F.lit(0.0))).alias("entropy"),
    )
