"""Joining facts about keys to the rows that have them, where one key may have most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000  # a key is hot if it has more than one in so many rows


def attach(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each key of ``rows``.

    ``key`` is never null, and ``n`` is the number of rows with it. Fewer than ``HOT_KEYS``
    keys can be hot, which bounds what is broadcast; their rows stay where they are. Only
    the others are shuffled. ``rows`` is read twice and should be a table or cheap.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_KEYS > total
    hot = facts.where(is_hot)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return often.unionByName(seldom.join(facts.where(~is_hot), key))
