"""Joins of rows with facts about their keys, where a few keys may have a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of all rows on (one in HOT); there are fewer than HOT such keys.
HOT = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of facts, which has one row for each key; facts[count] is how many rows the key has, and is dropped.

    The facts of hot keys, fewer than HOT rows whatever the input, go to the rows by a broadcast; the others meet by a shuffle in
    which no key has more than one row in HOT. Rows whose key is null or has no facts are left out.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT > total
    hot = facts.where(is_hot).drop(count)
    of_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~is_hot).drop(count), key)
    return of_hot.unionByName(others)
