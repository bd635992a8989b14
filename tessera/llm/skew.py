"""Joins on a key of which a few values may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value is heavy if it has more than one row in so many; there can't be more heavy values than that.
SHARE = 500


def heavy(counted: DataFrame, key: str, n: str, total: int) -> list:
    """The values of key whose counted rows are more than total / SHARE, at most SHARE of them."""
    return [r[0] for r in counted.where(F.col(n) > max(total / SHARE, 1)).select(key).limit(SHARE).collect()]


def skew_join(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """big joined with small on key (inner or left). Rows of hot values stay where they are, and meet a broadcast of
    small's rows of these few values; the others are dealt by key."""
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return big.where(~is_hot).join(small.where(~is_hot), key, how).unionByName(big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how))
