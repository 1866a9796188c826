"""Shared scratch tables, and sizes from a plan's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanloom.scratch import materialize, partitions

__all__ = ["hash_bits", "materialize", "partitions", "shards_for", "table_bytes"]


def table_bytes(df: DataFrame) -> int:
    """How large the tables are that ``df`` reads, from its plan's statistics, so without a job; 0 where one isn't known.

    Only leaves are asked: what a plan says of its joins is a product.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if all(size < 1 << 55 for size in sizes) else 0


def shards_for(df: DataFrame, shard_bytes: int = 16 << 20) -> int:
    """A number of hash shards for ``df``: the shuffle's partitions, or one for each ``shard_bytes`` of the table if these
    are more, so that what a task holds of a shard doesn't grow with the table."""
    return max(partitions(df.sparkSession), -(-table_bytes(df) // shard_bytes))


def hash_bits(df: DataFrame) -> int:
    """Bits of a hash that tells the table's n-grams apart: one of them falls together with another with a chance of about
    2 ** -13 at every size, as 2 ** 13 hashes stand against each byte; 40 at least."""
    size = table_bytes(df)
    return min(64, max(40, size.bit_length() + 13)) if size else 64
