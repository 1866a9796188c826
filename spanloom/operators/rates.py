"""What detectors answer with, and one conditional aggregation for all rates of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE = 20


@dataclass(frozen=True)
class Found:
    """``rows``: keys, metric, hits, total, value, baseline, severity, category, first_seen, last_seen and details, a row
    for each finding. ``hits``: keys, metric, span_id, run_id, start_time, the rows behind them (lazy, never collected)."""

    rows: DataFrame
    hits: DataFrame
    keys: tuple[str, ...]

    def affected(self) -> DataFrame:
        """``hits`` of the findings alone."""
        return self.hits.join(self.rows.select(*self.keys, "metric").alias("_f"), same(self.hits, [*self.keys, "metric"]), "left_semi")


def same(df: DataFrame, keys: list[str], other: str = "_f") -> Column:
    """Null-safe equality of ``df``'s keys with those of a frame aliased ``other``."""
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(F.col(f"{other}.{k}"))
    return on


@dataclass(frozen=True)
class Rate:
    """A share of rows. It is a finding from ``least`` on, with ``min_affected`` hits or more."""

    name: str
    hit: Column
    least: float = 0.01
    high: float = 0.2
    medium: float = 0.05
    category: str = "reliability"
    min_affected: int = 3


def severity(rate: Column, high: float = 0.2, medium: float = 0.05) -> Column:
    return F.when(rate >= high, "high").when(rate >= medium, "medium").otherwise("low")


def rates(df: DataFrame, keys: list[str], metrics: list[Rate], **details: Column) -> Found:
    """All metrics of a table in one pass with partial aggregation; only groups remain after the shuffle.

    A null condition is no hit. ``details``: further aggregates of a group.
    """
    aggregates = [F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in details.items()]]
    for r in metrics:
        mine = F.when(r.hit, F.col("start_time"))
        aggregates += [F.count_if(F.coalesce(r.hit, F.lit(False))).alias(f"_h_{r.name}"), F.min(mine).alias(f"_f_{r.name}"), F.max(mine).alias(f"_l_{r.name}")]
    fired = []
    for r in metrics:
        value = F.col(f"_h_{r.name}") / F.col("total")
        row = F.struct(
            F.lit(r.name).alias("metric"),
            F.col(f"_h_{r.name}").alias("hits"),
            value.alias("value"),
            severity(value, r.high, r.medium).alias("severity"),
            F.lit(r.category).alias("category"),
            F.col(f"_f_{r.name}").alias("first_seen"),
            F.col(f"_l_{r.name}").alias("last_seen"),
        )
        fired.append(F.when((F.col(f"_h_{r.name}") >= r.min_affected) & (value >= r.least), row))
    rows = df.groupBy(*keys).agg(*aggregates).withColumn("_m", F.explode(F.array_compact(F.array(*fired))))
    hit = F.array_compact(F.array(*[F.when(r.hit, F.lit(r.name)) for r in metrics]))
    hits = df.select(*keys, F.explode(hit).alias("metric"), "span_id", "run_id", "start_time")
    return Found(rows.select(*keys, "total", *details, "_m.*", F.lit(0.0).alias("baseline")), hits, tuple(keys))




def evidence(df: DataFrame, keys: list[str], limit: int = EVIDENCE, *, slices: int = 4096) -> DataFrame:
    """At most ``limit`` rows of each group, evenly spread over (start_time, span_id): rows i * n div limit.

    A group's time is cut into slices. Counting them tells in which slices the wanted rows lie, and only the rows of these
    are sorted, so no task sorts a group, however many rows one group has.
    """
    at = F.unix_micros(F.col("start_time").cast("timestamp"))
    ends = df.groupBy(*keys).agg(F.min(at).alias("_from"), (F.max(at) - F.min(at) + 1).alias("_long"))
    rows = df.alias("r").join(ends.alias("e"), _same("r", "e", keys)).select(
        "r.*",
        F.floor((F.unix_micros(F.col("r.start_time").cast("timestamp")) - F.col("e._from")) * slices / F.col("e._long")).alias("_slice")
    )
    sizes = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_n": F.sum("_size").over(group), "_before": F.sum("_size").over(group.orderBy("_slice")) - F.col("_size")})
    # the first wanted row from place k on is number ceil(k * limit / n), which stands at its number * n div limit
    first = lambda k: F.floor((k * limit + F.col("_n") - 1) / F.col("_n"))
    place_of = lambda i: F.floor(i * F.col("_n") / limit)
    holds = (F.col("_n") <= limit) | ((first(F.col("_before")) < limit) & (place_of(first(F.col("_before"))) < F.col("_before") + F.col("_size")))
    some = sizes.filter(holds)
    near = rows.alias("r").join(some.alias("s"), _same("r", "s", [*keys, "_slice"])).select("r.*", "s._n", "s._before")
    k = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("start_time", "span_id")) - 1
    near = near.withColumn("_k", k)
    chosen = (F.col("_n") <= limit) | ((first(F.col("_k")) < limit) & (place_of(first(F.col("_k"))) == F.col("_k")))
    return near.filter(chosen).select(*df.columns)


def _same(left: str, right: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on
