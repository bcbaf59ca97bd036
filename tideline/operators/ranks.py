"""Exact order statistics without a global sort: running sums over distinct values, in ranges of values.

Rows are first counted by distinct value (partial sums on the map side, so ties never meet as rows). Sketched quantiles of
the distinct values cut them into ranges of about equal size; a small table with one row a key and range carries the sums
of the ranges before, and a window inside each range does the rest. The ranges decide speed only: any number of them gives
the same answer, and no task holds more than about one range of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _null_safe(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def running(values: DataFrame, keys: list[str], value: str, weights: list[str], ranges: int = RANGES) -> DataFrame:
    """Add before_<w> for each weight: its sum over the smaller values of the key. ``values`` has one row a key and value."""
    cuts = [i / ranges for i in range(1, ranges)]
    ranged = values.withColumn("__range", F.lit(0))
    if cuts:
        edges = values.groupBy(*keys).agg(F.percentile_approx(value, cuts, 100 * ranges).alias("__edges"))  # one row a key, at most ``ranges`` numbers
        place = F.size(F.filter("__edges", lambda e: e < F.col(f"v.{value}")))
        ranged = values.alias("v").join(F.broadcast(edges.alias("e")), _null_safe(keys, "v", "e")).select("v.*", place.alias("__range"))
    sums = ranged.groupBy(*keys, "__range").agg(*[F.sum(w).alias(f"__sum_{w}") for w in weights])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__range", *[F.coalesce(F.sum(f"__sum_{w}").over(earlier), F.lit(0)).alias(f"__off_{w}") for w in weights])
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"__in_{w}") for w in weights])
    joined = local.alias("l").join(F.broadcast(offsets.alias("o")), _null_safe([*keys, "__range"], "l", "o"))  # keys x ranges rows
    return joined.select(*[F.col(f"l.{c}") for c in values.columns], *[(F.col(f"o.__off_{w}") + F.col(f"l.__in_{w}")).alias(f"before_{w}") for w in weights])


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: tuple[float, ...], ranges: int = RANGES) -> DataFrame:
    """keys, q0, q1, ...: exact quantiles with linear interpolation between neighbours; null and NaN values are left out."""
    clean = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = clean.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = running(counts, keys, "v", ["n"], ranges).alias("r").join(F.broadcast(totals.alias("t")), _null_safe(keys, "r", "t")).select("r.*", "t.total")
    picks = []
    for i, q in enumerate(wanted):
        at = F.lit(q) * (F.col("total") - 1)
        for name, place in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            held = (place >= F.col("before_n")) & (place < F.col("before_n") + F.col("n"))
            picks.append(F.max(F.when(held, F.col("v"))).alias(name))
    found = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    share = lambda q: F.lit(q) * (F.col("total") - 1) - F.floor(F.lit(q) * (F.col("total") - 1))
    return found.select(*keys, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * share(q)).alias(f"q{i}") for i, q in enumerate(wanted)])


def bin_of(position: Column, total: Column, bins: int) -> Column:
    """The bin (from 1) of a row's place (from 0) when rows are dealt into bins of equal number, the first ones larger by one."""
    size, extra = F.floor(total / bins), total % bins
    edge = (size + 1) * extra
    return F.when(position < edge, F.floor(position / (size + 1)) + 1).otherwise(extra + F.floor((position - edge) / F.greatest(size, F.lit(1))) + 1).cast("int")
