"""Exact order statistics of very large groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import nearest_index
from ..session import materialize

BINS_PER_OCTAVE = 256
_EXPONENT_SPAN = 1100 * BINS_PER_OCTAVE
FINE_BINS = 4096
SMALL = 20_000  # values that may be put in order at once


def _log_bin(value: Column) -> Column:
    """A bin number that never falls as the value rises (the logarithm is monotone)."""
    size = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + _EXPONENT_SPAN
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def select_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    small: int = SMALL,
) -> DataFrame:
    """The values at given zero-based ranks of each group's ascending order, plus the count `n`.

    `ranks` maps a result column to a function from the group's count to the rank. A first pass
    counts each group's values in monotone bins, with map-side combine, which tells the bin each rank
    falls into; the bin of a group of at most `small` values is the whole group. As long as a bin that
    is wanted holds more, a pass splits its range once more by counts, so no task ever orders more
    than `small` distinct values, whatever the distribution. Exact. `df` is read once a pass, twice
    unless values crowd together: write it out first if it is costly to compute.
    """
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).dropna()
    first = values.groupBy(*keys, _log_bin(F.col("_v")).alias("_bin")).agg(*_extent())
    whole = Window.partitionBy(*keys)
    total = F.sum("_n").over(whole)
    counted = first.withColumn("n", total)
    little = F.col("n") <= small
    merged = counted.groupBy(*keys, "n", F.when(~little, F.col("_bin")).alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    asked = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("n")).cast("long").alias("rank")) for n, f in ranks.items()])
    bins = materialize(_wanted(_cumulate(merged, keys, "_bin").withColumn("_asked", asked)).select(*keys, "n", *_BIN), "ranks")
    wide = (F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))
    while not bins.filter(wide).isEmpty():
        bins = materialize(bins.filter(~wide).unionByName(_split(values, bins.filter(wide), keys)), "ranks")

    own = [*keys, "n", "_lo", "_asked"]
    inside = _in_bins(values, bins, keys).groupBy(*own, "_v").agg(F.count("*").alias("_n"))
    placed = _wanted(_cumulate(inside, [*keys, "_lo"], "_v")).withColumn("_one", F.explode("_asked"))
    columns = [F.max(F.when(F.col("_one.name") == name, F.col("_v"))).alias(name) for name in ranks]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *columns)


_BIN = ["_n", "_lo", "_hi", "_asked"]


def _extent() -> list[Column]:
    return [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]


def _wanted(bins: DataFrame) -> DataFrame:
    """The bins that hold an asked rank, with these ranks counted from the bin's first value."""
    here = F.filter("_asked", lambda a: (a["rank"] >= F.col("_below")) & (a["rank"] < F.col("_upto")))
    left = F.transform(here, lambda a: F.struct(a["name"].alias("name"), (a["rank"] - F.col("_below")).alias("rank")))
    return bins.withColumn("_asked", left).filter(F.size("_asked") > 0)


def _in_bins(values: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in a wanted bin; the bins of a group do not overlap."""
    return values.join(bins, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _split(values: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Each bin's wanted parts, after one more pass of counts."""
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    part = F.least(F.floor(share * FINE_BINS), F.lit(FINE_BINS - 1))
    old = F.col("_lo").alias("_from")
    counts = _in_bins(values, bins.drop("_n"), keys).groupBy(*keys, "n", "_asked", old, part.alias("_part")).agg(*_extent())
    return _wanted(_cumulate(counts, [*keys, "_from"], "_part")).select(*keys, "n", *_BIN)


def percentile_nearest(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], small: int = SMALL) -> DataFrame:
    """Nearest-rank percentiles (banker's rounding of q*(n-1)) of each group."""
    ranks = {name: (lambda n, q=q: nearest_index(n, q)) for name, q in quantiles.items()}
    return select_ranks(df, keys, value, ranks, small)


def _cumulate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Running count in order: `_below` before each row and `_upto` with it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_below", F.col("_upto") - F.col("_n"))
