"""Length statistics: N50 and the like, exact, by a histogram of lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(len, n) of lengths(len)."""
    return lengths.groupBy("len").agg(F.count("*").alias("n"))


def nx_table(lengths: DataFrame, step: int = 10) -> DataFrame:
    """(x, nx, lx): nx is the largest length such that rows of that length and longer hold x % of the total; lx is how many rows that takes, from the longest.

    Windows run over distinct lengths, which are few however many rows there are.
    """
    down = Window.orderBy(F.desc("len"))
    whole = Window.partitionBy().orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = length_histogram(lengths).withColumn("sum", F.sum(F.col("n") * F.col("len")).over(down)).withColumn("rows", F.sum("n").over(down)).withColumn("total", F.sum(F.col("n") * F.col("len")).over(whole))
    x = F.explode(F.array(*[F.lit(k) for k in range(0, 101, step)])).alias("x")
    reached = h.select("len", "n", "sum", "rows", "total", x).where(F.col("sum") * 100 >= F.col("total") * F.col("x"))
    best = F.max_by(F.struct("len", "n", "sum", "rows", "total"), F.col("len"))
    short = F.greatest(F.lit(0), F.floor((F.col("b.sum") * 100 - F.col("b.total") * F.col("x")) / (F.col("b.len") * 100)))
    return reached.groupBy("x").agg(best.alias("b")).select("x", F.col("b.len").alias("nx"), (F.col("b.rows") - F.least(short, F.col("b.n") - 1)).cast("long").alias("lx"))


def summary(lengths: DataFrame) -> DataFrame:
    """One row: count, total, avg, min, max, n50, l50, n90, l90."""
    nx = nx_table(lengths).where("x in (50, 90)").groupBy().pivot("x", [50, 90]).agg(F.first("nx").alias("n"), F.first("lx").alias("l"))
    nx = nx.select(F.col("50_n").alias("n50"), F.col("50_l").alias("l50"), F.col("90_n").alias("n90"), F.col("90_l").alias("l90"))
    one = lengths.agg(F.count("*").alias("count"), F.sum("len").alias("total"), F.avg("len").alias("avg"), F.min("len").alias("min"), F.max("len").alias("max"))
    return one.crossJoin(nx)  # one row each


def weighted_median(histogram: DataFrame, value: str, weight: str) -> DataFrame:
    """The smallest value up to which half of the weight lies."""
    w = Window.orderBy(value)
    whole = Window.partitionBy().orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = histogram.select(value, F.sum(weight).over(w).alias("upto"), F.sum(weight).over(whole).alias("total"))
    return run.where(F.col("upto") * 2 >= F.col("total")).agg(F.min(value).alias("median"))


def bar_plot(counts: list[int], width: int = 60) -> str:
    """Counts as lines of text bars, for the driver's log."""
    top = max(counts, default=0) or 1
    return "\n".join(f"{k:>6} {c:>12} {'|' * round(c * width / top)}" for k, c in enumerate(counts))
