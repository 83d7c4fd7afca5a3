"""Operators on records: filters, clean-up of subreads, caps, cutting into bins.

A table of reads is (ridx long, tag string, seq string), ridx being the records' order.
Totals over ordered rows go by a histogram of the ordering value, and by blocks of order
within a value; so no window needs all rows, or all of one length, in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of consecutive order whose lengths are summed before running totals are taken over blocks.
BLOCK = 4096
#: Bytes that a task should at least have; smaller inputs are dealt to all cores.
TASK_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if Spark expects it to be so small that its files would keep only some of them busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * TASK_BYTES else df


def ranked_by_length(reads: DataFrame) -> DataFrame:
    """reads, with len, rank (0, 1, ... by falling length, of equals by ridx) and all, the number of reads."""
    sized = reads.withColumn("len", F.length("seq")).withColumn("block", F.floor(F.col("ridx") / BLOCK))
    blocks = sized.groupBy("len", "block").agg(F.count("*").alias("n"))
    lengths = blocks.groupBy("len").agg(F.sum("n").alias("n"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = lengths.select("len", (F.sum("n").over(Window.orderBy(F.desc("len"))) - F.col("n")).alias("start"), F.sum("n").over(whole).alias("all"))
    inner = F.sum("n").over(Window.partitionBy("len").orderBy("block")) - F.col("n")
    before = blocks.withColumn("inner", inner).join(start, "len").select("len", "block", (F.col("start") + F.col("inner")).alias("before"), "all")
    within = F.row_number().over(Window.partitionBy("len", "block").orderBy("ridx")) - 1
    return sized.withColumn("within", within).join(before, ["len", "block"]).select(*reads.columns, "len", (F.col("before") + F.col("within")).alias("rank"), "all")


def named_only(reads: DataFrame, names: DataFrame, deny: bool = False) -> DataFrame:
    """Reads whose tag is, or with deny isn't, among names(tag)."""
    return reads.join(names.select("tag"), "tag", "left_anti" if deny else "left_semi")


def longest_subreads(reads: DataFrame, min_length: int = 0) -> DataFrame:
    """Of the subreads name/begin_end of one well the longest (of equals the first), if it has min_length at least."""
    well = F.regexp_replace("tag", "/[0-9]+_[0-9]+$", "")
    best = F.max_by(F.struct("ridx", "tag", "seq"), F.struct(F.length("seq"), -F.col("ridx")))
    return reads.groupBy(well.alias("well")).agg(best.alias("r")).select("r.*").where(F.length("seq") >= min_length)


def subsample(reads: DataFrame, most: int, key: list[str], seed: int = 13) -> DataFrame:
    """Of each key `most` rows at random: those with the smallest hashes of ridx, so that equal inputs give equal samples."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), "ridx"), "ridx")
    return reads.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def split_long(reads: DataFrame, most: int) -> DataFrame:
    """Records over `most` letters in pieces of that length, the pieces after the first named with the suffix _V<n>."""
    n = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("seq") / most) - 1, F.lit(0)).cast("int")))
    cut = reads.withColumn("part", n)
    tag = F.when(F.col("part") > 0, F.concat("tag", F.lit("_V"), F.col("part").cast("string"))).otherwise(F.col("tag"))
    return cut.select("ridx", "part", tag.alias("tag"), F.substr("seq", F.col("part") * most + 1, F.lit(most)).alias("seq"))


def first_bases(reads: DataFrame, bases: int) -> DataFrame:
    """The first reads by ridx, up to and including the one that reaches `bases` letters."""
    sized = reads.withColumn("len", F.length("seq")).withColumn("block", F.floor(F.col("ridx") / BLOCK))
    blocks = sized.groupBy("block").agg(F.sum("len").alias("total"))
    before = blocks.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    inside = F.sum("len").over(Window.partitionBy("block").orderBy("ridx")) - F.col("len")
    return sized.join(before, "block").withColumn("inside", inside).where(F.col("before") + F.col("inside") < bases).select("ridx", "tag", "seq")


def trimmed_to_bins(reads: DataFrame, bin_size: int) -> DataFrame:
    """Reads cut to a multiple of bin_size, and their number of bins."""
    bins = F.floor(F.length("seq") / bin_size).cast("int")
    return reads.select("ridx", "tag", bins.alias("bincnt"), F.substr("seq", F.lit(1), bins * bin_size).alias("seq"))


def coverage_cap(reads: DataFrame, bases: int) -> DataFrame:
    """The longest reads, as many as stay below `bases` letters in total; the one that would reach it goes. Of equal lengths the first."""
    ranked = ranked_by_length(reads)
    by_length = ranked.groupBy("len").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    longer = F.sum(F.col("n") * F.col("len")).over(Window.orderBy(F.desc("len"))) - F.col("n") * F.col("len")
    room = by_length.select("len", "first", longer.alias("longer"))
    upto = F.col("longer") + (F.col("rank") - F.col("first") + 1) * F.col("len")
    return ranked.join(room, "len").where(upto < bases).select("ridx", "tag", "seq")


def median_band(reads: DataFrame, bases: int) -> DataFrame:
    """Reads around the median length, by rank outwards from it, as many as stay within `bases` letters."""
    away = ranked_by_length(reads).withColumn("away", F.abs(F.col("rank") - F.floor(F.col("all") / 2)))
    rings = away.groupBy("away").agg(F.sum("len").alias("total")).withColumn("block", F.floor(F.col("away") / BLOCK))
    blocks = rings.groupBy("block").agg(F.sum("total").alias("t")).select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))
    kept = rings.join(blocks, "block").withColumn("upto", F.col("before") + F.sum("total").over(Window.partitionBy("block").orderBy("away"))).where(F.col("upto") <= bases)
    return away.join(kept.select("away"), "away", "left_semi").select("ridx", "tag", "seq")


def by_length(reads: DataFrame) -> DataFrame:
    """Rank 0, 1, ... of each read by falling length, of equals by ridx."""
    return ranked_by_length(reads).select("ridx", "tag", "seq", "rank")


def bins(reads: DataFrame, bin_size: int) -> DataFrame:
    """(ridx, off, seq): one row for each whole bin; off counts bins."""
    cut = trimmed_to_bins(reads, bin_size).where("bincnt > 0")
    off = F.explode(F.sequence(F.lit(0), F.col("bincnt") - 1))
    return cut.select("ridx", off.alias("off"), "seq").select("ridx", "off", F.substr("seq", F.col("off") * bin_size + 1, F.lit(bin_size)).alias("seq"))


def rename(reads: DataFrame, prefix: str) -> DataFrame:
    """New tags: the prefix and the record's order in ten digits."""
    return reads.select("ridx", F.concat(F.lit(prefix), F.lpad(F.col("ridx").cast("string"), 10, "0")).alias("tag"), "seq")


def reverse_reads(reads: DataFrame) -> DataFrame:
    from strandlake.functions.sequence import reverse_complement

    return reads.withColumn("seq", reverse_complement(F.col("seq")))
