"""Self-correction of reads: windows of each read with what overlaps it, and their consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.config import MapParams
from strandlake.functions.sequence import reverse_complement
from strandlake.operators.consensus import CHOICE, MOST_READS, edge_consensus, stitched
from strandlake.operators.regions import depth_runs

#: Letters of a window, and from one window to the next.
SIZE, STEP = 2048, 1536


def both_ways(overlaps: DataFrame) -> DataFrame:
    """Each overlap from both its reads: (rid, beg, end, oid, odir, obeg, oend), all places on forward strands, in bins."""
    q = overlaps.select(F.col("qidx").alias("rid"), F.col("qb").alias("beg"), F.col("qe").alias("end"), F.col("tidx").alias("oid"), F.col("qdir").alias("odir"), F.col("tb").alias("obeg"), F.col("te").alias("oend"))
    t = overlaps.select(F.col("tidx").alias("rid"), F.col("tb").alias("beg"), F.col("te").alias("end"), F.col("qidx").alias("oid"), F.col("qdir").alias("odir"), F.col("qb").alias("obeg"), F.col("qe").alias("oend"))
    return q.unionByName(t)


def overlap_windows(overlaps: DataFrame, reads: DataFrame, bin_size: int, size: int = SIZE, step: int = STEP, most: int = CHOICE * MOST_READS) -> DataFrame:
    """Layout rows (ctg, edge, off, ord, seq) of windows over each overlapped read: its own slice, then slices of the reads that overlap it there, the widest first.

    A slice counts if it covers nine tenths of the window; where it begins and ends on the other
    read is interpolated between the overlap's ends. A read with very many overlaps gives no
    window more than `most` slices, of which the consensus takes fewer.
    """
    lengths = reads.select(F.col("ridx").alias("rid"), F.length("seq").alias("rlen"))
    sides = both_ways(overlaps).select("rid", "oid", "odir", *[(F.col(c) * bin_size).alias(c) for c in ("beg", "end", "obeg", "oend")]).join(lengths, "rid")
    count = F.greatest(F.lit(1), F.ceil((F.col("rlen") - (size - step)) / step)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("beg") - size) / step).cast("int") + 1)
    last = F.least(count, F.floor((F.col("end") - 1) / step).cast("int") + 1) - 1
    w = sides.where(first <= last).withColumn("edge", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("beg", F.col("edge") * step), F.least("end", F.col("edge") * step + size, "rlen")
    w = w.withColumn("lo", lo).withColumn("hi", hi).where((F.col("hi") - F.col("lo")) * 10 >= F.least(F.lit(size), F.col("rlen") - F.col("edge") * step) * 9)
    scale = (F.col("oend") - F.col("obeg")) / (F.col("end") - F.col("beg"))
    a, b = F.round((F.col("lo") - F.col("beg")) * scale).cast("int"), F.round((F.col("hi") - F.col("beg")) * scale).cast("int")
    begin = F.when(F.col("odir") == 0, F.col("obeg") + a).otherwise(F.col("oend") - b)
    rank = F.row_number().over(Window.partitionBy("rid", "edge").orderBy(F.desc(F.col("hi") - F.col("lo")), "oid", "obeg"))
    chosen = w.withColumn("n", b - a).withColumn("begin", begin).withColumn("ord", rank + 1).where(F.col("ord") <= most)
    part = F.substr("seq", F.col("begin") + 1, F.col("n"))
    others = chosen.join(reads.select(F.col("ridx").alias("oid"), "seq"), "oid").select("rid", "edge", "ord", F.when(F.col("odir") == 0, part).otherwise(reverse_complement(part)).alias("seq"))
    n = F.greatest(F.lit(1), F.ceil((F.length("seq") - (size - step)) / step)).cast("int")
    own = reads.join(sides.select(F.col("rid").alias("ridx")).distinct(), "ridx", "left_semi").select(F.col("ridx").alias("rid"), "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("edge"))
    own = own.select("rid", "edge", F.lit(1).alias("ord"), F.substr("seq", F.col("edge") * step + 1, F.lit(size)).alias("seq"))
    return own.unionByName(others).select(F.col("rid").alias("ctg"), "edge", (F.col("edge") * step).alias("off"), "ord", "seq")


def well_covered(overlaps: DataFrame, reads: DataFrame, bin_size: int, min_hits: int, min_cover: float) -> DataFrame:
    """(rid) of reads with min_hits overlaps at least, which cover the fraction min_cover of their bins."""
    sides = both_ways(overlaps)
    hits = sides.groupBy("rid").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
    cover = depth_runs(sides.select("rid", "beg", "end"), 1).groupBy("rid").agg(F.sum(F.col("end") - F.col("beg")).alias("cover"))
    bins = reads.select(F.col("ridx").alias("rid"), F.floor(F.length("seq") / bin_size).alias("bins"))
    return hits.join(cover, "rid").join(bins, "rid").where(F.col("cover") >= F.col("bins") * min_cover).select("rid")


def corrected(reads: DataFrame, overlaps: DataFrame, p: MapParams, min_hits: int = 5, min_cover: float = 0.75, size: int = SIZE, step: int = STEP) -> DataFrame:
    """reads(ridx, tag, seq) whose sequences are the stitched consensus of their windows, where they are well covered; others as they are.

    The corrected reads can be mapped again by map_reads().
    """
    good = well_covered(overlaps, reads, p.bin_size, min_hits, min_cover)
    stacked = overlap_windows(overlaps, reads, p.bin_size, size, step).join(good.select(F.col("rid").alias("ctg")), "ctg", "left_semi")
    made = stitched(edge_consensus(stacked), size - step).select(F.col("ctg").alias("ridx"), F.col("seq").alias("better"))
    return reads.join(made, "ridx", "left").select("ridx", "tag", F.coalesce("better", "seq").alias("seq"))
