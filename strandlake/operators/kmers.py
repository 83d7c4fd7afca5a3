"""Seeds: k-mers of bins, counted, filtered by frequency, and listed with their places.

kmers are (kmer long, ridx long, off int, dir int): the code of the canonical seed, the
read, the first base's place in the read and the strand. Counting aggregates before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.config import MapParams
from strandlake.functions.sequence import homopolymer_compressed, kmer_code, reverse_complement, sampled
from strandlake.operators.reads import bins, trimmed_to_bins

#: Counts stop growing here.
MOST = 65_535
#: Two bits a base; any letter but C, G and T counts as A.
BASES = np.zeros(256, np.uint8)
BASES[[67, 99]], BASES[[71, 103]], BASES[[84, 116]] = 1, 2, 3


def _sample(code: np.ndarray, one_of: int) -> np.ndarray:
    """The same as functions.sequence.sampled."""
    return (code ^ code >> 4 ^ code >> 7) % (4096 * one_of) < 4096


def _windows(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of k bases, forward and reverse complement."""
    n = len(code) - k + 1
    fwd, rev = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        part = code[j : j + n]
        fwd = fwd << 2 | part
        rev |= (3 - part) << 2 * j
    return fwd, rev


def seeds_of(code: np.ndarray, end: np.ndarray, p: MapParams, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of reads that are whole bins, by their bases (0 to 3) in one array, so that a bin starts at each multiple of its size: (kmer, read, off, dir).

    end: where each read begins and the last one ends, from 0. once: of equal seeds of one bin and strand only the first.
    """
    k, size = p.seed, p.bin_size
    at = np.arange(len(code))
    if p.psize:  # only the first of a run of equal bases
        at = at[(np.diff(code, prepend=-1) != 0) | (at % size == 0)]
    if len(at) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    fwd, rev = _windows(code[at], k)
    first, last = at[: len(fwd)], at[k - 1 :]
    canonical = np.minimum(fwd, rev)
    keep = np.flatnonzero((first // size == last // size) & (fwd != rev) & (_sample(canonical, p.ksample) if p.ksample > 1 else True))
    if once and len(keep):
        seed, bin_ = canonical[keep] * 2 + (rev < fwd)[keep], first[keep] // size
        order = np.lexsort((seed, bin_))  # stable: the first place comes first
        new = np.r_[True, (np.diff(seed[order]) != 0) | (np.diff(bin_[order]) != 0)]
        keep = keep[np.sort(order[new])]
    read = np.searchsorted(end, first[keep], side="right") - 1
    off = (last[keep] if p.psize else first[keep] + k - 1) - (k - 1) - end[read]
    return canonical[keep], read, off.astype(np.int32), (rev < fwd)[keep].astype(np.int32)


def _vectorised(p: MapParams, once: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """seeds_of() reads that are whole bins, some of a batch at a time."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                text = b.column("seq").cast(pa.large_binary())
                end = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                if end[-1] == end[0]:
                    continue
                code = BASES[np.frombuffer(text.buffers()[2], np.uint8)[end[0] : end[-1]]].astype(np.int64)
                kmer, read, off, dir_ = seeds_of(code, end - end[0], p, once)
                yield pa.RecordBatch.from_arrays([pa.array(kmer), b.column("ridx").take(pa.array(read)), pa.array(off), pa.array(dir_)], names=["kmer", "ridx", "off", "dir"])

    return found


def kmers(reads: DataFrame, p: MapParams) -> DataFrame:
    """Sampled canonical seeds of each bin of each read. Palindromes have no strand and are left out.

    With ksize only, seeds are plain k-mers; with psize only, k-mers of the homopolymer-
    compressed bin, whose off is that of their last run less psize - 1; with both, a plain
    k-mer and, going outward from it on its own strand, psize compressed bases. The first
    two are made in Arrow batches by array operations, up to 31 bases; sampling comes
    before rows are made.
    """
    if p.ksize and p.psize:
        return _two_part(reads, p)
    return _by_arrays(reads, p, once=False)


def first_kmers(reads: DataFrame, p: MapParams) -> DataFrame:
    """kmers, of equal ones of one bin and strand of a read only the first: a bin is in one batch whole, so nothing is shuffled for it. Two-part seeds come all."""
    return _two_part(reads, p) if p.ksize and p.psize else _by_arrays(reads, p, once=True)


def _by_arrays(reads: DataFrame, p: MapParams, once: bool) -> DataFrame:
    cut = trimmed_to_bins(reads, p.bin_size).where("bincnt > 0").select("ridx", "seq")
    return cut.mapInArrow(_vectorised(p, once), "kmer long, ridx long, off int, dir int")


def _two_part(reads: DataFrame, p: MapParams) -> DataFrame:
    cut = bins(reads, p.bin_size).withColumn("start", F.col("off") * p.bin_size).drop("off")
    place = F.explode(F.sequence(F.lit(0), F.length("seq") - p.ksize)).alias("p")
    placed = cut.where(F.length("seq") >= p.ksize).select("*", place)
    fwd = placed.select("*", F.substr("seq", F.col("p") + 1, F.lit(p.ksize)).alias("fwd"))
    whole = fwd.select("*", reverse_complement(F.col("fwd")).alias("rev"), (F.col("start") + F.col("p")).cast("int").alias("at")).where("fwd != rev")
    after = F.left(homopolymer_compressed(F.substr("seq", F.col("p") + p.ksize + 1, F.lit(p.bin_size))), F.lit(p.psize))
    before = F.right(homopolymer_compressed(F.left("seq", F.col("p"))), F.lit(p.psize))
    forward = F.col("fwd") < F.col("rev")
    outward = F.when(forward, reverse_complement(after)).otherwise(before)
    found = whole.select("ridx", F.when(forward, F.col("at")).otherwise(F.col("at") - p.psize).cast("int").alias("off"), F.when(forward, 0).otherwise(1).alias("dir"), F.when(F.length(outward) == p.psize, F.concat(F.least("fwd", "rev"), outward)).alias("text")).where("text is not null")
    coded = found.select(kmer_code(F.col("text")).alias("kmer"), "ridx", "off", "dir")
    return coded.where(sampled(F.col("kmer"), p.ksample)) if p.ksample > 1 else coded


def kmer_counts(seeds: DataFrame) -> DataFrame:
    """(kmer, tot), tot up to MOST."""
    return seeds.groupBy("kmer").agg(F.least(F.count("*"), F.lit(MOST)).alias("tot"))


def depth_histogram(counts: DataFrame) -> DataFrame:
    """(tot, n): how many seeds have each count."""
    return counts.groupBy("tot").agg(F.count("*").alias("n"))


def max_depth(histogram: DataFrame, p: MapParams) -> DataFrame:
    """One row (kmax): p.kmax, or more where seeds above it would hold over the fraction ktop of all instances.

    Of the smallest depths whose instances from the deepest down stay within ktop, and p.kmax, the larger.
    """
    instances = F.col("n") * F.col("tot")
    down = Window.orderBy(F.desc("tot"))
    whole = Window.partitionBy().orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = histogram.select("tot", F.sum(instances).over(down).alias("above"), F.sum(instances).over(whole).alias("all"))
    cut = h.where(F.col("above") <= F.col("all") * p.ktop).agg(F.min("tot").alias("least"), F.count("*").alias("k"))
    deepest = histogram.agg(F.max("tot").alias("deepest"))
    return cut.crossJoin(deepest).select(F.greatest(F.lit(p.kmax).cast("long"), F.coalesce(F.col("least") - 1, F.col("deepest"), F.lit(0).cast("long"))).alias("kmax"))


def solid(counts: DataFrame, p: MapParams) -> DataFrame:
    """Counts of the seeds that are neither too rare nor too common."""
    limit = max_depth(depth_histogram(counts), p)
    return counts.where(F.col("tot") >= p.kmin).crossJoin(F.broadcast(limit)).where("tot <= kmax").select("kmer", "tot")  # one row


def postings(seeds: DataFrame, counts: DataFrame, p: MapParams) -> DataFrame:
    """(kmer, ridx, bin, dir, off): the first place of each seed in each bin and strand, for the seeds in counts."""
    placed = seeds.withColumn("bin", F.floor(F.col("off") / p.bin_size).cast("int"))
    first = placed.groupBy("kmer", "ridx", "bin", "dir").agg(F.min("off").alias("off"))
    return first.join(counts.select("kmer"), "kmer", "left_semi")


def bin_degrees(posted: DataFrame) -> DataFrame:
    """(ridx, bin, degree): seeds in the index of each bin that has any."""
    return posted.groupBy("ridx", "bin").agg(F.count("*").alias("degree"))


def open_bins(posted: DataFrame, p: MapParams) -> DataFrame:
    """Postings without those of bins of low complexity."""
    degree = F.count("*").over(Window.partitionBy("ridx", "bin"))  # a bin has few seeds
    return posted.withColumn("_degree", degree).where(F.col("_degree") >= p.min_bin_degree).drop("_degree")


def open_postings(reads: DataFrame, solid_counts: DataFrame, p: MapParams, parts: int | None = None) -> DataFrame:
    """(kmer, ridx, bin, dir, off, tot): open_bins of the postings of the seeds in solid_counts, with their counts, dealt by read.

    Seeds are shuffled twice, by seed for their counts and by read for the degrees of bins, both
    times as three numbers (place: twice the place, and the strand). Counts are the built side
    of a hash join, so that neither side is sorted by seed. parts: how many parts the result has.
    """
    place = (F.col("off") * 2 + F.col("dir")).alias("place")
    seeds = first_kmers(reads, p).select("kmer", "ridx", place)
    kept = seeds.join(solid_counts.select("kmer", "tot").hint("shuffle_hash"), "kmer").repartition(*([parts] if parts else []), "ridx")
    placed = kept.select("kmer", "ridx", F.floor(F.col("place") / (2 * p.bin_size)).cast("int").alias("bin"), (F.col("place") % 2).cast("int").alias("dir"), F.floor(F.col("place") / 2).cast("int").alias("off"), "tot")
    w = Window.partitionBy("ridx", "bin").orderBy("kmer", "dir", "off")
    again = (F.lag("kmer").over(w) == F.col("kmer")) & (F.lag("dir").over(w) == F.col("dir"))  # two-part seeds, and reads of one ridx
    return open_bins(placed.withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again").drop("_again"), p)


def index(reads: DataFrame, p: MapParams) -> DataFrame:
    """The whole index of reads: postings of solid seeds in open bins. Counts are written once, as the cut and the filter both need them; so seeds are made twice."""
    from strandlake.operators.graph import checkpointed

    counts = checkpointed(kmer_counts(kmers(reads, p)))
    return open_postings(reads, solid(counts, p), p).drop("tot")


def seeds_in_index(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each read how many of its seeds an index holds: (ridx, n_seeds, n_found)."""
    hit = seeds.select("kmer", "ridx").join(counts.select("kmer", F.lit(1).alias("has")).hint("shuffle_hash"), "kmer", "left")
    return hit.groupBy("ridx").agg(F.count("*").alias("n_seeds"), F.count("has").alias("n_found"))
