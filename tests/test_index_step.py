"""The index shuffles its seeds twice, once by seed and once by read, and sorts none by seed."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from strandlake.config import SMALL
from strandlake.operators import kmers as km


def reads(spark):
    r = random.Random(5)
    unit = "".join(r.choices("ACGT", k=21))
    texts = ["".join(r.choices("ACGT", k=300)), unit * 20, unit * 20, "AC" * 100, "", "ACGT" * 15] + ["".join(r.choices("ACGT", k=40)) * 9 for _ in range(20)]
    rows = [(k, f"r{k}", t) for k, t in enumerate(texts)] + [(1, "twice", unit * 20), (7, "twice", texts[8])]  # two reads of one ridx
    return spark.createDataFrame(rows, "ridx long, tag string, seq string")


def test_first_kmers_are_the_first_of_each_bin_and_strand(spark):
    r = reads(spark).where("tag != 'twice'")
    for p in (replace(SMALL, ksample=1), replace(SMALL, ksize=0, psize=9, ksample=1), replace(SMALL, ksize=9, psize=0, ksample=2)):
        every = km.kmers(r, p)
        want = every.groupBy("kmer", "ridx", F.floor(F.col("off") / p.bin_size).alias("bin"), "dir").agg(F.min("off").alias("off")).select("kmer", "ridx", "off", "dir")
        got = km.first_kmers(r, p)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 0 < got.count() < every.count()


def test_index_is_that_of_postings_and_shuffles_seeds_twice(spark):
    r = reads(spark)
    for p in (replace(SMALL, ksample=1), replace(SMALL, ksize=8, psize=4, ksample=1)):
        seeds = km.kmers(r, p)
        counts = km.solid(km.kmer_counts(seeds), p).localCheckpoint()
        want = km.open_bins(km.postings(seeds, counts, p), p)
        got = km.index(r, p)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not got.isEmpty()
    plan = km.index(r, SMALL)._jdf.queryExecution().executedPlan().toString()
    # by seed: seeds and their counts; by read
    assert plan.count("Exchange hashpartitioning(kmer") == 2 and plan.count("Exchange hashpartitioning(ridx") == 1 and "SortMergeJoin" not in plan, plan
