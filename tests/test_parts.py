"""Mapping by parts of an index gives the same overlaps for any number of parts."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandlake.config import SMALL
from strandlake.operators import overlaps as ov

FIELDS = [f.split()[0] for f in ov.OVERLAP.split(", ")]


def noisy(r, text, rate):
    """The text with letters replaced, dropped and doubled."""
    out = []
    for c in text:
        x = r.random()
        out.append(r.choice("ACGT") if x < rate / 3 else "" if x < 2 * rate / 3 else c + r.choice("ACGT") if x < rate else c)
    return "".join(out)


@pytest.fixture(scope="module")
def reads(spark):
    r = random.Random(11)
    genome = "".join(r.choices("ACGT", k=12_000))
    turned = str.maketrans("ACGT", "TGCA")
    rows = []
    for k in range(60):
        at, size = r.randrange(10_000), r.randint(900, 2_000)
        text = noisy(r, genome[at : at + size], 0.03)
        rows.append((k, text[::-1].translate(turned) if k % 3 == 0 else text))
    rows += [(60, ""), (61, rows[5][1]), (62, rows[5][1])]  # an empty one, and copies
    return spark.createDataFrame([(k, f"r{k}", s) for k, s in rows], "ridx long, tag string, seq string")


def rows(found):
    return sorted(tuple(x) for x in found.select(FIELDS).collect())


def test_reads_by_parts(spark, reads):
    one = rows(ov.map_reads(reads, replace(SMALL, parts=1)))
    assert len(one) > 100 and {r[1] for r in one} == {0, 1}
    for parts in (2, 5):
        assert rows(ov.map_reads(reads, replace(SMALL, parts=parts))) == one
    # few best ones: those of a later part push out earlier ones
    few = replace(SMALL, best_n=2)
    want = rows(ov.map_reads(reads, replace(few, parts=1)))
    assert len(want) < len(one) and rows(ov.map_reads(reads, replace(few, parts=5))) == want


def test_queries_by_parts(spark, reads):
    queries, references = reads.where("ridx % 4 = 0"), reads.where("ridx % 4 != 0")
    one = rows(ov.map_queries(queries, references, replace(SMALL, parts=1)))
    assert len(one) > 30
    assert rows(ov.map_queries(queries, references, replace(SMALL, parts=4))) == one


def test_parts_hold_every_read_once_and_follow_the_hits(spark):
    posted = spark.range(500).select((F.col("id") % 10).alias("kmer"), F.col("id").alias("ridx"))
    pieces = [ov.part_of(posted, k, 3) for k in range(3)]
    assert sorted(r.ridx for p in pieces for r in p.collect()) == list(range(500)) and all(not p.isEmpty() for p in pieces)
    # ten seeds of fifty reads each: 12,250 hits
    assert [ov.parts_needed(posted, m) for m in (12_250, 12_249, 5_000, 1_000_000)] == [1, 2, 3, 1]
    assert ov.parts_needed(posted.limit(0)) == 1
