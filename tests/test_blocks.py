"""Hits of two blocks of reads: what they add up to is that of the seed join, and none is shuffled."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandlake.config import SMALL
from strandlake.operators import blocks as bl
from strandlake.operators import graph as g
from strandlake.operators import kmers as km
from strandlake.operators import overlaps as ov
from strandlake.operators import reads as rd

P = replace(SMALL, ksample=2)


@pytest.fixture(scope="module")
def reads(spark):
    r = random.Random(4)
    genome = "".join(r.choices("ACGT", k=4_000))
    turned = str.maketrans("ACGT", "TGCA")
    texts = []
    for k in range(40):
        at = r.randrange(3_000)
        text = genome[at : at + r.randint(200, 1_000)]
        texts.append(text[::-1].translate(turned) if k % 3 == 0 else text)
    texts += ["", "ACGT" * 80, texts[1], texts[1], "AC" * 200, texts[5][:400] + texts[2][:400] + texts[5][:400]]
    ids = [k * 7 - 50 if k % 5 else k + 2**40 for k in range(len(texts))]
    return spark.createDataFrame([(i, f"r{i}", s) for i, s in zip(ids, texts, strict=True)], "ridx long, tag string, seq string")


@pytest.fixture(scope="module")
def hits(reads):
    posted = g.checkpointed(ov.with_lengths(km.index(reads, P), ov.letters(rd.trimmed_to_bins(reads, P.bin_size), P)))
    return g.checkpointed(ov.seed_hits(posted, posted, P))


def rows(df, columns):
    return sorted(map(tuple, df.select(columns).collect()))


def test_same_as_the_seed_join(reads, hits):
    every = hits.withColumn("qbin", F.floor(F.col("poff") / P.bin_size).cast("int"))
    cells = ov.cells(every, P)
    lengths = rd.trimmed_to_bins(reads, P.bin_size)
    runs = ov.cells(ov.islands(hits, P), P).join(lengths.select(F.col("ridx").alias("qidx"), F.col("bincnt").alias("qlen")), "qidx").join(lengths.select(F.col("ridx").alias("tidx"), F.col("bincnt").alias("tlen")), "tidx")
    want = {
        bl.CELLS: cells,
        bl.SUMS: cells.groupBy("qidx", "tidx", "strand").agg(F.sum("kcnt").alias("seeds"), F.count("*").alias("bins"), F.sum("kmat").alias("letters")),
        bl.ISLANDS: runs,
        bl.COUNTS: hits.where("strand = 0").groupBy("qidx", "tidx").agg(F.count("*").alias("n"), F.min("poff").alias("first")),
    }
    for size in (bl.BLOCK, 300):
        index = bl.packed_index(reads, P, size)
        assert index.count() > (6 if size == 300 else 1)
        for kind, df in want.items():
            got = bl.from_hits(index, P, kind, 1 if kind is bl.COUNTS else 3)
            assert rows(got, df.columns) == rows(df, df.columns) and got.count() > 100, kind


def test_reads_stay_whole_in_small_blocks_and_turns(reads, hits, monkeypatch):
    monkeypatch.setattr(bl, "MOST", 200)
    posted = ov.with_lengths(km.index(reads, P), ov.letters(rd.trimmed_to_bins(reads, P.bin_size), P))
    import pyarrow as pa

    table = pa.Table.from_pandas(posted.orderBy("ridx").toPandas())
    packed = [b for b in bl._pack(iter(table.to_batches(max_chunksize=64)))]
    every = [bl.Block(*[bl.np.frombuffer(b.column(c)[0].as_py(), t) for c, t in zip(bl.Block._fields, bl.TYPES, strict=True)]) for b in packed]
    assert len(every) > 5 and sum(len(b.kmer) for b in every) == table.num_rows
    assert len({i for b in every for i in b.ids.tolist()}) == sum(len(b.ids) for b in every)
    want = rows(hits, ["qidx", "tidx", "strand", "tbin", "poff"])
    for together in (10**9, 50):
        found = [h for i, a in enumerate(every) for b in every[i:] for h in bl.block_hits(a, b, a is b, P, together=together)]
        got = [t for h in found for t in zip(h.qidx.tolist(), h.tidx.tolist(), h.strand.tolist(), h.tbin.tolist(), h.poff.tolist())]
        assert sorted(got) == want
        assert together > 50 or max(len(h.new) for h in found) < len(want) / 20


def test_hits_are_not_shuffled(reads):
    index = bl.packed_index(reads, P)
    for kind in (bl.COUNTS, bl.CELLS, bl.SUMS, bl.ISLANDS):
        plan = bl.from_hits(index, P, kind)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan and "Broadcast" not in plan, plan


def test_mapping_by_blocks_and_by_parts(reads):
    columns = [f.split()[0] for f in ov.OVERLAP.split(", ")]
    want = rows(ov.map_reads(reads, replace(P, parts=1)), columns)
    assert rows(ov.map_reads(reads, P), columns) == want and len(want) > 50
