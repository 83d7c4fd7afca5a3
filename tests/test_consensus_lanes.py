"""Consensus of edges: many are aligned side by side, with the result of one after the other, and dealt to all tasks."""

import random

from pyspark.sql import functions as F

from strandlake.operators import consensus as con
from strandlake.operators import graph as g


def noisy(r, s, rate):
    t = []
    for c in s:
        x = r.random()
        t.append("" if x < rate else r.choice("ACGT") + c if x < 2 * rate else r.choice("ACGT") if x < 3 * rate else c)
    return "".join(t) or "A"


def groups(n, seed=5):
    r = random.Random(seed)
    for _ in range(n):
        s = "".join(r.choice("ACGT"[: r.choice((2, 4))]) for _ in range(r.randint(1, 90)))
        yield [noisy(r, s, r.choice((0, 0.02, 0.1, 0.3))) for _ in range(r.choice((1, 2, 2, 3, 5, 8)))] + [s] * r.randint(0, 2)


def one_by_one(reads):
    graph = con.Graph(reads[0])
    for s in reads[1:]:
        graph.add(s)  # by align()
    return graph.msa()


def test_alignments_side_by_side_are_those_one_by_one(monkeypatch):
    found = list(groups(60))
    want = [one_by_one(x) for x in found]
    assert con.alignments(found) == want
    monkeypatch.setattr(con, "CELLS", 1)  # each alone
    assert con.alignments(found[:20]) == want[:20]


def test_edges_are_dealt_to_all_tasks(spark):
    found = list(groups(64))
    rows = [(k // 8, k % 8, 0, i + 1, s) for k, x in enumerate(found) for i, s in enumerate(x)]
    pieces = con.edge_consensus(spark.createDataFrame(rows, "ctg long, edge int, off int, ord int, seq string"))
    got = pieces.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.ctg, r.edge): (r.seq, r.n_reads) for r in got} == {(k // 8, k % 8): (s, len(m)) for k, x in enumerate(found) for s, m in [con.consensus(x)]}
    assert len({r.task for r in got}) > 4
    cut = con.stitched(pieces.drop("task"), 32)._jdf.queryExecution().executedPlan().toString()
    assert cut.count("REPARTITION_BY_NUM") == 2  # edges, then contigs, whose joints are found where Spark would make one task of few bytes


def test_rows_placed_side_by_side_are_those_one_by_one():
    found = [one_by_one(x) for x in groups(60)]
    for reach in (4, con.REACH):
        assert con.all_realigned(found, reach) == [con.realigned(x, 1, reach) for x in found]


def test_repeat_nodes_are_judged_in_all_tasks(spark):
    regions = spark.createDataFrame([(n, rid, 0, n * 4, n * 4 + 4, False) for rid in range(3) for n in range(5)], "node long, rid long, dir int, beg int, end int, closed boolean")
    judged = g.repeat_nodes(regions, 2)
    assert judged.count() == 0 and "REPARTITION_BY_NUM" in judged._jdf.queryExecution().executedPlan().toString()
