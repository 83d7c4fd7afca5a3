"""Rounds of node selection shuffle regions, not pairs of them that conflict."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from strandlake.config import SMALL_GRAPH
from strandlake.operators import regions as rg

P = replace(SMALL_GRAPH, min_node_cov=2)


def candidates(spark, anchors, rids, seed=7):
    r = random.Random(seed)
    rows = []
    for anchor in range(anchors):
        for tile in range(2):
            for rid in r.sample(range(rids), min(rids, r.randint(2, 12))):
                beg = r.randrange(12)
                rows.append((anchor, tile, rid, r.randrange(2), beg, beg + r.randint(3, 5), r.random() < 0.1))
    df = spark.createDataFrame(rows, "anchor long, tile int, rid long, dir int, beg int, end int, closed boolean")
    return df.join(df.groupBy("anchor", "tile").agg(F.count("*").alias("nreg")), ["anchor", "tile"]).localCheckpoint()


def in_turn(ranked, p):
    """The rule, node by node."""
    nodes, taken, out = {}, {}, []
    for row in ranked:
        nodes.setdefault(row["node"], []).append(row)
    for node in sorted(nodes):
        stays = []
        for x in nodes[node]:
            twice = sum(y["rid"] == x["rid"] for y in nodes[node]) > 1
            met = any(min(e, x["end"]) - max(b, x["beg"]) > p.reg_ovl for b, e in taken.get(x["rid"], ()))
            stays.append(not (x["closed"] or twice or met))
        if sum(stays) >= p.min_node_cov and sum(stays) >= x["nreg"] * (1 - p.node_drop):
            for x, open_ in zip(nodes[node], stays, strict=True):
                out.append((node, x["rid"], x["beg"], x["end"], not open_))
                if open_:
                    taken.setdefault(x["rid"], []).append((x["beg"], x["end"]))
    return sorted(out)


def test_same_as_in_turn(spark, monkeypatch):
    monkeypatch.setattr(rg, "TOGETHER", 1)
    for seed, rids in ((1, 40), (2, 400)):
        c = candidates(spark, 120, rids, seed)
        ranked = c.join(rg.ranked(c).select("anchor", "tile", F.col("rank").alias("node")), ["anchor", "tile"]).collect()
        for p in (P, replace(P, node_drop=0.8, reg_ovl=0)):
            got = rg.select_nodes(c, p).select("node", "rid", "beg", "end", "closed")
            want = in_turn(ranked, p)
            assert sorted(map(tuple, got.collect())) == want and len({w[0] for w in want}) > 3


def test_conflicts_are_not_shuffled(spark):
    c = candidates(spark, 1_500, 12)  # every region conflicts with hundreds
    n, sc = c.count(), spark.sparkContext._jsc.sc()
    before = sc.statusStore().executorSummary("driver").totalShuffleWrite()
    rg.select_nodes(c, P).count()
    sc.listenerBus().waitUntilEmpty()
    shuffled = sc.statusStore().executorSummary("driver").totalShuffleWrite() - before
    assert shuffled < 400 * n, (shuffled, n)
