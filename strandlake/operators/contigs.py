"""Fragments, links between them, contigs and their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.config import GraphParams
from strandlake.operators.graph import build_edges, checkpointed, close, degrees, half_edges, unitigs


def offsets(paths: DataFrame, edges: DataFrame, reg_len: int, path: str = "utg") -> DataFrame:
    """Adds `pos`, where each node of a path starts: the lengths of the nodes and gaps before it."""
    h = half_edges(edges, 3).select(F.col("src").alias("node"), F.col("sdir").alias("dir"), F.col("dst").alias("n2"), F.col("ddir").alias("d2"), F.col("off").alias("gap")).groupBy("node", "dir", "n2", "d2").agg(F.min("gap").alias("gap"))
    w = Window.partitionBy(path).orderBy("step")
    ahead = paths.withColumn("n2", F.lead("node").over(w)).withColumn("d2", F.lead("dir").over(w))
    joined = ahead.join(h, ["node", "dir", "n2", "d2"], "left").withColumn("len", F.lit(reg_len) + F.coalesce("gap", F.lit(0)))
    return joined.withColumn("pos", (F.sum("len").over(w) - F.col("len")).cast("int")).select(*paths.columns, "pos")


def fragments(utgs: DataFrame, edges: DataFrame, reg_len: int) -> DataFrame:
    """(utg, n, length) of each unitig, lengths in bins."""
    placed = offsets(utgs, edges, reg_len)
    return placed.groupBy("utg").agg(F.count("*").cast("int").alias("n"), (F.max("pos") + reg_len).alias("length"))


def links(regions: DataFrame, utgs: DataFrame, edges: DataFrame, p: GraphParams) -> DataFrame:
    """Edges between fragments: for each read the first fragment that it sees and the last, if they differ: KEY (of utg ids), cov, off, weak, closed.

    off is the upper median of the distances between the fragments' near ends.
    """
    placed = offsets(utgs, edges, p.reg_len)
    sizes = placed.groupBy("utg").agg((F.max("pos") + p.reg_len).alias("length"))
    seen = regions.where("not closed").join(placed.select("node", "utg", F.col("dir").alias("udir"), "pos"), "node").join(sizes, "utg")
    along = F.col("dir").bitwiseXOR(F.col("udir"))  # 0: the read runs along the fragment
    start = F.when(along == 0, F.col("beg") - F.col("pos")).otherwise(F.col("beg") - (F.col("length") - F.col("pos") - p.reg_len))
    seen = seen.select("rid", "beg", F.col("utg").alias("f"), along.alias("d"), start.alias("at"), (start + F.col("length")).alias("to"))
    ends = seen.groupBy("rid").agg(F.min_by(F.struct("f", "d", "to"), F.struct("beg", "f")).alias("a"), F.max_by(F.struct("f", "d", "at"), F.struct("beg", "f")).alias("b")).where("a.f != b.f")
    up = F.col("a.f") < F.col("b.f")
    pairs = ends.select(F.when(up, F.col("a.f")).otherwise(F.col("b.f")).alias("node1"), F.when(up, F.col("a.d")).otherwise(1 - F.col("b.d")).alias("dir1"), F.when(up, F.col("b.f")).otherwise(F.col("a.f")).alias("node2"), F.when(up, F.col("b.d")).otherwise(1 - F.col("a.d")).alias("dir2"), (F.col("b.at") - F.col("a.to")).alias("off"))
    return link_table(pairs, p.min_edge_cov)


def link_table(pairs: DataFrame, min_cov: int) -> DataFrame:
    """Links from their supporting pairs(KEY, off): cov, the upper median of off, weak below min_cov."""
    key = ["node1", "dir1", "node2", "dir2"]
    offs = pairs.groupBy(*key, "off").agg(F.count("*").alias("n"))
    w, whole = Window.partitionBy(key).orderBy("off"), Window.partitionBy(key)
    ranked = offs.withColumn("upto", F.sum("n").over(w)).withColumn("cov", F.sum("n").over(whole)).where(F.col("upto") > F.floor(F.col("cov") / 2))
    one = ranked.groupBy(key).agg(F.first("cov").cast("int").alias("cov"), F.min("off").cast("int").alias("off"))
    return one.select(*key, "cov", "off", (F.col("cov") < min_cov).alias("weak"), F.lit(0).alias("closed"))


def cut_binary_links(found: DataFrame) -> DataFrame:
    """Of two live links of one fragment to the same other one the one with more coverage stays; equals both go."""
    h = half_edges(found)
    best = F.max("cov").over(Window.partitionBy("src", "dst"))
    n = F.count("*").over(Window.partitionBy("src", "dst"))
    top = F.count(F.when(F.col("cov") == F.col("best"), 1)).over(Window.partitionBy("src", "dst"))
    lost = h.withColumn("best", best).withColumn("n", n).withColumn("top", top).where("n > 1 and (cov < best or top > 1)")
    from strandlake.operators.graph import as_keys

    return close(found, as_keys(lost), 3)


def boomerangs(found: DataFrame, frags: DataFrame, most: int) -> DataFrame:
    """KEY of links of short fragments that have none on one side and several on the other."""
    from strandlake.operators.graph import as_keys

    d = degrees(found).join(frags.where(F.col("length") <= most).select(F.col("utg").alias("node")), "node").where("(fwd = 0 and bwd > 1) or (bwd = 0 and fwd > 1)")
    return as_keys(half_edges(found).join(d.select(F.col("node").alias("src")), "src", "left_semi")).distinct()


def weak_branches(found: DataFrame) -> DataFrame:
    """KEY of weak links at a side that has others."""
    from strandlake.operators.graph import as_keys

    key = ["node1", "dir1", "node2", "dir2"]
    h = half_edges(found)
    forks = h.groupBy("src", "sdir").agg(F.count("*").alias("n")).where("n > 1").select("src", "sdir")
    at = as_keys(h.join(forks, ["src", "sdir"], "left_semi")).distinct()
    return at.join(found.where("weak and closed = 0").select(key), key, "left_semi")


def detached_repeats(found: DataFrame, frags: DataFrame, most: int) -> DataFrame:
    """(repeat, left, ldir, right, rdir): fragments up to `most` bins with several links on both sides, and the pairs of their neighbours that another link joins, each one to one."""
    h = half_edges(found)
    d = degrees(found).where("fwd > 1 and bwd > 1").join(frags.where(F.col("length") <= most).select(F.col("utg").alias("node")), "node").select(F.col("node").alias("repeat"))
    right = h.where("sdir = 0").select(F.col("src").alias("repeat"), F.col("dst").alias("right"), F.col("ddir").alias("rdir")).join(d, "repeat", "left_semi")
    left = h.where("sdir = 1").select(F.col("src").alias("repeat"), F.col("dst").alias("left"), (1 - F.col("ddir")).alias("ldir")).join(d, "repeat", "left_semi")
    across = half_edges(found, 2).select(F.col("src").alias("left"), F.col("sdir").alias("ldir"), F.col("dst").alias("right"), F.col("ddir").alias("rdir"))
    pairs = left.join(across, ["left", "ldir"]).join(right, ["repeat", "right", "rdir"])
    l, r = F.count("*").over(Window.partitionBy("repeat", "left", "ldir")), F.count("*").over(Window.partitionBy("repeat", "right", "rdir"))
    return pairs.withColumn("l", l).withColumn("r", r).where("l = 1 and r = 1").select("repeat", "left", "ldir", "right", "rdir")


def detach_repeats(found: DataFrame, frags: DataFrame, most: int) -> DataFrame:
    """Links after repeats were detached: the links of each detached pair to the repeat are closed hard, the one across is opened."""
    from strandlake.operators.graph import KEY, as_keys

    pairs = checkpointed(detached_repeats(found, frags, most))
    through = pairs.select(F.col("left").alias("src"), F.col("ldir").alias("sdir"), F.col("repeat").alias("dst"), F.lit(0).alias("ddir")).unionByName(pairs.select(F.col("repeat").alias("src"), F.lit(0).alias("sdir"), F.col("right").alias("dst"), F.col("rdir").alias("ddir")))
    across = pairs.select(F.col("left").alias("src"), F.col("ldir").alias("sdir"), F.col("right").alias("dst"), F.col("rdir").alias("ddir"))
    cut, opened = as_keys(through).distinct().withColumn("c", F.lit(True)), as_keys(across).distinct().withColumn("o", F.lit(True))
    joined = found.join(cut, KEY, "left").join(opened, KEY, "left")
    return joined.select(*[F.when(F.col("o"), 0).when(F.col("c"), 3).otherwise(F.col("closed")).alias("closed") if c == "closed" else c for c in found.columns])


def clean_links(found: DataFrame, frags: DataFrame, p: GraphParams, fuzz: int = 39, short: int = 117, repeat: int = 390) -> DataFrame:
    """The clean-up of links: double links, transitive ones, boomerangs of short fragments, weak branches, tips, bubbles, repeats. Lengths are in bins."""
    from strandlake.operators.graph import KEY, bubble_nodes, tip_nodes, transitive, without_nodes
    from strandlake.operators.local import detach

    if found.isEmpty():
        return found
    weak = found.select(*KEY, "weak")

    def with_weak(edges: DataFrame) -> DataFrame:
        return checkpointed(edges.join(weak, KEY))

    e = with_weak(cut_binary_links(found))
    e = with_weak(close(e, transitive(e, 0, fuzz), 3))
    e = with_weak(close(e, boomerangs(e, frags, short), 3))
    e = with_weak(close(e, weak_branches(e), 3))
    nodes = frags.select(F.col("utg").alias("node"))
    for find in (lambda e: tip_nodes(e, nodes, p.tip_step), lambda e: bubble_nodes(e, nodes, p.bub_step)):
        e = with_weak(without_nodes(e, checkpointed(find(e))))
    e = checkpointed(detach(e, frags, repeat, repeat))
    return with_weak(without_nodes(e.drop("weak"), checkpointed(tip_nodes(e, nodes, p.tip_step))))


def densified(ctgs: DataFrame, regions: DataFrame, least: int = 12) -> DataFrame:
    """(ctg, edge, ord, node, dir): for contig edges of `least` bins or more the nodes that reads over the edge have between its ends, by the path with the most steps (of equals the most reads).

    Steps are pairs of regions next to each other on a read that holds both ends in the contig's direction or against it.
    """
    w = Window.partitionBy("ctg").orderBy("step")
    long = ctgs.select("ctg", F.col("step").alias("edge"), F.col("node").alias("n1"), F.col("dir").alias("d1"), F.lead("node").over(w).alias("n2"), F.lead("dir").over(w).alias("d2"), (F.lead("pos").over(w) - F.col("pos")).alias("span")).where(F.col("span") >= least)
    live = regions.where("not closed").select("node", "rid", "dir", "beg", "end")
    a, b = (live.select("rid", F.col("node").alias(f"n{k}"), F.col("dir").alias(f"r{k}"), F.col("beg").alias(f"b{k}")) for k in (1, 2))
    on = long.join(a, "n1").join(b, ["n2", "rid"])
    on = on.where(((F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2")) & (F.col("b1") < F.col("b2"))) | ((F.col("r1") != F.col("d1")) & (F.col("r2") != F.col("d2")) & (F.col("b1") > F.col("b2"))))
    between = on.join(live, "rid").where(F.col("beg").between(F.least("b1", "b2"), F.greatest("b1", "b2")))
    back = F.col("b1") > F.col("b2")
    order = Window.partitionBy("ctg", "edge", "rid").orderBy(F.when(back, -F.col("beg")).otherwise(F.col("beg")), "node")
    state = F.col("node") * 2 + F.when(back, 1 - F.col("dir")).otherwise(F.col("dir"))
    steps = between.select("ctg", "edge", "n1", "d1", "n2", "d2", "rid", state.alias("s"), F.lead(state).over(order).alias("t")).where("t is not null")
    counted = steps.groupBy("ctg", "edge", "n1", "d1", "n2", "d2", "s", "t").agg(F.count("*").alias("cov"))

    def longest(f):  # type: ignore[no-untyped-def]
        import pandas as pd

        start, goal = int(f["n1"].iloc[0]) * 2 + int(f["d1"].iloc[0]), int(f["n2"].iloc[0]) * 2 + int(f["d2"].iloc[0])
        after: dict[int, list[tuple[int, int]]] = {}
        waits: dict[int, int] = {}
        for s, t, c in zip(f["s"], f["t"], f["cov"], strict=True):
            after.setdefault(s, []).append((t, c))
            waits[t] = waits.get(t, 0) + 1
        best: dict[int, tuple[int, int, int | None]] = {start: (0, 0, None)}
        todo = [s for s in after if s not in waits]
        while todo:  # topological order; nodes on a ring are never ready, and stay out
            s = todo.pop()
            for t, c in after.get(s, ()):
                if s in best and (n := (best[s][0] + 1, best[s][1] + c, s)) > best.get(t, (0, 0, None))[:2] + (s,):
                    best[t] = n
                waits[t] -= 1
                if not waits[t]:
                    todo.append(t)
        path, s = [], goal if goal in best else None
        while s is not None:
            path.append(s)
            s = best[s][2]
        path.reverse()
        return pd.DataFrame({"ctg": f["ctg"].iloc[0], "edge": f["edge"].iloc[0], "ord": range(len(path)), "node": [s // 2 for s in path], "dir": [s % 2 for s in path]}, columns=["ctg", "edge", "ord", "node", "dir"])

    return counted.groupBy("ctg", "edge").applyInPandas(longest, "ctg long, edge int, ord int, node long, dir int")


def contigs(edges: DataFrame, nodes: DataFrame, p: GraphParams) -> DataFrame:
    """(ctg, step, node, dir, pos) of paths with enough nodes and length; ctg is the path's first state."""
    return long_enough(checkpointed(offsets(unitigs(edges, nodes), edges, p.reg_len)).withColumnRenamed("utg", "ctg"), p)


def long_enough(placed: DataFrame, p: GraphParams) -> DataFrame:
    """Those of placed paths(ctg, step, node, dir, pos) that have enough nodes and length."""
    size = placed.groupBy("ctg").agg(F.count("*").alias("n"), (F.max("pos") + p.reg_len).alias("length"))
    kept = size.where((F.col("n") >= p.ctg_min_nodes) & (F.col("length") >= p.ctg_min_length)).select("ctg")
    return placed.join(kept, "ctg", "left_semi")


def scaffolded(utgs: DataFrame, edges: DataFrame, cleaned: DataFrame, p: GraphParams) -> DataFrame:
    """(ctg, step, node, dir, pos): fragments along the unbranched paths of cleaned links, as paths of nodes.

    A fragment that is passed against its own direction gives its nodes in reverse order,
    turned round. A link's off is the gap between its fragments, or minus what they share.
    """
    placed = checkpointed(offsets(utgs, edges, p.reg_len))
    sizes = placed.groupBy("utg").agg((F.max("pos") + p.reg_len).alias("length"), F.count("*").alias("n"))
    paths = unitigs(cleaned, sizes.select(F.col("utg").alias("node"))).select(F.col("utg").alias("ctg"), F.col("step").alias("k"), F.col("node").alias("utg"), F.col("dir").alias("udir"))
    h = half_edges(cleaned, 3).select(F.col("src").alias("utg"), F.col("sdir").alias("udir"), F.col("dst").alias("u2"), F.col("ddir").alias("d2"), F.col("off").alias("gap")).groupBy("utg", "udir", "u2", "d2").agg(F.min("gap").alias("gap"))
    w = Window.partitionBy("ctg").orderBy("k")
    ahead = paths.withColumn("u2", F.lead("utg").over(w)).withColumn("d2", F.lead("udir").over(w)).join(h, ["utg", "udir", "u2", "d2"], "left").join(sizes, "utg")
    step = F.greatest(F.col("length") + F.coalesce("gap", F.lit(0)), F.lit(1))
    at = ahead.withColumn("start", F.sum(step).over(w) - step).withColumn("before", F.sum("n").over(w) - F.col("n"))
    nodes = at.select("ctg", "utg", "udir", "length", "n", "start", "before").join(placed.select("utg", "step", "node", "dir", F.col("pos").alias("inner")), "utg")
    along = F.col("udir") == 0
    return nodes.select(
        "ctg",
        (F.col("before") + F.when(along, F.col("step")).otherwise(F.col("n") - 1 - F.col("step"))).cast("int").alias("step"),
        "node",
        F.col("dir").bitwiseXOR(F.col("udir")).alias("dir"),
        (F.col("start") + F.when(along, F.col("inner")).otherwise(F.col("length") - F.col("inner") - p.reg_len)).cast("int").alias("pos"),
    )


def layout(ctgs: DataFrame, regions: DataFrame, reads: DataFrame, bin_size: int) -> DataFrame:
    """Reads on each edge of a contig, longest first: (ctg, edge, off, node1, dir1, node2, dir2, ord, rid, rdir, rbeg, rlen, seq), lengths in letters.

    A read supports an edge if it holds both nodes, one after the other, in the contig's direction or against it.
    """
    from strandlake.functions.sequence import reverse_complement

    w = Window.partitionBy("ctg").orderBy("step")
    steps = ctgs.select("ctg", F.col("step").alias("edge"), F.col("pos").alias("off"), F.col("node").alias("node1"), F.col("dir").alias("dir1"), F.lead("node").over(w).alias("node2"), F.lead("dir").over(w).alias("dir2")).where("node2 is not null")
    live = regions.where("not closed").select("node", "rid", "dir", "beg", "end")
    a, b = (live.select("rid", F.col("node").alias(f"node{k}"), F.col("dir").alias(f"r{k}"), F.col("beg").alias(f"b{k}"), F.col("end").alias(f"e{k}")) for k in (1, 2))
    both = steps.join(a, "node1").join(b, ["node2", "rid"])
    along = (F.col("r1") == F.col("dir1")) & (F.col("r2") == F.col("dir2")) & (F.col("b2") >= F.col("b1"))
    against = (F.col("r1") != F.col("dir1")) & (F.col("r2") != F.col("dir2")) & (F.col("b1") >= F.col("b2"))
    on = both.where(along | against).withColumn("rdir", F.when(along, 0).otherwise(1)).withColumn("lo", F.least("b1", "b2")).withColumn("hi", F.greatest("e1", "e2"))
    rank = F.row_number().over(Window.partitionBy("ctg", "edge").orderBy(F.desc(F.col("hi") - F.col("lo")), "rid", "lo"))
    text = F.substr("seq", F.col("lo") * bin_size + 1, (F.col("hi") - F.col("lo")) * bin_size)
    found = on.withColumn("ord", rank).join(reads.select(F.col("ridx").alias("rid"), "seq"), "rid")
    return found.select("ctg", "edge", (F.col("off") * bin_size).alias("off"), "node1", "dir1", "node2", "dir2", "ord", "rid", "rdir", (F.col("lo") * bin_size).alias("rbeg"), ((F.col("hi") - F.col("lo")) * bin_size).alias("rlen"), F.when(F.col("rdir") == 0, text).otherwise(reverse_complement(text)).alias("seq"))


def assemble(reads: DataFrame, map_params, p: GraphParams) -> dict[str, DataFrame]:
    """The whole way from reads to contigs.

    Overlaps; without contained reads and cut at chimeras; regions, nodes, those of repeats
    masked; edges, with mercy rescues, cleaned; unitigs as fragments; links between them by
    the reads that see both, cleaned; contigs along the links, and their long edges filled
    with the nodes of their reads.
    """
    from strandlake.operators import overlaps as o
    from strandlake.operators import regions as r
    from strandlake.operators.graph import clean, repeat_nodes, rescue_mercy
    from strandlake.operators.reads import trimmed_to_bins

    cut = checkpointed(trimmed_to_bins(reads, map_params.bin_size))
    found = checkpointed(o.map_reads(reads, map_params))
    inner = checkpointed(o.contained_reads(found))
    margin = p.max_overhang if p.max_overhang > 0 else 4
    clip = r.clips(found, margin)
    # a read that lies in another one adds nothing to the graph but depth: it is no anchor of nodes
    anchors = cut.join(inner.select(F.col("rid").alias("ridx")), "ridx", "left_anti").select(cut.columns)
    tiled = r.tiles(found, p).join(inner.select(F.col("rid").alias("anchor")), "anchor", "left_anti")
    cand = checkpointed(r.candidates(tiled.select("anchor", "tile", "rid", "dir", "beg", "end", "closed"), anchors, p))
    chosen = r.without_chimeras(r.within_clips(r.select_nodes(cand, p), clip), r.chimera_cuts(found, margin))
    chosen = checkpointed(chosen)
    nodes = checkpointed(r.mask_by_depth(chosen, p))
    masked = checkpointed(repeat_nodes(chosen.join(nodes.where("not closed").select("node"), "node", "left_semi"), p.min_node_cov))
    nodes = checkpointed(nodes.join(masked.withColumn("repeat", F.lit(True)), "node", "left").select("node", "nreg", (F.col("closed") | F.coalesce("repeat", F.lit(False))).alias("closed")))
    raw = checkpointed(build_edges(chosen, nodes, p))
    edges = clean(checkpointed(rescue_mercy(raw, chosen.join(nodes.where("not closed").select("node"), "node", "left_semi"))), nodes, p)
    live = nodes.where("not closed").select("node").join(degrees(edges).select("node"), "node", "left_semi")
    utgs = checkpointed(unitigs(edges, live))
    frags = checkpointed(fragments(utgs, edges, p.reg_len))
    linked = checkpointed(links(chosen, utgs, edges, p))
    cleaned = checkpointed(clean_links(linked, frags, p))
    ctgs = checkpointed(long_enough(checkpointed(scaffolded(utgs, edges, cleaned.drop("weak"), p)), p))
    return {"overlaps": found, "contained": inner, "regions": chosen, "nodes": nodes, "raw_edges": raw, "edges": edges, "unitigs": utgs, "fragments": frags, "links": cleaned, "contigs": ctgs, "dense": densified(ctgs, chosen), "reads": cut}
