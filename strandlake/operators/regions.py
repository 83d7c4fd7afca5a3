"""From overlaps to graph nodes: clips of reads, tiles, node candidates and their selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.config import GraphParams


def sides(overlaps: DataFrame) -> DataFrame:
    """Each overlap from both of its reads: (rid, beg, end, len, odir, obeg, oend, olen, mat)."""
    q = overlaps.select(F.col("qidx").alias("rid"), F.col("qb").alias("beg"), F.col("qe").alias("end"), F.col("qlen").alias("len"), F.col("qdir").alias("odir"), F.col("tb").alias("obeg"), F.col("te").alias("oend"), F.col("tlen").alias("olen"), "mat")
    t = overlaps.select(F.col("tidx").alias("rid"), F.col("tb").alias("beg"), F.col("te").alias("end"), F.col("tlen").alias("len"), F.col("qdir").alias("odir"), F.col("qb").alias("obeg"), F.col("qe").alias("oend"), F.col("qlen").alias("olen"), "mat")
    return q.unionByName(t)


def depth_runs(intervals: DataFrame, min_depth: int = 2) -> DataFrame:
    """(rid, beg, end): maximal stretches of each read that min_depth intervals (rid, beg, end) cover."""
    events = intervals.select("rid", F.inline(F.array(F.struct(F.col("beg").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))))
    steps = events.groupBy("rid", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("rid").orderBy("pos")
    depth = steps.withColumn("depth", F.sum("d").over(w)).withColumn("next", F.lead("pos").over(w)).where((F.col("depth") >= min_depth) & F.col("next").isNotNull())
    new = F.coalesce((F.lag("next").over(w) != F.col("pos")).cast("int"), F.lit(1))
    runs = depth.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("rid", "run").agg(F.min("pos").alias("beg"), F.max("next").alias("end")).select("rid", "beg", "end")


def clips(overlaps: DataFrame, margin: int = 4, min_depth: int = 2) -> DataFrame:
    """(rid, clp_beg, clp_end) of each read with overlaps: its longest stretch of depth min_depth, of equals the first.

    A read that some overlap covers, but for the margin, is kept whole. Overlaps whose both
    ends stop inside both reads don't count. (0, 0) where no stretch is deep enough.
    """
    s = sides(overlaps)
    left = F.when(F.col("odir") == 0, F.col("obeg")).otherwise(F.col("olen") - F.col("oend"))
    right = F.when(F.col("odir") == 0, F.col("olen") - F.col("oend")).otherwise(F.col("obeg"))
    x = (F.col("beg") > margin) & (left > margin)
    y = (F.col("end") + margin < F.col("len")) & (right > margin)
    whole = s.groupBy("rid").agg(F.max((F.col("beg") <= margin) & (F.col("end") + margin >= F.col("len"))).alias("whole"), F.first("len").alias("len"))
    best = depth_runs(s.where(~(x & y)).select("rid", "beg", "end"), min_depth).groupBy("rid").agg(F.max_by(F.struct("beg", "end"), F.struct(F.col("end") - F.col("beg"), -F.col("beg"))).alias("b"))
    both = whole.join(best, "rid", "left")
    return both.select("rid", F.when(F.col("whole"), 0).otherwise(F.coalesce("b.beg", F.lit(0))).cast("int").alias("clp_beg"), F.when(F.col("whole"), F.col("len")).otherwise(F.coalesce("b.end", F.lit(0))).cast("int").alias("clp_end"))


def chimera_cuts(overlaps: DataFrame, margin: int = 4) -> DataFrame:
    """(rid, pos, spurs, depth): places where more overlaps of a read stop inside both reads than run through."""
    s = sides(overlaps)
    left = F.when(F.col("odir") == 0, F.col("obeg")).otherwise(F.col("olen") - F.col("oend"))
    right = F.when(F.col("odir") == 0, F.col("olen") - F.col("oend")).otherwise(F.col("obeg"))
    spur = F.array_compact(F.array(F.when((F.col("beg") > margin) & (left > margin), F.col("beg")), F.when((F.col("end") + margin < F.col("len")) & (right > margin), F.col("end"))))
    at = s.select("rid", F.explode(spur).alias("pos")).groupBy("rid", "pos").agg(F.count("*").alias("spurs"))
    # overlaps through a place: those that began before it, less those that ended up to it
    steps = s.select("rid", F.inline(F.array(F.struct((F.col("beg") + 1).alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))).groupBy("rid", "pos").agg(F.sum("d").alias("d"))
    both = steps.select("rid", "pos", "d", F.lit(0).alias("spurs")).unionByName(at.select("rid", "pos", F.lit(0).alias("d"), "spurs")).groupBy("rid", "pos").agg(F.sum("d").alias("d"), F.sum("spurs").alias("spurs"))
    depth = F.sum("d").over(Window.partitionBy("rid").orderBy("pos"))
    return both.withColumn("depth", depth).where("spurs > 0 and spurs > 2 * depth").select("rid", "pos", "spurs", "depth")


_TILES = pa.schema([("anchor", pa.int64()), ("tile", pa.int32()), ("rid", pa.int64()), ("dir", pa.int32()), ("beg", pa.int32()), ("end", pa.int32()), ("closed", pa.bool_())])


def cigar_steps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, letter) of each step of cigars: a letter without a number is one step."""
    text = pa.concat_arrays([pa.array([], pa.binary()), column.cast(pa.binary())])
    ends = np.cumsum(np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False)).astype(np.int64))
    data = np.frombuffer(b"".join(x or b"" for x in text.to_pylist()), np.uint8)
    at = np.flatnonzero(data > 57)  # letters, of which each ends a run
    figures = np.flatnonzero(data <= 57)
    run = np.searchsorted(at, figures)
    number = np.bincount(run, (data[figures] - 48.0) * 10.0 ** (at[run] - 1 - figures), len(at)).astype(np.int64)
    alone = np.diff(at, prepend=-1) == 1
    count = np.where(alone, 1, number)
    return np.repeat(np.searchsorted(ends, at, side="right"), count), np.repeat(data[at], count)


def _projected(p: GraphParams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n = p.reg_len

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {name: b.column(name).to_numpy(zero_copy_only=False) for name in ("qidx", "qdir", "qlen", "tidx", "tb", "qs", "mask")}
            row, letter = cigar_steps(b.column("cigar"))
            low = letter | 32
            first = np.searchsorted(row, np.arange(b.num_rows))

            def place(moves: np.ndarray, start: np.ndarray) -> np.ndarray:
                """The bin of each step on a read of which some letters take one more."""
                total = np.r_[0, np.cumsum(np.isin(low, moves))]
                return np.maximum(total[1:] - total[first[row]] - 1, 0) + start[row]  # noqa: B023

            x, y = place(np.frombuffer(b"mi", np.uint8), c["qs"]), place(np.frombuffer(b"md", np.uint8), c["tb"])
            forward = np.where(c["qdir"][row] == 0, x, c["qlen"][row] - 1 - x)
            back = c["qdir"][row] == 1
            for own, other, anchor, rid in ((forward, y, "qidx", "tidx"), (y, x, "tidx", "qidx")):
                # both places only grow, or only fall, along the steps of a row, so a tile's steps are neighbours
                tile = own // n
                head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])]) if len(row) else np.empty(0, np.int64)
                tail = np.r_[head[1:], len(row)] - 1
                hits = np.add.reduceat((letter < 97).astype(np.int64), head) if len(head) else head
                whole = (np.abs(own[tail] - own[head]) + 1 == n) & (hits >= p.min_node_mats)
                head, tail = head[whole], tail[whole]
                of, beg, end = row[head], other[head], other[tail] + 1
                if anchor == "tidx":  # on the query's forward strand
                    beg, end = np.where(back[head], c["qlen"][of] - end, beg), np.where(back[head], c["qlen"][of] - beg, end)
                closed = c["mask"][of] | (np.abs(end - beg - n) > 1)
                values = (c[anchor][of], tile[head], c[rid][of], c["qdir"][of], beg, end, closed.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _TILES, strict=True)], schema=_TILES)

    return projected


def tiles(overlaps: DataFrame, p: GraphParams) -> DataFrame:
    """(anchor, tile, rid, dir, beg, end, closed): each tile of reg_len bins of one read, projected by the cigar onto the other, both ways.

    A tile counts if min_node_mats bins of it match; it is closed if its projection is more
    than a bin longer or shorter, or the overlap no dovetail. Overlaps are projected where they
    are, a batch at a time as arrays of steps; nothing is shuffled.
    """
    from strandlake.operators.overlaps import dovetail

    qs = F.when(F.col("qdir") == 0, F.col("qb")).otherwise(F.col("qlen") - F.col("qe"))
    o = overlaps.where("cigar != '*'").select("qidx", "qdir", "qlen", "tidx", "tb", qs.alias("qs"), (~dovetail(p.max_overhang)).alias("mask"), "cigar")
    return o.mapInArrow(_projected(p), "anchor long, tile int, rid long, dir int, beg int, end int, closed boolean")


def candidates(projected: DataFrame, bincnts: DataFrame, p: GraphParams) -> DataFrame:
    """Regions of every candidate node, the anchor's own tile among them, with the node's number of regions: (anchor, tile, rid, dir, beg, end, closed, nreg)."""
    own = bincnts.where(F.col("bincnt") >= p.reg_len).select(F.col("ridx").alias("anchor"), F.explode(F.sequence(F.lit(0), F.floor(F.col("bincnt") / p.reg_len).cast("int") - 1)).alias("tile"))
    own = own.select("anchor", "tile", F.col("anchor").alias("rid"), F.lit(0).alias("dir"), (F.col("tile") * p.reg_len).alias("beg"), ((F.col("tile") + 1) * p.reg_len).alias("end"), F.lit(False).alias("closed"))
    every = own.unionByName(projected)
    count = every.groupBy("anchor", "tile").agg(F.count("*").alias("nreg")).where(F.col("nreg") >= p.min_node_cov)
    return every.join(count, ["anchor", "tile"])


#: Anchors of a block of nodes that are ranked together.
BLOCK = 4096


def ranked(regions: DataFrame) -> DataFrame:
    """(anchor, tile, nreg, rank): nodes by the distance of their regions from the deepest node's plus one, then anchor and tile.

    Most nodes have one of a few distances; so nodes are ranked within blocks of anchors of a
    distance, after the counts of the blocks before.
    """
    nodes = regions.select("anchor", "tile", "nreg").distinct()
    top = nodes.agg(F.max("nreg").alias("top"))
    away = nodes.crossJoin(F.broadcast(top)).select("anchor", "tile", "nreg", (F.col("top") + 1 - F.col("nreg")).alias("away"), F.floor(F.col("anchor") / BLOCK).alias("block"))  # one row
    blocks = away.groupBy("away", "block").agg(F.count("*").alias("n"))
    inner = blocks.withColumn("inner", F.sum("n").over(Window.partitionBy("away").orderBy("block")) - F.col("n"))
    start = blocks.groupBy("away").agg(F.sum("n").alias("n")).select("away", (F.sum("n").over(Window.orderBy("away")) - F.col("n")).alias("start"))
    before = inner.join(start, "away").select("away", "block", (F.col("inner") + F.col("start")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("away", "block").orderBy("anchor", "tile")) - 1
    return away.join(before, ["away", "block"]).select("anchor", "tile", "nreg", rank.alias("rank"))


_REGS = pa.schema([("node", pa.int64()), ("rid", pa.int64()), ("beg", pa.int32()), ("end", pa.int32()), ("nreg", pa.int64()), ("open", pa.int64()), ("fate", pa.int32()), ("state", pa.int32())])
#: Regions of whole reads that are judged together, about.
TOGETHER = 1 << 16


def _judged(rows: pa.Table, reg_ovl: int) -> pa.RecordBatch:
    """Rows of whole reads, in order of read and node, with the fates that follow for undecided regions from those of smaller rank."""
    c = {name: rows.column(name).to_numpy() for name in rows.column_names}
    fates = c["fate"].copy()
    cuts = np.flatnonzero(np.diff(c["rid"])) + 1
    starts = np.r_[0, cuts]
    waits = np.add.reduceat((fates == 0).astype(np.int64), starts)
    for start, stop in zip(starts[waits > 0].tolist(), np.r_[cuts, len(fates)][waits > 0].tolist(), strict=True):
        beg, end, fate, state = (x[start:stop] for x in (c["beg"], c["end"], fates, c["state"]))
        place = np.argsort(beg, kind="stable")
        todo = np.flatnonzero(fate == 0)
        low = np.searchsorted(beg[place], beg[todo] - (end - beg).max(), side="left")
        high = np.searchsorted(beg[place], end[todo], side="left")
        for k, first, last in zip(todo.tolist(), low.tolist(), high.tolist(), strict=True):
            near = place[first:last]
            near = near[near < k]
            near = near[(fate[near] >= 0) & (np.minimum(end[near], end[k]) - np.maximum(beg[near], beg[k]) > reg_ovl)]
            if not len(near):
                fate[k] = 1
            elif ((fate[near] == 1) & (state[near] == 1)).any():
                fate[k] = -1
    return pa.RecordBatch.from_arrays([pa.array(fates if x.name == "fate" else c[x.name], x.type) for x in _REGS], schema=_REGS)


def judged(regs: DataFrame, reg_ovl: int) -> DataFrame:
    """regs(node, rid, beg, end, nreg, open, fate, state) that are not lost, of nodes not rejected, after the regions of each read were judged in order of rank.

    A region is lost if it overlaps a safe one of an accepted node of smaller rank by more than
    reg_ovl bins, and safe if it overlaps none of smaller rank but lost ones. Reads stream through
    in Arrow batches; a task holds those of a few batches, and never parts one.
    """

    def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            rid = rows["rid"].to_numpy()
            whole = int(np.searchsorted(rid, rid[-1]))  # the last read may go on
            if whole:
                yield _judged(rows.slice(0, whole), reg_ovl)
            held = rows.slice(whole).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held)
        if size:
            yield _judged(pa.Table.from_batches(held), reg_ovl)

    return regs.select(_REGS.names).repartition("rid").sortWithinPartitions("rid", "node").mapInArrow(reads, "node long, rid long, beg int, end int, nreg long, open long, fate int, state int")


def select_nodes(regions: DataFrame, p: GraphParams) -> DataFrame:
    """Nodes whose regions don't conflict with those of nodes chosen before: (node, rid, dir, beg, end, closed), node being the rank.

    The rule is sequential by rank: a region is closed if its read comes twice in the node, or
    it overlaps an open region of an accepted node by more than reg_ovl bins; a node is accepted
    if enough regions stay open. It is run in rounds until nothing is undecided, which gives the
    sequential result: a region is lost once it overlaps one that stays, and safe once all of
    smaller rank that it overlaps are lost or their nodes rejected; a node is rejected once too
    many regions are lost, and accepted once enough are safe. Of what is undecided the smallest
    rank can always be decided, so rounds end. A round shuffles regions, by read and by node;
    which of them conflict is seen where a read's regions are, and never written.
    """
    from strandlake.operators.graph import checkpointed

    ranks = ranked(regions)
    r = regions.join(ranks.select("anchor", "tile", F.col("rank").alias("node")), ["anchor", "tile"]).select("node", "rid", "dir", "beg", "end", "closed", "nreg")
    twice = F.count("*").over(Window.partitionBy("node", "rid")) > 1
    r = checkpointed(r.withColumn("closed", F.col("closed") | twice))
    # fate of a region: 1 safe, -1 lost; state of its node: 1 accepted, -1 rejected
    each = Window.partitionBy("node")
    live = r.where("not closed").withColumn("open", F.count("*").over(each))
    regs = live.select("node", "rid", F.col("beg").cast("int").alias("beg"), F.col("end").cast("int").alias("end"), "nreg", "open", F.lit(0).alias("fate"), F.lit(0).alias("state"))
    while True:
        new = judged(regs.where("fate >= 0"), p.reg_ovl).unionByName(regs.where("fate < 0"))
        most, least = F.col("open") - F.sum((F.col("fate") == -1).cast("int")).over(each), F.sum((F.col("fate") == 1).cast("int")).over(each)
        most_stands, least_stands = ((n >= p.min_node_cov) & (n >= F.col("nreg") * (1 - p.node_drop)) for n in (most, least))
        state = F.when(F.col("state") != 0, F.col("state")).when(least_stands, 1).when(~most_stands, -1).otherwise(0)
        regs = checkpointed(new.withColumn("state", state).where("state >= 0"))  # a rejected node is in nobody's way
        if regs.where("fate = 0").isEmpty():
            break
    taken = regs.where("state = 1")
    lost = taken.where("fate = -1").select("node", "rid", F.lit(True).alias("lost"))
    out = r.join(taken.select("node").distinct(), "node", "left_semi").join(lost, ["node", "rid"], "left")
    return out.select("node", "rid", "dir", "beg", "end", (F.col("closed") | F.coalesce("lost", F.lit(False))).alias("closed"))


def mask_by_depth(regions: DataFrame, p: GraphParams) -> DataFrame:
    """(node, nreg, closed): nodes with too few or too many open regions are closed."""
    n = regions.groupBy("node").agg(F.sum((~F.col("closed")).cast("int")).alias("nreg"))
    return n.select("node", "nreg", ((F.col("nreg") < p.min_node_cov) | (F.col("nreg") > p.max_node_cov)).alias("closed"))


def within_clips(regions: DataFrame, clip: DataFrame) -> DataFrame:
    """Regions, closed where they reach out of their read's clip; reads without a clip are whole."""
    r = regions.join(clip, "rid", "left")
    out = F.col("clp_beg").isNotNull() & ((F.col("beg") < F.col("clp_beg")) | (F.col("end") > F.col("clp_end")))
    return r.select(*[(F.col("closed") | out).alias("closed") if c == "closed" else c for c in regions.columns])


def without_chimeras(regions: DataFrame, cuts: DataFrame) -> DataFrame:
    """Regions, closed where they lie across a place cuts(rid, pos) of their read."""
    at = regions.where("not closed").select("node", "rid", "beg", "end").join(cuts.select("rid", "pos"), "rid").where("beg < pos and end > pos").select("node", "rid", "beg", "end").distinct()
    r = regions.join(at.withColumn("cut", F.lit(True)), ["node", "rid", "beg", "end"], "left")
    return r.select(*[(F.col("closed") | F.coalesce("cut", F.lit(False))).alias("closed") if c == "closed" else c for c in regions.columns])


def greedy_best_hits(hits: DataFrame, min_length: int = 0, min_fraction: float = 0.0) -> DataFrame:
    """Of each query its hits by falling span that don't overlap one taken before: hits(qidx, qlen, qb, qe, ...)."""
    columns = hits.columns
    where = [columns.index(c) for c in ("qidx", "qlen", "qb", "qe")]
    ordered = hits.repartition("qidx").sortWithinPartitions("qidx", F.desc(F.col("qe") - F.col("qb")), "qb", *[c for c in columns if c not in ("qidx", "qb", "qe")])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        query, taken = None, []  # intervals of the query, in order
        for f in frames:
            keep = []
            for row in f.itertuples(index=False):
                q, n, b, e = (row[i] for i in where)
                if q != query:
                    query, taken = q, []
                k = bisect.bisect(taken, (b, e))
                free = (k == 0 or taken[k - 1][1] <= b) and (k == len(taken) or taken[k][0] >= e)
                good = free and e - b >= min_length and e - b >= min_fraction * n
                if good:
                    taken.insert(k, (b, e))
                keep.append(good)
            yield f[pd.Series(keep, index=f.index, dtype=bool)]

    return ordered.mapInPandas(choose, hits.schema)
