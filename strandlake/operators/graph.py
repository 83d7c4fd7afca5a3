"""The bidirected overlap graph as DataFrames: edges from regions, clean-up, paths.

edges: (node1, dir1, node2, dir2, cov, off, closed), node1 < node2; node1 is left in
direction dir1 and node2 entered in direction dir2. closed: 0 open, 1 masked, 2 less, 3
hard. Half-edges show each edge from both its nodes: (src, sdir, dst, ddir, cov, off,
closed). Each operator takes tables and gives a new one; loops write what they reached to
the checkpoint folder and stop when a round changes nothing.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.config import GraphParams

OPEN, MASKED, LESS, HARD = 0, 1, 2, 3
KEY = ["node1", "dir1", "node2", "dir2"]


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, which the session names; of this machine only where all run on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """Tasks that long computations on few bytes are dealt to: by its bytes Spark would give an assembly to a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


class Tables:
    """Tables that a loop writes to the shared folder, removed when it is over.

    Unlike a checkpoint's, the size of a written table is known: plans of later rounds are made
    from it, and not from products of the sizes that the rounds before were estimated to have. A
    table beyond SMALL_TABLE is never broadcast: its files may be some hundredths of its rows in memory.
    """

    #: Bytes of files.
    SMALL_TABLE = 1 << 18

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Tables:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n}")
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return out.hint("merge") if size > self.SMALL_TABLE else out

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def region_pairs(regions: DataFrame, span: int) -> DataFrame:
    """Pairs of regions of one read up to `span` bins apart, in node order: KEY, off, adjacent.

    regions: (node, rid, dir, beg, end), open ones only. Each region is met by the later ones
    in its own and the next slots of the read, a slot being the span and the longest region
    wide at least; so a join by slot finds all pairs within the span, and no others grow with
    the read's length.
    """
    w = Window.partitionBy("rid").orderBy("beg", "end", "node", "dir")
    numbered = regions.withColumn("k", F.row_number().over(w)).withColumn("slot", F.floor(F.col("beg") / (span + 64)).cast("int"))
    longest = F.greatest(F.lit(0), F.floor((F.col("end") + span) / (span + 64)) - F.col("slot")).cast("int")
    a = numbered.select("rid", F.explode(F.sequence(F.col("slot"), F.col("slot") + longest)).alias("slot"), *[F.col(c).alias(f"{c}_a") for c in ("node", "dir", "beg", "end", "k")])
    b = numbered.select("rid", "slot", *[F.col(c).alias(f"{c}_b") for c in ("node", "dir", "beg", "end", "k")])
    pairs = a.join(b, ["rid", "slot"]).where((F.col("k_a") < F.col("k_b")) & (F.col("beg_b") <= F.col("end_a") + span) & (F.col("node_a") != F.col("node_b")))
    up = F.col("node_a") < F.col("node_b")
    return pairs.select(
        F.when(up, F.col("node_a")).otherwise(F.col("node_b")).alias("node1"), F.when(up, F.col("dir_a")).otherwise(1 - F.col("dir_b")).alias("dir1"),
        F.when(up, F.col("node_b")).otherwise(F.col("node_a")).alias("node2"), F.when(up, F.col("dir_b")).otherwise(1 - F.col("dir_a")).alias("dir2"),
        (F.col("beg_b") - F.col("end_a")).alias("off"), (F.col("k_b") == F.col("k_a") + 1).alias("adjacent"),
    )


def build_edges(regions: DataFrame, nodes: DataFrame, p: GraphParams) -> DataFrame:
    """Edges with their number of reads and their upper median offset; LESS where no read has the two nodes next to each other, or too few reads.

    nodes(node, closed): regions of closed nodes don't count.
    """
    live = regions.where("not closed").join(nodes.where("not closed").select("node"), "node", "left_semi")
    found = region_pairs(live, p.max_edge_span)
    offs = found.groupBy(*KEY, "off").agg(F.count("*").alias("n"), F.max("adjacent").alias("adjacent"))
    w = Window.partitionBy(KEY).orderBy("off")
    whole = Window.partitionBy(KEY)
    ranked = offs.withColumn("upto", F.sum("n").over(w)).withColumn("cov", F.sum("n").over(whole)).withColumn("adjacent", F.max("adjacent").over(whole))
    middle = ranked.where(F.col("upto") > F.floor(F.col("cov") / 2))
    closed = F.when(F.first("adjacent") & (F.first("cov") >= p.min_edge_cov), OPEN).otherwise(LESS)
    return middle.groupBy(KEY).agg(F.first("cov").cast("int").alias("cov"), F.min("off").cast("int").alias("off"), closed.alias("closed"))


def half_edges(edges: DataFrame, most_closed: int = OPEN) -> DataFrame:
    live = edges.where(F.col("closed") <= most_closed)
    one = live.select(F.col("node1").alias("src"), F.col("dir1").alias("sdir"), F.col("node2").alias("dst"), F.col("dir2").alias("ddir"), "cov", "off", "closed")
    two = live.select(F.col("node2").alias("src"), (1 - F.col("dir2")).alias("sdir"), F.col("node1").alias("dst"), (1 - F.col("dir1")).alias("ddir"), "cov", "off", "closed")
    return one.unionByName(two)


def degrees(edges: DataFrame, most_closed: int = OPEN) -> DataFrame:
    """(node, fwd, bwd): live edges on either side of each node that has any."""
    h = half_edges(edges, most_closed)
    return h.groupBy(F.col("src").alias("node")).agg(F.count(F.when(F.col("sdir") == 0, 1)).alias("fwd"), F.count(F.when(F.col("sdir") == 1, 1)).alias("bwd"))


def close(edges: DataFrame, keys: DataFrame, level: int) -> DataFrame:
    """edges, those of keys(KEY) closed to `level` at least."""
    hit = keys.select(*KEY).distinct().withColumn("hit", F.lit(True))
    joined = edges.join(hit, KEY, "left")
    return joined.select(*KEY, "cov", "off", F.when(F.col("hit"), F.greatest(F.col("closed"), F.lit(level))).otherwise(F.col("closed")).alias("closed"))


def as_keys(halves: DataFrame) -> DataFrame:
    """KEY of half-edges."""
    up = F.col("src") < F.col("dst")
    return halves.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("node1"), F.when(up, F.col("sdir")).otherwise(1 - F.col("ddir")).alias("dir1"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("node2"), F.when(up, F.col("ddir")).otherwise(1 - F.col("sdir")).alias("dir2"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges, those at nodes of gone(node) closed hard."""
    g = gone.select("node").distinct()
    hit1, hit2 = g.select(F.col("node").alias("node1"), F.lit(True).alias("h1")), g.select(F.col("node").alias("node2"), F.lit(True).alias("h2"))
    joined = edges.join(hit1, "node1", "left").join(hit2, "node2", "left")
    return joined.select(*KEY, "cov", "off", F.when(F.coalesce("h1", "h2", F.lit(False)), HARD).otherwise(F.col("closed")).alias("closed"))


def cut_binary(edges: DataFrame) -> DataFrame:
    """Two nodes that are joined on both sides of one of them lose those edges."""
    h = half_edges(edges)
    both = h.groupBy("src", "dst").agg(F.count_distinct("sdir").alias("n")).where("n = 2")
    return close(edges, as_keys(h.join(both.select("src", "dst"), ["src", "dst"], "left_semi")), HARD)


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of open nodes without a live edge."""
    return nodes.where("not closed").select("node").join(degrees(edges).select("node"), "node", "left_anti")


def branching_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("fwd > 1 or bwd > 1").select("node")


def blunt_tips(edges: DataFrame) -> DataFrame:
    """Nodes with no edge on one side and two or more on the other."""
    return degrees(edges).where("(fwd = 0 and bwd > 1) or (bwd = 0 and fwd > 1)").select("node")


def tandem_repeats(edges: DataFrame, nodes: DataFrame, min_cov: int, ratio: float) -> DataFrame:
    """Nodes of min_cov regions at least, none of whose edges has the fraction `ratio` of them."""
    best = half_edges(edges, LESS).groupBy(F.col("src").alias("node")).agg(F.max("cov").alias("best"))
    return nodes.where(F.col("nreg") >= min_cov).join(best, "node").where(F.col("best") < F.col("nreg") * ratio).select("node")


def transitive(edges: DataFrame, reg_len: int, fuzz: int = 1, share: float = 0.2) -> DataFrame:
    """KEY of edges that go two ways: directly, and by a node between (Myers, 2005), seen from both their nodes.

    From a node's side an edge to x goes if an edge to w and one from w to x add up to no
    more than the side's longest edge and the fuzz (the larger of fuzz and share x longest),
    or if the edge from w to x is within the fuzz, or the first one from w.
    """
    h = half_edges(edges)
    side = h.groupBy("src", "sdir").agg(F.max(F.col("off") + reg_len).alias("longest"))
    side = side.withColumn("fuzz", F.greatest(F.lit(fuzz), F.floor(F.col("longest") * share)).cast("int"))
    first = F.row_number().over(Window.partitionBy("src", "sdir").orderBy("off", F.desc("cov"), "dst", "ddir")) == 1
    second = h.withColumn("first", first).select(F.col("src").alias("w"), F.col("sdir").alias("wdir"), F.col("dst").alias("x"), F.col("off").alias("off2"), "first")
    hops = h.select("src", "sdir", F.col("dst").alias("w"), F.col("ddir").alias("wdir"), F.col("off").alias("off1")).join(second, ["w", "wdir"]).join(side, ["src", "sdir"])
    near = hops.where((F.col("off1") + F.col("off2") + reg_len <= F.col("longest") + F.col("fuzz")) | (F.col("off2") <= F.col("fuzz")) | F.col("first"))
    flagged = h.join(near.select("src", "sdir", F.col("x").alias("dst")).distinct(), ["src", "sdir", "dst"], "left_semi")
    return as_keys(flagged).groupBy(KEY).agg(F.count("*").alias("n")).where("n = 2").select(KEY)


def cut_transitive(edges: DataFrame, reg_len: int) -> DataFrame:
    return close(edges, transitive(edges, reg_len), HARD)


def linear_steps(edges: DataFrame) -> DataFrame:
    """(state, next): oriented nodes (2 node + direction) joined by an edge that is the only one on both its sides."""
    h = half_edges(edges)
    out = h.groupBy("src", "sdir").agg(F.count("*").alias("n")).where("n = 1").select("src", "sdir")
    # a graph's size isn't known from the tables it comes from: neither these nor the paths below are to be broadcast
    out = out.hint("merge")
    single = h.join(out, ["src", "sdir"], "left_semi")
    entry = out.select(F.col("src").alias("dst"), (1 - F.col("sdir")).alias("ddir"))
    both = single.join(entry, ["dst", "ddir"], "left_semi")
    return both.select((F.col("src") * 2 + F.col("sdir")).alias("state"), (F.col("dst") * 2 + F.col("ddir")).alias("next"))


def linear_paths(steps: DataFrame, states: DataFrame) -> DataFrame:
    """(head, state, step): each state of states(state), the first state of its path and the number of steps from there.

    Pointer jumping: a state's pointer and distance double each round, so a path of n states
    takes log n joins. The smallest state of a cycle becomes its head.
    """
    back = states.hint("merge").join(steps.select(F.col("next").alias("state"), F.col("state").alias("to")), "state", "left")
    at = checkpointed(back.select("state", F.coalesce("to", "state").alias("to"), F.col("to").isNotNull().cast("long").alias("step"), F.least("state", F.coalesce("to", "state")).alias("low"), F.col("to").isNull().alias("done")))
    n = at.count()
    for _ in range(max(1, n).bit_length() + 1):
        ahead = at.select(F.col("state").alias("to"), F.col("to").alias("to2"), F.col("step").alias("step2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        waiting = at.where("not done").hint("merge").join(ahead, "to").select("state", F.col("to2").alias("to"), (F.col("step") + F.col("step2")).alias("step"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        at = checkpointed(at.where("done").unionByName(waiting))
        if at.where("not done").isEmpty():
            break
    ringed = at.where("not done").select("state", "low")
    if ringed.isEmpty():
        return at.select(F.col("to").alias("head"), "state", "step")
    cut = steps.join(ringed.where("state = low").select(F.col("state").alias("next")), "next", "left_anti")
    return linear_paths(cut.select("state", "next"), states)


def unitigs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(utg, step, node, dir): maximal paths without branches, each once, by the end whose state is smaller.

    nodes(node) are the nodes that take part; one without such edges is a path by itself.
    """
    states = nodes.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("state"))
    paths = linear_paths(linear_steps(edges), states)
    ends = paths.groupBy("head").agg(F.max_by("state", "step").alias("tail"))
    # the same path the other way starts at the tail's other direction
    kept = ends.where(F.col("head") <= F.col("tail") + 1 - 2 * (F.col("tail") % 2)).select("head")
    out = paths.hint("merge").join(kept, "head", "left_semi")
    # a ring, or a path that is its own reverse, may have kept both ways: the smaller head of each node has it
    out = out.select(F.col("head").alias("utg"), F.col("step").cast("int").alias("step"), F.floor(F.col("state") / 2).alias("node"), (F.col("state") % 2).cast("int").alias("dir"))
    first = out.groupBy("node").agg(F.min("utg").alias("utg"))
    return out.join(first.hint("merge"), ["node", "utg"], "left_semi").select("utg", "step", "node", "dir")


def unitig_ends(utgs: DataFrame, edges: DataFrame) -> DataFrame:
    """Both ends of each unitig, and what lies beyond: (utg, n, end, node, dir, out): leaving the end at `node` in `dir`, `out` live edges."""
    size = utgs.groupBy("utg").agg(F.max("step").alias("last"), F.min_by("node", "step").alias("n0"), F.min_by("dir", "step").alias("d0"), F.max_by("node", "step").alias("n1"), F.max_by("dir", "step").alias("d1"))
    ends = size.select("utg", (F.col("last") + 1).alias("n"), F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("n0").alias("node"), (1 - F.col("d0")).alias("dir")), F.struct(F.lit(1).alias("end"), F.col("n1").alias("node"), F.col("d1").alias("dir")))))
    out = half_edges(edges).groupBy(F.col("src").alias("node"), F.col("sdir").alias("dir")).agg(F.count("*").alias("out"))
    return ends.join(out, ["node", "dir"], "left").select("utg", "n", "end", "node", "dir", F.coalesce("out", F.lit(0)).alias("out"))


def tip_nodes(edges: DataFrame, nodes: DataFrame, max_step: int) -> DataFrame:
    """(node) of dead ends up to max_step nodes, where they meet a branch that is longer, or as long with a better edge.

    A branch that doesn't end itself counts as one step longer.
    """
    utgs = unitigs(edges, nodes)
    ends = checkpointed(unitig_ends(utgs, edges))
    other = ends.select("utg", F.col("end").alias("e2"), F.col("out").alias("out2"))
    sized = ends.join(other, "utg").where("e2 != end").select("utg", "n", "node", "dir", "out", "out2")
    tips = sized.where(f"out = 1 and out2 = 0 and n <= {max_step}")
    h = half_edges(edges)
    joint = tips.join(h, (h.src == tips.node) & (h.sdir == tips.dir)).select("utg", "n", F.col("src").alias("tip"), F.col("dst").alias("j"), F.col("ddir").alias("jdir"), F.col("cov").alias("tcov"), F.col("off").alias("toff"))
    rivals = h.select(F.col("src").alias("r"), F.col("sdir").alias("rdir"), F.col("dst").alias("j"), F.col("ddir").alias("jdir"), F.col("cov").alias("rcov"), F.col("off").alias("roff"))
    reach = sized.select(F.col("node").alias("r"), F.col("dir").alias("rdir"), (F.col("n") + (F.col("out2") > 0).cast("int")).alias("rn"))
    met = joint.join(rivals, ["j", "jdir"]).where("r != tip").join(reach, ["r", "rdir"])
    better = (F.col("rn") > F.col("n")) | ((F.col("rn") == F.col("n")) & ((F.col("rcov") > F.col("tcov")) | ((F.col("n") == 1) & (F.col("rcov") == F.col("tcov")) & ((F.col("roff") > F.col("toff")) | ((F.col("roff") == F.col("toff")) & (F.col("r") < F.col("tip")))))))
    lost = met.where(better).select("utg").distinct()
    return utgs.join(lost, "utg", "left_semi").select("node").distinct()


def bubble_nodes(edges: DataFrame, nodes: DataFrame, max_step: int) -> DataFrame:
    """(node) of the weaker sides of bubbles: unbranched paths up to max_step nodes between the same two oriented nodes.

    The side with the largest mean coverage stays, of equals the one with more nodes, then the smallest.
    """
    utgs = unitigs(edges, nodes)
    ends = checkpointed(unitig_ends(utgs, edges).where(f"out = 1 and n <= {max_step}"))
    h = half_edges(edges)
    beyond = ends.join(h, (h.src == ends.node) & (h.sdir == ends.dir)).select("utg", "n", "end", "dst", "ddir", F.col("cov").alias("ecov"))
    a = beyond.where("end = 0").select("utg", "n", F.struct("dst", "ddir").alias("a"), F.col("ecov").alias("c0"))
    b = beyond.where("end = 1").select("utg", F.struct("dst", "ddir").alias("b"), F.col("ecov").alias("c1"))
    sides = a.join(b, "utg").where("a.dst != b.dst").select("utg", "n", F.least("a", "b").alias("from"), F.greatest("a", "b").alias("to"), (F.col("c0") + F.col("c1")).alias("cov"))
    rank = F.row_number().over(Window.partitionBy("from", "to").orderBy(F.desc("cov"), F.desc("n"), "utg"))
    lost = sides.withColumn("k", rank).where("k > 1").select("utg")
    return utgs.join(lost, "utg", "left_semi").select("node").distinct()


def rescue_mercy(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Opens stored edges between a node that ends and, next on some read, one that starts.

    All rescues are judged on the graph as it comes, so their order doesn't matter.
    """
    deg = degrees(edges)
    placed = regions.where("not closed").join(deg, "node", "left").na.fill(0, ["fwd", "bwd"])
    w = Window.partitionBy("rid").orderBy("beg", "end", "node", "dir")
    ahead = F.when(F.col("dir") == 0, F.col("fwd")).otherwise(F.col("bwd"))
    behind = F.when(F.col("dir") == 0, F.col("bwd")).otherwise(F.col("fwd"))
    steps = placed.withColumn("ahead", ahead).withColumn("behind", behind)
    pair = steps.select(F.col("node").alias("src"), F.col("dir").alias("sdir"), F.lead("node").over(w).alias("dst"), F.lead("dir").over(w).alias("ddir"), "ahead", F.lead("behind").over(w).alias("behind"))
    keys = as_keys(pair.where("ahead = 0 and behind = 0 and src != dst")).distinct().withColumn("hit", F.lit(True))
    joined = edges.join(keys, KEY, "left")
    return joined.select(*KEY, "cov", "off", F.when(F.col("hit") & (F.col("closed") <= LESS), OPEN).otherwise(F.col("closed")).alias("closed"))


def rescue_high_cov(edges: DataFrame, low: int = 20) -> DataFrame:
    """Where a side's only live edge has a coverage below `low`, and a closed edge of more coverage leads to a node at most two linear steps on, the two exchange."""
    h = half_edges(edges)
    side = h.groupBy("src", "sdir").agg(F.count("*").alias("n"), F.first("dst").alias("d1"), F.first("ddir").alias("e1"), F.first("cov").alias("c1"))
    one = side.where(f"n = 1 and c1 < {low}").select("src", "sdir", "d1", "e1", "c1")
    after = side.where("n = 1").select(F.col("src").alias("d1"), F.col("sdir").alias("e1"), F.col("d1").alias("d2"), F.col("e1").alias("e2"))
    reach = one.join(after, ["d1", "e1"]).select("src", "sdir", "d1", "e1", "c1", F.col("d2").alias("dst"), F.col("e2").alias("ddir"))
    shut = half_edges(edges, LESS).where(F.col("closed") > OPEN).select("src", "sdir", "dst", "ddir", "cov")
    swap = checkpointed(reach.join(shut, ["src", "sdir", "dst", "ddir"]).where("cov > c1"))
    opened = as_keys(swap).distinct().withColumn("o", F.lit(True))
    cut = as_keys(swap.select("src", "sdir", F.col("d1").alias("dst"), F.col("e1").alias("ddir"))).distinct().withColumn("c", F.lit(True))
    j = edges.join(opened, KEY, "left").join(cut, KEY, "left")
    return j.select(*KEY, "cov", "off", F.when(F.col("o"), OPEN).when(F.col("c"), LESS).otherwise(F.col("closed")).alias("closed"))


def clean(edges: DataFrame, nodes: DataFrame, p: GraphParams) -> DataFrame:
    """The clean-up of a node graph: binary edges, transitive reduction, tips, blunt tips and bubbles until nothing changes, superbubbles, yarns, coverage rescue, branching nodes."""
    from strandlake.operators.local import pop_superbubbles, resolve_yarns

    e = checkpointed(cut_transitive(checkpointed(cut_binary(edges)), p.reg_len))
    live = nodes.where("not closed").select("node")
    changed = True
    while changed:  # each round takes nodes out, so rounds end
        changed = False
        for find in (lambda e, n: tip_nodes(e, n, p.tip_step), lambda e, n: blunt_tips(e), lambda e, n: bubble_nodes(e, n, p.bub_step)):
            gone = checkpointed(find(e, live))
            if not gone.isEmpty():
                e, live, changed = checkpointed(without_nodes(e, gone)), checkpointed(live.join(gone, "node", "left_anti")), True
    e = resolve_yarns(pop_superbubbles(e, p.bub_step), p.yarn_step)
    e = checkpointed(rescue_high_cov(e))
    return checkpointed(without_nodes(e, branching_nodes(e)))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within so many live edges of start(node)."""
    h = half_edges(edges).select("src", "dst").distinct()
    found = start.select("node", F.lit(0).alias("hop"))
    edge = found
    for k in range(1, hops + 1):
        new = edge.join(h, edge.node == h.src).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        edge = checkpointed(new.select("node", F.lit(k).alias("hop")))
        found = found.unionByName(edge)
    return found


def initial_ends(edges: DataFrame) -> DataFrame:
    """(node) of nodes that have live edges on one side only: where the graph ends before it is cleaned."""
    return degrees(edges).where("fwd = 0 or bwd = 0").select("node")


def reopened(edges: DataFrame, keys: DataFrame, most: int = LESS) -> DataFrame:
    """edges, those of keys(KEY) open again if they aren't closed beyond `most`."""
    hit = keys.select(*KEY).distinct().withColumn("hit", F.lit(True))
    joined = edges.join(hit, KEY, "left")
    return joined.select(*KEY, "cov", "off", F.when(F.col("hit") & (F.col("closed") <= most), OPEN).otherwise(F.col("closed")).alias("closed"))


def repeat_nodes(regions: DataFrame, min_node_cov: int, most: int = 64) -> DataFrame:
    """(node) of nodes that stand in several places: what the reads through one do beyond it never comes together again.

    Judged in the node's own graph: reads through it, each as a walk over its open regions,
    turned so that they pass the node forward; nodes that fewer than min_node_cov of these
    reads hold take no part, nor do steps of a single read. A side with two or more steps is
    good if some node can be reached from all of them; with more than `most`, or if none
    can, the node is a repeat. A group holds the reads of one node, whose number is bounded
    by the depth mask.
    """
    live = regions.where("not closed").select("node", "rid", "dir", "beg")
    here = live.select(F.col("node").alias("at"), "rid", F.col("dir").alias("turn"), F.col("beg").alias("place"))
    walks = here.join(live, "rid").select("at", "rid", "turn", "place", "node", "dir", "beg")

    def judge(t: pa.Table) -> pa.Table:
        at = t["at"][0].as_py()
        seen: dict[int, int] = {}
        reads: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for rid, turn, place, node, dir_, beg in zip(*(t[c].to_pylist() for c in ("rid", "turn", "place", "node", "dir", "beg")), strict=True):
            reads.setdefault((rid, place), []).append((beg if not turn else -beg, node * 2 + (dir_ ^ turn)))
        for walk in reads.values():
            for node in {s // 2 for _, s in walk}:
                seen[node] = seen.get(node, 0) + 1
        steps: dict[tuple[int, int], int] = {}
        for walk in reads.values():
            states = [s for _, s in sorted(walk) if seen[s // 2] >= min_node_cov]
            for s, u in zip(states, states[1:]):
                steps[s, u] = steps.get((s, u), 0) + 1
                steps[u ^ 1, s ^ 1] = steps.get((u ^ 1, s ^ 1), 0) + 1
        after: dict[int, list[int]] = {}
        for (s, u), n in steps.items():
            if n > 1:
                after.setdefault(s, []).append(u)
        bad = False
        for side in (2 * at, 2 * at + 1):
            first = after.get(side, [])
            if len(first) < 2:
                continue
            common: set[int] | None = None if len(first) <= most else set()
            for s in first if common is None else ():
                reached, todo = {s}, [s]
                while todo:
                    for u in after.get(todo.pop(), ()):
                        if u not in reached and u >> 1 != at:
                            reached.add(u)
                            todo.append(u)
                common = reached if common is None else common & reached
            bad |= not common
        return pa.table({"node": pa.array([at] if bad else [], pa.int64())})

    return walks.repartition(tasks(walks.sparkSession), "at").groupBy("at").applyInArrow(judge, "node long")
