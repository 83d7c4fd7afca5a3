"""Queries of the operators over the shared tables. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.config import SMALL, SMALL_GRAPH
from strandlake.functions.sequence import cigar_spans, count_letter, kmer_code, kmer_text, mismatches, reverse_complement, squeeze, text_as_bases
from strandlake.operators import blocks
from strandlake.operators import consensus as con
from strandlake.operators import contigs as ctg
from strandlake.operators import graph as g
from strandlake.operators import kmers as km
from strandlake.operators import local
from strandlake.operators import overlaps as ov
from strandlake.operators import reads as rd
from strandlake.operators import regions as rg
from strandlake.operators import stats
from strandlake.sources import callbacks, formats

HPC = replace(SMALL, ksize=0, psize=15)
#: Caps of the queries, in letters.
CAP, MOST = 1_000_000, 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a sequence."""
    d = rd.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("ridx"), F.concat(F.lit("w"), F.floor(F.col("doc_id") / 5).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), (F.col("doc_id") + 1).cast("string")).alias("tag"), text_as_bases(F.coalesce("text", F.lit(""))).alias("seq"))


def folded(spark: SparkSession, sf_dir: str) -> int:
    """Reads of either side that line items are folded onto."""
    return max(1, table(spark, sf_dir, "orders").count() // 5)


def overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as overlaps between orders and parts, one for each place; reads grow in number with the tables."""
    li, n = table(spark, sf_dir, "lineitem"), folded(spark, sf_dir)
    keyed = li.select((F.col("l_orderkey") % n).alias("qidx"), (F.col("l_linenumber") % 2).cast("int").alias("qdir"), (F.col("l_suppkey") % 32).cast("int").alias("qb"), (F.col("l_partkey") % n + n).alias("tidx"), (F.col("l_partkey") % 40).cast("int").alias("tb"), F.floor("l_extendedprice").cast("int").alias("mat"))
    one = keyed.groupBy("qidx", "qdir", "qb", "tidx", "tb").agg(F.max("mat").alias("mat"))
    aln = (F.lit(8) + (F.col("qb") * 7 + F.col("tb") * 3) % 40).cast("int")
    return one.select("qidx", "qdir", F.lit(96).alias("qlen"), "qb", (F.col("qb") + aln).alias("qe"), "tidx", F.lit(96).alias("tlen"), "tb", (F.col("tb") + aln).alias("te"), "mat", aln.alias("aln"), F.lit(1).alias("cnt"), F.lit(0).alias("gap"), F.lit("*").alias("cigar"))


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions: orders are reads that pass through classes of parts."""
    li = table(spark, sf_dir, "lineitem")
    beg = ((F.col("l_linenumber") - 1) * 6).cast("int")
    return li.select((F.col("l_partkey") % 100).alias("node"), F.col("l_orderkey").alias("rid"), (F.col("l_suppkey") % 2).cast("int").alias("dir"), beg.alias("beg"), (beg + 4).alias("end"), F.lit(False).alias("closed"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = region_rows(spark, sf_dir)
    nodes = r.select("node", F.lit(False).alias("closed")).distinct()
    return g.build_edges(r, nodes, replace(SMALL_GRAPH, max_edge_span=8, min_edge_cov=3))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.kmers(reads(spark, sf_dir), SMALL)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.index(reads(spark, sf_dir), SMALL)


def _lengths(r: DataFrame) -> DataFrame:
    return rd.trimmed_to_bins(r, SMALL.bin_size).select("ridx", (F.col("bincnt") * SMALL.bin_size).alias("len"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.packed_index(reads(spark, sf_dir), SMALL)


def shared_seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the 20 pairs of documents that share the most seeds."""
    return ov.top_pairs(blocks.from_hits(_blocks(spark, sf_dir), SMALL, blocks.SUMS), 20)


def seed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.from_hits(_blocks(spark, sf_dir), SMALL, blocks.RUNS)


def cell_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.from_hits(_blocks(spark, sf_dir), SMALL, blocks.CELLS)


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items by the share of the item's distinct seeds that the document holds."""
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ridx"), F.lit("").alias("tag"), text_as_bases(F.coalesce("text", F.lit(""))).alias("seq"))
    s = km.kmers(item, SMALL).select(F.col("ridx").alias("item_id"), "kmer").distinct()
    total = s.groupBy("item_id").agg(F.count("*").alias("n_item"))
    d = _seeds(spark, sf_dir).select(F.col("ridx").alias("doc_id"), "kmer").distinct()
    both = d.join(s, "kmer").groupBy("item_id", "doc_id").agg(F.count("*").alias("n_shared"))
    return both.join(total, "item_id").where(F.col("n_shared") * 2 >= F.col("n_item")).select("item_id", "doc_id", "n_shared", "n_item")


def longest_subread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.longest_subreads(reads(spark, sf_dir), 100).select("ridx", "tag", F.length("seq").alias("len"))


def named_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ridx"))
    names = r.join(labelled, "ridx", "left_semi").select("tag")
    return rd.named_only(r, names, deny=True).select("ridx", "tag")


def depth_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    beg = F.floor(F.unix_timestamp("ts") / 60)
    return rg.depth_runs(e.select(F.col("user_id").alias("rid"), beg.alias("beg"), (beg + 1 + F.col("event_id") % 2000).alias("end")), 2)


def degree_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = g.degrees(graph_edges(spark, sf_dir))
    return d.select("node", "fwd", "bwd", ((F.col("fwd") > 1) | (F.col("bwd") > 1)).cast("int").alias("branching"), (((F.col("fwd") == 0) & (F.col("bwd") > 1)) | ((F.col("bwd") == 0) & (F.col("fwd") > 1))).cast("int").alias("blunt"))


def linear_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a graph of steps from each turn to the next."""
    states = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("state")).distinct()
    steps = states.join(states.select((F.col("state") - 1).alias("state")), "state", "left_semi").select("state", (F.col("state") + 1).alias("next"))
    return g.linear_paths(steps, states)


def column_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority letter of each place, over the documents of a source."""
    d = rd.spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("block"), text_as_bases(F.coalesce("text", F.lit(""))).alias("row"))
    return con.column_votes(d, 2, 0.3)


def window_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("rid"), (F.col("event_id") * 7).alias("pos"), (1 + F.col("event_id") % 700).alias("len"))
    return con.window_blocks(e, 500, 333)


def n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(reads(spark, sf_dir).select(F.length("seq").alias("len")))


def nx_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nx_table(table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("len")))


def sam_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sam = e.select(F.col("event_id").alias("rid"), F.lit("r").alias("rname"), (F.col("event_id") % 4096).cast("int").alias("flag"), F.lit("10M").alias("cigar"))
    return formats.mapped(sam).select("rid", "flag")


def layered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions whose nodes know their place on the order, so that the graph has ends."""
    li = table(spark, sf_dir, "lineitem")
    beg = ((F.col("l_linenumber") - 1) * 6).cast("int")
    return li.select((F.col("l_partkey") % 40 * 8 + F.col("l_linenumber")).alias("node"), F.col("l_orderkey").alias("rid"), F.lit(0).alias("dir"), beg.alias("beg"), (beg + 4).alias("end"), F.lit(False).alias("closed"))


def layered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctg.link_table(g.region_pairs(layered_rows(spark, sf_dir), 8), 3)


def ladder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a chain with tips and bubbles: a sparse graph that grows with the table."""
    k = table(spark, sf_dir, "part").select((F.col("p_partkey") * 4).alias("n"))
    chain = k.where("n % 28 != 0").select(F.col("n").alias("node1"), (F.col("n") + 4).alias("node2"), F.lit(9).alias("cov"))
    tips = k.where("n % 20 = 0").select("n", (F.col("n") + 1).alias("node2"), F.lit(5).alias("cov"))
    side = k.where("n % 44 = 0").select("n", (F.col("n") + 2).alias("node2"), F.lit(7).alias("cov"))
    back = k.where("n % 44 = 0").select(F.col("n") + 2, (F.col("n") + 8).alias("node2"), F.lit(6).alias("cov"))
    every = chain.union(tips).union(side).union(back)
    return every.select("node1", F.lit(0).alias("dir1"), "node2", F.lit(0).alias("dir2"), F.col("cov").cast("int").alias("cov"), F.lit(0).alias("off"), F.lit(0).alias("closed"))


def block_edges(spark: SparkSession, sf_dir: str, steps: list[tuple[int, int, int]]) -> DataFrame:
    """A block of 16 nodes for each part, joined to the next one's: steps (a, b, m) where m divides the part's key.

    Some nodes lie the other way round, and coverages differ from part to part.
    """
    n = F.col("p_partkey") * 16
    k = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.struct(*[F.lit(x) for x in s]).alias("s") for s in steps])).alias("s"))
    k = k.select("p_partkey", n.alias("n"), F.col("s.col1").alias("a"), F.col("s.col2").alias("b"), F.col("s.col3").alias("m")).where("p_partkey % m = 0")

    def state(c: str) -> F.Column:
        node = F.col("n") + F.col(c)
        return node * 2 + ((node + F.floor(node / 16)) % 3 == 0).cast("int")

    cov = (F.col("p_partkey") * 7 + F.col("a") * 5 + F.col("b") * 11 + F.col("p_partkey") * F.col("b")) % 23 + 1
    every = k.select(state("a").alias("s"), state("b").alias("t"), cov.cast("int").alias("cov"))
    return local.edge_keys(every).select(*g.KEY, "cov", F.lit(0).alias("off"), F.lit(0).alias("closed"))


#: From 0 to 7 by three ways, one of which parts and meets again at 6; some blocks have a tip, a way in, or a ring.
BUBBLES = [(0, 1, 1), (0, 2, 1), (1, 4, 1), (1, 5, 1), (4, 6, 1), (5, 6, 1), (6, 7, 1), (2, 7, 1), (7, 16, 1), (0, 3, 3), (3, 7, 3), (2, 9, 5), (12, 4, 7), (6, 1, 11)]
#: From 3 to 8 through four nodes, in some blocks with rings; others have a tip or a way in.
TANGLES = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (3, 5, 1), (4, 6, 1), (5, 7, 1), (6, 8, 1), (7, 8, 1), (8, 16, 1), (6, 5, 2), (7, 4, 2), (4, 7, 3), (6, 9, 5), (10, 5, 7)]
#: Two ways lead to the repeat 4, 5, 6, and two from it.
REPEATS = [(0, 1, 1), (1, 4, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (6, 7, 1), (7, 8, 1), (6, 9, 1), (9, 10, 1)]
#: Links across the repeat.
ACROSS = [(0, 8, 1), (3, 9, 2), (2, 10, 4), (1, 9, 3)]


def superbubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = local.superbubbles(g.checkpointed(block_edges(spark, sf_dir, BUBBLES)), 20)
    return found.withColumn("kept", F.col("kept").cast("int"))


def yarns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = local.yarns(g.checkpointed(block_edges(spark, sf_dir, TANGLES)), 16)
    return found.withColumn("kept", F.col("kept").cast("int"))


def repeat_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links with repeats of three fragments, and the fragments."""
    near, across = (block_edges(spark, sf_dir, s).withColumn("weak", F.lit(False)) for s in (REPEATS, ACROSS))
    links = g.checkpointed(near.unionByName(across.withColumn("closed", F.lit(g.HARD - 1))))
    return links, fragment_nodes(near).select(F.col("node").alias("utg"), (F.lit(20) + F.col("node") % 7).cast("int").alias("length"))


def detached_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.detached(*repeat_links(spark, sf_dir), 200, 400)


def fragment_nodes(edges: DataFrame) -> DataFrame:
    return g.degrees(edges).select("node")


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as overlaps with cigars: a run of matches, inserted bins, a gap, deleted bins, matches."""
    o = overlap_rows(spark, sf_dir)
    a, b, c, d = F.col("qb") % 9 + 4, F.col("tb") % 3 + 1, F.col("qb") % 4 + 1, F.col("tb") % 2 + 1
    e = F.col("aln") - 3
    text = F.concat(*[x for n, op in ((a, "M"), (b, "I"), (c, "m"), (d, "D"), (e, "M")) for x in (n.cast("string"), F.lit(op))])
    return o.select("qidx", "qdir", F.lit(160).alias("qlen"), "qb", (F.col("qb") + a + b + c + e).alias("qe"), "tidx", F.lit(160).alias("tlen"), "tb", (F.col("tb") + a + c + d + e).alias("te"), "mat", "aln", "cnt", "gap", text.alias("cigar"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions of node candidates, with the number of each one's."""
    n = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("anchor"), F.col("l_linenumber").cast("int").alias("tile")).agg(F.count("*").alias("nreg"))
    return n


def tip_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir))
    return g.tip_nodes(e, fragment_nodes(e), 10)


def bubble_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir).where("node2 % 4 != 1"))
    return g.bubble_nodes(e, fragment_nodes(e), 40)


def ladder_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir))
    return g.unitigs(e, fragment_nodes(e))


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir))
    return g.neighbourhood(e, table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select((F.col("p_partkey") * 4).alias("node")), 4)


def rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered edges of little coverage, some opened again where reads bridge ends."""
    r = layered_rows(spark, sf_dir)
    nodes = r.select("node", F.lit(False).alias("closed")).distinct()
    return g.rescue_mercy(g.build_edges(r, nodes, replace(SMALL_GRAPH, max_edge_span=8, min_edge_cov=9)), r)


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder, with closed edges of more coverage two steps on."""
    e = ladder_edges(spark, sf_dir).where("node2 % 4 = 0")
    shut = e.where("node1 % 12 = 0").select("node1", "dir1", (F.col("node1") + 8).alias("node2"), "dir2", F.lit(12).alias("cov"), "off", F.lit(1).alias("closed"))
    return g.rescue_high_cov(e.union(shut))


def rarest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    counts = g.checkpointed(km.kmer_counts(km.kmers(r, SMALL)))
    return ov.rarest_of(km.open_postings(r, km.solid(counts, SMALL), SMALL), 3)


def through_text(lines: DataFrame, read: Callable[[SparkSession, str], DataFrame], compression: str = "none") -> DataFrame:
    """Lines written as text to the shared folder, and what a reader makes of the files."""
    spark = lines.sparkSession
    g.checkpointed(spark.range(1))  # sets the folder, if it isn't
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/text-{uuid.uuid4().hex}"
    lines.write.text(path, compression=compression)
    return read(spark, path)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).where("seq != ''").select("ridx", "tag", "seq")


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_text(formats.fasta_lines(sequences(spark, sf_dir), 80), formats.read_fasta).select("tag", "seq")


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_text(formats.fastq_lines(sequences(spark, sf_dir), "@"), formats.read_fastq)


def tagged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(2 * folded(spark, sf_dir)).select(F.col("id").alias("ridx"), F.concat(F.lit("r_"), F.col("id").cast("string")).alias("tag"), F.lit(160).alias("bincnt"))


def overlaps_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tagged_numbers(spark, sf_dir)
    rows = through_text(formats.overlap_lines(aligned_rows(spark, sf_dir), tags, 64), formats.read_overlaps, "gzip")
    return formats.overlaps_by_name(rows, tags, 64)


def node_regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = region_rows(spark, sf_dir).select("node", "rid", "dir", "beg", "end", (F.col("rid") % 7 == 0).alias("closed"))
    nodes = r.select("node", (F.col("node") % 5 == 0).alias("closed")).distinct()
    tags = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ridx"), F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("tag"), F.lit(50).alias("bincnt"))
    return r, nodes, tags


def nodes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = through_text(formats.node_lines(*node_regions(spark, sf_dir)), formats.read_nodes)
    return read.select("node", F.col("node_closed").cast("int").alias("node_closed"), "tag", "dir", "beg", "end", F.col("closed").cast("int").alias("closed"))


def read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, tags = node_regions(spark, sf_dir)
    return formats.read_lines(r, tags, 64)


def clips_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tagged_numbers(spark, sf_dir)
    return through_text(formats.clip_lines(rg.clips(overlap_rows(spark, sf_dir)), tags, 64), formats.read_clips)


def dot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph_edges(spark, sf_dir)
    return through_text(formats.dot_lines(g.degrees(e, 3).select("node"), e), formats.read_dot)


def fragment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir))
    u = g.checkpointed(g.unitigs(e, fragment_nodes(e)))
    return formats.fragment_lines(ctg.offsets(u, e, 4), 4, 64)


def sam_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as aligned reads, many with equal places and texts."""
    e = table(spark, sf_dir, "events")
    cigar = F.concat((F.col("event_id") % 4 * 2).cast("string"), F.lit("S"), (F.col("event_id") % 9 + 5).cast("string"), F.lit("M2I3M4D"), (F.col("event_id") % 7 + 1).cast("string"), F.lit("M"))
    return e.select(F.col("event_id").cast("string").alias("qname"), F.lit(0).alias("flag"), F.col("event_type").alias("rname"), (F.col("event_id") % 500 + 1).cast("int").alias("pos"), (F.col("event_id") % 61).cast("int").alias("mapq"), cigar.alias("cigar"), F.repeat(F.lit("ACGTTGCA"), F.lit(5)).alias("seq"))


def sam_windows_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.sam_windows(formats.trusted(sam_rows(spark, sf_dir), 10), 30, 20).select("rname", "window", "qname", "beg", "len", "seq")


def sam_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.sam_layout_lines(con.sam_windows(formats.trusted(sam_rows(spark, sf_dir), 10), 30, 20), 30, 20)


def layout_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = through_text(sam_layout(spark, sf_dir).coalesce(1), formats.read_layout)
    return read.select("ctg", "bidx", "off", "node1", "dir1", "node2", "dir2", "tag", "rddir", "rdoff", "len", "seq")


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as a bucketed table, and loaded with the same parameters."""
    name = f"seed_index_{uuid.uuid4().hex}"
    formats.save_index(_index(spark, sf_dir), name, 8, psize=SMALL.psize, ksize=SMALL.ksize)
    return formats.load_index(spark, name, psize=SMALL.psize, ksize=SMALL.ksize)


def named_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir).where("length(seq) >= 60")
    kinds = [F.concat("tag", F.lit(x)) for x in ("", "[+:5,25]", "[-:10,40]", "_R_3_17", "_F_0_9")]
    return formats.sequences_by_name(r.select(F.explode(F.array(*kinds)).alias("name")), r.select("tag", "seq"))


def regions_in_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = region_rows(spark, sf_dir)
    clip = r.where("rid % 2 = 0").select("rid").distinct().select("rid", (F.col("rid") % 13).cast("int").alias("clp_beg"), (F.col("rid") % 13 + 20).cast("int").alias("clp_end"))
    return rg.within_clips(r, clip).withColumn("closed", F.col("closed").cast("int"))


def path_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir).withColumn("off", (F.col("node1") % 5).cast("int")))
    return ctg.offsets(g.checkpointed(g.unitigs(e, fragment_nodes(e))), e, 4)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(ladder_edges(spark, sf_dir))
    return ctg.fragments(g.checkpointed(g.unitigs(e, fragment_nodes(e))), e, 4)


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph_edges(spark, sf_dir)
    return g.reopened(e, e.where("node1 % 3 = 0").select(*g.KEY))


def forward_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.from_hits(_blocks(spark, sf_dir), SMALL, blocks.COUNTS, strands=1)


def callback_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a function that reads the table's row groups, some in each part of the source."""
    fs, path = pafs.FileSystem.from_uri(f"{sf_dir}/part.parquet")
    pieces = [(f.path, g.id) for f in ds.dataset(path, filesystem=fs).get_fragments() for g in f.row_groups]

    def read(part):  # type: ignore[no-untyped-def]
        for at, group in part:
            with fs.open_input_file(at) as file:
                rows = pq.ParquetFile(file).read_row_group(group, ["p_partkey", "p_name"])
                yield from zip(*(c.to_pylist() for c in rows.columns), strict=True)

    return callbacks.records(spark, read, [pieces[k : k + 4] for k in range(0, len(pieces), 4)], "k long, name string")


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part classes on an order as links."""
    return ctg.link_table(g.region_pairs(region_rows(spark, sf_dir), 8), 3)


def fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("utg")).agg(F.max("p_size").cast("int").alias("length"))


def weak_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctg.weak_branches(link_rows(spark, sf_dir))


def median_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rg.mask_by_depth(region_rows(spark, sf_dir), SMALL_GRAPH)
    return stats.weighted_median(n.groupBy("nreg").agg(F.count("*").alias("n")), "nreg", "n")


def best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.best_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("price")), ["o_custkey"], "price")


def overlap_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.map_reads(reads(spark, sf_dir), SMALL)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.tiles(g.checkpointed(overlap_dp(spark, sf_dir)), SMALL_GRAPH)


def node_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.checkpointed(overlap_dp(spark, sf_dir))
    cut = rd.trimmed_to_bins(reads(spark, sf_dir), SMALL.bin_size)
    return rg.select_nodes(g.checkpointed(rg.candidates(rg.tiles(found, SMALL_GRAPH), cut, SMALL_GRAPH)), SMALL_GRAPH)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctg.assemble(reads(spark, sf_dir), SMALL, SMALL_GRAPH)["contigs"]


def contig_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ctg.assemble(reads(spark, sf_dir), SMALL, SMALL_GRAPH)
    stacked = ctg.layout(a["contigs"], a["regions"], a["reads"], SMALL.bin_size)
    return con.stitched(con.edge_consensus(g.checkpointed(stacked)), 4 * SMALL.bin_size)


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.checkpointed(graph_edges(spark, sf_dir))
    return g.unitigs(g.checkpointed(g.cut_transitive(e, 4)), g.degrees(e).select("node"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "shared_seed_pairs": shared_seed_pairs,
    "seq_projection": lambda s, d: reads(s, d).select("ridx", F.length("seq").alias("len"), "seq"),
    "reverse_reads": lambda s, d: rd.rename(reads(s, d), "S").select("ridx", "tag", reverse_complement(F.col("seq")).alias("seq")),
    "bins": lambda s, d: rd.bins(reads(s, d), SMALL.bin_size),
    "trimmed_to_bins": lambda s, d: rd.trimmed_to_bins(reads(s, d), SMALL.bin_size).select("ridx", "bincnt", F.length("seq").alias("len")),
    "named_only": named_only,
    "longest_subread": longest_subread,
    "split_long": lambda s, d: rd.split_long(reads(s, d), MOST).select("ridx", "tag", F.length("seq").alias("len")),
    "first_bases": lambda s, d: rd.first_bases(reads(s, d), CAP).select("ridx"),
    "coverage_cap": lambda s, d: rd.coverage_cap(reads(s, d), CAP).select("ridx"),
    "median_band": lambda s, d: rd.median_band(reads(s, d), CAP).select("ridx"),
    "by_length": lambda s, d: rd.by_length(reads(s, d)).select("ridx", "rank"),
    "canonical_kmers": _seeds,
    "hpc_kmers": lambda s, d: km.kmers(reads(s, d), HPC),
    "kmer_count": lambda s, d: km.kmer_counts(_seeds(s, d)),
    "kmer_depth_hist": lambda s, d: km.depth_histogram(km.kmer_counts(_seeds(s, d))),
    "kmer_filter_threshold": lambda s, d: km.max_depth(km.depth_histogram(km.kmer_counts(_seeds(s, d))), SMALL),
    "seed_postings": _index,
    "bin_degree": lambda s, d: km.bin_degrees(_index(s, d)),
    "seeds_in_index": lambda s, d: km.seeds_in_index(_seeds(s, d), km.solid(km.kmer_counts(_seeds(s, d)), SMALL)),
    "cell_matches": cell_matches,
    "seed_islands": seed_islands,
    "benchmark_containment": containment,
    "best_per_pair": lambda s, d: ov.best_per_pair(overlap_rows(s, d)),
    "bestn_per_read": lambda s, d: ov.best_n(overlap_rows(s, d), 5),
    "most_hits": lambda s, d: ov.most_hits(overlap_rows(s, d), 10),
    "acceptable_overlaps": lambda s, d: ov.acceptable(overlap_rows(s, d), SMALL),
    "dovetail_overlaps": lambda s, d: overlap_rows(s, d).where(ov.dovetail(4)),
    "contained_reads": lambda s, d: ov.contained_reads(overlap_rows(s, d), 30),
    "flipped_overlaps": lambda s, d: ov.flipped(overlap_rows(s, d)),
    "read_clips": lambda s, d: rg.clips(overlap_rows(s, d)),
    "depth_sweep": depth_sweep,
    "band_pairs": lambda s, d: g.region_pairs(region_rows(s, d), 8).groupBy(*g.KEY, "off", F.col("adjacent").cast("int").alias("adjacent")).agg(F.count("*").alias("n")),
    "edge_agg": graph_edges,
    "degree_masks": degree_masks,
    "cut_binary": lambda s, d: g.cut_binary(graph_edges(s, d)),
    "two_hop_transitive": lambda s, d: g.transitive(graph_edges(s, d), 4),
    "link_agg": lambda s, d: ctg.link_table(g.region_pairs(region_rows(s, d), 20), 4).withColumn("weak", F.col("weak").cast("int")),
    "tandem_repeats": lambda s, d: g.tandem_repeats(graph_edges(s, d), rg.mask_by_depth(region_rows(s, d), SMALL_GRAPH), 10, 0.02),
    "linear_paths": linear_paths,
    "column_votes": column_votes,
    "window_blocks": window_blocks,
    "n50": n50,
    "nx_table": nx_table,
    "sam_filter": sam_windows,
    "weak_branches": weak_links,
    "binary_links": lambda s, d: ctg.cut_binary_links(link_rows(s, d)),
    "boomerangs": lambda s, d: ctg.boomerangs(layered_links(s, d), table(s, d, "part").groupBy((F.col("p_partkey") % 320).alias("utg")).agg(F.max("p_size").cast("int").alias("length")), 50),
    "node_depths": lambda s, d: rg.mask_by_depth(region_rows(s, d), SMALL_GRAPH).withColumn("closed", F.col("closed").cast("int")),
    "median_depth": median_depth,
    "best_order": best_order,
    "unitigs": unitigs,
    "tip_nodes": tip_nodes,
    "bubble_nodes": bubble_nodes,
    "ladder_unitigs": ladder_unitigs,
    "neighbourhood": neighbourhood,
    "rescue_mercy": rescued,
    "rescue_high_cov": swapped,
    "isolated_nodes": lambda s, d: g.isolated_nodes(table(s, d, "part").select((F.col("p_partkey") * 4 + 1).alias("node"), (F.col("p_size") > 40).alias("closed")), ladder_edges(s, d)),
    "initial_ends": lambda s, d: g.initial_ends(ladder_edges(s, d)),
    "rarest_seeds": rarest,
    "chimera_cuts": lambda s, d: rg.chimera_cuts(overlap_rows(s, d), 30),
    "tile_regions": lambda s, d: rg.tiles(aligned_rows(s, d), SMALL_GRAPH).withColumn("closed", F.col("closed").cast("int")),
    "node_ranks": lambda s, d: rg.ranked(candidate_rows(s, d)),
    "cigar_spans": lambda s, d: aligned_rows(s, d).select("qidx", "tidx", "qdir", "qb", "tb", cigar_spans(F.col("cigar")).alias("s")).select("qidx", "tidx", "qdir", "qb", "tb", "s.query", "s.target", "s.aligned"),
    "kmer_codes": lambda s, d: sequences(s, d).where("length(seq) >= 20").select("ridx", kmer_text(kmer_code(F.left("seq", F.lit(20))), 20).alias("kmer"), mismatches(F.left("seq", F.lit(40)), F.reverse(F.left("seq", F.lit(40)))).alias("differ"), count_letter(F.col("seq"), "A").alias("n_a"), squeeze(F.left("seq", F.lit(60)), "A").alias("squeezed")),
    "fasta_round_trip": fasta_round_trip,
    "fastq_round_trip": fastq_round_trip,
    "overlaps_round_trip": overlaps_round_trip,
    "nodes_round_trip": nodes_round_trip,
    "clips_round_trip": clips_round_trip,
    "dot_round_trip": dot_round_trip,
    "read_table": read_table,
    "fragment_table": fragment_table,
    "gfa_table": lambda s, d: formats.gfa_lines(fragment_nodes(ladder_edges(s, d)), ladder_edges(s, d), 4),
    "sam_trusted": lambda s, d: formats.trusted(sam_rows(s, d), 10).select("rname", "pos", "qname", "mapq"),
    "sam_windows": sam_windows_cut,
    "sam_layout": sam_layout,
    "layout_round_trip": layout_round_trip,
    "index_round_trip": index_round_trip,
    "named_slices": named_slices,
    "regions_in_clips": regions_in_clips,
    "path_offsets": path_offsets,
    "fragments": fragments,
    "reopened_edges": reopened,
    "forward_pairs": forward_pairs,
    "callback_records": callback_records,
    "superbubbles": superbubbles,
    "yarns": yarns,
    "detached_repeats": detached_repeats,
    "overlap_dp": overlap_dp,
    "chain": lambda s, d: ov.chained(overlap_rows(s, d), SMALL),
    "tiles": tiles,
    "node_selection": node_selection,
    "contigs": contigs,
    "consensus": contig_consensus,
    "greedy_best_hits": lambda s, d: rg.greedy_best_hits(overlap_rows(s, d)),
}
