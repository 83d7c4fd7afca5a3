"""Operators without a SQL form: small cases with known results, and properties."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from strandlake.config import GraphParams, MapParams
from strandlake.functions import sequence as fs
from strandlake.operators import consensus as con
from strandlake.operators import contigs as ctg
from strandlake.operators import graph as g
from strandlake.operators import kmers as km
from strandlake.operators import overlaps as ov
from strandlake.operators import regions as rg

P = MapParams(bin_size=64, ksize=13, psize=0, kmin=2, kmax=100, ksample=1, min_aln=3, min_mat=40)
FLIP = str.maketrans("ACGT", "TGCA")


def genome(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def edges_of(spark, *rows_):
    return spark.createDataFrame([(a, d, b, e, c, 0, 0) for a, d, b, e, c in rows_], "node1 long, dir1 int, node2 long, dir2 int, cov int, off int, closed int")


def test_sequence_functions(spark):
    d = spark.createDataFrame([("acgtn", "4.6m", "10M2mI3M", "ACCGGT")], "s string, n string, c string, k string")
    r = d.select(fs.bases(F.col("s")).alias("b"), fs.bases(F.col("s"), True).alias("strict"), fs.parse_number(F.col("n")).alias("n"), fs.cigar_runs(F.col("c")).alias("runs"), fs.canonical(F.col("k")).alias("pal"), fs.kmer_text(fs.kmer_code(F.col("k")), 6).alias("k"), fs.mismatches(F.col("k"), F.lit("ACCGGA")).alias("mm"), fs.cigar_text(F.array(*map(F.lit, "MMMIDD"))).alias("t"), fs.cigar_spans(F.col("c")).alias("sp")).first()
    assert (r.b, r.strict, r.n, r.pal, r.k, r.mm, r.t) == ("ACGTA", None, 4600000, None, "ACCGGT", 1, "3MI2D")
    assert [tuple(x) for x in r.runs] == [("M", 10), ("m", 2), ("I", 1), ("M", 3)]
    assert tuple(r.sp) == (16, 15, 15)


def test_kmers_do_not_depend_on_the_strand(spark):
    s = genome(640)
    for p in (P, MapParams(bin_size=640, ksize=0, psize=13, ksample=1), MapParams(bin_size=640, ksize=9, psize=4, ksample=1)):
        one = spark.createDataFrame([(1, "a", s)], "ridx long, tag string, seq string")
        two = spark.createDataFrame([(1, "a", s[::-1].translate(FLIP))], "ridx long, tag string, seq string")
        a, b = ([r[0] for r in km.kmers(x, p).select("kmer").orderBy("kmer").collect()] for x in (one, two))
        assert a == b and a


def test_overlaps_of_shifted_reads(spark):
    s = genome(4000)
    reads = spark.createDataFrame([(0, "a", s[:2560]), (1, "b", s[1280:3840]), (2, "c", s[640:3200][::-1].translate(FLIP)), (3, "d", genome(2560, 9))], "ridx long, tag string, seq string")
    found = {(r.qidx, r.tidx): r for r in ov.map_reads(reads, P).collect()}
    assert set(found) == {(0, 1), (0, 2), (1, 2)}
    r = found[0, 1]
    assert (r.qdir, r.qb, r.qe, r.tb, r.te, r.cigar) == (0, 20, 40, 0, 20, "20M")
    r = found[0, 2]
    assert (r.qdir, r.qb, r.qe, r.tb, r.te) == (1, 10, 40, 10, 40)


def paths_of(cells, p):
    """bin_paths of one run given as {(row, col): (kcnt, kmat)}."""
    at = np.array(sorted(cells))
    return ov.bin_paths(np.zeros(len(at), int), at[:, 0], at[:, 1], np.array([cells[r, c][0] for r, c in at.tolist()]), np.array([cells[r, c][1] for r, c in at.tolist()]), p)


def test_bin_path_bridges_a_gap_and_drifts():
    p = MapParams(bin_size=64, min_aln=2, min_mat=30)
    (path,) = paths_of({(y, y): (3, 30) for y in range(10) if y not in (4, 5)}, p)
    assert path == (0, 0, 10, 0, 10, 240, 10, 24, 2, "4M2m4M")
    (path,) = paths_of({(y, y + (y > 4)): (3, 30) for y in range(10)}, p)
    assert path[1:5] == (0, 11, 0, 10)


def test_cigars_of_bin_paths():
    # written from the end: opposite neighbours are one match, each step in one pair only
    assert [ov.path_cigar(x) for x in ("MMM", "IDM", "IIDM", "IDIM", "DImIMM", "iIDdM")] == ["3M", "2M", "2MI", "MIM", "2MImM", "MdMi"]


def every_cell(cells, p):
    """The recurrence cell by cell over the whole grid: best (end, score) of each first cell."""
    state, best = {}, {}
    for y in range(max(r for r, _ in cells) + 1):
        for x in range(max(c for _, c in cells) + 1):
            count, letters = cells.get((y, x), (0, 0))
            gain = count + letters if (y, x) in cells else p.pgap
            options = []
            for k, before in enumerate(((y - 1, x - 1), (y, x - 1), (y - 1, x))):
                first, mat, drift, gap, score = state.get(before, (None, 0, 0, 0, 0))
                back = (k == 1 and drift < 0) or (k == 2 and drift > 0)
                bend = 0 if not k else -p.pvar if back else p.pvar
                options.append((score + gain + bend, -k, first, mat + letters, 0 if not k else drift + (1 if k == 1 else -1), 0 if (y, x) in cells else gap + 1))
            score, _, first, mat, drift, gap = max(options, key=lambda o: o[:2])
            if score > 0 and gap <= p.max_bgap and abs(drift) <= p.max_bvar:
                first = first or (y, x)
                state[y, x] = (first, mat, drift, gap, score)
                if (y, x) in cells and mat >= p.min_mat and (first not in best or score > best[first][1]):
                    best[first] = ((y, x), score, mat)
    return best


def test_bin_paths_by_brute_force():
    r = random.Random(11)
    for n in range(250):
        p = MapParams(bin_size=64, min_aln=2, min_mat=r.choice([1, 30, 60]), max_bgap=r.randint(0, 4), max_bvar=r.randint(0, 4), pvar=r.choice([-21, -5]), pgap=r.choice([-7, -2]))
        runs = []
        for _ in range(r.randint(1, 4)):
            size = r.randint(1, 14)
            cells = {(r.randrange(size), r.randrange(size)): (r.randint(1, 4), r.randint(5, 40)) for _ in range(r.randint(1, 2 * size))}
            cells |= {(k, k): (r.randint(1, 4), r.randint(5, 40)) for k in range(size) if r.random() < n / 300}
            runs.append(cells)
        rows_ = [(k, y, x, *cells[y, x]) for k, cells in enumerate(runs) for y, x in sorted(cells)]
        got = ov.bin_paths(*(np.array(c) for c in zip(*rows_, strict=True)), p)
        want = [(k, first, *found) for k, cells in enumerate(runs) for first, found in sorted(every_cell(cells, p).items())]
        assert [(g[0], (g[3], g[1]), (g[4] - 1, g[2] - 1), g[5]) for g in got] == [(k, first, end, mat) for k, first, end, _, mat in want]
        for g in got:  # the cigar spells the path's extent, and its letters the cells with seeds
            ops = "".join(c * int(m or 1) for m, c in re.findall(r"(\d*)([MIDmid])", g[9]))
            assert sum(o in "MmIi" for o in ops) == g[2] - g[1] and sum(o in "MmDd" for o in ops) == g[4] - g[3]
            assert sum(o.islower() for o in ops) == g[8] and g[6] == min(g[2] - g[1], g[4] - g[3])


def test_depth_runs_and_clips(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 4, 12), (1, 10, 20), (2, 0, 5)], "rid long, beg int, end int")
    assert rows(rg.depth_runs(d), "rid", "beg") == [(1, 4, 12)]


def test_transitive_edge_goes(spark):
    e = edges_of(spark, (1, 0, 2, 0, 5), (2, 0, 3, 0, 5), (1, 0, 3, 0, 5))
    assert rows(g.transitive(e, 4), "node1") == [(1, 0, 3, 0)]


def test_tip_goes_and_line_stays(spark):
    line = [(k, 0, k + 1, 0, 5) for k in range(1, 8)]
    e = edges_of(spark, *line, (4, 0, 20, 0, 2))
    n = g.degrees(e).select("node")
    assert rows(g.tip_nodes(e, n, 10), "node") == [(20,)]
    assert rows(g.tip_nodes(edges_of(spark, *line), n.where("node < 20"), 10), "node") == []


def test_bubble_keeps_the_better_side(spark):
    e = edges_of(spark, (1, 0, 2, 0, 9), (2, 0, 3, 0, 9), (2, 0, 4, 0, 3), (3, 0, 5, 0, 9), (4, 0, 5, 0, 3), (5, 0, 6, 0, 9))
    n = g.degrees(e).select("node")
    assert rows(g.bubble_nodes(e, n, 40), "node") == [(4,)]


def test_unitigs_of_line_ring_and_flipped_edge(spark):
    e = edges_of(spark, (1, 0, 2, 0, 5), (2, 0, 3, 1, 5), (3, 1, 4, 1, 5), (10, 0, 11, 0, 5), (11, 0, 12, 0, 5), (10, 1, 12, 1, 5))
    n = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 10, 11, 12, 99)], "node long")
    got = {}
    for utg, step, node, d in rows(g.unitigs(e, n), "utg", "step"):
        got.setdefault(utg, []).append((node, d))
    paths = sorted(got.values())
    assert [(1, 0), (2, 0), (3, 1), (4, 1)] in paths or [(4, 0), (3, 0), (2, 1), (1, 1)] in paths
    assert [(99, 0)] in paths
    assert sorted(len(p) for p in paths) == [1, 3, 4]


def test_node_selection_is_that_of_the_sequential_rule(spark):
    r = random.Random(3)
    data = []
    for node in range(30):
        for rid in r.sample(range(12), r.randint(2, 6)):
            beg = r.randint(0, 20)
            data.append((node, 0, rid, 0, beg, beg + 4, False))
    regions = spark.createDataFrame(data, "anchor long, tile int, rid long, dir int, beg int, end int, closed boolean")
    counted = regions.join(regions.groupBy("anchor", "tile").agg(F.count("*").alias("nreg")), ["anchor", "tile"])
    p = GraphParams(min_node_cov=2)
    rank = {a: k for a, k in g.checkpointed(rg.ranked(counted)).select("anchor", "rank").collect()}
    taken, open_ = {}, []
    for node in sorted(range(30), key=rank.get):
        own = [x for x in data if x[0] == node]
        free = [x for x in own if not any(min(e, x[5]) - max(b, x[4]) > p.reg_ovl for b, e in taken.get(x[2], []))]
        if len(free) >= p.min_node_cov and len(free) >= len(own) * 0.75:
            for x in free:
                open_.append((rank[node], x[2]))
            for x in free:
                taken.setdefault(x[2], []).append((x[4], x[5]))
    got = rows(rg.select_nodes(counted, p).where("not closed").select("node", "rid"), "node", "rid")
    assert got == sorted(open_)


def sequential(data, rank, p):
    taken, want = {}, []
    for node in sorted(rank, key=rank.get):
        own = [x for x in data if x[0] == node]
        free = [x for x in own if not any(min(e, x[5]) - max(b, x[4]) > p.reg_ovl for b, e in taken.get(x[2], []))]
        if len(free) >= p.min_node_cov and len(free) >= len(own) * (1 - p.node_drop):
            for x in free:
                want.append((rank[node], x[2]))
                taken.setdefault(x[2], []).append((x[4], x[5]))
    return sorted(want)


def test_node_selection_decides_every_node(spark):
    r = random.Random(8)
    # 205 rivals on the same reads, and a last node that meets all of them and stands by reads of its own
    dense = [(node, 0, rid, 0, 0, 4, False) for node in range(205) for rid in range(10)]
    dense += [(205, 0, rid, 0, 0, 4, False) for rid in (0, 1, *range(100, 108))]
    # regions that only meet a region closed before stay open
    mixed = [(node, 0, rid, 0, (b := r.randint(0, 40)), b + 4, False) for node in range(80) for rid in r.sample(range(10), r.randint(4, 8))]
    p = GraphParams(min_node_cov=2, node_drop=0.5)
    for data, least in ((dense, 18), (mixed, 20)):
        regions = spark.createDataFrame(data, "anchor long, tile int, rid long, dir int, beg int, end int, closed boolean")
        counted = g.checkpointed(regions.join(regions.groupBy("anchor", "tile").agg(F.count("*").alias("nreg")), ["anchor", "tile"]))
        rank = {a: k for a, k in rg.ranked(counted).select("anchor", "rank").collect()}
        want = sequential(data, rank, p)
        assert len(want) >= least
        assert rows(rg.select_nodes(counted, p).where("not closed").select("node", "rid"), "node", "rid") == want


def test_clean_up_goes_on_until_nothing_changes(spark, monkeypatch):
    found = iter(range(25))
    monkeypatch.setattr(g, "tip_nodes", lambda e, n, k: spark.createDataFrame([(x,) for x in [next(found, None)] if x is not None], "node long"))
    monkeypatch.setattr(g, "blunt_tips", lambda e: spark.createDataFrame([], "node long"))
    monkeypatch.setattr(g, "bubble_nodes", lambda e, n, k: spark.createDataFrame([], "node long"))
    line = spark.createDataFrame([(k, 0, k + 1, 0, 5, 0, 0) for k in range(28)], "node1 long, dir1 int, node2 long, dir2 int, cov int, off int, closed int")
    nodes = spark.createDataFrame([(k, 5, False) for k in range(29)], "node long, nreg long, closed boolean")
    assert rows(g.clean(line, nodes, GraphParams()).where("closed = 0").select("node1"), "node1") == [(25,), (26,), (27,)]


def test_consensus_of_equal_and_noisy_reads():
    s = genome(300, 5)
    assert con.consensus([s, s, s])[0] == s
    r = random.Random(2)
    noisy = []
    for _ in range(12):
        t = []
        for c in s:
            x = r.random()
            t.append("" if x < 0.03 else r.choice("ACGT") + c if x < 0.06 else r.choice("ACGT") if x < 0.09 else c)
        noisy.append("".join(t))
    got = con.consensus(noisy)[0]
    assert sum(a != b for a, b in zip(got, s)) <= 30 and abs(len(got) - len(s)) <= 3
    assert con.consensus([]) == ("", [])


def test_consensus_takes_the_reads_that_share_most(spark):
    s = genome(120, 5)
    foreign = [genome(130, 100 + k) for k in range(25)]
    stacked = spark.createDataFrame([(1, 0, 0, k + 1, x) for k, x in enumerate(foreign + [s] * 20)], "ctg long, edge int, off int, ord int, seq string")
    assert [(r.seq, r.n_reads) for r in con.edge_consensus(stacked).collect()] == [(s, 20)]


def test_stitching(spark):
    s = genome(600, 7)
    d = spark.createDataFrame([(1, 0, s[:300]), (1, 1, s[200:450]), (1, 2, s[380:])], "ctg long, edge int, seq string")
    assert con.stitched(d, 128).first().seq == s


def test_assembly_of_a_simulated_genome(spark):
    s = genome(12_000, 11)
    r = random.Random(4)
    reads = []
    for k in range(60):
        a = r.randint(0, len(s) - 2560)
        t = s[a : a + 2560]
        reads.append((k, f"r{k}", t if r.random() < 0.5 else t[::-1].translate(FLIP)))
    d = spark.createDataFrame(reads, "ridx long, tag string, seq string")
    a = ctg.assemble(d, P, GraphParams(min_node_cov=2, min_edge_cov=2, max_edge_span=64, ctg_min_length=2))
    stacked = ctg.layout(a["contigs"], a["regions"], a["reads"], P.bin_size)
    (longest,) = con.stitched(con.edge_consensus(stacked), 256).collect()  # one contig
    assert 11_000 < longest.len < 12_500
    mers = {x[i : i + 25] for x in (s, s[::-1].translate(FLIP)) for i in range(len(s) - 24)}
    own = [longest.seq[i : i + 25] for i in range(longest.len - 24)]
    assert sum(m in mers for m in own) > 0.99 * len(own)


def test_given_pairs_and_realignment(spark):
    s = genome(4000)
    reads = spark.createDataFrame([(0, "a", s[:2560]), (1, "b", s[1280:3840]), (2, "c", s[640:3200][::-1].translate(FLIP))], "ridx long, tag string, seq string")
    pairs = spark.createDataFrame([(1, 0), (0, 2)], "qidx long, tidx long")
    found = g.checkpointed(ov.map_pairs(reads, pairs, P))
    assert {(r.qidx, r.tidx) for r in found.collect()} == {(1, 0), (0, 2)}
    again = {(r.qidx, r.tidx): r for r in ov.realigned(found, reads, P).collect()}
    for r in found.collect():
        a = again[r.qidx, r.tidx]
        assert (a.qdir, a.qb, a.qe, a.tb, a.te) == (r.qdir, r.qb, r.qe, r.tb, r.te)


def test_path_consensus_and_reference():
    assert con.best_path(["ACCGT", "AC-GT", "AC-GT"]) in ("ACGT", "ACCGT")
    assert con.best_path(["ACGT", "ACGT", "ATGT"]) == "ACGT"
    assert con.anchored(["A-CG", "ATCG"]) == ["ACG", "ACG"]
    s = genome(120, 3)
    assert con.consensus([s, s, s], mode="path")[0] == s
    assert con.consensus([s, s[:60] + "A" + s[60:], s], reference=True)[0] == s


def test_detached_repeat(spark):
    links = spark.createDataFrame([(1, 0, 5, 0, 4, 0, False, 0), (2, 0, 5, 0, 4, 0, False, 0), (3, 1, 5, 1, 4, 0, False, 0), (4, 1, 5, 1, 4, 0, False, 0), (1, 0, 3, 0, 2, 9, False, 2), (2, 0, 4, 0, 2, 9, False, 2)], "node1 long, dir1 int, node2 long, dir2 int, cov int, off int, weak boolean, closed int")
    frags = spark.createDataFrame([(k, 10, 50) for k in range(1, 6)], "utg long, n int, length int")
    out = {(r.node1, r.node2): r.closed for r in ctg.detach_repeats(links, frags, 100).collect()}
    assert out == {(1, 5): 3, (2, 5): 3, (3, 5): 3, (4, 5): 3, (1, 3): 0, (2, 4): 0}


def test_link_clean_up_runs(spark):
    links = spark.createDataFrame([(k, 0, k + 1, 0, 4, 0, False, 0) for k in range(1, 6)] + [(1, 0, 3, 0, 1, 0, True, 0)], "node1 long, dir1 int, node2 long, dir2 int, cov int, off int, weak boolean, closed int")
    frags = spark.createDataFrame([(k, 10, 50) for k in range(1, 7)], "utg long, n int, length int")
    out = {(r.node1, r.node2): r.closed for r in ctg.clean_links(links, frags, GraphParams()).collect()}
    assert out[1, 3] == 3 and all(out[k, k + 1] == 0 for k in range(1, 6))


def test_long_edge_takes_the_nodes_of_its_reads(spark):
    ctgs = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 1, 2, 0, 20)], "ctg long, step int, node long, dir int, pos int")
    regions = spark.createDataFrame([(1, 7, 0, 0, 4, False), (8, 7, 0, 6, 10, False), (9, 7, 0, 12, 16, False), (2, 7, 0, 20, 24, False), (1, 6, 1, 30, 34, False), (9, 6, 1, 18, 22, False), (2, 6, 1, 10, 14, False)], "node long, rid long, dir int, beg int, end int, closed boolean")
    assert rows(ctg.densified(ctgs, regions).select("ord", "node", "dir"), "ord") == [(0, 1, 0), (1, 8, 0), (2, 9, 0), (3, 2, 0)]
