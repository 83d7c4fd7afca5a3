"""Callback sources, pairwise alignment, the command line, best hits and assembly of fragments."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake import __main__ as cli
from strandlake.config import GraphParams
from strandlake.functions import alignment as al
from strandlake.operators import contigs as ctg
from strandlake.operators import graph as g
from strandlake.operators import reads as rd
from strandlake.operators import regions as rg
from strandlake.sources import callbacks, formats


def test_records_from_and_to_functions(spark, tmp_path):
    def read(part):
        for k in range(part):
            yield f"r{part}_{k}", "ACGT" * k

    d = callbacks.records(spark, read, [0, 1, 3], "tag string, seq string")
    assert sorted(map(tuple, d.collect())) == [("r1_0", ""), ("r3_0", ""), ("r3_1", "ACGT"), ("r3_2", "ACGTACGT")]
    folder, log = str(tmp_path), str(tmp_path / "done")

    def write(part, rows):
        found = [r["tag"] for r in rows]
        with open(f"{folder}/{part}", "w") as f:
            f.write("\n".join(found))
        return len(found)

    def done(results):
        with open(log, "w") as f:
            f.write(str(sum(results)))

    callbacks.write_records(d, write, done)
    assert open(log).read() == "4"
    assert sorted(x for k in range(3) for x in open(f"{folder}/{k}").read().split()) == ["r1_0", "r3_0", "r3_1", "r3_2"]
    assert [tuple(r) for r in callbacks.lines_of(spark, "a\nb").collect()] == [(0, "a"), (1, "b")]


def best_score(q, t, how, s):
    """All alignments by recursion over three states, without arrays."""
    from functools import cache

    never = -10**9

    @cache
    def h(i, j, state):  # best score of an alignment that ends at (i, j); state: M any, I or D in such a gap
        if state == "I":
            return max(h(i - 1, j, "M") - s.gap_open, h(i - 1, j, "I")) - s.gap_extend if i else never
        if state == "D":
            return max(h(i, j - 1, "M") - s.gap_open, h(i, j - 1, "D")) - s.gap_extend if j else never
        found = [h(i, j, "I"), h(i, j, "D")]
        if i and j:
            found.append(h(i - 1, j - 1, "M") + (s.match if q[i - 1] == t[j - 1] else s.mismatch))
        if not i and not j or how == al.LOCAL or (how == al.OVERLAP and not (i and j)):
            found.append(0)
        return max(found)

    n, m = len(q), len(t)
    if how == al.GLOBAL:
        return h(n, m, "M")
    ends = [(i, j) for i in range(n + 1) for j in range(m + 1) if how == al.LOCAL or i == n or j == m]
    return max([0] + [h(i, j, "M") for i, j in ends])


@pytest.mark.parametrize("how", [al.LOCAL, al.OVERLAP, al.GLOBAL])
def test_alignments_by_brute_force(how):
    r = random.Random(3)
    for _ in range(300):
        q, t = ("".join(r.choice("ACG") for _ in range(r.randint(0, 9))) for _ in range(2))
        s = al.Scores(r.randint(1, 3), -r.randint(1, 5), r.randint(0, 3), r.randint(1, 2))
        score, qb, qe, tb, te, cigar = al.align(q, t, how, s)
        assert score == best_score(q, t, how, s)
        i, j, value = qb, tb, 0
        import re

        for n, op in re.findall(r"(\d*)([MID])", cigar):
            n = int(n or 1)
            if op == "M":
                value += sum(s.match if a == b else s.mismatch for a, b in zip(q[i : i + n], t[j : j + n], strict=True))
            else:
                value -= s.gap_open + n * s.gap_extend
            i, j = i + n * (op != "D"), j + n * (op != "I")
        assert (i, j, value) == (qe, te, score)


def test_alignment_column(spark):
    d = spark.createDataFrame([("ACGTACGT", "TTACGTACGTTT"), (None, "A")], "a string, b string")
    rows = d.select(al.aligned(F.col("a"), F.col("b")).alias("x")).collect()
    assert tuple(rows[0].x) == (16, 0, 8, 2, 10, "8M") and rows[1].x.score is None


def test_best_hits_by_brute_force(spark):
    r = random.Random(5)
    hits = [(q, 100, b, b + r.randint(5, 40), k) for q in range(6) for k, b in enumerate(r.randint(0, 60) for _ in range(25))]
    d = spark.createDataFrame(hits, "qidx long, qlen int, qb int, qe int, k int")
    want = []
    for q in range(6):
        taken = []
        for h in sorted((h for h in hits if h[0] == q), key=lambda h: (-(h[3] - h[2]), h[2], h[1], h[4])):
            if h[3] - h[2] >= 8 and h[3] - h[2] >= 0.1 * h[1] and all(h[3] <= b or h[2] >= e for b, e in taken):
                taken.append((h[2], h[3]))
                want.append(h)
    assert sorted(map(tuple, rg.greedy_best_hits(d, 8, 0.1).collect())) == sorted(want)


def test_fragments_are_joined_along_links(spark):
    edges = spark.createDataFrame([(1, 0, 2, 0, 5, 1, 0), (2, 0, 3, 0, 5, 0, 0), (4, 0, 5, 0, 5, 2, 0)], "node1 long, dir1 int, node2 long, dir2 int, cov int, off int, closed int")
    utgs = g.unitigs(edges, g.degrees(edges).select("node"))
    ids = {r.node: r.utg for r in utgs.collect()}
    a, b = ids[1], ids[4]
    # the second fragment is passed against its direction, two bins after the first
    link = spark.createDataFrame([(min(a, b), 0 if a < b else 0, max(a, b), 1, 4, 2, 0)], edges.schema)
    got = ctg.scaffolded(utgs, edges, link, GraphParams(reg_len=4)).orderBy("step").collect()
    assert [(r.node, r.dir, r.pos) for r in got] == [(1, 0, 0), (2, 0, 5), (3, 0, 9), (5, 1, 15), (4, 1, 21)]
    alone = ctg.scaffolded(utgs, edges, link.limit(0), GraphParams(reg_len=4)).collect()
    assert sorted((r.node, r.pos) for r in alone) == [(1, 0), (2, 5), (3, 9), (4, 0), (5, 6)]


def test_repeat_node_is_found(spark):
    # reads 0-3 go 1 2 3 9, reads 4-7 go 11 2 13 19: node 2 stands in two places; node 21 branches and comes together
    walks = [[1, 2, 3, 9]] * 4 + [[11, 2, 13, 19]] * 4 + [[21, 22, 24, 25]] * 4 + [[21, 23, 24, 25]] * 4
    rows = [(n, k, 0, 6 * i, 6 * i + 4, False) for k, w in enumerate(walks) for i, n in enumerate(w)]
    rows += [(n, 100 + k, 1, 6 * i, 6 * i + 4, False) for k, w in enumerate(walks[:8]) for i, n in enumerate(reversed(w))]
    d = spark.createDataFrame(rows, "node long, rid long, dir int, beg int, end int, closed boolean")
    assert [r.node for r in g.repeat_nodes(d, 3).collect()] == [2]


def test_subsample_is_stable(spark):
    d = spark.range(1000).select(F.col("id").alias("ridx"), (F.col("id") % 3).alias("k"))
    one, two = (sorted(r.ridx for r in rd.subsample(d.repartition(n), 20, ["k"]).collect()) for n in (1, 5))
    assert one == two and len(one) == 60


def test_numbered_lines_of_split_files(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = formats.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line: r.value for r in rows if r.file.endswith("a.txt")} == dict(enumerate(lines))
    assert {r.line: r.value for r in rows if r.file.endswith("b.txt")} == {0: "one", 1: "two"}


def test_command_line(spark, tmp_path):
    r = random.Random(2)
    s = "".join(r.choice("ACGT") for _ in range(3000))
    (tmp_path / "r.fa").write_text("".join(f">r{k}\n{s[a : a + 1536]}\n" for k, a in enumerate(range(0, 1465, 200))))
    shown = {}
    args = cli.parser().parse_args(["map", str(tmp_path / "r.fa"), "-o", "out", "-x", "ccs", "--bin-size", "64", "--psize", "0", "--ksize", "13", "--ksample", "1", "--min-aln", "3", "--min-mat", "40"])
    assert (args.preset, cli.number("4.6m")) == ("ccs", 4_600_000)
    cli.run(spark, args, lambda lines, path: shown.setdefault(path, [x.value for x in lines.collect()]))
    found = [x.split("\t") for x in shown["out/overlaps"]]
    assert found and all(len(x) == 15 for x in found) and {x[0] for x in found} | {x[5] for x in found} == {f"r{k}" for k in range(8)}
    sam = "".join(f"q{k}\t0\tref\t{a + 1}\t60\t900M\t*\t0\t0\t{s[a : a + 900]}\t*\n" for k, a in enumerate(range(0, 2101, 150)))
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + sam)
    shown.clear()
    cli.run(spark, cli.parser().parse_args(["polish", str(tmp_path / "a.sam"), "-o", "out"]), lambda lines, path: shown.setdefault(path, [x.value for x in lines.collect()]))
    assert shown["out/layout"][0] == ">ref len=3164"
    name, *seq = shown["out/consensus"][0].split("\n")
    assert name == ">ref" and "".join(seq) == s


def noisy(s, r, rate=0.05):
    return "".join("" if (x := r.random()) < rate / 3 else r.choice("ACGT") + c if x < 2 * rate / 3 else r.choice("ACGT") if x < rate else c for c in s)


def identity(a, b):
    score, *_ , cigar = al.align(a, b, al.GLOBAL, al.Scores(1, 0, 0, 0))
    return score / max(len(a), len(b))


def test_self_correction(spark):
    r = random.Random(8)
    s = "".join(r.choice("ACGT") for _ in range(1536))
    reads, spans = [], [(0, 1024), (128, 1152), (256, 1280), (384, 1408), (512, 1536), (64, 1088), (448, 1472)]
    for k, (a, b) in enumerate(spans):
        t = noisy(s[a:b], r)
        reads.append((k, f"r{k}", t if k % 2 == 0 else t[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    lone = "".join(r.choice("ACGT") for _ in range(900))
    reads.append((99, "lone", lone))
    rows = []
    for i, (a, b) in enumerate(spans):
        for j, (c, d) in enumerate(spans[i + 1 :], i + 1):
            lo, hi = max(a, c), min(b, d)
            place = [((lo - x) // 64, (hi - x) // 64) if not k % 2 else ((y - hi) // 64, (y - lo) // 64) for k, x, y in ((i, a, b), (j, c, d))]
            rows.append((i, (i + j) % 2, 16, *place[0], j, 16, *place[1], 500, (hi - lo) // 64, 50, 0, "*"))
    from strandlake.config import MapParams
    from strandlake.operators import correction
    from strandlake.operators.overlaps import OVERLAP

    given, overlaps = spark.createDataFrame(reads, "ridx long, tag string, seq string"), spark.createDataFrame(rows, OVERLAP)
    got = {x.ridx: x.seq for x in correction.corrected(given, overlaps, MapParams(bin_size=64), 4, 0.7, 512, 384).collect()}
    assert got[99] == lone and len(got) == len(reads)
    flip = str.maketrans("ACGT", "TGCA")
    for k, (a, b) in enumerate(spans):
        want = s[a:b] if k % 2 == 0 else s[a:b][::-1].translate(flip)
        assert identity(got[k], want) > identity(reads[k][2], want)


def test_votes_by_runs():
    from strandlake.operators import consensus as con

    assert con.run_vote(["ACCCGT", "ACC-GT", "ACC-GT"]) == "ACCGT"
    assert con.run_vote(["ACCCGT", "ACCCGT", "ACC-GT"]) == "ACCCGT"
    assert con.run_vote([]) == "" and con.run_vote(["AC"]) == "AC"
    r = random.Random(4)
    s = "".join(r.choice("ACGT") * r.choice([1, 1, 2, 4]) for _ in range(120))
    reads = [noisy(s, r) for _ in range(14)]
    assert identity(con.consensus(reads, mode="runs")[0], s) > 0.97


def agreement(msa):
    """Pairs of rows that have the same letter in a column."""
    return sum(a == b != "-" for i, x in enumerate(msa) for y in msa[:i] for a, b in zip(x, y, strict=True))


def test_realignment_agrees_more_and_keeps_the_reads():
    from strandlake.operators import consensus as con

    assert con.realigned(["AC-GT", "A-CGT", "AC-GT"]) == ["ACGT"] * 3
    r = random.Random(12)
    for _ in range(6):
        s = "".join(r.choice("ACGT") for _ in range(80))
        reads = [noisy(s, r, 0.2) for _ in range(7)]
        g_ = con.Graph(reads[0])
        for x in reads[1:]:
            g_.add(x)
        before = g_.msa()
        after = con.realigned(before, 3)
        assert [x.replace("-", "") for x in after] == [x.replace("-", "") for x in before]
        assert agreement(after) >= 0.97 * agreement(before)  # gaps agree too, and may outweigh letters
        assert identity(con.vote(after), s) >= identity(con.vote(before), s) - 0.03


def test_consensus_by_halves():
    from strandlake.operators import consensus as con

    r = random.Random(21)
    s = "".join(r.choice("ACGT") for _ in range(1000))
    reads = [noisy(s, r, 0.08) for _ in range(9)]
    places = con.split_places(reads, 100)
    assert sum(p is not None for p in places) >= 8 and all(abs(p - 500) < 150 for p in places if p is not None)
    assert identity(con.split_consensus(reads, 100), s) > 0.985
    assert con.split_consensus([s] * 3, 100) == s and con.split_consensus(["ACGT"], 100) == "ACGT" and con.split_consensus([], 100) == ""
