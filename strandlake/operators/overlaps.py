"""Overlaps: seed join, runs of matches, banded alignment of bins, filters, chains and ranks.

An overlap is (qidx, qdir, qlen, qb, qe, tidx, tlen, tb, te, mat, aln, cnt, gap, cigar).
Positions are in bins, mat is in letters; the target is always forward, and positions of a
reverse query count on its forward strand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.config import MapParams

OVERLAP = "qidx long, qdir int, qlen int, qb int, qe int, tidx long, tlen int, tb int, te int, mat int, aln int, cnt int, gap int, cigar string"


def with_lengths(posted: DataFrame, lengths: DataFrame) -> DataFrame:
    """Postings with the lengths(ridx, len) of their reads, so that hits needn't be shuffled by their query to find it."""
    return posted.hint("merge").join(lengths.select("ridx", "len"), "ridx").select("kmer", "ridx", "dir", "off", "bin", "len")


def seed_hits(query: DataFrame, target: DataFrame, p: MapParams, self_join: bool = True, strands: int = 3) -> DataFrame:
    """(qidx, tidx, strand, tbin, poff): seeds of the query that the target's index holds.

    query and target are postings, the query's with lengths. With self_join each pair of
    reads comes once, the query being the smaller ridx. poff is the seed's place on the query's
    strand. strands: 1 forward, 2 reverse, 3 both. Both sides are shuffled by seed: their sizes
    aren't known from the texts they come from, and neither is to be broadcast.
    """
    q = query.select("kmer", F.col("ridx").alias("qidx"), F.col("dir").alias("qd"), F.col("off").alias("qoff"), F.col("len").alias("qlen"))
    t = target.select("kmer", F.col("ridx").alias("tidx"), F.col("dir").alias("td"), F.col("bin").alias("tbin"))
    pairs = q.hint("merge").join(t, "kmer")
    if self_join:
        pairs = pairs.where("tidx > qidx")
    pairs = pairs.withColumn("strand", F.col("qd").bitwiseXOR(F.col("td")))
    if strands != 3:
        pairs = pairs.where(F.col("strand") == (0 if strands == 1 else 1))
    poff = F.when(F.col("strand") == 0, F.col("qoff")).otherwise(F.col("qlen") - F.col("qoff") - p.seed)
    return pairs.select("qidx", "tidx", "strand", "tbin", poff.cast("int").alias("poff"))


def rarest_seeds(query: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Of each query bin the n seeds with the smallest counts."""
    return rarest_of(query.join(counts.select("kmer", "tot"), "kmer"), n).select(query.columns)


def rarest_of(counted: DataFrame, n: int) -> DataFrame:
    """rarest_seeds of postings that have their counts (tot) with them."""
    w = Window.partitionBy("ridx", "bin").orderBy("tot", "kmer", "off")
    return counted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k", "tot")


def islands(hits: DataFrame, p: MapParams) -> DataFrame:
    """Hits of runs on one strand whose target bins follow within max_bgap + 1, if the run has min_mat letters and min_aln bins.

    Adds the run's number and qbin. Letters of a hit that overlaps the one before count once.
    """
    pair = ["qidx", "tidx", "strand"]
    w = Window.partitionBy(pair).orderBy("tbin", "poff")
    before, last = F.lag("tbin").over(w), F.lag("poff").over(w)
    marked = hits.withColumn("new", F.coalesce((F.col("tbin") - before > p.max_bgap + 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("step", F.when((before == F.col("tbin")) & (F.col("poff") <= last + p.seed), F.col("poff") - last).otherwise(p.seed))
    numbered = marked.withColumn("run", F.sum("new").over(w))
    whole = Window.partitionBy(*pair, "run")
    letters = F.sum(F.when(F.col("new") == 1, p.seed).otherwise(F.col("step"))).over(whole)
    span = F.max("tbin").over(whole) - F.min("tbin").over(whole) + 1
    kept = numbered.withColumn("letters", letters).withColumn("span", span).where((F.col("letters") >= p.min_mat) & (F.col("span") >= p.min_aln))
    return kept.select(*pair, "run", "tbin", F.floor(F.col("poff") / p.bin_size).cast("int").alias("qbin"), "poff")


def cells(hits: DataFrame, p: MapParams) -> DataFrame:
    """(qidx, tidx, strand[, run], qbin, tbin, kcnt, kmat): seeds that two bins share, and letters under them."""
    key = [c for c in ("qidx", "tidx", "strand", "run", "qbin", "tbin") if c in hits.columns]
    last = F.lag("poff").over(Window.partitionBy(key).orderBy("poff"))
    grown = hits.withColumn("grow", F.least(F.coalesce(F.col("poff") - last, F.lit(p.seed)), F.lit(p.seed)))
    return grown.groupBy(key).agg(F.count("*").cast("int").alias("kcnt"), F.sum("grow").cast("int").alias("kmat"))


def shared_bins(hits: DataFrame, p: MapParams, top: int) -> DataFrame:
    """A report of the `top` pairs of reads by shared seeds: (qidx, tidx, strand, seeds, bins, letters)."""
    c = cells(hits.withColumn("qbin", F.floor(F.col("poff") / p.bin_size).cast("int")), p)
    pairs = c.groupBy("qidx", "tidx", "strand").agg(F.sum("kcnt").alias("seeds"), F.count("*").alias("bins"), F.sum("kmat").alias("letters"))
    return top_pairs(pairs, top)


def top_pairs(pairs: DataFrame, top: int) -> DataFrame:
    """The `top` rows of shared_bins() with the most letters."""
    return pairs.orderBy(F.desc("letters"), F.desc("seeds"), "qidx", "tidx", "strand").limit(top)


def candidate_cells(run: np.ndarray, row: np.ndarray, col: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells that a path can be alive in, by antidiagonals, and where the seeded ones are among them: (run, row, col, seeded).

    A path ends after more than `reach` cells in a row without seeds, so it never gets farther
    than that from a seeded cell, along either axis; nor need it go beyond its run's last seed.
    """
    runs = int(run.max()) + 1
    last_row, last_col = np.full(runs, -1), np.full(runs, -1)
    np.maximum.at(last_row, run, row)
    np.maximum.at(last_col, run, col)
    below, right_of = last_row[run] - row, last_col[run] - col
    seeds = cell_codes(run, row, col, bits := cell_bits(run, row))
    near = []
    for down in range(reach + 1):
        for right in range(reach + 1):
            inside = (below >= down) & (right_of >= right)
            near.append(seeds[inside] + ((down + right << sum(bits)) + down))
    every = np.sort(np.concatenate(near))
    every = every[np.r_[True, every[1:] != every[:-1]]]
    y = every & (1 << bits[1]) - 1
    return every >> bits[1] & (1 << bits[0]) - 1, y, (every >> sum(bits)) - y, np.searchsorted(every, seeds)


def cell_bits(run: np.ndarray, row: np.ndarray) -> tuple[int, int]:
    """Bits of a cell's code that its run and its row take."""
    return int(run.max()).bit_length(), int(row.max()).bit_length()


def cell_codes(run: np.ndarray, row: np.ndarray, col: np.ndarray, bits: tuple[int, int]) -> np.ndarray:
    """Numbers of cells, in order of antidiagonals, runs and rows."""
    return (row + col << sum(bits)) + (run << bits[1]) + row


def meeting(run: np.ndarray, row: np.ndarray, col: np.ndarray, reach: int) -> np.ndarray:
    """Which seeded cells, in order of runs, rows and columns, have another one of their run up to reach + 1 rows and columns away. What lies near a cell without is reached by no path from another seed."""
    far = reach + 1
    wide, high = int(col.max()) + 1 + far, int(row.max()) + 1 + far
    code = (run * high + row) * wide + col
    met = np.r_[False, (code[1:] - code[:-1] <= far) & (row[1:] == row[:-1])] if len(code) else np.zeros(0, bool)
    met[:-1] |= met[1:]
    for down in range(1, far + 1):
        # columns beyond either edge belong to no other row's cells: rows are `far` wider than their cells
        lo, hi = (np.searchsorted(code, code + down * wide + x, side) for x, side in ((-np.minimum(col, far), "left"), (far, "right")))
        some = np.flatnonzero(hi > lo)
        met[some] = True
        ends = np.bincount(lo[some], minlength=len(code) + 1) - np.bincount(hi[some], minlength=len(code) + 1)
        met |= np.cumsum(ends[:-1]) > 0
    return met


def bin_paths(run: np.ndarray, row: np.ndarray, col: np.ndarray, kcnt: np.ndarray, kmat: np.ndarray, p: MapParams) -> list[tuple]:
    """Best path of each first cell, of many runs at once: (run, qb, qe, tb, te, mat, aln, cnt, gap, cigar), ends exclusive.

    A seeded cell (given: run numbered from 0, target bin, query bin, seeds, letters) gains its
    seeds and letters, any other pgap. With S the score so far and d the drift,

        diagonal    S(row-1, col-1) + gain          d = 0
        along query S(row, col-1) + gain + pvar     d + 1   (- pvar instead where d < 0)
        along target S(row-1, col) + gain + pvar    d - 1   (- pvar instead where d > 0)

    and the largest counts, of equals the first named. A path goes on while its score is
    positive, its drift within max_bvar and its cells in a row without seeds within max_bgap;
    where none goes on, one may begin, with score, drift and gap 0. It is known by its first
    cell, and of all paths of one first cell the best end in a seeded cell, with min_mat
    letters at least, is taken. Cells of one antidiagonal, of all runs, are one step.
    """
    if not len(run):
        return []
    # each run from its own first row and column, so that their antidiagonals go together
    runs = int(run.max()) + 1
    top, side = np.full(runs, row.max()), np.full(runs, col.max())
    np.minimum.at(top, run, row)
    np.minimum.at(side, run, col)
    row, col = row - top[run], col - side[run]
    of, y, x, seeded = candidate_cells(run, row, col, p.max_bgap)
    n = len(of)
    count, letters = np.zeros((2, n + 1), np.int64)
    count[seeded], letters[seeded] = kcnt, kmat
    has = np.zeros(n + 1, bool)
    has[seeded] = True
    gain = np.where(has, count + letters, p.pgap)
    bits = cell_bits(run, row)
    code = cell_codes(of, y, x, bits)
    # a cell's neighbours; n stands for none
    before = np.full((3, n), n)
    for k, (up, left) in enumerate(((1, 1), (0, 1), (1, 0))):
        wanted = code - ((up + left << sum(bits)) + up)
        at = np.minimum(np.searchsorted(code, wanted), n - 1)
        found = (code[at] == wanted) & (y >= up) & (x >= left)
        before[k, found] = at[found]
    score, drift, gap, mat = np.zeros((4, n + 1), np.int64)
    first = np.full(n + 1, n)
    came = np.full(n, n)  # the cell before, on the best path
    move = np.zeros(n, np.int8)
    step = code >> sum(bits)
    heads = np.r_[0, np.flatnonzero(np.diff(step)) + 1, n].tolist()
    for head, tail in zip(heads, heads[1:]):
        prior = before[:, head:tail]
        bend = np.zeros_like(prior)
        bend[1] = np.where(drift[prior[1]] < 0, -p.pvar, p.pvar)
        bend[2] = np.where(drift[prior[2]] > 0, -p.pvar, p.pvar)
        way = np.argmax(score[prior] + bend, axis=0)  # the first of equals
        here = np.arange(tail - head)
        chosen = prior[way, here]
        total = score[chosen] + bend[way, here] + gain[head:tail]
        turn = np.where(way == 0, 0, drift[chosen] + np.where(way == 1, 1, -1))
        idle = np.where(has[head:tail], 0, gap[chosen] + 1)
        alive = np.flatnonzero((total > 0) & (idle <= p.max_bgap) & (np.abs(turn) <= p.max_bvar))
        kept, chosen = head + alive, chosen[alive]
        score[kept], drift[kept], gap[kept] = total[alive], turn[alive], idle[alive]
        mat[kept] = mat[chosen] + letters[kept]
        first[kept] = np.where(chosen == n, kept, first[chosen])
        first[kept[first[kept] == n]] = kept[first[kept] == n]
        came[kept], move[kept] = np.where(first[kept] == kept, n, chosen), way[alive]
    ends = np.flatnonzero(has[:n] & (score[:n] > 0) & (mat[:n] >= p.min_mat))
    begs = first[ends]
    ends = ends[np.lexsort((x[ends], y[ends], -score[ends], x[begs], y[begs], of[begs]))]
    ends = ends[np.r_[True, first[ends[1:]] != first[ends[:-1]]]] if len(ends) else ends
    # back along all paths together, a letter a cell: of the step, capital where it has seeds
    written = [[] for _ in ends]
    met = np.zeros((2, len(ends)), np.int64)
    at = ends.copy()
    while len(going := np.flatnonzero(at < n)):
        cells_ = at[going]
        met[0, going] += count[cells_]
        met[1, going] += ~has[cells_]
        for k, letter in zip(going.tolist(), np.where(has[cells_], move[cells_], move[cells_] + 3).tolist()):
            written[k].append("MIDmid"[letter])
        at[going] = came[cells_]
    out = []
    for k, end in enumerate(ends.tolist()):
        beg = int(first[end])
        aln = int(min(x[end] - x[beg], y[end] - y[beg])) + 1
        q, t = int(side[of[end]]), int(top[of[end]])
        out.append((int(of[end]), q + int(x[beg]), q + int(x[end]) + 1, t + int(y[beg]), t + int(y[end]) + 1, int(mat[end]), aln, int(met[0, k]), int(met[1, k]), path_cigar("".join(written[k]))))
    return out


def path_cigar(backwards: str) -> str:
    """Cigar of a path's letters from its end: neighbouring steps along both axes are one match, and equal letters are counted."""
    forwards = re.sub("ID|DI", "M", backwards)[::-1]
    return re.sub(r"(.)\1+", lambda m: f"{len(m[0])}{m[1]}", forwards)


#: Cells of runs that are aligned together.
TOGETHER = 50_000
_COLUMNS = pa.schema([("qidx", pa.int64()), ("qdir", pa.int32()), ("qlen", pa.int32()), ("qb", pa.int32()), ("qe", pa.int32()), ("tidx", pa.int64()), ("tlen", pa.int32()), ("tb", pa.int32()), ("te", pa.int32()), ("mat", pa.int32()), ("aln", pa.int32()), ("cnt", pa.int32()), ("gap", pa.int32()), ("cigar", pa.string())])


def align(run_cells: DataFrame, bincnts: DataFrame, p: MapParams) -> DataFrame:
    """Overlaps of runs, by the best paths through their cells(qidx, tidx, strand, run, qbin, tbin, kcnt, kmat); bincnts(ridx, bincnt).

    Cells come sorted by run, and stream through in Arrow batches; a task holds the runs of a
    few batches at a time, and never parts one. Only acceptable overlaps are returned.
    """
    sized = run_cells.join(bincnts.select(F.col("ridx").alias("qidx"), F.col("bincnt").alias("qlen")), "qidx").join(bincnts.select(F.col("ridx").alias("tidx"), F.col("bincnt").alias("tlen")), "tidx")
    key = ["qidx", "tidx", "strand", "run"]
    ordered = sized.select(*key, F.col("qlen").cast("int").alias("qlen"), F.col("tlen").cast("int").alias("tlen"), "tbin", "qbin", "kcnt", "kmat").repartition(*key).sortWithinPartitions(*key, "tbin", "qbin")
    return align_ordered(ordered, p)


def align_ordered(ordered: DataFrame, p: MapParams) -> DataFrame:
    """align() of cells that have qlen and tlen, and stand together by run, in order of tbin and qbin."""
    key = ["qidx", "tidx", "strand", "run"]

    def overlaps(rows: pa.Table) -> pa.RecordBatch:
        cols = {c: rows.column(c).to_numpy() for c in rows.column_names}
        new = np.r_[True, np.any([np.diff(cols[c]) != 0 for c in key], axis=0)]
        run, head = np.cumsum(new) - 1, np.flatnonzero(new)
        row, col = cols["tbin"].astype(np.int64), cols["qbin"].astype(np.int64)
        if p.min_aln > 1:  # a path of one cell isn't acceptable
            kept = meeting(run, row, col, p.max_bgap)
            cols, row, col = {c: v[kept] for c, v in cols.items()}, row[kept], col[kept]
            new = np.diff(run[kept], prepend=-1) != 0
            run, head = np.cumsum(new) - 1, np.flatnonzero(new)
        found = bin_paths(run, row, col, cols["kcnt"], cols["kmat"], p)
        at = head[np.array([f[0] for f in found], np.int64)]
        strand, qlen = cols["strand"][at], cols["qlen"][at]
        qb, qe, tb, te, mat, aln, cnt, gap = (np.array([f[k] for f in found], np.int64) for k in range(1, 9))
        back = strand == 1
        values = (cols["qidx"][at], strand, qlen, np.where(back, qlen - qe, qb), np.where(back, qlen - qb, qe), cols["tidx"][at], cols["tlen"][at], tb, te, mat, aln, cnt, gap, [f[9] for f in found])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _COLUMNS, strict=True)], schema=_COLUMNS)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            other = np.any([rows.column(c).to_numpy() != rows.column(c)[-1].as_py() for c in key], axis=0)
            whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last run may go on
            if whole:
                yield overlaps(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held)
        if size:
            yield overlaps(pa.Table.from_batches(held))

    return acceptable(ordered.mapInArrow(runs, OVERLAP), p)


def acceptable(overlaps: DataFrame, p: MapParams) -> DataFrame:
    """Overlaps with enough letters, similarity and length, and not too much gap or difference of lengths."""
    span = F.abs((F.col("qe") - F.col("qb")) - (F.col("te") - F.col("tb")))
    return overlaps.where((F.col("mat") >= p.min_mat) & (F.col("mat") >= F.floor(F.col("aln") * p.bin_size * p.min_sim)) & (F.col("gap") <= F.floor(F.col("aln") * p.max_gap)) & (F.col("aln") >= p.min_aln) & (span <= F.floor(F.greatest(F.col("aln") * p.aln_var, F.lit(1.0)))))


def best_per_pair(overlaps: DataFrame) -> DataFrame:
    """Of each pair of reads the overlap with the largest aln, then mat."""
    order = F.struct("aln", "mat", -F.col("qdir"), -F.col("qb"), -F.col("tb"))
    return overlaps.groupBy("qidx", "tidx").agg(F.max_by(F.struct(*overlaps.columns), order).alias("o")).select("o.*")


def best_n(overlaps: DataFrame, n: int) -> DataFrame:
    """Overlaps that are among the n with the largest mat of either of their reads."""
    both = overlaps.select(F.explode(F.array("qidx", "tidx")).alias("rid"), "qidx", "tidx", "qdir", "qb", "tb", "mat")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("mat"), "qidx", "tidx", "qdir", "qb", "tb"))
    kept = both.withColumn("k", rank).where(F.col("k") <= n).select("qidx", "tidx", "qdir", "qb", "tb").distinct()
    return overlaps.join(kept, ["qidx", "tidx", "qdir", "qb", "tb"], "left_semi").select(overlaps.columns)


def most_hits(overlaps: DataFrame, n: int) -> DataFrame:
    """The n overlaps of each query with the largest mat."""
    rank = F.row_number().over(Window.partitionBy("qidx").orderBy(F.desc("mat"), "tidx", "qdir", "qb", "tb"))
    return overlaps.withColumn("k", rank).where(F.col("k") <= n).drop("k")


def chained(overlaps: DataFrame, p: MapParams) -> DataFrame:
    """Parts of one pair and strand that follow each other on both reads become one overlap; where they don't, or their lengths differ too much, all parts stay."""
    key = ["qidx", "tidx", "qdir"]
    # on the query's strand
    qs, qt = F.when(F.col("qdir") == 0, F.col("qb")).otherwise(F.col("qlen") - F.col("qe")), F.when(F.col("qdir") == 0, F.col("qe")).otherwise(F.col("qlen") - F.col("qb"))
    o = overlaps.withColumn("qs", qs).withColumn("qt", qt)
    w = Window.partitionBy(key).orderBy("tb", "te", "qs")
    whole = Window.partitionBy(key)
    o = o.withColumn("ok", (F.coalesce(F.lag("te").over(w), F.lit(0)) <= F.col("tb")) & (F.coalesce(F.lag("qt").over(w), F.lit(0)) <= F.col("qs")))
    o = o.withColumn("ok", F.min("ok").over(whole)).withColumn("parts", F.count("*").over(whole))
    spans = [F.max("qt").over(whole) - F.min("qs").over(whole), F.max("te").over(whole) - F.min("tb").over(whole)]
    o = o.withColumn("q_span", spans[0]).withColumn("t_span", spans[1])
    joins = F.col("ok") & (F.col("parts") > 1) & (F.abs(F.col("q_span") - F.col("t_span")) <= F.floor(F.greatest(F.least("q_span", "t_span") * p.aln_var, F.lit(1.0))))
    o = o.withColumn("group", F.when(joins, F.lit(0)).otherwise(F.row_number().over(w)))
    cigar = F.when(F.count("*") == 1, F.first("cigar")).otherwise("*")
    one = o.groupBy(*key, "group").agg(F.first("qlen").alias("qlen"), F.min("qb").alias("qb"), F.max("qe").alias("qe"), F.first("tlen").alias("tlen"), F.min("tb").alias("tb"), F.max("te").alias("te"), F.sum("mat").cast("int").alias("mat"), F.count("*").alias("n"), F.sum("aln").cast("int").alias("aln"), F.sum("cnt").cast("int").alias("cnt"), F.sum("gap").cast("int").alias("gap"), cigar.alias("cigar"))
    aln = F.when(F.col("n") > 1, F.least(F.col("qe") - F.col("qb"), F.col("te") - F.col("tb"))).otherwise(F.col("aln"))
    return one.withColumn("aln", aln).select(*overlaps.columns)


def dovetail(margin: int) -> F.Column:
    """Whether an overlap runs to an end of a read on either side: not both left overhangs, nor both right ones, exceed the margin."""
    left = F.when(F.col("qdir") == 0, F.col("qb")).otherwise(F.col("qlen") - F.col("qe"))
    right = F.when(F.col("qdir") == 0, F.col("qlen") - F.col("qe")).otherwise(F.col("qb"))
    return ~(((left > margin) & (F.col("tb") > margin)) | ((right > margin) & (F.col("tlen") - F.col("te") > margin)))


def contained_reads(overlaps: DataFrame, slack: int = 1) -> DataFrame:
    """(rid) of reads that lie, but for the slack, wholly in a longer one; of equally long ones the larger id counts as contained."""
    q_in = (F.col("qb") <= slack) & (F.col("qe") + slack >= F.col("qlen"))
    t_in = (F.col("tb") <= slack) & (F.col("te") + slack >= F.col("tlen"))
    q_less = (F.col("qlen") < F.col("tlen")) | ((F.col("qlen") == F.col("tlen")) & (F.col("qidx") > F.col("tidx")))
    found = overlaps.select(F.explode(F.array_compact(F.array(F.when(q_in & q_less, F.col("qidx")), F.when(t_in & ~q_less, F.col("tidx"))))).alias("rid"))
    return found.distinct()


def flipped(overlaps: DataFrame) -> DataFrame:
    """The same overlaps with query and target exchanged."""
    ops = F.translate("cigar", "IDid", "DIdi")
    from strandlake.functions.sequence import cigar_runs

    turned = F.array_join(F.transform(F.reverse(cigar_runs(ops)), lambda r: F.concat(F.when(r["n"] > 1, r["n"].cast("string")).otherwise(""), r["op"])), "")
    cigar = F.when(F.col("cigar") == "*", "*").when(F.col("qdir") == 0, ops).otherwise(turned)
    return overlaps.select(F.col("tidx").alias("qidx"), "qdir", F.col("tlen").alias("qlen"), F.col("tb").alias("qb"), F.col("te").alias("qe"), F.col("qidx").alias("tidx"), F.col("qlen").alias("tlen"), F.col("qb").alias("tb"), F.col("qe").alias("te"), "mat", "aln", "cnt", "gap", cigar.alias("cigar"))


def letters(bincnts: DataFrame, p: MapParams) -> DataFrame:
    """(ridx, len): what whole bins of reads(ridx, bincnt) have."""
    return bincnts.select("ridx", (F.col("bincnt") * p.bin_size).alias("len"))


#: Hits of a part of the index at most, about: some 100 GB of shuffle files.
PART_HITS = 2_000_000_000


def parts_needed(posted: DataFrame, most: int = PART_HITS) -> int:
    """In how many parts an index has at most `most` hits each when all its reads are mapped to a part: a pair of postings of one seed is a hit."""
    n = F.col("n").cast("double")
    hits = posted.groupBy("kmer").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0]
    return max(1, math.ceil((hits or 0) / most))


def part_of(posted: DataFrame, k: int, parts: int) -> DataFrame:
    """Postings of the reads of one part of an index; a read is in one part whole."""
    return posted.where(F.pmod(F.xxhash64("ridx"), F.lit(parts)) == k)


def map_to_index(query: DataFrame, target: DataFrame, bincnts: DataFrame, p: MapParams, parts: int, self_join: bool = True) -> DataFrame:
    """Overlaps of the postings of queries with an index, part by part of it: seed join, runs, alignment, chains, best of each pair and read.

    query: with lengths; bincnts(ridx, bincnt): of queries and targets. Each part's overlaps join the best so far and
    are written before the next part begins, so that shuffle files of one part stand at a time.
    The result doesn't depend on the parts: seeds are counted over the whole index, a pair of
    reads meets in one part, and what is among the best n of a read is so in its part as well.
    """
    from strandlake.operators.graph import checkpointed

    best = None
    for k in range(parts):
        hits = seed_hits(query, part_of(target, k, parts) if parts > 1 else target, p, self_join)
        found = best_per_pair(chained(align(cells(islands(hits, p), p), bincnts, p), p))
        if parts == 1:
            return best_n(found, p.best_n)
        best = checkpointed(best_n(found if best is None else best.unionByName(found), p.best_n))
        query.sparkSession.sparkContext._jvm.System.gc()  # Spark removes a shuffle's files once the driver has collected what held them
    return best


def map_reads(reads: DataFrame, p: MapParams) -> DataFrame:
    """All overlaps among reads: by blocks of them, whose hits are aligned where they come up; or by p.parts parts of their index."""
    from strandlake.operators import blocks
    from strandlake.operators.graph import checkpointed
    from strandlake.operators.kmers import index
    from strandlake.operators.reads import trimmed_to_bins

    if not p.parts:
        runs = blocks.from_hits(blocks.packed_index(reads, p), p, blocks.ISLANDS)
        return best_n(best_per_pair(chained(align_ordered(runs, p), p)), p.best_n)
    bincnts = trimmed_to_bins(reads, p.bin_size).select("ridx", "bincnt")
    posted = checkpointed(with_lengths(index(reads, p), letters(bincnts, p)))
    return map_to_index(posted, posted, bincnts, p, p.parts)


def map_queries(queries: DataFrame, references: DataFrame, p: MapParams) -> DataFrame:
    """Overlaps of queries with an index of references, both reads(ridx, seq) with ids of their own; the frequency cut is the references' alone.

    Ids of queries in the result are theirs, as are those of references.
    """
    from strandlake.operators.graph import checkpointed
    from strandlake.operators.kmers import index, kmers
    from strandlake.operators.reads import trimmed_to_bins

    target = checkpointed(index(references, p))
    seeds = kmers(queries, p).join(target.select("kmer").distinct(), "kmer", "left_semi").select("kmer", "ridx", "dir", "off", F.floor(F.col("off") / p.bin_size).cast("int").alias("bin"))
    # a name space for both: queries have even numbers, references odd ones
    query, target = seeds.withColumn("ridx", F.col("ridx") * 2), target.withColumn("ridx", F.col("ridx") * 2 + 1)
    bincnts = trimmed_to_bins(queries, p.bin_size).select(F.col("ridx") * 2, "bincnt").toDF("ridx", "bincnt").unionByName(trimmed_to_bins(references, p.bin_size).select(F.col("ridx") * 2 + 1, "bincnt").toDF("ridx", "bincnt"))
    query = checkpointed(with_lengths(query, letters(bincnts, p)))
    met = query.groupBy("kmer").agg(F.count("*").alias("m")).join(target.groupBy("kmer").agg(F.count("*").alias("n")), "kmer").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0]
    found = map_to_index(query, target, bincnts, p, p.parts or max(1, math.ceil((met or 0) / PART_HITS)), self_join=False)
    return found.withColumn("qidx", F.floor(F.col("qidx") / 2)).withColumn("tidx", F.floor(F.col("tidx") / 2))


def map_pairs(reads: DataFrame, pairs: DataFrame, p: MapParams) -> DataFrame:
    """Overlaps of the given pairs(qidx, tidx) only: the pair list meets the seeds before anything is aligned."""
    from strandlake.operators.graph import checkpointed
    from strandlake.operators.kmers import index
    from strandlake.operators.reads import trimmed_to_bins

    cut = trimmed_to_bins(reads, p.bin_size)
    posted = checkpointed(with_lengths(index(reads, p), letters(cut, p)))
    wanted = pairs.select("qidx", "tidx").distinct()
    # only seeds of reads that some pair has, each with the reads it is to meet
    q = posted.join(wanted.select(F.col("qidx").alias("ridx")).distinct(), "ridx", "left_semi").select(posted.columns)
    t = posted.join(wanted.select(F.col("tidx").alias("ridx")).distinct(), "ridx", "left_semi").select(posted.columns)
    hits = seed_hits(q, t, p, self_join=False).join(wanted, ["qidx", "tidx"], "left_semi").where("qidx != tidx")
    return align(cells(islands(hits, p), p), cut.select("ridx", "bincnt"), p)


def realigned(overlaps: DataFrame, reads: DataFrame, p: MapParams) -> DataFrame:
    """The pairs of overlaps aligned once more with query and target exchanged, and turned back; pairs that fail stay out."""
    again = map_pairs(reads, overlaps.select(F.col("tidx").alias("qidx"), F.col("qidx").alias("tidx")), p)
    return flipped(best_per_pair(again))


def best_rows(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The row of each key with the largest `by`; of equals the one whose other columns are smallest."""
    rest = [c for c in rows.columns if c not in (*key, by)]
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), *rest))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")
