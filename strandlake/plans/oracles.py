"""The same results in DuckDB's SQL, over views of the same tables."""

from __future__ import annotations

from strandlake.config import SMALL_GRAPH

_SEQ = """reads AS (SELECT doc_id AS ridx, 'w' || (doc_id // 5) || '/' || doc_id || '_' || (doc_id + 1) AS tag,
  translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
_BINS = _SEQ + """, bins AS (SELECT ridx, CAST(off AS INT) AS off, substr(seq, off * 64 + 1, 64) AS seq FROM (SELECT ridx, seq, unnest(range(length(seq) // 64)) AS off FROM reads))"""


def _code(text: str) -> str:
    return f"CAST('0b' || replace(replace(replace(replace({text}, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11') AS BIGINT)"


def _sampled(source: str) -> str:
    return f"seeds AS (SELECT code AS kmer, ridx, off, dir FROM (SELECT {_code('least(fwd, rev)')} AS code, ridx, CAST(off AS INT) AS off, CASE WHEN fwd < rev THEN 0 ELSE 1 END AS dir FROM {source} WHERE fwd <> rev) WHERE xor(xor(code, code >> 4), code >> 7) % 16384 < 4096)"


_KMERS = _BINS + """, placed AS (SELECT ridx, off * 64 + p AS off, substr(seq, p + 1, 15) AS fwd FROM (SELECT ridx, off, seq, unnest(range(50)) AS p FROM bins)),
 both_ AS (SELECT ridx, off, fwd, reverse(translate(fwd, 'ACGT', 'TGCA')) AS rev FROM placed), """ + _sampled("both_")
_HPC = _BINS + """, runs AS (SELECT ridx, off, seq, list_filter(range(1, length(seq) + 1), lambda i: i = 1 OR substr(seq, i, 1) <> substr(seq, i - 1, 1)) AS r FROM bins),
 packed AS (SELECT ridx, off, r, array_to_string(list_transform(r, lambda i: substr(seq, i, 1)), '') AS seq FROM runs),
 placed AS (SELECT ridx, off * 64 + r[p + 15] - 1 - 14 AS off, substr(seq, p + 1, 15) AS fwd FROM (SELECT *, unnest(range(length(seq) - 14)) AS p FROM packed)),
 both_ AS (SELECT ridx, off, fwd, reverse(translate(fwd, 'ACGT', 'TGCA')) AS rev FROM placed), """ + _sampled("both_")
_COUNTS = _KMERS + ", counts AS (SELECT kmer, least(count(*), 65535) AS tot FROM seeds GROUP BY kmer)"
_HIST = _COUNTS + ", hist AS (SELECT tot, count(*) AS n FROM counts GROUP BY tot)"
_LIMIT = _HIST + """, lim AS (SELECT greatest(100, coalesce((SELECT min(tot) - 1 FROM (SELECT tot, sum(n * tot) OVER (ORDER BY tot DESC) AS above, sum(n * tot) OVER () AS every FROM hist) WHERE above <= every * 0.05), max(tot), 0)) AS kmax FROM hist)"""
_SOLID = _LIMIT + ", solid AS (SELECT kmer, tot FROM counts, lim WHERE tot >= 2 AND tot <= kmax)"
_POSTED = _SOLID + """, posted0 AS (SELECT kmer, ridx, CAST(off // 64 AS INT) AS bin, dir, min(off) AS off FROM seeds WHERE kmer IN (SELECT kmer FROM solid) GROUP BY ALL),
 degree0 AS (SELECT ridx, bin FROM posted0 GROUP BY ridx, bin HAVING count(*) >= 2),
 posted AS (SELECT p.* FROM posted0 p JOIN degree0 USING (ridx, bin))"""
_HITS = _POSTED + """, hits AS (SELECT q.ridx AS qidx, t.ridx AS tidx, xor(q.dir, t.dir) AS strand, t.bin AS tbin,
  CAST(CASE WHEN q.dir = t.dir THEN q.off ELSE length(r.seq) // 64 * 64 - q.off - 15 END AS INT) AS poff
  FROM posted q JOIN posted t ON q.kmer = t.kmer AND t.ridx > q.ridx JOIN reads r ON r.ridx = q.ridx)"""
_CELLS = _HITS + """, cells AS (SELECT qidx, tidx, strand, qbin, tbin, CAST(count(*) AS INT) AS kcnt, CAST(sum(least(coalesce(poff - last, 15), 15)) AS INT) AS kmat FROM
  (SELECT *, lag(poff) OVER (PARTITION BY qidx, tidx, strand, qbin, tbin ORDER BY poff) AS last FROM (SELECT *, poff // 64 AS qbin FROM hits)) GROUP BY ALL)"""
_ISLANDS = _HITS + """, marked AS (SELECT *, CASE WHEN tbin - lag(tbin) OVER w > 5 OR lag(tbin) OVER w IS NULL THEN 1 ELSE 0 END AS new,
  CASE WHEN lag(tbin) OVER w = tbin AND poff <= lag(poff) OVER w + 15 THEN poff - lag(poff) OVER w ELSE 15 END AS step FROM hits WINDOW w AS (PARTITION BY qidx, tidx, strand ORDER BY tbin, poff)),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY qidx, tidx, strand ORDER BY tbin, poff) AS run FROM marked)"""
_OVL = """fold AS (SELECT greatest(1, count(*) // 5) AS r FROM orders), ovl0 AS (SELECT l_orderkey % r AS qidx, CAST(l_linenumber % 2 AS INT) AS qdir, CAST(l_suppkey % 32 AS INT) AS qb, l_partkey % r + r AS tidx, CAST(l_partkey % 40 AS INT) AS tb, max(CAST(floor(l_extendedprice) AS INT)) AS mat FROM lineitem, fold GROUP BY ALL),
 ovl AS (SELECT qidx, qdir, 96 AS qlen, qb, qb + aln AS qe, tidx, 96 AS tlen, tb, tb + aln AS te, mat, aln, 1 AS cnt, 0 AS gap, '*' AS cigar FROM (SELECT *, 8 + (qb * 7 + tb * 3) % 40 AS aln FROM ovl0))"""
_SIDES = _OVL + """, sides AS (SELECT qidx AS rid, qb AS beg, qe AS "end", qlen AS len, qdir AS odir, tb AS obeg, te AS oend, tlen AS olen FROM ovl UNION ALL SELECT tidx, tb, te, tlen, qdir, qb, qe, qlen FROM ovl),
 ends_ AS (SELECT *, CASE WHEN odir = 0 THEN obeg ELSE olen - oend END AS l, CASE WHEN odir = 0 THEN olen - oend ELSE obeg END AS r FROM sides)"""


def _depth(intervals: str) -> str:
    """Stretches of depth two of a table (rid, beg, end)."""
    return f"""steps AS (SELECT rid, pos, sum(d) AS d FROM (SELECT rid, beg AS pos, 1 AS d FROM {intervals} UNION ALL SELECT rid, "end", -1 FROM {intervals}) GROUP BY rid, pos),
 depth AS (SELECT rid, pos, sum(d) OVER (PARTITION BY rid ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt FROM steps),
 deep AS (SELECT *, CASE WHEN lag(nxt) OVER (PARTITION BY rid ORDER BY pos) = pos THEN 0 ELSE 1 END AS new FROM depth WHERE depth >= 2 AND nxt IS NOT NULL),
 stretches AS (SELECT rid, min(pos) AS beg, max(nxt) AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM deep) GROUP BY rid, run)"""


_REGIONS = """regs AS (SELECT l_partkey % 100 AS node, l_orderkey AS rid, CAST(l_suppkey % 2 AS INT) AS dir, CAST((l_linenumber - 1) * 6 AS INT) AS beg, CAST((l_linenumber - 1) * 6 + 4 AS INT) AS "end" FROM lineitem),
 placed AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY beg, "end", node, dir) AS k FROM regs)"""


_LAYERED = _REGIONS.replace("l_partkey % 100 AS node", "l_partkey % 40 * 8 + l_linenumber AS node").replace("CAST(l_suppkey % 2 AS INT) AS dir", "0 AS dir")


def _pairs(span: int, regions: str = _REGIONS) -> str:
    return regions + f""", pairs AS (SELECT CASE WHEN a.node < b.node THEN a.node ELSE b.node END AS node1, CASE WHEN a.node < b.node THEN a.dir ELSE 1 - b.dir END AS dir1,
  CASE WHEN a.node < b.node THEN b.node ELSE a.node END AS node2, CASE WHEN a.node < b.node THEN b.dir ELSE 1 - a.dir END AS dir2, b.beg - a."end" AS off, CAST(b.k = a.k + 1 AS INT) AS adjacent
  FROM placed a JOIN placed b ON a.rid = b.rid AND a.k < b.k AND b.beg <= a."end" + {span} AND a.node <> b.node)"""


_MEDIAN = "CAST(list_sort(list(off))[count(*) // 2 + 1] AS INT)"
_EDGES = _pairs(8) + f""", edges AS (SELECT node1, dir1, node2, dir2, CAST(count(*) AS INT) AS cov, {_MEDIAN} AS off, CASE WHEN max(adjacent) = 1 AND count(*) >= 3 THEN 0 ELSE 2 END AS closed FROM pairs GROUP BY ALL),
 halves AS (SELECT node1 AS src, dir1 AS sdir, node2 AS dst, dir2 AS ddir, cov, off FROM edges WHERE closed = 0 UNION ALL SELECT node2, 1 - dir2, node1, 1 - dir1, cov, off FROM edges WHERE closed = 0)"""
_DEGREES = _EDGES + ", degrees AS (SELECT src AS node, count(*) FILTER (sdir = 0) AS fwd, count(*) FILTER (sdir = 1) AS bwd FROM halves GROUP BY src)"
_LESS = "(SELECT sum(length(seq)) FROM reads)"


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _nx(lengths: str, xs: str) -> str:
    return f"""len_ AS ({lengths}), down AS (SELECT len, row_number() OVER (ORDER BY len DESC) AS k, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS total FROM len_),
 nx AS (SELECT x, min(k) AS lx, max(len) AS nx FROM (SELECT unnest({xs}) AS x) JOIN down ON upto * 100 >= total * x GROUP BY x)"""


def _links(pairs: str) -> str:
    return pairs + f""", found AS (SELECT node1, dir1, node2, dir2, CAST(count(*) AS INT) AS cov, {_MEDIAN} AS off, count(*) < 3 AS weak FROM pairs GROUP BY ALL),
 halves AS (SELECT node1 AS src, dir1 AS sdir, node2 AS dst, dir2 AS ddir, cov FROM found UNION ALL SELECT node2, 1 - dir2, node1, 1 - dir1, cov FROM found)"""


_LINKS = _links(_pairs(8))
_LADDER = """k AS (SELECT p_partkey * 4 AS n FROM part), edges AS (
  SELECT n AS node1, 0 AS dir1, n + 4 AS node2, 0 AS dir2, 9 AS cov, 0 AS off, 0 AS closed FROM k WHERE n % 28 <> 0 UNION ALL SELECT n, 0, n + 1, 0, 5, 0, 0 FROM k WHERE n % 20 = 0
  UNION ALL SELECT n, 0, n + 2, 0, 7, 0, 0 FROM k WHERE n % 44 = 0 UNION ALL SELECT n + 2, 0, n + 8, 0, 6, 0, 0 FROM k WHERE n % 44 = 0)"""
_HALVES = """, halves AS (SELECT node1 AS src, dir1 AS sdir, node2 AS dst, dir2 AS ddir, cov, off FROM edges WHERE closed = 0 UNION ALL SELECT node2, 1 - dir2, node1, 1 - dir1, cov, off FROM edges WHERE closed = 0),
 degrees AS (SELECT src AS node, count(*) FILTER (sdir = 0) AS fwd, count(*) FILTER (sdir = 1) AS bwd FROM halves GROUP BY src)"""


def _unitigs(edges: str) -> str:
    """Paths without branches of a graph without rings: each state's way to the end, and of both directions that with the smaller first state."""
    return edges + _HALVES + """, single AS (SELECT src, sdir FROM halves GROUP BY ALL HAVING count(*) = 1),
 steps AS (SELECT src * 2 + sdir AS state, dst * 2 + ddir AS next FROM halves WHERE (src, sdir) IN (SELECT (src, sdir) FROM single) AND (dst, 1 - ddir) IN (SELECT (src, sdir) FROM single)),
 states AS (SELECT node * 2 AS state FROM degrees UNION ALL SELECT node * 2 + 1 FROM degrees),
 walk AS (SELECT state AS head, state, 0 AS step FROM states WHERE state NOT IN (SELECT next FROM steps) UNION ALL SELECT head, next, step + 1 FROM walk JOIN steps USING (state)),
 utg AS (SELECT head AS utg, step, state // 2 AS node, CAST(state % 2 AS INT) AS dir FROM walk WHERE head IN (SELECT head FROM walk GROUP BY head HAVING head <= xor(arg_max(state, step), 1))),
 size AS (SELECT utg, max(step) + 1 AS n, arg_min(node, step) AS n0, 1 - arg_min(dir, step) AS d0, arg_max(node, step) AS n1, arg_max(dir, step) AS d1 FROM utg GROUP BY utg),
 outs AS (SELECT src, sdir, count(*) AS n FROM halves GROUP BY ALL),
 ends_ AS (SELECT e.*, coalesce(o.n, 0) AS out FROM (SELECT utg, n, 0 AS e, n0 AS node, d0 AS dir FROM size UNION ALL SELECT utg, n, 1, n1, d1 FROM size) e LEFT JOIN outs o ON o.src = node AND o.sdir = dir),
 sized AS (SELECT a.*, b.out AS out2 FROM ends_ a JOIN ends_ b ON a.utg = b.utg AND a.e <> b.e)"""


_ALIGNED = _OVL + """, al AS (SELECT *, qb % 9 + 4 AS a, tb % 3 + 1 AS b, qb % 4 + 1 AS c, tb % 2 + 1 AS d, aln - 3 AS e FROM ovl),
 aligned AS (SELECT qidx, qdir, 160 AS qlen, qb, qb + a + b + c + e AS qe, tidx, 160 AS tlen, tb, tb + a + c + d + e AS te, mat, aln, cnt, gap, a || 'M' || b || 'I' || c || 'm' || d || 'D' || e || 'M' AS cigar, repeat('M', a) || repeat('I', b) || repeat('m', c) || repeat('D', d) || repeat('M', e) AS ops, a, b, c, d, e FROM al)"""
_SAM = """sam AS (SELECT CAST(event_id AS VARCHAR) AS qname, event_type AS rname, CAST(event_id % 500 + 1 AS INT) AS pos, CAST(event_id % 61 AS INT) AS mapq, event_id % 4 * 2 AS s, event_id % 9 + 5 AS a, event_id % 7 + 1 AS b FROM events),
 good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rname, pos ORDER BY mapq DESC, qname) AS k FROM sam WHERE mapq >= 10) WHERE k = 1)"""
_NODES = 'regs AS (SELECT l_partkey % 100 AS node, l_orderkey AS rid, CAST(l_suppkey % 2 AS INT) AS dir, CAST((l_linenumber - 1) * 6 AS INT) AS beg, CAST((l_linenumber - 1) * 6 + 4 AS INT) AS "end", l_orderkey % 7 = 0 AS closed FROM lineitem)'

ORACLE_SQL: dict[str, str] = {
    "weak_branches": _q(_LINKS + ", forks AS (SELECT src, sdir FROM halves GROUP BY ALL HAVING count(*) > 1)", "SELECT node1, dir1, node2, dir2 FROM found WHERE weak AND ((node1, dir1) IN (SELECT (src, sdir) FROM forks) OR (node2, 1 - dir2) IN (SELECT (src, sdir) FROM forks))"),
    "binary_links": _q(_LINKS + """, ranked AS (SELECT *, count(*) OVER p AS n, max(cov) OVER p AS best FROM halves WINDOW p AS (PARTITION BY src, dst)),
 lost AS (SELECT src, sdir, dst, ddir FROM (SELECT *, count(*) FILTER (cov = best) OVER (PARTITION BY src, dst) AS top FROM ranked) WHERE n > 1 AND (cov < best OR top > 1))""", "SELECT node1, dir1, node2, dir2, cov, off, CASE WHEN (node1, dir1, node2, dir2) IN (SELECT (src, sdir, dst, ddir) FROM lost) OR (node2, 1 - dir2, node1, 1 - dir1) IN (SELECT (src, sdir, dst, ddir) FROM lost) THEN 3 ELSE 0 END AS closed FROM found"),
    "boomerangs": _q(_links(_pairs(8, _LAYERED)) + """, d AS (SELECT src AS node, count(*) FILTER (sdir = 0) AS fwd, count(*) FILTER (sdir = 1) AS bwd FROM halves GROUP BY src),
 short AS (SELECT p_partkey % 320 AS node FROM part GROUP BY 1 HAVING max(p_size) <= 50), b AS (SELECT node FROM d JOIN short USING (node) WHERE (fwd = 0 AND bwd > 1) OR (bwd = 0 AND fwd > 1))""", "SELECT node1, dir1, node2, dir2 FROM found WHERE node1 IN (SELECT node FROM b) OR node2 IN (SELECT node FROM b)"),
    "chain": _q(_OVL + """, o AS (SELECT *, CASE WHEN qdir = 0 THEN qb ELSE qlen - qe END AS qs, CASE WHEN qdir = 0 THEN qe ELSE qlen - qb END AS qt FROM ovl),
 f AS (SELECT *, coalesce(lag(te) OVER w, 0) <= tb AND coalesce(lag(qt) OVER w, 0) <= qs AS fits, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY qidx, tidx, qdir ORDER BY tb, te, qs)),
 whole AS (SELECT qidx, tidx, qdir, bool_and(fits) AND count(*) > 1 AND abs((max(qt) - min(qs)) - (max(te) - min(tb))) <= floor(greatest(least(max(qt) - min(qs), max(te) - min(tb)) * 0.25, 1)) AS joins FROM f GROUP BY ALL),
 g AS (SELECT f.*, CASE WHEN joins THEN 0 ELSE k END AS part FROM f JOIN whole USING (qidx, tidx, qdir))""", """SELECT qidx, qdir, any_value(qlen) AS qlen, min(qb) AS qb, max(qe) AS qe, tidx, any_value(tlen) AS tlen, min(tb) AS tb, max(te) AS te, CAST(sum(mat) AS INT) AS mat,
 CAST(CASE WHEN count(*) > 1 THEN least(max(qe) - min(qb), max(te) - min(tb)) ELSE sum(aln) END AS BIGINT) AS aln, CAST(sum(cnt) AS INT) AS cnt, CAST(sum(gap) AS INT) AS gap, '*' AS cigar FROM g GROUP BY qidx, tidx, qdir, part"""),
    "ladder_unitigs": _q("RECURSIVE " + _unitigs(_LADDER), "SELECT utg, step, node, dir FROM utg"),
    "tip_nodes": _q("RECURSIVE " + _unitigs(_LADDER) + """, tips AS (SELECT utg, n, src AS tip, dst AS j, ddir AS jdir, cov AS tcov, off AS toff FROM sized JOIN halves ON src = node AND sdir = dir WHERE out = 1 AND out2 = 0 AND n <= 10),
 reach AS (SELECT node AS r, dir AS rdir, n + CAST(out2 > 0 AS INT) AS rn FROM sized),
 met AS (SELECT t.*, h.src AS r, h.cov AS rcov, h.off AS roff, rn FROM tips t JOIN halves h ON h.dst = j AND h.ddir = jdir AND h.src <> tip JOIN reach ON r = h.src AND rdir = h.sdir),
 lost AS (SELECT utg FROM met WHERE rn > n OR (rn = n AND (rcov > tcov OR (n = 1 AND rcov = tcov AND (roff > toff OR (roff = toff AND r < tip))))))""", "SELECT DISTINCT node FROM utg WHERE utg IN (SELECT utg FROM lost)"),
    "bubble_nodes": _q("RECURSIVE " + _unitigs(_LADDER.replace("UNION ALL SELECT n, 0, n + 1, 0, 5, 0, 0 FROM k WHERE n % 20 = 0\n", "")) + """, beyond AS (SELECT utg, n, e, dst, ddir, cov FROM ends_ JOIN halves ON src = node AND sdir = dir WHERE out = 1 AND n <= 40),
 both_ AS (SELECT a.utg, a.n, least((a.dst, a.ddir), (b.dst, b.ddir)) AS f, greatest((a.dst, a.ddir), (b.dst, b.ddir)) AS t, a.cov + b.cov AS cov FROM beyond a JOIN beyond b ON a.utg = b.utg AND a.e = 0 AND b.e = 1 WHERE a.dst <> b.dst),
 lost AS (SELECT utg FROM (SELECT utg, row_number() OVER (PARTITION BY f, t ORDER BY cov DESC, n DESC, utg) AS k FROM both_) WHERE k > 1)""", "SELECT DISTINCT node FROM utg WHERE utg IN (SELECT utg FROM lost)"),
    "neighbourhood": _q("RECURSIVE " + _LADDER + _HALVES + ", near AS (SELECT p_partkey * 4 AS node, 0 AS hop FROM part WHERE p_partkey % 50 = 0 UNION SELECT dst, hop + 1 FROM near JOIN halves ON src = node WHERE hop < 4)", "SELECT node, min(hop) AS hop FROM near GROUP BY node"),
    "rescue_mercy": _q(_pairs(8, _LAYERED) + f""", edges AS (SELECT node1, dir1, node2, dir2, CAST(count(*) AS INT) AS cov, {_MEDIAN} AS off, CASE WHEN max(adjacent) = 1 AND count(*) >= 9 THEN 0 ELSE 2 END AS closed FROM pairs GROUP BY ALL)""" + _HALVES + """,
 seen AS (SELECT rid, p.node, lead(p.node) OVER w AS nxt, CASE WHEN dir = 0 THEN coalesce(fwd, 0) ELSE coalesce(bwd, 0) END AS ahead, dir, lead(dir) OVER w AS ndir, lead(CASE WHEN dir = 0 THEN coalesce(bwd, 0) ELSE coalesce(fwd, 0) END) OVER w AS behind FROM placed p LEFT JOIN degrees USING (node) WINDOW w AS (PARTITION BY rid ORDER BY beg, "end", node, dir)),
 hit AS (SELECT DISTINCT least(node, nxt) AS node1, CASE WHEN node < nxt THEN dir ELSE 1 - ndir END AS dir1, greatest(node, nxt) AS node2, CASE WHEN node < nxt THEN ndir ELSE 1 - dir END AS dir2 FROM seen WHERE nxt IS NOT NULL AND nxt <> node AND ahead = 0 AND behind = 0)""", "SELECT node1, dir1, node2, dir2, cov, off, CASE WHEN closed <= 2 AND (node1, dir1, node2, dir2) IN (SELECT (node1, dir1, node2, dir2) FROM hit) THEN 0 ELSE closed END AS closed FROM edges"),
    "rescue_high_cov": _q(_LADDER.replace("edges AS", "every AS") + """, chosen AS (SELECT * FROM every WHERE node2 % 4 = 0), edges AS (SELECT * FROM chosen UNION ALL SELECT node1, dir1, node1 + 8, dir2, 12, off, 1 FROM chosen WHERE node1 % 12 = 0)""" + _HALVES + """,
 side AS (SELECT src, sdir, count(*) AS n, any_value(dst) AS d1, any_value(ddir) AS e1, any_value(cov) AS c1 FROM halves GROUP BY ALL),
 hop AS (SELECT a.src, a.sdir, a.d1, a.e1, a.c1, b.d1 AS dst, b.e1 AS ddir FROM side a JOIN side b ON b.src = a.d1 AND b.sdir = a.e1 WHERE a.n = 1 AND a.c1 < 20 AND b.n = 1),
 shut AS (SELECT node1 AS src, dir1 AS sdir, node2 AS dst, dir2 AS ddir, cov FROM edges WHERE closed BETWEEN 1 AND 2 UNION ALL SELECT node2, 1 - dir2, node1, 1 - dir1, cov FROM edges WHERE closed BETWEEN 1 AND 2),
 swap AS (SELECT hop.* FROM hop JOIN shut USING (src, sdir, dst, ddir) WHERE cov > c1),
 opened AS (SELECT least(src, dst) AS a, CASE WHEN src < dst THEN sdir ELSE 1 - ddir END AS b, greatest(src, dst) AS c, CASE WHEN src < dst THEN ddir ELSE 1 - sdir END AS d FROM swap),
 cut AS (SELECT least(src, d1) AS a, CASE WHEN src < d1 THEN sdir ELSE 1 - e1 END AS b, greatest(src, d1) AS c, CASE WHEN src < d1 THEN e1 ELSE 1 - sdir END AS d FROM swap)""", "SELECT node1, dir1, node2, dir2, cov, off, CASE WHEN (node1, dir1, node2, dir2) IN (SELECT (a, b, c, d) FROM opened) THEN 0 WHEN (node1, dir1, node2, dir2) IN (SELECT (a, b, c, d) FROM cut) THEN 2 ELSE closed END AS closed FROM edges"),
    "isolated_nodes": _q(_LADDER + _HALVES, "SELECT p_partkey * 4 + 1 AS node FROM part WHERE p_size <= 40 AND p_partkey * 4 + 1 NOT IN (SELECT node FROM degrees)"),
    "initial_ends": _q(_LADDER + _HALVES, "SELECT node FROM degrees WHERE fwd = 0 OR bwd = 0"),
    "rarest_seeds": _q(_POSTED, "SELECT kmer, ridx, bin, dir, off FROM (SELECT p.*, row_number() OVER (PARTITION BY ridx, bin ORDER BY tot, kmer, off) AS k FROM posted p JOIN solid USING (kmer)) WHERE k <= 3"),
    "chimera_cuts": _q(_SIDES + """, spur AS (SELECT rid, beg AS pos FROM ends_ WHERE beg > 30 AND l > 30 UNION ALL SELECT rid, "end" FROM ends_ WHERE "end" + 30 < len AND r > 30), at_ AS (SELECT rid, pos, count(*) AS spurs FROM spur GROUP BY ALL),
 deep AS (SELECT a.rid, pos, spurs, count(s.rid) AS depth FROM at_ a LEFT JOIN ends_ s ON s.rid = a.rid AND s.beg < pos AND s."end" > pos GROUP BY a.rid, pos, spurs)""", "SELECT rid, pos, spurs, depth FROM deep WHERE spurs > 2 * depth"),
    "tile_regions": _q(_ALIGNED + """, o AS (SELECT *, row_number() OVER () AS oid, CASE WHEN qdir = 0 THEN qb ELSE qlen - qe END AS qs, CASE WHEN qdir = 0 THEN qlen - qe ELSE qb END AS qr FROM aligned),
 m AS (SELECT *, (qs > 1 AND tb > 1) OR (qr > 1 AND tlen - te > 1) AS mask FROM o),
 st AS (SELECT *, substr(ops, k, 1) AS op FROM (SELECT *, unnest(range(1, length(ops) + 1)) AS k FROM m)),
 path AS (SELECT oid, qidx, tidx, qdir, qlen, mask, qs + greatest(sum(CASE WHEN lower(op) IN ('m', 'i') THEN 1 ELSE 0 END) OVER w - 1, 0) AS x, tb + greatest(sum(CASE WHEN lower(op) IN ('m', 'd') THEN 1 ELSE 0 END) OVER w - 1, 0) AS y, CASE WHEN op IN ('M', 'I', 'D') THEN 1 ELSE 0 END AS hit FROM st WINDOW w AS (PARTITION BY oid ORDER BY k)),
 ont AS (SELECT oid, qidx AS anchor, (CASE WHEN qdir = 0 THEN x ELSE qlen - 1 - x END) // NNN AS tile, tidx AS rid, qdir AS dir, min(y) AS beg, max(y) + 1 AS "end", mask, sum(hit) AS mat, count(DISTINCT x) AS w FROM path GROUP BY ALL),
 onq AS (SELECT oid, tidx AS anchor, y // NNN AS tile, qidx AS rid, qdir AS dir, CASE WHEN qdir = 1 THEN any_value(qlen) - max(x) - 1 ELSE min(x) END AS beg, CASE WHEN qdir = 1 THEN any_value(qlen) - min(x) ELSE max(x) + 1 END AS "end", mask, sum(hit) AS mat, count(DISTINCT y) AS w FROM path GROUP BY oid, tidx, y // NNN, qidx, qdir, mask)""", 'SELECT anchor, CAST(tile AS INT) AS tile, rid, dir, CAST(beg AS INT) AS beg, CAST("end" AS INT) AS "end", CAST(mask OR NOT ("end" - beg BETWEEN NNN - 1 AND NNN + 1) AS INT) AS closed FROM (SELECT * FROM ont UNION ALL SELECT * FROM onq) WHERE w = NNN AND mat >= MMM'),
    "node_ranks": "WITH n AS (SELECT l_partkey % 500 AS anchor, CAST(l_linenumber AS INT) AS tile, count(*) AS nreg FROM lineitem GROUP BY ALL) SELECT anchor, tile, nreg, row_number() OVER (ORDER BY (SELECT max(nreg) FROM n) + 1 - nreg, anchor, tile) - 1 AS rank FROM n",
    "cigar_spans": _q(_ALIGNED, "SELECT qidx, tidx, qdir, qb, tb, CAST(a + b + c + e AS INT) AS query, CAST(a + c + d + e AS INT) AS target, CAST(a + c + e AS INT) AS aligned FROM aligned"),
    "kmer_codes": _q(_SEQ, "SELECT ridx, substr(seq, 1, 20) AS kmer, CAST(len(list_filter(range(1, least(length(seq), 40) + 1), lambda i: substr(seq, i, 1) <> substr(reverse(substr(seq, 1, 40)), i, 1))) AS INT) AS differ, CAST(length(seq) - length(replace(seq, 'A', '')) AS INT) AS n_a, regexp_replace(substr(seq, 1, 60), 'A+', 'A', 'g') AS squeezed FROM reads WHERE length(seq) >= 20"),
    "fasta_round_trip": _q(_SEQ, "SELECT tag, seq FROM reads WHERE seq <> ''"),
    "fastq_round_trip": _q(_SEQ, "SELECT tag, '' AS dsc, seq, repeat('@', length(seq)) AS qlt FROM reads WHERE seq <> ''"),
    "overlaps_round_trip": _q(_ALIGNED, "SELECT qidx, qdir, qlen, qb, qe, tidx, tlen, tb, te, mat, aln, cnt, gap, cigar FROM aligned"),
    "nodes_round_trip": _q(_NODES, """SELECT node, CAST(node % 5 = 0 AS INT) AS node_closed, 'o_' || rid AS tag, dir, beg, "end", CAST(closed AS INT) AS closed FROM regs"""),
    "read_table": _q(_NODES + """, t AS (SELECT rid, beg, node, 'N' || node || CASE WHEN closed THEN '*' ELSE '' END || CASE WHEN dir = 1 THEN ':R_' ELSE ':F_' END || beg || '_' || ("end" - beg) AS t FROM regs)""", "SELECT 'o_' || rid || chr(9) || 3200 || chr(9) || count(*) || chr(9) || string_agg(t, chr(9) ORDER BY beg, node, t) AS value FROM t GROUP BY rid"),
    "dot_round_trip": _q(_EDGES, "SELECT node1 AS src, dir1 AS sdir, node2 AS dst, dir2 AS ddir, cov, off FROM edges UNION ALL SELECT node2, 1 - dir2, node1, 1 - dir1, cov, off FROM edges"),
    "fragment_table": _q("RECURSIVE " + _unitigs(_LADDER), "SELECT 'F' || utg || chr(9) || count(*) || chr(9) || (max(step) * 4 + 4) * 64 || chr(9) || string_agg('N' || node || CASE WHEN dir = 1 THEN ':-:' ELSE ':+:' END || step * 4 * 64, chr(9) ORDER BY step) AS value FROM utg GROUP BY utg"),
    "gfa_table": _q(_LADDER + _HALVES, "SELECT 'H' || chr(9) || 'VN:Z:1.0' AS value UNION ALL SELECT 'S' || chr(9) || 'N' || node || chr(9) || '*' || chr(9) || 'LN:i:4' FROM degrees UNION ALL SELECT 'L' || chr(9) || 'N' || node1 || chr(9) || '+' || chr(9) || 'N' || node2 || chr(9) || '+' || chr(9) || '0M' || chr(9) || 'RC:i:' || cov FROM edges"),
    "sam_trusted": _q(_SAM, "SELECT rname, pos, qname, mapq FROM good"),
    "sam_windows": _q(_SAM + """, runs AS (SELECT *, repeat('ACGTTGCA', 5) AS seq, unnest([{'q': s, 't': 0, 'n': a}, {'q': s + a, 't': a, 'n': -2}, {'q': s + a + 2, 't': a, 'n': 3}, {'q': s + a + 5, 't': a + 7, 'n': b}]) AS r FROM good),
 letters AS (SELECT rname, qname, pos - 1 AS start, a + 7 + b AS reach, r.q + i AS q, pos - 1 + r.t + CASE WHEN r.n > 0 THEN i ELSE 0 END AS t, substr(seq, r.q + i + 1, 1) AS letter FROM (SELECT *, unnest(range(abs(r.n))) AS i FROM runs)),
 placed AS (SELECT *, unnest(range(greatest(0, CAST(floor((t - 30) / 20.0) AS BIGINT) + 1), t // 20 + 1)) AS win FROM letters),
 joined AS (SELECT rname, win, qname, greatest(start, win * 20) AS beg, least(start + reach, win * 20 + 30) - greatest(start, win * 20) AS len, reach, string_agg(letter, '' ORDER BY q) AS seq FROM placed GROUP BY rname, win, qname, start, reach)""", 'SELECT rname, CAST(win AS INT) AS "window", qname, CAST(beg AS INT) AS beg, CAST(len AS INT) AS len, seq FROM joined WHERE len * 2 >= least(reach, 30)'),
    "node_depths": "SELECT l_partkey % 100 AS node, count(*) AS nreg, CAST(count(*) < 2 OR count(*) > 200 AS INT) AS closed FROM lineitem GROUP BY 1",
    "median_depth": "WITH d AS (SELECT count(*) AS nreg FROM lineitem GROUP BY l_partkey % 100) SELECT min(nreg) AS median FROM (SELECT nreg, count(*) OVER (ORDER BY nreg) AS upto, count(*) OVER () AS total FROM d) WHERE upto * 2 >= total",
    "best_order": "SELECT o_custkey, o_orderkey, price FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "shared_seed_pairs": _q(_CELLS, "SELECT qidx, tidx, strand, sum(kcnt) AS seeds, count(*) AS bins, sum(kmat) AS letters FROM cells GROUP BY ALL ORDER BY letters DESC, seeds DESC, qidx, tidx, strand LIMIT 20"),
    "seq_projection": _q(_SEQ, "SELECT ridx, CAST(length(seq) AS INT) AS len, seq FROM reads"),
    "reverse_reads": _q(_SEQ, "SELECT ridx, 'S' || lpad(CAST(ridx AS VARCHAR), 10, '0') AS tag, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads"),
    "bins": _q(_BINS, "SELECT * FROM bins"),
    "trimmed_to_bins": _q(_SEQ, "SELECT ridx, CAST(length(seq) // 64 AS INT) AS bincnt, CAST(length(seq) // 64 * 64 AS INT) AS len FROM reads"),
    "named_only": _q(_SEQ, "SELECT ridx, tag FROM reads WHERE tag NOT IN (SELECT tag FROM reads WHERE ridx IN (SELECT doc_id FROM labels))"),
    "longest_subread": _q(_SEQ, "SELECT ridx, tag, len FROM (SELECT ridx, tag, CAST(length(seq) AS INT) AS len, row_number() OVER (PARTITION BY regexp_replace(tag, '/[0-9]+_[0-9]+$', '') ORDER BY length(seq) DESC, ridx) AS k FROM reads) WHERE k = 1 AND len >= 100"),
    "split_long": _q(_SEQ, "SELECT ridx, CASE WHEN part > 0 THEN tag || '_V' || part ELSE tag END AS tag, CAST(length(substr(seq, part * 5000 + 1, 5000)) AS INT) AS len FROM (SELECT *, unnest(range(greatest((length(seq) + 4999) // 5000, 1))) AS part FROM reads)"),
    "first_bases": _q(_SEQ, "SELECT ridx FROM (SELECT ridx, sum(length(seq)) OVER (ORDER BY ridx) - length(seq) AS before FROM reads) WHERE before < 1000000"),
    "coverage_cap": _q(_SEQ, "SELECT ridx FROM (SELECT ridx, sum(length(seq)) OVER (ORDER BY length(seq) DESC, ridx ROWS UNBOUNDED PRECEDING) AS upto FROM reads) WHERE upto < 1000000"),
    "median_band": _q(_SEQ, "SELECT ridx FROM (SELECT ridx, sum(length(seq)) OVER (ORDER BY away RANGE UNBOUNDED PRECEDING) AS upto FROM (SELECT ridx, seq, abs(row_number() OVER (ORDER BY length(seq) DESC, ridx) - 1 - count(*) OVER () // 2) AS away FROM reads)) WHERE upto <= 1000000"),
    "by_length": _q(_SEQ, "SELECT ridx, row_number() OVER (ORDER BY length(seq) DESC, ridx) - 1 AS rank FROM reads"),
    "canonical_kmers": _q(_KMERS, "SELECT * FROM seeds"),
    "hpc_kmers": _q(_HPC, "SELECT * FROM seeds"),
    "kmer_count": _q(_COUNTS, "SELECT * FROM counts"),
    "kmer_depth_hist": _q(_HIST, "SELECT * FROM hist"),
    "kmer_filter_threshold": _q(_LIMIT, "SELECT * FROM lim"),
    "seed_postings": _q(_POSTED, "SELECT kmer, ridx, bin, dir, off FROM posted"),
    "bin_degree": _q(_POSTED, "SELECT ridx, bin, count(*) AS degree FROM posted GROUP BY ridx, bin"),
    "seeds_in_index": _q(_SOLID, "SELECT ridx, count(*) AS n_seeds, count(tot) AS n_found FROM seeds LEFT JOIN solid USING (kmer) GROUP BY ridx"),
    "cell_matches": _q(_CELLS, "SELECT * FROM cells"),
    "seed_islands": _q(_ISLANDS, "SELECT qidx, tidx, strand, run, count(*) AS n, min(tbin) AS first_bin, max(tbin) AS last_bin FROM numbered GROUP BY ALL HAVING sum(CASE WHEN new = 1 THEN 15 ELSE step END) >= 30 AND max(tbin) - min(tbin) + 1 >= 2"),
    "best_per_pair": _q(_OVL, "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY qidx, tidx ORDER BY aln DESC, mat DESC, qdir, qb, tb) AS k FROM ovl) WHERE k = 1"),
    "bestn_per_read": _q(_OVL, "SELECT * FROM ovl WHERE (qidx, tidx, qdir, qb, tb) IN (SELECT (qidx, tidx, qdir, qb, tb) FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY mat DESC, qidx, tidx, qdir, qb, tb) AS k FROM (SELECT *, qidx AS rid FROM ovl UNION ALL SELECT *, tidx FROM ovl)) WHERE k <= 5)"),
    "most_hits": _q(_OVL, "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY mat DESC, tidx, qdir, qb, tb) AS k FROM ovl) WHERE k <= 10"),
    "acceptable_overlaps": _q(_OVL, "SELECT * FROM ovl WHERE mat >= 30 AND mat >= floor(aln * 64 * 0.05) AND gap <= floor(aln * 0.6) AND aln >= 2 AND abs((qe - qb) - (te - tb)) <= floor(greatest(aln * 0.25, 1))"),
    "dovetail_overlaps": _q(_OVL, "SELECT * EXCLUDE (l, r) FROM (SELECT *, CASE WHEN qdir = 0 THEN qb ELSE qlen - qe END AS l, CASE WHEN qdir = 0 THEN qlen - qe ELSE qb END AS r FROM ovl) WHERE NOT ((l > 4 AND tb > 4) OR (r > 4 AND tlen - te > 4))"),
    "contained_reads": _q(_OVL, "SELECT DISTINCT rid FROM (SELECT qidx AS rid FROM ovl WHERE qb <= 30 AND qe + 30 >= qlen AND (qlen < tlen OR (qlen = tlen AND qidx > tidx)) UNION ALL SELECT tidx FROM ovl WHERE tb <= 30 AND te + 30 >= tlen AND NOT (qlen < tlen OR (qlen = tlen AND qidx > tidx)))"),
    "flipped_overlaps": _q(_OVL, "SELECT tidx AS qidx, qdir, tlen AS qlen, tb AS qb, te AS qe, qidx AS tidx, qlen AS tlen, qb AS tb, qe AS te, mat, aln, cnt, gap, cigar FROM ovl"),
    "read_clips": _q(_SIDES + ', good AS (SELECT rid, beg, "end" FROM ends_ WHERE NOT (beg > 4 AND l > 4 AND "end" + 4 < len AND r > 4)), ' + _depth("good") + """, best AS (SELECT rid, beg, "end", row_number() OVER (PARTITION BY rid ORDER BY "end" - beg DESC, beg) AS k FROM stretches),
 whole AS (SELECT rid, bool_or(beg <= 4 AND "end" + 4 >= len) AS w, any_value(len) AS len FROM ends_ GROUP BY rid)""", 'SELECT rid, CAST(CASE WHEN w THEN 0 ELSE coalesce(beg, 0) END AS INT) AS clp_beg, CAST(CASE WHEN w THEN len ELSE coalesce("end", 0) END AS INT) AS clp_end FROM whole LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (rid)'),
    "depth_sweep": _q('spans AS (SELECT user_id AS rid, CAST(floor(epoch(ts) / 60) AS BIGINT) AS beg, CAST(floor(epoch(ts) / 60) AS BIGINT) + 1 + event_id % 2000 AS "end" FROM events), ' + _depth("spans"), "SELECT * FROM stretches"),
    "band_pairs": _q(_pairs(8), "SELECT node1, dir1, node2, dir2, off, adjacent, count(*) AS n FROM pairs GROUP BY ALL"),
    "edge_agg": _q(_EDGES, "SELECT * FROM edges"),
    "degree_masks": _q(_DEGREES, "SELECT node, fwd, bwd, CAST(fwd > 1 OR bwd > 1 AS INT) AS branching, CAST((fwd = 0 AND bwd > 1) OR (bwd = 0 AND fwd > 1) AS INT) AS blunt FROM degrees"),
    "cut_binary": _q(_EDGES + ", twice AS (SELECT src, dst FROM halves GROUP BY src, dst HAVING count(DISTINCT sdir) = 2)", "SELECT node1, dir1, node2, dir2, cov, off, CASE WHEN closed = 0 AND ((node1, node2) IN (SELECT (src, dst) FROM twice) OR (node2, node1) IN (SELECT (src, dst) FROM twice)) THEN 3 ELSE closed END AS closed FROM edges"),
    "two_hop_transitive": _q(_EDGES + """, side AS (SELECT src, sdir, longest, greatest(1, CAST(floor(longest * 0.2) AS INT)) AS fuzz FROM (SELECT src, sdir, max(off + 4) AS longest FROM halves GROUP BY ALL)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY src, sdir ORDER BY off, cov DESC, dst, ddir) AS k FROM halves),
 near AS (SELECT DISTINCT a.src, a.sdir, b.dst FROM halves a JOIN ranked b ON b.src = a.dst AND b.sdir = a.ddir JOIN side s ON s.src = a.src AND s.sdir = a.sdir WHERE a.off + b.off + 4 <= longest + fuzz OR b.off <= fuzz OR b.k = 1),
 flagged AS (SELECT h.* FROM halves h JOIN near USING (src, sdir, dst))""", "SELECT node1, dir1, node2, dir2 FROM (SELECT least(src, dst) AS node1, CASE WHEN src < dst THEN sdir ELSE 1 - ddir END AS dir1, greatest(src, dst) AS node2, CASE WHEN src < dst THEN ddir ELSE 1 - sdir END AS dir2 FROM flagged) GROUP BY ALL HAVING count(*) = 2"),
    "link_agg": _q(_pairs(20), f"SELECT node1, dir1, node2, dir2, CAST(count(*) AS INT) AS cov, {_MEDIAN} AS off, CAST(count(*) < 4 AS INT) AS weak, 0 AS closed FROM pairs GROUP BY ALL"),
    "tandem_repeats": _q(_EDGES, "SELECT node FROM (SELECT node, count(*) AS nreg FROM regs GROUP BY node) JOIN (SELECT node, max(cov) AS best FROM (SELECT node1 AS node, cov FROM edges UNION ALL SELECT node2, cov FROM edges) GROUP BY node) USING (node) WHERE nreg >= 10 AND best < nreg * 0.02"),
    "linear_paths": "WITH s AS (SELECT DISTINCT conv_id * 1000 + turn AS state FROM conversations), k AS (SELECT state, state - row_number() OVER (ORDER BY state) AS run FROM s) SELECT min(state) OVER (PARTITION BY run) AS head, state, state - min(state) OVER (PARTITION BY run) AS step FROM k",
    "column_votes": _q(_SEQ + ", each_ AS (SELECT source AS block, CAST(pos AS INT) AS pos, substr(seq, pos + 1, 1) AS base FROM (SELECT source, seq, unnest(range(length(seq))) AS pos FROM reads JOIN documents ON doc_id = ridx)), n AS (SELECT block, pos, base, count(*) AS n FROM each_ GROUP BY ALL)", "SELECT block, pos, base, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY block, pos) AS BIGINT) AS total, row_number() OVER (PARTITION BY block, pos ORDER BY n DESC, base) AS k FROM n) WHERE k = 1 AND n >= 2 AND n >= total * 0.3"),
    "window_blocks": """WITH r AS (SELECT event_type AS name, event_id AS rid, event_id * 7 AS pos, 1 + event_id % 700 AS len FROM events),
 w AS (SELECT *, unnest(range(CAST(greatest(0, floor((pos - 500) / 333.0) + 1) AS BIGINT), (pos + len - 1) // 333 + 1)) AS win FROM r),
 c AS (SELECT *, greatest(pos, win * 333) AS beg, least(pos + len, win * 333 + 500) - greatest(pos, win * 333) AS cut FROM w) SELECT name, win AS "window", rid, beg, cut AS len FROM c WHERE cut * 2 >= least(len, 500)""",
    "n50": _q(_SEQ + ", " + _nx("SELECT length(seq) AS len FROM reads", "[50, 90]"), "SELECT count(*) AS count, sum(len) AS total, avg(len) AS avg, CAST(min(len) AS INT) AS min, CAST(max(len) AS INT) AS max, (SELECT CAST(nx AS INT) FROM nx WHERE x = 50) AS n50, (SELECT lx FROM nx WHERE x = 50) AS l50, (SELECT CAST(nx AS INT) FROM nx WHERE x = 90) AS n90, (SELECT lx FROM nx WHERE x = 90) AS l90 FROM len_"),
    "nx_table": _q(_nx("SELECT CAST(floor(o_totalprice) AS BIGINT) AS len FROM orders", "range(0, 101, 10)"), "SELECT CAST(x AS INT) AS x, nx, lx FROM nx"),
    "sam_filter": "SELECT event_id AS rid, CAST(event_id % 4096 AS INT) AS flag FROM events WHERE (event_id % 4096) & 2308 = 0",
    "benchmark_containment": _q(_KMERS + """, item0 AS (SELECT item_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark),
 item1 AS (SELECT item_id, substr(seq, off * 64 + p + 1, 15) AS fwd FROM (SELECT *, unnest(range(50)) AS p FROM (SELECT item_id, seq, unnest(range(length(seq) // 64)) AS off FROM item0))),
 item2 AS (SELECT DISTINCT item_id, code AS kmer FROM (SELECT item_id, """ + _code("least(fwd, rev)") + """ AS code FROM (SELECT item_id, fwd, reverse(translate(fwd, 'ACGT', 'TGCA')) AS rev FROM item1) WHERE fwd <> rev) WHERE xor(xor(code, code >> 4), code >> 7) % 16384 < 4096),
 doc AS (SELECT DISTINCT ridx AS doc_id, kmer FROM seeds)""", "SELECT item_id, doc_id, n_shared, n_item FROM (SELECT item_id, doc_id, count(*) AS n_shared FROM doc JOIN item2 USING (kmer) GROUP BY ALL) JOIN (SELECT item_id, count(*) AS n_item FROM item2 GROUP BY item_id) USING (item_id) WHERE n_shared * 2 >= n_item"),
}

ORACLE_SQL["clips_round_trip"] = f"WITH c AS ({ORACLE_SQL['read_clips']}) SELECT 'r_' || rid AS tag, 10240 AS len, CAST(clp_beg * 64 AS INT) AS clp_beg, CAST(clp_end * 64 AS INT) AS clp_end FROM c"
ORACLE_SQL["tile_regions"] = ORACLE_SQL["tile_regions"].replace("NNN", str(SMALL_GRAPH.reg_len)).replace("MMM", str(SMALL_GRAPH.min_node_mats))

_CUT = ORACLE_SQL["sam_windows"]
ORACLE_SQL |= {
    "sam_layout": f"""WITH w AS ({_CUT}) SELECT '>' || rname || ' len=' || (max("window") * 20 + 30) AS value FROM w GROUP BY rname
 UNION ALL SELECT DISTINCT 'E' || chr(9) || "window" * 20 || chr(9) || 'N' || "window" || chr(9) || '+' || chr(9) || 'N' || ("window" + 1) || chr(9) || '+' FROM (SELECT DISTINCT rname, "window" FROM w) GROUP BY rname, "window"
 UNION ALL SELECT 'S' || chr(9) || qname || chr(9) || '+' || chr(9) || beg || chr(9) || length(seq) || chr(9) || seq FROM w""".replace("SELECT DISTINCT 'E'", "SELECT 'E'"),
    "layout_round_trip": f"""WITH w AS ({_CUT}) SELECT rname AS ctg, CAST(dense_rank() OVER (PARTITION BY rname ORDER BY "window") - 1 AS INT) AS bidx, CAST("window" * 20 AS INT) AS off, CAST("window" AS BIGINT) AS node1, '+' AS dir1, CAST("window" + 1 AS BIGINT) AS node2, '+' AS dir2,
 qname AS tag, '+' AS rddir, beg AS rdoff, CAST(length(seq) AS INT) AS len, seq FROM w""",
    "index_round_trip": ORACLE_SQL["seed_postings"],
    "named_slices": _q(_SEQ + ", r AS (SELECT tag, seq FROM reads WHERE length(seq) >= 60)", """SELECT tag AS name, seq FROM r UNION ALL SELECT tag || '[+:5,25]', substr(seq, 6, 20) FROM r UNION ALL SELECT tag || '[-:10,40]', reverse(translate(substr(seq, 11, 30), 'ACGT', 'TGCA')) FROM r
 UNION ALL SELECT tag || '_R_3_17', reverse(translate(substr(seq, 4, 17), 'ACGT', 'TGCA')) FROM r UNION ALL SELECT tag || '_F_0_9', substr(seq, 1, 9) FROM r"""),
    "regions_in_clips": _q(_REGIONS, 'SELECT node, rid, dir, beg, "end", CAST(rid % 2 = 0 AND (beg < rid % 13 OR "end" > rid % 13 + 20) AS INT) AS closed FROM regs'),
    "path_offsets": _q("RECURSIVE " + _unitigs(_LADDER.replace("edges AS", "plain AS") + ", edges AS (SELECT * REPLACE (CAST(node1 % 5 AS INT) AS off) FROM plain)") + """, ahead AS (SELECT *, lead(node) OVER w AS n2, lead(dir) OVER w AS d2 FROM utg WINDOW w AS (PARTITION BY utg ORDER BY step)),
 sized2 AS (SELECT a.*, 4 + coalesce(h.off, 0) AS len FROM ahead a LEFT JOIN halves h ON h.src = node AND h.sdir = dir AND h.dst = n2 AND h.ddir = d2)""", "SELECT utg, step, node, dir, CAST(sum(len) OVER (PARTITION BY utg ORDER BY step) - len AS INT) AS pos FROM sized2"),
    "fragments": _q("RECURSIVE " + _unitigs(_LADDER), "SELECT utg, CAST(count(*) AS INT) AS n, CAST(max(step) * 4 + 4 AS INT) AS length FROM utg GROUP BY utg"),
    "reopened_edges": _q(_EDGES, "SELECT node1, dir1, node2, dir2, cov, off, CASE WHEN node1 % 3 = 0 AND closed <= 2 THEN 0 ELSE closed END AS closed FROM edges"),
    "forward_pairs": _q(_HITS, "SELECT qidx, tidx, count(*) AS n, min(poff) AS first FROM hits WHERE strand = 0 GROUP BY ALL"),
    "callback_records": "SELECT p_partkey AS k, p_name AS name FROM part",
}

#: The line items' graph without its transitive edges, whose paths start at the nodes of the whole graph.
_CUT_EDGES = ORACLE_SQL["two_hop_transitive"].removeprefix("WITH ").replace("halves", "halves0").replace("edges AS", "edges0 AS").replace("FROM edges", "FROM edges0")
_CTES, _GONE = _CUT_EDGES.split(" SELECT node1, dir1, node2, dir2 FROM (", 1)
ORACLE_SQL["unitigs"] = _q(
    "RECURSIVE " + _unitigs(_CTES + ", gone AS (SELECT node1, dir1, node2, dir2 FROM (" + _GONE + "), edges AS (SELECT * REPLACE (CASE WHEN (node1, dir1, node2, dir2) IN (SELECT (node1, dir1, node2, dir2) FROM gone) THEN 3 ELSE closed END AS closed) FROM edges0)").replace("SELECT node * 2 AS state FROM degrees UNION ALL SELECT node * 2 + 1 FROM degrees", "SELECT DISTINCT src * 2 AS state FROM halves0 UNION SELECT src * 2 + 1 FROM halves0"),
    "SELECT utg, step, node, dir FROM utg",
)


def _blocks(steps: str) -> str:
    """Steps (s, t, cov) of blocks of 16 nodes, one for each part, both ways."""
    turn = "CAST((({0}) + ({0}) // 16) % 3 = 0 AS INT)"
    state = "(({0}) * 2 + " + turn + ")"
    return f"""k AS (SELECT p_partkey AS p, p_partkey * 16 AS n FROM part),
  up AS (SELECT {state.format('n + a')} AS s, {state.format('n + b')} AS t, (p * 7 + a * 5 + b * 11 + p * b) % 23 + 1 AS cov FROM k, (VALUES {steps}) v(a, b, m) WHERE p % m = 0),
  e AS (SELECT s, t, cov FROM up UNION ALL SELECT xor(t, 1), xor(s, 1), cov FROM up),
  outs AS (SELECT s, count(*) AS n FROM e GROUP BY s), ins AS (SELECT t, count(*) AS n FROM e GROUP BY t)"""


def _regions(starts: str) -> str:
    """Regions (s, x, n, d): what lies between a start and each state that is up to 8 steps away, where nothing else enters or leaves; all their steps (s, x, v, t, cov)."""
    return f"""starts AS ({starts}),
  walk8 AS (SELECT s, s AS v, 0 AS d FROM starts UNION SELECT w.s, e.t, w.d + 1 FROM walk8 w JOIN e ON e.s = w.v WHERE w.d < 8),
  dist AS (SELECT s, v, min(d) AS d FROM walk8 GROUP BY s, v),
  seen AS (SELECT s, v AS x, s AS v FROM dist WHERE v <> s UNION SELECT w.s, w.x, e.t FROM seen w JOIN e ON e.s = w.v JOIN dist i ON i.s = w.s AND i.v = e.t WHERE w.v <> w.x),
  steps AS (SELECT w.s, w.x, w.v, e.t, e.cov FROM seen w JOIN e ON e.s = w.v WHERE w.v <> w.x),
  entered AS (SELECT s, x, t, count(*) AS n FROM steps GROUP BY s, x, t),
  bad AS (SELECT w.s, w.x FROM seen w LEFT JOIN outs o ON o.s = w.v WHERE w.v NOT IN (w.s, w.x) AND o.n IS NULL
    UNION SELECT w.s, w.x FROM seen w JOIN dist i ON i.s = w.s AND i.v = w.v WHERE w.v <> w.x AND i.d = 8
    UNION SELECT c.s, c.x FROM entered c JOIN ins USING (t) WHERE c.n <> ins.n OR c.t = c.s
    UNION SELECT a.s, a.x FROM seen a JOIN seen b ON a.s = b.s AND a.x = b.x AND b.v = xor(a.v, 1)),
  good AS (SELECT w.s, w.x, count(*) AS n, max(i.d) FILTER (WHERE w.v = w.x) AS d FROM seen w JOIN dist i ON i.s = w.s AND i.v = w.v GROUP BY w.s, w.x HAVING bool_or(w.v = w.x)),
  region AS (SELECT g.* FROM good g ANTI JOIN bad b ON g.s = b.s AND g.x = b.x),
  ways AS (SELECT s, x, s AS v, 0 AS n, 0 AS cov, [s] AS way FROM region UNION ALL SELECT w.s, w.x, c.t, w.n + 1, w.cov + c.cov, list_prepend(c.t, w.way) FROM ways w JOIN steps c ON c.s = w.s AND c.x = w.x AND c.v = w.v WHERE w.n < 9)"""


def _kept(best: str) -> str:
    return f"""chosen AS (SELECT s, x, arg_min(way, {best}) AS way FROM ways WHERE v = x GROUP BY s, x)
SELECT c.s AS entrance, c.x AS exit, c.v AS s, c.t AS t, CAST(coalesce(list_position(h.way, c.t) + 1 = list_position(h.way, c.v), FALSE) AS INT) AS kept
FROM steps c JOIN first f ON f.s = c.s AND f.x = c.x JOIN chosen h ON h.s = c.s AND h.x = c.x"""


_BUBBLES = "(0, 1, 1), (0, 2, 1), (1, 4, 1), (1, 5, 1), (4, 6, 1), (5, 6, 1), (6, 7, 1), (2, 7, 1), (7, 16, 1), (0, 3, 3), (3, 7, 3), (2, 9, 5), (12, 4, 7), (6, 1, 11)"
_TANGLES = "(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (3, 5, 1), (4, 6, 1), (5, 7, 1), (6, 8, 1), (7, 8, 1), (8, 16, 1), (6, 5, 2), (7, 4, 2), (4, 7, 3), (6, 9, 5), (10, 5, 7)"
# a way of nine steps goes round a ring, as no region's paths are as long
ORACLE_SQL["superbubbles"] = (
    f"WITH RECURSIVE {_blocks(_BUBBLES)}, {_regions('SELECT s FROM outs WHERE n > 1')}, "
    "whole AS (SELECT * FROM region r WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.s = r.s AND w.x = r.x AND w.n = 9)), "
    "first AS (SELECT s, x FROM whole WHERE x <> xor(s, 1) QUALIFY row_number() OVER (PARTITION BY s ORDER BY n) = 1 AND s <= xor(x, 1)), "
    + _kept("struct_pack(a := -n, b := -cov, c := way)")
)
# an entrance follows a path of four nodes, or one that nothing leads to
ORACLE_SQL["yarns"] = (
    f"WITH RECURSIVE {_blocks(_TANGLES)}, behind AS (SELECT s, s AS v, 1 AS n FROM outs WHERE n > 1 UNION ALL SELECT b.s, e.s, b.n + 1 FROM behind b JOIN ins i ON i.t = b.v AND i.n = 1 JOIN e ON e.t = b.v JOIN outs o ON o.s = e.s AND o.n = 1 WHERE b.n < 4), "
    + _regions("SELECT DISTINCT b.s FROM behind b LEFT JOIN ins i ON i.t = b.v WHERE b.n = 4 OR i.n IS NULL")
    + ", open AS (SELECT r.* FROM region r WHERE r.n >= 4 AND r.d < 8 AND (NOT EXISTS (SELECT 1 FROM outs o WHERE o.s = r.x) OR EXISTS (SELECT 1 FROM e WHERE e.s = r.x AND NOT EXISTS (SELECT 1 FROM seen w WHERE w.s = r.s AND w.x = r.x AND w.v = e.t)))), "
    "first AS (SELECT s, x FROM open QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, x) = 1), "
    + _kept("struct_pack(a := n, b := -cov, c := way)")
)
ORACLE_SQL["detached_repeats"] = (
    f"WITH {_blocks('(0, 8, 1), (3, 9, 2), (2, 10, 4), (1, 9, 3)')}, "
    "across AS (SELECT s, t, cov, s // 32 AS p, CASE WHEN s // 2 % 16 < 2 THEN 1 ELSE 3 END AS l, CASE WHEN t // 2 % 16 < 9 THEN 7 ELSE 9 END AS r FROM up), "
    "pairs AS (SELECT p, l, r, arg_min(s, (-cov, s, t)) AS s, arg_min(t, (-cov, s, t)) AS t FROM across GROUP BY p, l, r), "
    "alone AS (SELECT * FROM pairs QUALIFY count(*) OVER (PARTITION BY p, l) = 1 AND count(*) OVER (PARTITION BY p, r) = 1), "
    "nodes AS (SELECT *, p * 16 + 4 AS head, p * 16 + l AS ln, p * 16 + r AS rn FROM alone) "
    "SELECT head * 2 + CAST((head + p) % 3 = 0 AS INT) AS repeat, ln * 2 + 1 - CAST((ln + p) % 3 = 0 AS INT) AS \"left\", rn * 2 + CAST((rn + p) % 3 = 0 AS INT) AS \"right\", s, t FROM nodes"
)
