"""Readers and writers of the text formats: FASTA, FASTQ, overlaps, clips, nodes, layout, SAM, DOT, GFA.

Readers take paths that Spark can read, compressed files included, and split what can be
split; writers return DataFrames of lines (value string) in order, for df.write.text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"
OVERLAPS = "qtag string, qdir string, qlen int, qb int, qe int, ttag string, tdir string, tlen int, tb int, te int, mat int, aln int, cnt int, gap int, cigar string"


def _tagged(head: F.Column) -> list[F.Column]:
    return [F.regexp_extract(head, r"^([^ \t]*)", 1).alias("tag"), F.regexp_extract(head, r"^[^ \t]*[ \t]?(.*)$", 1).alias("dsc")]


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(tag, dsc, seq): records start with > at a line's start; sequences may span lines. Splits at records."""
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).where("value != ''")
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*(\n|\z)", ""), r"\s", "")
    return raw.select(*_tagged(head), seq.alias("seq"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 in each; files are split as Spark splits them.

    Rows of a block of a file come in order, so their row numbers in the task, less the
    block's first, and the lines of the blocks before give the place in the file.
    """
    raw = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    blocks = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return raw.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("row") - F.col("first")).alias("line"), "value")


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """(tag, dsc, seq, qlt) from records of four lines. A quality line may start with @, so lines are told apart by their numbers in the file."""
    lines = numbered_lines(spark, *paths).select("file", F.floor(F.col("line") / 4).alias("record"), (F.col("line") % 4).alias("k"), F.regexp_replace("value", r"\r$", "").alias("value"))
    four = lines.groupBy("file", "record").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)]).where("l0 like '@%' and l3 is not null")
    return four.select(*_tagged(F.substr("l0", F.lit(2))), F.col("l1").alias("seq"), F.col("l3").alias("qlt"))


def read_overlaps(spark: SparkSession, *paths: str) -> DataFrame:
    """The 15 columns of an overlap file; lines with fewer, and comments, are left out. Lengths and places are in letters."""
    t = spark.read.text(list(paths)).where("value not like '#%'").select(F.split("value", "\t").alias("c")).where("size(c) >= 15")
    names = [x.split() for x in OVERLAPS.split(", ")]
    return t.select(*[F.col("c")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def _names(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qidx, qtag) and (tidx, ttag) of reads(ridx, tag), to be the built side of hash joins: overlaps are many and wide, and aren't sorted for their names."""
    q, t = (reads.select(F.col("ridx").alias(i), F.col("tag").alias(n)).hint("shuffle_hash") for i, n in (("qidx", "qtag"), ("tidx", "ttag")))
    return q, t


def overlaps_by_name(rows: DataFrame, reads: DataFrame, bin_size: int) -> DataFrame:
    """Overlaps between known reads(ridx, tag), the query being the smaller, in bins; without those that have no cigar."""
    q, t = _names(reads)
    found = rows.where("cigar != '*'").join(q, "qtag").join(t, "ttag").where("qidx < tidx")
    bins = [F.floor(F.col(c) / bin_size).cast("int").alias(c) for c in ("qlen", "qb", "qe", "tlen", "tb", "te", "aln")]
    return found.select("qidx", F.when(F.col("qdir") == "-", 1).otherwise(0).alias("qdir"), *bins[:3], "tidx", *bins[3:6], "mat", bins[6], "cnt", "gap", "cigar")


def overlap_lines(overlaps: DataFrame, reads: DataFrame, bin_size: int) -> DataFrame:
    q, t = _names(reads)
    o = overlaps.join(q, "qidx").join(t, "tidx")
    letters = {c: (F.col(c) * bin_size).cast("string") for c in ("qlen", "qb", "qe", "tlen", "tb", "te", "aln")}
    strand = F.when(F.col("qdir") == 1, "-").otherwise("+")
    return o.select(F.concat_ws("\t", "qtag", strand, letters["qlen"], letters["qb"], letters["qe"], "ttag", F.lit("+"), letters["tlen"], letters["tb"], letters["te"], F.col("mat").cast("string"), letters["aln"], F.col("cnt").cast("string"), F.col("gap").cast("string"), "cigar").alias("value"))


def read_clips(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.csv(list(paths), sep="\t", schema="tag string, len int, clp_beg int, clp_end int")


def clip_lines(clips: DataFrame, reads: DataFrame, bin_size: int) -> DataFrame:
    r = reads.select(F.col("ridx").alias("rid"), "tag", (F.col("bincnt") * bin_size).alias("len"))
    return clips.join(r, "rid").select(F.concat_ws("\t", "tag", F.col("len").cast("string"), (F.col("clp_beg") * bin_size).cast("string"), (F.col("clp_end") * bin_size).cast("string")).alias("value"))


def read_nodes(spark: SparkSession, *paths: str) -> DataFrame:
    """(node, node_closed, tag, dir, beg, end, closed), one row for each region; tags may hold underscores."""
    c = spark.read.text(list(paths)).select(F.split("value", "\t").alias("c"))
    name = F.col("c")[0]
    each = c.select(F.regexp_extract(name, "N([0-9]+)", 1).cast("long").alias("node"), name.endswith("*").alias("node_closed"), F.explode(F.slice("c", 3, F.greatest(F.size("c") - 2, F.lit(0)))).alias("r"))
    part = [F.regexp_extract("r", r"^(.*)_([FR])_([0-9]+)_([0-9]+)(\*?)$", k) for k in range(6)]
    return each.select("node", "node_closed", part[1].alias("tag"), F.when(part[2] == "R", 1).otherwise(0).alias("dir"), part[3].cast("int").alias("beg"), (part[3].cast("int") + part[4].cast("int")).alias("end"), (part[5] == "*").alias("closed"))


def node_lines(regions: DataFrame, nodes: DataFrame, reads: DataFrame) -> DataFrame:
    r = regions.join(reads.select(F.col("ridx").alias("rid"), "tag"), "rid").join(nodes.select("node", F.col("closed").alias("nc")), "node")
    star = F.when(F.col("closed"), "*").otherwise("")
    token = F.concat("tag", F.when(F.col("dir") == 1, "_R_").otherwise("_F_"), F.col("beg").cast("string"), F.lit("_"), (F.col("end") - F.col("beg")).cast("string"), star)
    rows = r.groupBy("node", "nc").agg(F.array_sort(F.collect_list(F.struct("rid", "beg", token.alias("t")))).alias("r"))  # regions of a node: at most its depth
    return rows.select(F.concat_ws("\t", F.concat(F.lit("N"), F.col("node").cast("string"), F.when(F.col("nc"), "*").otherwise("")), F.size("r").cast("string"), F.array_join(F.transform("r", lambda x: x["t"]), "\t")).alias("value"))


def read_lines(regions: DataFrame, reads: DataFrame, bin_size: int) -> DataFrame:
    r = regions.join(reads.select(F.col("ridx").alias("rid"), "tag", (F.col("bincnt") * bin_size).alias("len")), "rid")
    token = F.concat(F.lit("N"), F.col("node").cast("string"), F.when(F.col("closed"), "*").otherwise(""), F.when(F.col("dir") == 1, ":R_").otherwise(":F_"), F.col("beg").cast("string"), F.lit("_"), (F.col("end") - F.col("beg")).cast("string"))
    rows = r.groupBy("rid", "tag", "len").agg(F.array_sort(F.collect_list(F.struct("beg", "node", token.alias("t")))).alias("r"))
    return rows.select(F.concat_ws("\t", "tag", F.col("len").cast("string"), F.size("r").cast("string"), F.array_join(F.transform("r", lambda x: x["t"]), "\t")).alias("value"))


def fragment_lines(placed: DataFrame, reg_len: int, bin_size: int) -> DataFrame:
    """A line for each fragment: its name, nodes, letters, and the nodes with their directions and places; placed(utg, step, node, dir, pos)."""
    token = F.concat(F.lit("N"), F.col("node").cast("string"), F.when(F.col("dir") == 1, ":-:").otherwise(":+:"), (F.col("pos") * bin_size).cast("string"))
    rows = placed.groupBy("utg").agg(F.array_sort(F.collect_list(F.struct("step", token.alias("t")))).alias("r"), F.max("pos").alias("last"))
    return rows.select(F.concat_ws("\t", F.concat(F.lit("F"), F.col("utg").cast("string")), F.size("r").cast("string"), ((F.col("last") + reg_len) * bin_size).cast("string"), F.array_join(F.transform("r", lambda x: x["t"]), "\t")).alias("value"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A directed graph: node lines, then an edge line for each direction, labelled with strands, coverage and offset."""
    from strandlake.operators.graph import half_edges

    sign = lambda c: F.when(F.col(c) == 1, "-").otherwise("+")
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    n = nodes.select(F.lit(1).alias("k"), F.concat(name("node"), F.lit(' [label="'), name("node"), F.lit('"]')).alias("value"))
    h = half_edges(edges, 3)
    style = F.when(F.col("closed") > 0, " style=dashed").otherwise("")
    e = h.select(F.lit(2).alias("k"), F.concat(name("src"), F.lit(" -> "), name("dst"), F.lit(' [label="'), sign("sdir"), sign("ddir"), F.lit(":"), F.col("cov").cast("string"), F.lit(":"), F.col("off").cast("string"), F.lit('"'), style, F.lit("]")).alias("value"))
    s = nodes.sparkSession
    ends = s.sql("select 0 as k, 'digraph {' as value union all select 3, '}'")
    return ends.unionByName(n).unionByName(e).orderBy("k", "value").select("value")


def read_dot(spark: SparkSession, *paths: str) -> DataFrame:
    """(src, sdir, dst, ddir, cov, off) of the edge lines of a graph file."""
    pattern = r'^\s*N([0-9]+) -> N([0-9]+) \[label="([+-])([+-]):([0-9]+):(-?[0-9]+)"'
    g = [F.regexp_extract("value", pattern, k) for k in range(7)]
    return spark.read.text(list(paths)).where(F.col("value").rlike(pattern)).select(g[1].cast("long").alias("src"), (g[3] == "-").cast("int").alias("sdir"), g[2].cast("long").alias("dst"), (g[4] == "-").cast("int").alias("ddir"), g[5].cast("int").alias("cov"), g[6].cast("int").alias("off"))


def gfa_lines(nodes: DataFrame, edges: DataFrame, reg_len: int) -> DataFrame:
    sign = lambda c: F.when(F.col(c) == 1, "-").otherwise("+")
    s = nodes.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("S"), F.concat(F.lit("N"), F.col("node").cast("string")), F.lit("*"), F.lit(f"LN:i:{reg_len}")).alias("value"))
    e = edges.where("closed = 0").select(F.lit(2).alias("k"), F.concat_ws("\t", F.lit("L"), F.concat(F.lit("N"), F.col("node1").cast("string")), sign("dir1"), F.concat(F.lit("N"), F.col("node2").cast("string")), sign("dir2"), F.lit("0M"), F.concat(F.lit("RC:i:"), F.col("cov").cast("string"))).alias("value"))
    return nodes.sparkSession.sql("select 0 as k, 'H\tVN:Z:1.0' as value").unionByName(s).unionByName(e).orderBy("k", "value").select("value")


def layout_lines(stacked: DataFrame, sizes: DataFrame, tags: DataFrame) -> DataFrame:
    """Layout text: > contig, E edge, S read lines. sizes(ctg, nodes, len); tags(ridx, tag)."""
    sign = lambda c: F.when(F.col(c) == 1, "-").otherwise("+")
    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    top = sizes.select("ctg", F.lit(-1).alias("edge"), F.lit(0).alias("ord"), F.concat(F.lit(">ctg"), F.col("ctg").cast("string"), F.lit(" nodes="), F.col("nodes").cast("string"), F.lit(" len="), F.col("len").cast("string")).alias("value"))
    e = stacked.select("ctg", "edge", F.lit(0).alias("ord"), F.concat_ws("\t", F.lit("E"), F.col("off").cast("string"), name("node1"), sign("dir1"), name("node2"), sign("dir2")).alias("value")).distinct()
    s = stacked.join(tags.select(F.col("ridx").alias("rid"), "tag"), "rid").select("ctg", "edge", "ord", F.concat_ws("\t", F.lit("S"), "tag", sign("rdir"), F.col("rbeg").cast("string"), F.col("rlen").cast("string"), "seq").alias("value"))
    return top.unionByName(e).unionByName(s).orderBy("ctg", "edge", "ord").select("value")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(ctg, bidx, off, node1, dir1, node2, dir2, tag, rddir, rdoff, len, seq, rbeg, rend) from layout text.

    Splits at contigs; edges and reads take what stands above them by their place in the contig.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where("value != ''")
    lines = raw.select(F.regexp_extract("value", r"^>?([^ \t\n]*)", 1).alias("ctg"), F.posexplode(F.split("value", "\n")).alias("line", "text")).where("line > 0 and text != ''").select("ctg", "line", F.split("text", "\t").alias("c"))
    w = Window.partitionBy("ctg").orderBy("line")
    e = F.when(F.col("c")[0] == "E", F.col("c"))
    placed = lines.withColumn("e", F.last(e, True).over(w)).withColumn("bidx", F.count(e).over(w).cast("int") - 1).where("c[0] in ('S', 's')")
    node = lambda k: F.regexp_extract(F.col("e")[k], "([0-9]+)", 1).cast("long")
    return placed.select("ctg", "bidx", F.col("e")[1].cast("int").alias("off"), node(2).alias("node1"), F.col("e")[3].alias("dir1"), node(4).alias("node2"), F.col("e")[5].alias("dir2"), F.col("c")[1].alias("tag"), F.col("c")[2].alias("rddir"), F.col("c")[3].cast("int").alias("rdoff"), F.col("c")[4].cast("int").alias("len"), F.col("c")[5].alias("seq"), F.get(F.col("c"), F.lit(6)).cast("int").alias("rbeg"), F.get(F.col("c"), F.lit(7)).cast("int").alias("rend"))


def read_sam(spark: SparkSession, *paths: str, secondary: bool = False) -> DataFrame:
    """Mapped records with a cigar; with secondary also secondary and supplementary ones."""
    c = spark.read.text(list(paths)).where("value not like '@%'").select(F.split("value", "\t").alias("c")).where("size(c) >= 11")
    names = [x.split() for x in SAM.split(", ")]
    return mapped(c.select(*[F.col("c")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)]), secondary)


def mapped(sam: DataFrame, secondary: bool = False) -> DataFrame:
    off = 0x4 if secondary else 0x4 | 0x100 | 0x800
    return sam.where((F.col("flag").bitwiseAND(off) == 0) & (F.col("cigar") != "*") & (F.col("rname") != "*"))


def trusted(sam: DataFrame, min_mapq: int) -> DataFrame:
    """Records of sam(rname, pos, seq, qname, mapq, ...) with a mapping quality of min_mapq at least, one of those with equal places and sequences: the best mapped, of equals the first by name."""
    good = sam.where(F.col("mapq") >= min_mapq)
    rest = [c for c in sam.columns if c not in ("rname", "pos", "seq")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("mapq"))) if "qname" not in rest else F.min_by(F.struct(*rest), F.struct(-F.col("mapq"), "qname"))
    return good.groupBy("rname", "pos", "seq").agg(best.alias("r")).select(*[F.col(c) if c in ("rname", "pos", "seq") else F.col("r")[c].alias(c) for c in sam.columns])


def sam_layout_lines(windows: DataFrame, size: int, step: int) -> DataFrame:
    """Windows over aligned reads (rname, window, qname, beg, len, seq) as layout text: a contig for each reference, an edge for each window."""
    top = windows.groupBy("rname").agg(F.max("window").alias("last")).select("rname", F.lit(-1).alias("window"), F.lit(0).alias("k"), F.lit(0).alias("beg"), F.lit("").alias("qname"), F.concat(F.lit(">"), "rname", F.lit(" len="), (F.col("last") * step + size).cast("string")).alias("value"))
    name = lambda n: F.concat(F.lit("N"), n.cast("string"))
    e = windows.select("rname", "window").distinct().select("rname", "window", F.lit(1).alias("k"), F.lit(0).alias("beg"), F.lit("").alias("qname"), F.concat_ws("\t", F.lit("E"), (F.col("window") * step).cast("string"), name(F.col("window")), F.lit("+"), name(F.col("window") + 1), F.lit("+")).alias("value"))
    s = windows.select("rname", "window", F.lit(2).alias("k"), "beg", "qname", F.concat_ws("\t", F.lit("S"), "qname", F.lit("+"), F.col("beg").cast("string"), F.length("seq").cast("string"), "seq").alias("value"))
    return top.unionByName(e).unionByName(s).orderBy("rname", "window", "k", "beg", "qname").select("value")


def fasta_lines(seqs: DataFrame, width: int = 100) -> DataFrame:
    """Records of seqs(tag, seq) as FASTA text, `width` letters a line."""
    return seqs.select(F.concat(F.lit(">"), "tag", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def fastq_lines(seqs: DataFrame, quality: str = "I") -> DataFrame:
    """Records as FASTQ; without a column qlt each letter has the given quality."""
    q = F.coalesce("qlt", F.repeat(F.lit(quality), F.length("seq"))) if "qlt" in seqs.columns else F.expr(f"repeat('{quality}', length(seq))")
    return seqs.select(F.concat(F.lit("@"), "tag", F.lit("\n"), "seq", F.lit("\n+\n"), q).alias("value"))


def edge_map_lines(pieces: DataFrame) -> DataFrame:
    """Where each edge's consensus lies in its contig: pieces(ctg, ctg_off, edge, full_len, off, len)."""
    return pieces.orderBy("ctg", "ctg_off").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("ctg", "ctg_off", "edge", "full_len", "off", "len")]).alias("value"))


def save_index(posted: DataFrame, table: str, buckets: int, **params: object) -> None:
    """The index as a bucketed table, its parameters kept as table properties; joins on the seed then need no shuffle of it."""
    posted.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(table)
    posted.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({', '.join(f"'seed.{k}' = '{v}'" for k, v in params.items())})")


def load_index(spark: SparkSession, table: str, **params: object) -> DataFrame:
    """The index, if it was built with the same parameters."""
    kept = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    wrong = [k for k, v in params.items() if kept.get(f"seed.{k}") != str(v)]
    if wrong:
        raise ValueError(f"the index has other parameters: {', '.join(wrong)}")
    return spark.table(table)


def sequences_by_name(wanted: DataFrame, seqs: DataFrame) -> DataFrame:
    """(name, seq) of wanted(name) in seqs(tag, seq): `tag`, `tag[+:b,e]` or `tag[-:b,e]` for a slice, `tag_F_b_len` or `tag_R_b_len` for a region; - and R give the reverse complement. A name that is a whole tag is that."""
    from strandlake.functions.sequence import reverse_complement

    slice_, region = r"^(.*)\[([+-]):([0-9]+),([0-9]+)\]$", r"^(.*)_([FR])_([0-9]+)_([0-9]+)$"
    g = lambda p, k: F.regexp_extract("name", p, k)
    by_slice, by_region = F.col("name").rlike(slice_), F.col("name").rlike(region)
    parsed = wanted.select("name").distinct().join(seqs.select(F.col("tag").alias("name"), F.lit(True).alias("whole")), "name", "left")
    plain = F.coalesce("whole", F.lit(False)) | ~(by_slice | by_region)
    parsed = parsed.select("name", F.when(plain, F.col("name")).when(by_slice, g(slice_, 1)).otherwise(g(region, 1)).alias("tag"), (~plain).alias("part"), F.when(by_slice, g(slice_, 2) == "-").otherwise(g(region, 2) == "R").alias("back"), F.when(by_slice, g(slice_, 3)).otherwise(g(region, 3)).try_cast("int").alias("b"), F.when(by_slice, g(slice_, 4).try_cast("int") - g(slice_, 3).try_cast("int")).otherwise(g(region, 4).try_cast("int")).alias("n"))
    cut = F.when(F.col("part"), F.substr("seq", F.col("b") + 1, F.col("n"))).otherwise(F.col("seq"))
    return parsed.join(seqs.select("tag", "seq"), "tag").select("name", F.when(F.col("part") & F.col("back"), reverse_complement(cut)).otherwise(cut).alias("seq"))
