"""Command line: python -m strandlake (map | assemble | polish) reads.fa ... -o folder.

map finds overlaps, assemble goes on to contigs and their consensus, and polish makes the
consensus of references from sorted or unsorted alignments. Results are folders of text.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.config import PRESETS, GraphParams, MapParams, min_edge_cov
from strandlake.operators import consensus, contigs, overlaps, reads, stats
from strandlake.sources import formats

SUFFIXES = {"k": 1_000, "m": 1_000_000, "g": 1_000_000_000}


def number(text: str) -> int:
    """4.6m as 4600000."""
    unit = SUFFIXES.get(text[-1:].lower(), 1)
    return int(float(text[:-1] if unit > 1 else text) * unit)


def numbered(records: DataFrame) -> DataFrame:
    """Records as reads(ridx, tag, seq): bases only, numbered by name, for an order that doesn't hang on how files are split."""
    from strandlake.functions.sequence import bases

    tags = records.select("tag").groupBy((F.xxhash64("tag") % 4096).alias("part"), "tag").agg(F.count("*").alias("n"))
    parts = tags.groupBy("part").agg(F.count("*").alias("size"))
    start = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    ids = tags.join(F.broadcast(start), "part").select("tag", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("tag")) - 1).alias("ridx"))  # 8,191 rows at most
    return records.groupBy("tag").agg(F.max_by("seq", F.length("seq")).alias("seq")).join(ids, "tag").select("ridx", "tag", bases(F.col("seq")).alias("seq"))


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    fastq = [p for p in paths if p.removesuffix(".gz").endswith((".fq", ".fastq"))]
    fasta = [p for p in paths if p not in fastq]
    found = [formats.read_fasta(spark, *fasta).select("tag", "seq")] if fasta else []
    found += [formats.read_fastq(spark, *fastq).select("tag", "seq")] if fastq else []
    return numbered(found[0] if len(found) == 1 else found[0].unionByName(found[1]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    p.add_argument("command", choices=("map", "assemble", "polish"))
    p.add_argument("inputs", nargs="+", help="FASTA or FASTQ files; for polish SAM files")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("-x", "--preset", choices=sorted(PRESETS))
    p.add_argument("-g", "--genome", type=number, default=0, help="size of the genome, for the coverage of edges; 4.6m")
    p.add_argument("-L", "--min-length", type=number, default=0)
    p.add_argument("-X", "--most-bases", type=number, default=0, help="of the longest reads only so many letters")
    p.add_argument("--window", type=number, default=500)
    p.add_argument("--min-mapq", type=int, default=0)
    for kind in (MapParams, GraphParams):
        for f in fields(kind):
            p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=None)
    return p


def chosen(args: argparse.Namespace, base: object) -> object:
    given = {f.name: getattr(args, f.name) for f in fields(base) if getattr(args, f.name) is not None}  # type: ignore[arg-type]
    return replace(base, **given)  # type: ignore[type-var]


def run(spark: SparkSession, args: argparse.Namespace, show: Callable[[DataFrame, str], None] | None = None) -> None:
    """One command. show(lines, path) takes each result; it writes text unless another is given."""
    show = show or (lambda lines, path: lines.write.mode("overwrite").text(path))
    if args.command == "polish":
        size, step = args.window, args.window * 2 // 3
        sam = formats.trusted(formats.read_sam(spark, *args.inputs), args.min_mapq)
        windows = consensus.sam_windows(sam, size, step)
        show(formats.sam_layout_lines(windows, size, step), f"{args.out}/layout")
        names = windows.select("rname").distinct().select("rname", F.xxhash64("rname").alias("ctg"))
        stacked = windows.join(names, "rname").select("ctg", F.col("window").alias("edge"), (F.col("window") * step).alias("off"), F.row_number().over(Window.partitionBy("rname", "window").orderBy(F.desc("len"), "qname")).alias("ord"), "seq")
        made = consensus.stitched(consensus.edge_consensus(stacked), size)
        show(formats.fasta_lines(made.join(names, "ctg").select(F.col("rname").alias("tag"), "seq")), f"{args.out}/consensus")
        return
    found = load(spark, args.inputs).where(F.length("seq") >= args.min_length)
    found = reads.coverage_cap(found, args.most_bases) if args.most_bases else found
    p: MapParams = chosen(args, replace(MapParams(), **PRESETS.get(args.preset, {})))  # type: ignore[assignment]
    cut = reads.trimmed_to_bins(found, p.bin_size)
    if args.command == "map":
        show(formats.overlap_lines(overlaps.map_reads(found, p), cut, p.bin_size), f"{args.out}/overlaps")
        return
    graph = GraphParams()
    if args.genome:
        bases = found.agg(F.sum(F.length("seq"))).first()[0] or 0
        graph = replace(graph, min_edge_cov=min_edge_cov(bases, args.genome))
    a = contigs.assemble(found, p, chosen(args, graph))  # type: ignore[arg-type]
    stacked = contigs.layout(a["contigs"], a["regions"], a["reads"], p.bin_size)
    sizes = a["contigs"].groupBy("ctg").agg(F.count("*").alias("nodes"), ((F.max("pos") + graph.reg_len) * p.bin_size).alias("len"))
    show(formats.overlap_lines(a["overlaps"], cut, p.bin_size), f"{args.out}/overlaps")
    show(formats.gfa_lines(a["nodes"], a["edges"], graph.reg_len), f"{args.out}/graph")
    show(formats.layout_lines(stacked, sizes, cut.select("ridx", "tag")), f"{args.out}/layout")
    made = consensus.stitched(consensus.edge_consensus(stacked), 4 * p.bin_size)
    show(formats.fasta_lines(made.select(F.concat(F.lit("ctg"), F.col("ctg").cast("string")).alias("tag"), "seq")), f"{args.out}/consensus")
    show(stats.summary(made.select("len")).select(F.to_json(F.struct("*")).alias("value")), f"{args.out}/summary")


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
