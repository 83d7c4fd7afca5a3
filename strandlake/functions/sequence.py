"""Column functions for sequences, k-mers and cigars, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters by residue of their place in the alphabet, for texts read as sequences.
TEXT_LETTERS, TEXT_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: One-letter codes of ambiguous bases and the bases that each stands for.
AMBIGUITY = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def text_as_bases(text: Column) -> Column:
    """The letters a to z of a text, each as a base; other characters go."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), TEXT_LETTERS, TEXT_BASES)


def bases(seq: Column, strict: bool = False) -> Column:
    """Upper-case A, C, G, T; any other letter becomes A, or with strict the row's value null."""
    upper = F.upper(seq)
    return F.when(~upper.rlike("[^ACGT]"), upper) if strict else F.regexp_replace(upper, "[^ACGT]", "A")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def homopolymer_compressed(seq: Column) -> Column:
    """Runs of one base as one base."""
    return F.regexp_replace(seq, "(.)\\1+", "$1")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; null for a palindrome, which has no strand."""
    other = reverse_complement(kmer)
    return F.when(kmer != other, F.least(kmer, other))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, the first base highest. Up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def smear(code: Column) -> Column:
    """Spreads the bits of a code before it is sampled."""
    return code.bitwiseXOR(F.shiftright(code, 4)).bitwiseXOR(F.shiftright(code, 7))


def sampled(code: Column, one_of: int, classes: int = 4096) -> Column:
    """Whether a code is in the sample of 1 / one_of."""
    return F.pmod(smear(code), F.lit(classes * one_of)) < classes


def hash64(*columns: Column, seed: int = 0) -> Column:
    """A 64-bit hash of the columns; its values are Spark's own (XXH64), not those of other programs."""
    return F.xxhash64(F.lit(seed), *columns)


def hash32(*columns: Column, seed: int = 0) -> Column:
    """A 32-bit hash of the columns; its values are Spark's own (Murmur3)."""
    return F.hash(F.lit(seed), *columns)


def mismatches(a: Column, b: Column) -> Column:
    """Places up to the shorter's length in which two strings differ."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))).otherwise(F.lit(0))


def squeeze(text: Column, letter: str) -> Column:
    """Runs of a letter as one."""
    return F.regexp_replace(text, f"{letter}+", letter)


def count_letter(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def parse_number(text: Column) -> Column:
    """4.6m as 4600000: a number with the suffix k, m or g."""
    unit = F.lower(F.right(text, F.lit(1)))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return (F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double") * factor).cast("long")


def cigar_runs(cigar: Column) -> Column:
    """array<struct<op, n>> of a cigar; a missing count is 1; `*` is empty."""
    tokens = F.regexp_extract_all(cigar, F.lit("([0-9]*[A-Za-z=])"), 1)
    return F.transform(tokens, lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), F.coalesce(F.regexp_extract(t, "^([0-9]+)", 1).try_cast("int"), F.lit(1)).alias("n")))


def cigar_text(ops: Column) -> Column:
    """Run-length text of an array of one-letter operations, a count of 1 left out; `*` for none."""
    joined = F.array_join(ops, "")
    runs = F.regexp_extract_all(joined, F.lit("((.)\\2*)"), 1)
    coded = F.transform(runs, lambda r: F.concat(F.when(F.length(r) > 1, F.length(r).cast("string")).otherwise(""), F.left(r, F.lit(1))))
    return F.when(joined == "", "*").otherwise(F.array_join(coded, ""))


def cigar_spans(cigar: Column) -> Column:
    """struct<query, target, aligned> lengths that a cigar covers; lower-case operations are the gap forms of M, I, D."""
    runs = cigar_runs(cigar)

    def total(ops: str) -> Column:
        return F.aggregate(F.filter(runs, lambda r: F.instr(F.lit(ops), r["op"]) > 0), F.lit(0), lambda a, r: a + r["n"])

    return F.struct(total("MI=XSmi").alias("query"), total("MDN=Xmd").alias("target"), total("M=Xm").alias("aligned"))
