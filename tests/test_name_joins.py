"""Overlaps aren't sorted for the names of their reads, and their text is written compressed."""

import glob

from strandlake.plans import queries as q
from strandlake.sources import formats

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_not_sorted_for_names(spark, tmp_path):
    tags = q.tagged_numbers(spark, SF)
    lines = formats.overlap_lines(q.aligned_rows(spark, SF), tags, 64)
    rows = formats.overlaps_by_name(formats.read_overlaps(spark, SF), tags, 64)
    for df in (lines, rows):
        assert plan(df).count("ShuffledHashJoin") == 2 and plan(df).count("BuildRight") == 2 and "SortMergeJoin" not in plan(df), plan(df)
    paths = []

    def read(spark, path):
        paths.append(path)
        return formats.read_overlaps(spark, path)

    back = q.through_text(lines, read, "gzip")
    assert back.count() == lines.count() > 1_000
    files = glob.glob(f"{paths[0].removeprefix('file:')}/part-*")
    assert files and all(f.endswith(".gz") for f in files)
