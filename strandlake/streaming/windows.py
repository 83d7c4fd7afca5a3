"""Streams: windows over placed reads, and queries against a standing index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlake.config import MapParams


_STATE = "top long, windows array<long>, n array<long>, letters array<long>, released long"


def window_depths(reads: DataFrame, size: int, step: int, late: int) -> DataFrame:
    """(name, window, n, letters) over a stream of reads(name, pos, len) sorted by position, but for `late` letters, within each name.

    Each name has its own clock, the farthest position it has come to. A window is released,
    once, when its name has moved `late` letters beyond its end; what comes for it later is
    dropped. The state of a name is its open windows; a name's rows of a batch go to one task,
    as its clock is one, and stream through it.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step).cast("int") + 1)
    last = F.floor((F.col("pos") + F.col("len") - 1) / step).cast("int")
    placed = reads.where("len > 0").withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    cut = F.least(F.col("pos") + F.col("len"), F.col("window") * step + size) - F.greatest(F.col("pos"), F.col("window") * step)
    kept = placed.select("name", "window", F.col("pos").cast("long").alias("pos"), F.when(cut * 2 >= F.least(F.col("len"), F.lit(size)), cut).cast("long").alias("cut"))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, windows, n, letters, released = state.get if state.exists else (-1, [], [], [], -1)
        open_ = {w: [a, b] for w, a, b in zip(windows, n, letters, strict=True)}
        for f in frames:
            top = max(top, int(f["pos"].max()))
            sums = f[f["cut"].notna() & (f["window"] > released)].groupby("window")["cut"].agg(["count", "sum"])
            for w, a, b in sums.itertuples():
                at = open_.setdefault(int(w), [0, 0])
                at[0], at[1] = at[0] + int(a), at[1] + int(b)
        done = (top - late - size) // step  # the last window whose end the clock has left `late` letters behind
        out = sorted(w for w in open_ if w <= done)
        rows = [(key[0], w, *open_.pop(w)) for w in out]
        released = max(released, done)
        left = sorted(open_)
        state.update((top, left, [open_[w][0] for w in left], [open_[w][1] for w in left], released))
        yield pd.DataFrame(rows, columns=["name", "window", "n", "letters"])

    return kept.groupBy("name").applyInPandasWithState(advance, "name string, window long, n long, letters long", _STATE, "append", GroupStateTimeout.NoTimeout)


def query_index(queries: DataFrame, index: DataFrame, p: MapParams) -> DataFrame:
    """Stream of reads(ridx, tag, seq) against a static index: seeds shared with each target, (ridx, tidx, tbin, strand) rows."""
    from strandlake.operators.kmers import kmers

    q = kmers(queries, p).select("kmer", "ridx", F.col("dir").alias("qd"))
    t = index.select("kmer", F.col("ridx").alias("tidx"), F.col("bin").alias("tbin"), F.col("dir").alias("td"))
    return q.join(t, "kmer").select("ridx", "tidx", "tbin", F.col("qd").bitwiseXOR(F.col("td")).alias("strand"))
