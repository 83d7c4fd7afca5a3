"""Substring dedup of words by relative Lempel-Ziv parsing.

A reference block is what a part of the exchange in repeats.py gathers: the runs of words,
from all documents, that can match each other. The runs come in order of their documents,
and each is factored greedily against the block of everything before it. A factor starts
where a window of W words is found in the block's index, and is stretched word by word
while the reference goes on alike; so a factor has W words at least. At a factor's end the
parse steps back to the next window, the one that reaches over the boundary, and looks that
up in turn: no match that a boundary cuts is lost. What isn't found becomes a literal and
joins the block's index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import table
from strandlake.llm.repeats import Block, Units, cut_repeats

WINDOW, GRAM = 13, 4


class Reference:
    """An indexed reference block: where each window of words first came."""

    def __init__(self, window: int):
        self.window = window
        self.runs: list[list[bytes]] = []
        self.docs: list[int] = []
        self.index: dict[bytes, tuple[int, int]] = {}

    def factors(self, words: list[bytes], doc: int) -> list[tuple[int, int, int, int]]:
        """Greedy factors of words as (start, length, reference run, start there), whose reference is in a smaller document; then adds words to the block."""
        w, n, i, found = self.window, len(words), 0, []
        me = len(self.runs)
        self.runs.append(words)
        self.docs.append(doc)
        windows = [b" ".join(words[k : k + w]) for k in range(n - w + 1)]
        while i <= n - w:
            hit = self.index.setdefault(windows[i], (me, i))
            run, at = hit
            if self.docs[run] >= doc:
                i += 1
                continue
            there, length = self.runs[run], w
            while i + length < n and at + length < len(there) and there[at + length] == words[i + length]:
                length += 1
            found.append((i, length, run, at))
            i += length - w + 1  # the first window that reaches over the factor's end
        return found


def lempel_ziv_block(block: Block, u: Units) -> np.ndarray:
    mask = np.zeros(len(block.content), np.uint32)
    reference, last = Reference(u.window), None
    for k in np.lexsort((block.doc, block.value)).tolist():
        if block.value[k] != last:  # only runs with one minimiser can match
            reference, last = Reference(u.window), block.value[k]
        for start, length, _, _ in reference.factors(block.content[k].split(b" "), int(block.doc[k])):
            windows = length - u.window + 1
            mask[k] |= np.uint32(((1 << windows) - 1) << start)
    return mask


def dedup(docs: DataFrame, window: int = WINDOW, keep: str = "bytes", **sizes: int) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document with a smaller doc_id.

    docs: doc_id long, text; other columns are left out. Words are runs of anything but
    ASCII white space. Returns doc_id, n_units (words), n_removed, spans (maximal removed
    runs of words), kept_sha256 and with keep the kept words, joined by one space. Windows
    are judged on the input. Null and empty texts have no words; documents below the window
    stay whole; an empty table gives an empty one.
    """
    gram = max(1, min(GRAM, window - 1)) if window - GRAM + 1 <= 32 else window - 31
    return cut_repeats(docs, Units(True, window, gram), lempel_ziv_block, keep, None, **sizes)


def op2_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), keep="")
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", "spans")
