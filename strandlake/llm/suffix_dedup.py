"""Suffix-array dedup of byte strings by column-wise multi-document construction.

A collection is indexed as in the external-memory construction of Bauer, Cox, Rosone and
Sciortino (2013, 2012): each round inserts one more symbol of every document, from its
end, into the Burrows-Wheeler transform of the whole collection, and extends the array of
longest common prefixes. Every round rewrites the sequential files once, front to back:
transform, common prefixes, owner and suffix length. As the collection of a part is
bounded, these files are memory buffers here, never an executor's local disk.

repeats.py routes the runs of windows that may repeat to the parts; here they are the
documents of the collection. Neighbouring suffixes whose common prefix reaches the window
hold the same window, and the smallest owner among them is the document that keeps it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, table
from strandlake.llm.repeats import Block, Units, cut_repeats

WINDOW, GRAM = 50, 20
#: Documents that are built together, at most, unless more share one minimiser.
COLLECTION = 2048


def collection_index(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all docs in order, as owner and length, and the common prefix of each with the one before.

    Docs hold no byte 0. Equal suffixes stand in order of their docs.
    """
    m = len(docs)
    size = np.array([len(d) for d in docs], np.int64)
    longest = int(size.max())
    symbol = np.zeros((longest + 1, m), np.uint8)  # row j: what precedes the suffix of length j
    flat = np.frombuffer(b"".join(docs), np.uint8)
    of = np.repeat(np.arange(m), size)
    symbol[np.repeat(np.cumsum(size), size) - 1 - np.arange(len(flat)), of] = flat
    number = np.uint8 if longest < 255 else np.uint32
    # the files: of empty suffixes first
    bwt, lcp = symbol[0].copy(), np.zeros(m, number)
    owner, length = np.arange(m, dtype=np.int32), np.zeros(m, number)
    place, active = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        ended = n - int(np.count_nonzero(bwt))  # symbols before a document's first: none
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        p = place[active]
        q = rank[p]  # place of the longer suffix, among all suffixes that have a first symbol
        by = np.argsort(q)
        q, p, active = q[by], p[by], active[by]
        c = bwt[p]
        before, after = order[q - 1], order[np.minimum(q + 1, n - 1)]
        has_before = (q > ended) & (bwt[before] == c)
        has_after = (q + 1 < n) & (bwt[after] == c)
        padded = np.append(lcp, number(0))

        def least(low: np.ndarray, high: np.ndarray, padded: np.ndarray = padded) -> np.ndarray:
            """Smallest common prefix of the places low + 1 to high."""
            if not len(low):
                return np.zeros(0, number)
            return np.minimum.reduceat(padded, np.column_stack([low + 1, high + 1]).ravel())[::2]

        ahead = np.zeros(len(q), number)
        ahead[has_before] = 1 + least(before[has_before], p[has_before])
        behind = 1 + least(p[has_after], after[has_after])
        # rewrite the files with the new suffixes in their places
        to = q - ended + m
        at = to - np.arange(len(to))
        follows = to[has_after] + 1
        bwt = np.insert(bwt, at, symbol[j][active])
        lcp = np.insert(lcp, at, ahead)
        lcp[follows] = behind
        owner, length = np.insert(owner, at, active), np.insert(length, at, number(j))
        place[active] = to
        active = active[size[active] > j]  # the others' places move too, but aren't read again
    return owner, length, lcp


def first_documents(docs: list[bytes], ids: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each doc the smallest id of the docs that hold it."""
    owner, length, lcp = collection_index(docs)
    full = length >= window
    group = np.cumsum(lcp < window)[full]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    smallest = np.minimum.reduceat(ids[owner[full]], starts)
    smallest = np.repeat(smallest, np.diff(np.r_[starts, len(group)]))
    size = np.array([len(d) for d in docs])
    out = np.zeros(int(np.maximum(size - window + 1, 0).sum()), np.int64)
    begin = np.r_[0, np.cumsum(np.maximum(size - window + 1, 0))]
    out[begin[owner[full]] + size[owner[full]] - length[full]] = smallest
    return [out[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def suffix_array_block(block: Block, u: Units) -> np.ndarray:
    """Masks of the block's contents, whose windows are compared by the suffix array of collections of them."""
    mask = np.zeros(len(block.content), np.uint32)
    change = np.flatnonzero(np.r_[True, block.value[1:] != block.value[:-1], True])
    a = 0
    while a < len(change) - 1:
        b = max(int(np.searchsorted(change, change[a] + COLLECTION, side="right")) - 1, a + 1)
        low, high = int(change[a]), int(change[b])
        # byte 0 ends a document in the transform; UTF-8 has no byte 255, which stands for a NUL of the text
        docs = [d.replace(b"\x00", b"\xff") for d in block.content[low:high]]
        first = first_documents(docs, block.doc[low:high], u.window)
        for k, f in enumerate(first):
            mask[low + k] = np.packbits(f < block.doc[low + k], bitorder="little").astype(np.uint32) @ (1 << 8 * np.arange(-(-len(f) // 8), dtype=np.uint32)).astype(np.uint32)
        a = b
    return mask


def dedup(docs: DataFrame, window: int = WINDOW, keep: str = "bytes", carry: list[str] | None = None, **sizes: int) -> DataFrame:
    """Removes each byte covered by a window of bytes that also starts in a document with a smaller doc_id.

    docs: doc_id long, text string; other columns are left out. Returns doc_id, n_units (bytes),
    n_removed, spans (maximal removed runs), kept_sha256, and with keep the kept bytes.
    Windows are judged on the input. Null and empty texts have no window and stay empty;
    documents below the window stay whole; an empty table gives an empty one.
    """
    if docs.schema["text"].dataType.typeName() == "binary":
        raise TypeError("text must be a string: UTF-8 has no byte 255, which stands for byte 0 in the collection")
    gram = max(1, min(GRAM, window - 1)) if window - GRAM + 1 <= 32 else window - 31
    return cut_repeats(docs, Units(False, window, gram), suffix_array_block, keep, carry, **sizes)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), keep="")
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of their texts, and n_chars (if there is one) counted anew.

    What is left of a character that lost some of its bytes goes too. Texts that are covered
    whole become empty and stay, as do null texts. All columns come back.
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    out = dedup(docs, keep="text", carry=others)
    count = {"n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[count.get(c, F.col("kept") if c == "text" else F.col("carried")[c]).alias(c) for c in docs.columns])
