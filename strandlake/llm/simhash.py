"""SimHash near-dedup with a pigeonring filter.

A fingerprint of 64 bits is cut into a ring of three segments. If two fingerprints differ
in at most 2 bits, then some segment starts a chain whose every prefix stays within its
proportional budget (the strong form of the pigeonhole principle on a ring): l segments
from there on differ in at most 2 l / 3 bits, that is 0, then 1, then 2 bits. The first
segment is thus equal; of the second, which differs in one bit at most, one half is equal.
Segment and half make keys of about 32 bits, six for each fingerprint. Only what shares a
key and passes the chain's budgets gets the full Hamming check.

Equal fingerprints become one before keys are made. Under one key a few fingerprints are
compared directly, many by looking up what at most two flipped bits would give, so no group
is ever joined with itself in full; links leave a part as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, checkpointed, components, named, pieces, table, text_bytes, tidy

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: First bit and number of bits of each segment of the ring.
RING = ((0, 21), (21, 21), (42, 22))
#: Fingerprints under one key up to which all are compared directly.
DIRECT = 512
#: Fingerprints that may be so frequent that their classes are broadcast: of n documents those of more than n / HOT.
HOT = 10_000
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of words, a bit is 1 if it is set in over half of their hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    count = max(len(words) - shingle + 1, 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, grams)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for a in range(0, count, CHUNK):
        ones += np.unpackbits(h[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long: the unsigned fingerprint's bits) of docs(doc_id, text). Null and empty texts: 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


def _segment(i: int) -> F.Column:
    low, bits = RING[i]
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def _keys() -> list[F.Column]:
    """Of a fingerprint: (segment, half of the next) with its number in the lowest bits."""
    keys = []
    for i in range(3):
        low, bits = RING[(i + 1) % 3]
        half = bits // 2
        for k, (at, width) in enumerate(((low, half), (low + half, bits - half))):
            part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
            keys.append(F.shiftleft(_segment(i), 20).bitwiseOR(F.shiftleft(part, 4)).bitwiseOR(F.lit(2 * i + k).cast("long")))
    return keys


def within_budgets(x: np.ndarray, start: int) -> np.ndarray:
    """Whether the chain of segments from `start` keeps its budgets, and the whole the distance; x: differing bits."""
    total, ok = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for length in (1, 2, 3):
        low, bits = RING[(start + length - 1) % 3]
        total += np.bitwise_count(x >> np.uint64(low) & np.uint64((1 << bits) - 1))
        ok &= total <= length * DISTANCE // 3
    return ok & (np.bitwise_count(x) <= DISTANCE)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0 .. n - 1 by the links u - v."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            return label


def _flips() -> dict[int, np.ndarray]:
    """By a key's number: what two fingerprints under it can differ in, given its budgets."""
    out = {}
    for number in range(6):
        x = np.array([0] + [1 << a | 1 << b for a in range(64) for b in range(a + 1)], np.uint64)
        i, k = divmod(number, 2)
        low, bits = RING[(i + 1) % 3]
        half = bits // 2
        fixed = ((1 << half) - 1) << low if k == 0 else ((1 << bits - half) - 1) << low + half
        out[number] = x[within_budgets(x, i) & (x & np.uint64(fixed) == 0) & (x != 0)]
    return out


def _links(t: pa.Table) -> pa.Table:
    """Links among the fingerprints of a part, as a forest of (u, v): each fingerprint's document and the smallest it is linked with here."""
    key, fp, rep = (t[c].to_numpy() for c in ("key", "fp", "rep"))
    fp = fp.view(np.uint64)
    order = np.lexsort((fp, key))
    key, fp, rep = key[order], fp[order], rep[order]
    _, node = np.unique(rep, return_inverse=True)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        start = (key[a] & 15) // 2
        x = fp[a] ^ fp[b]
        ok = np.zeros(len(a), bool)
        for i in range(3):
            ok[start == i] = within_budgets(x[start == i], i)
        if ok.any():
            pairs.append((a[ok], b[ok]))

    for d in range(1, min(int(size.max(initial=0)), 16)):  # small groups, all at once
        a = np.flatnonzero(key[:-d] == key[d:])
        keep(a, a + d)
    flips = None
    for g in np.flatnonzero(size > 16):
        low, high = edge[g], edge[g + 1]
        n = high - low
        if n <= DIRECT:
            a, b = np.triu_indices(n, 1)
            keep(a + low, b + low)
            continue
        flips = flips or _flips()
        own = fp[low:high]
        for x in flips[int(key[low] & 15)]:
            at = np.minimum(np.searchsorted(own, own ^ x), n - 1)
            hit = np.flatnonzero(own[at] == own ^ x)
            keep(hit[hit < at[hit]] + low, at[hit[hit < at[hit]]] + low)
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    if not pairs:
        return pa.Table.from_pylist([], schema=out)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    ids = np.unique(rep)
    label = forest(node[a], node[b], len(ids))
    u = np.flatnonzero(label != np.arange(len(label)))
    return pa.Table.from_arrays([pa.array(ids[u]), pa.array(ids[label[u]])], schema=out)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs(doc_id long, text): fingerprints that differ in two bits at most are linked.

    component_id is the smallest doc_id reachable by links. Null texts and texts without
    words have fingerprint zero, which links like any other. Repeated rows come back once
    each; an empty table gives an empty one. Null doc_ids link nothing together: they
    come back with their component's smallest id, if it has one.
    """
    bounded_batches(docs.sparkSession)
    parts = pieces(text_bytes(docs) // 8, 4 << 20)
    each = checkpointed(fingerprints(docs))
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    keyed = distinct.where("rep is not null").select("fp", "rep", F.explode(F.array(*_keys())).alias("key"))
    links = keyed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(tidy(_links), "u long, v long")
    roots = components(links)
    classes = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    # a fingerprint of very many documents would gather them in one task: those few (HOT at most) meet their documents where they are
    often = F.col("n") > each.count() // HOT
    hot, cold = F.broadcast(classes.where(often).drop("n")), classes.where(~often).drop("n")
    joined = each.join(hot, "fp").unionByName(each.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that have a smaller doc_id in their component. Rows of one doc_id stay or go together; null doc_ids stay."""
    gone = near_duplicates(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
