"""Toxicity by maximum-scoring segments of token log-odds.

1. A token's log-odds of standing in a toxic document has a Dirichlet prior, centred on
   what is known of its prefix, whose prior is centred on a shorter prefix, and so on up
   to the base rate; so unseen compounds of a toxic stem score, and chance words don't.
   Counts are kept in a hashed table of fixed size.
2. A linear scan (Ruzzo and Tompa, 1999) finds every maximal scoring segment of a text.
3. Scores of segments in clean text follow an extreme-value law (Karlin and Altschul,
   1990). Its decay is solved from the clean tokens' scores, its scale fitted to the best
   segments of clean documents. A segment's excess over the law is its evidence; a
   document's is the sum over its segments, turned into a probability by a logistic fit.

Labelled rows of crc32(doc_id as text) mod 4 = 2 are held out and never read. Of the others
remainders 0 and 1 give the counts, 3 the calibration. All of them are used, without a cap.
The prior's weight and what every token pays (the drift) are chosen in each fit: for each
choice the law and the logistic are fitted on one half of the calibration rows and judged by
the likelihood of the other half's labels, and the other way round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, chunks, table, tidy
from strandlake.llm.repeats import spans_hash

#: Cells of the hashed table, and slices in which tasks send their counts.
CELLS, SLICES = 1 << 20, 64
#: Bytes of the prefixes whose counts centre the priors of longer ones; the whole token comes last.
PREFIXES = (4, 5, 6, 8)
#: Choices of a prior's weight, and of what every token pays, so that clean text scores below zero.
PRIORS, DRIFTS = (4.0, 12.0, 36.0), (1.5, 2.0, 2.5, 3.0)
#: Messages of counts that one task adds up.
FAN = 1024
#: Classes of token scores and of evidence that go to the driver.
BINS, SCORE_STEP, EVIDENCE_STEP = 512, 0.05, 0.5
#: Broadcast labels up to this size; else join by a shuffle.
BROADCAST_BYTES = 8 << 20
THRESHOLD, SIGNIFICANT = 0.3, 3.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """toxic, all: tokens counted in each cell; prior and drift; the extreme-value law; the logistic fit of evidence."""

    toxic: np.ndarray
    all: np.ndarray
    base: float
    prior: float = PRIORS[0]
    drift: float = 0.0
    decay: float = 1.0
    scale: float = 0.0
    intercept: float = 0.0
    slope: float = 0.0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their tokens, and the first token of each text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    letter = np.r_[False, _LETTER[raw], False]
    start = np.flatnonzero(letter[1:-1] & (~letter[:-2] | edge[:-1]))
    end = np.flatnonzero(letter[1:-1] & (~letter[2:] | edge[1:])) + 1
    return _LOWER[raw], start, end, np.searchsorted(start, offsets)


def cells(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cells of each token: a row for each prefix that is shorter than it (-1 where none is), and for itself."""
    out = np.full((len(PREFIXES) + 1, len(start)), -1, np.int64)
    for k, n in enumerate((*PREFIXES, 1 << 40)):
        i = np.flatnonzero(end - start > n) if n < 1 << 40 else np.arange(len(start))
        h = spans_hash(buf, start[i], np.minimum(start[i] + n, end[i]))
        out[k, i] = (h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - CELLS.bit_length() + 1)
    return out


def scores(m: Model, c: np.ndarray) -> np.ndarray:
    """Log-odds of each token, above those of any token, less the drift."""
    p = np.full(c.shape[1], m.base)
    for row in c:
        p = np.where(row >= 0, (m.toxic[row] + m.prior * p) / (m.all[row] + m.prior), p)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)) - np.log(m.base / (1 - m.base)) - m.drift


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of s as (start, end, score), by one pass over its positive places."""
    total = np.r_[0.0, np.cumsum(s)]
    at = np.flatnonzero(s > 0)
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, the last one with a smaller sum before
    for i, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, start, i + 1, j))
                break
            low, start, before = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = before
    return [(a, b, high - low) for low, high, a, b, _ in stack]


def _each(ms: list[Model], batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each row's place and the scores of its tokens by each model. The models share their counts."""
    i = 0
    for part in chunks(batch, "text"):
        buf, start, end, first = tokens(part.column("text"))
        c = cells(buf, start, end) if len(start) else np.zeros((0, 0), np.int64)
        plain = {m.prior: scores(replace(m, drift=0.0), c) for m in ms}
        each = [plain[m.prior] - m.drift for m in ms]
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield i, [s[a:b] for s in each]
            i += 1


def evidence(m: Model, s: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of the segments' excess over the extreme-value law, and the significant ones as (first token, end, excess)."""
    law = np.log(max(len(s), 1)) + m.scale
    found = [(a, b, m.decay * x - law) for a, b, x in maximal_segments(s)]
    return sum(max(x, 0.0) for _, _, x in found), [f for f in found if f[2] >= SIGNIFICANT]


def _message(toxic: np.ndarray, every: np.ndarray) -> bytes:
    """Counts of a slice's cells that occur: their places, tokens in toxic texts, in all."""
    i = np.flatnonzero(every)
    return i.astype(np.uint16).tobytes() + toxic[i].tobytes() + every[i].tobytes()


def _add(message: bytes, toxic: np.ndarray, every: np.ndarray) -> None:
    n = len(message) // 18
    i = np.frombuffer(message, np.uint16, n)
    toxic[i] += np.frombuffer(message, np.int64, n, 2 * n)
    every[i] += np.frombuffer(message, np.int64, n, 10 * n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's tokens, by slices of the table. fan: the task's number, by FAN."""
    toxic, every = np.zeros((2, CELLS), np.int64)
    for b in (part for batch in batches for part in chunks(batch, "text")):
        buf, start, end, first = tokens(b.column("text"))
        if len(start):
            weight = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False), np.diff(first))
            for row in cells(buf, start, end):
                has = row >= 0
                toxic += np.bincount(row[has & (weight > 0)], minlength=CELLS)
                every += np.bincount(row[has], minlength=CELLS)
    width = CELLS // SLICES
    data = [_message(toxic[k : k + width], every[k : k + width]) for k in range(0, CELLS, width)]
    fan = TaskContext.get().partitionId() // FAN
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([fan] * SLICES, pa.int32()), pa.array(data, pa.binary())], names=["slice", "fan", "data"])


def _sum(t: pa.Table) -> pa.Table:
    toxic, every = np.zeros((2, CELLS // SLICES), np.int64)
    for d in t["data"].to_pylist():
        _add(d, toxic, every)
    return pa.table({"slice": t["slice"][:1], "data": pa.array([_message(toxic, every)], pa.binary())})


def _histogram(ms: list[Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of clean documents: how often each token score comes, by each model."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(ms), BINS), np.int64)
        for b in batches:
            for _, each in _each(ms, b):
                for k, s in enumerate(each):
                    seen[k] += np.bincount(np.clip((s / SCORE_STEP).round().astype(int) + BINS // 2, 0, BINS - 1), minlength=BINS)
        k, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(seen[k, at])], names=["model", "bin", "n"])

    return histogram


def _maxima(ms: list[Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of clean documents with tokens: the sum of the best segments' scaled scores less the length's log, by each model and half; documents."""

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(ms), 2)), np.zeros((len(ms), 2), np.int64)
        for b in batches:
            half = b.column("half").to_pylist()
            for i, each in _each(ms, b):
                for k, (m, s) in enumerate(zip(ms, each, strict=True)):
                    if len(s):
                        total[k, half[i]] += m.decay * max((x for _, _, x in maximal_segments(s)), default=0.0) - np.log(len(s))
                        n[k, half[i]] += 1
        k, h = np.indices(n.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(total.ravel()), pa.array(n.ravel())], names=["model", "half", "total", "n"])

    return maxima


def _evidence(ms: list[Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(ms), 2, 2, BINS), np.int64)
        for b in batches:
            half, toxic = b.column("half").to_pylist(), b.column("toxic").to_pylist()
            for i, each in _each(ms, b):
                for k, (m, s) in enumerate(zip(ms, each, strict=True)):
                    seen[k, half[i], toxic[i], min(int(evidence(m, s)[0] / EVIDENCE_STEP), BINS - 1)] += 1
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(seen[at])], names=["model", "half", "label", "bin", "n"])

    return classes


def decay_of(value: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(root * score)] = 1; without positive scores, or a negative mean, 1."""
    value, p = value[weight > 0], weight[weight > 0] / max(weight.sum(), 1)
    if not (value > 0).any() or (p * value).sum() >= 0:
        return 1.0

    def mean(root: float) -> float:
        return float((p * np.exp(np.minimum(root * value, 700.0))).sum())

    low, high = 1e-6, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if mean(mid) >= 1 else (mid, high)
    return low


def logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge, which also holds them where classes separate."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.array([np.log((toxic.sum() + 0.5) / (clean.sum() + 0.5)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        n = toxic + clean
        g = a.T @ (toxic - n * p) - 0.01 * w
        h = (a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(w[0]), float(w[1])


def loss(fitted: tuple[float, float], x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Negative log-likelihood of labels counted by evidence."""
    z = np.clip(fitted[0] + fitted[1] * x, -30, 30)
    return float((toxic * np.log1p(np.exp(-z)) + clean * np.log1p(np.exp(z))).sum())


def counted_cells(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in toxic texts and in all, by cell, of rows(text, toxic). Tasks' messages are added FAN at a time, then the sums of these."""
    sums = rows.mapInArrow(tidy(_count), "slice int, fan int, data binary").groupBy("slice", "fan").applyInArrow(_sum, "slice int, data binary").groupBy("slice").applyInArrow(_sum, "slice int, data binary")
    toxic, every = np.zeros((2, CELLS), np.int64)
    width = CELLS // SLICES
    for k, d in sums.collect():  # the whole table, of fixed size
        _add(d, toxic[k * width : (k + 1) * width], every[k * width : (k + 1) * width])
    return toxic, every


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of docs(doc_id, text) and labels(doc_id, toxic 0 or 1); None if no usable label of either class is left."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    remainder = F.pmod(crc, F.lit(4))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where((remainder != 2) & F.col("toxic").isin(0, 1))
    if int(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    half = F.pmod(F.shiftright(crc, 2), F.lit(2)).cast("int")
    rows = docs.select("doc_id", "text").where("text is not null").join(known, "doc_id").select(remainder.alias("part"), half.alias("half"), F.col("text").cast("binary").alias("text"), "toxic")
    toxic, every = counted_cells(rows.where("part < 2").select("text", "toxic"))
    if not toxic.any() or (every == toxic).all():
        return None
    start = Model(toxic.astype(np.float32), every.astype(np.float32), float(toxic.sum() / every.sum()))
    held = rows.where("part = 3").select("text", "toxic", "half")
    clean = held.where("toxic = 0")
    # the law of each choice: its decay from all clean rows, its scale from those of either half
    seen = np.zeros((len(PRIORS), BINS))
    for k, b, n in clean.mapInArrow(tidy(_histogram([replace(start, prior=p) for p in PRIORS])), "model long, bin long, n long").groupBy("model", "bin").agg(F.sum("n")).collect():
        seen[k, b] = n
    value = (np.arange(BINS) - BINS // 2) * SCORE_STEP
    choices = [replace(start, prior=p, drift=d, decay=decay_of(value - d, seen[k])) for k, p in enumerate(PRIORS) for d in DRIFTS]
    best = np.zeros((2, len(choices), 2))
    for k, h, total, n in clean.mapInArrow(tidy(_maxima(choices)), "model long, half long, total double, n long").groupBy("model", "half").agg(F.sum("total"), F.sum("n")).collect():
        best[:, k, h] = total, n
    choices = [replace(m, scale=float(t / n - np.euler_gamma) if n else 0.0) for m, t, n in zip(choices, *best.sum(axis=2), strict=True)]
    found = np.zeros((len(choices), 2, 2, BINS))
    for k, h, label, b, n in held.mapInArrow(tidy(_evidence(choices)), "model long, half long, label long, bin long, n long").groupBy("model", "half", "label", "bin").agg(F.sum("n")).collect():
        found[k, h, label, b] = n
    x = np.arange(BINS) * EVIDENCE_STEP
    worst = [sum(loss(logistic(x, f[1 - h, 1], f[1 - h, 0]), x, f[h, 1], f[h, 0]) for h in (0, 1)) for f in found]
    pick = int(np.argmin(worst))
    a, b = logistic(x, found[pick, :, 1].sum(axis=0), found[pick, :, 0].sum(axis=0))
    return replace(choices[pick], intercept=a, slope=b)


def probability(m: Model | None, s: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """A document's score and significant segments, of its tokens' scores."""
    if m is None:
        return 0.0, []
    e, found = evidence(m, s)
    return float(1 / (1 + np.exp(-np.clip(m.intercept + m.slope * e, -30, 30)))), found


def _score(m: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, (s,) in _each([m], b) if m else ((i, (np.zeros(0),)) for i in range(b.num_rows)):
                p, found = probability(m, s)
                rows.append((p, len(found), [{"start": x, "end": y, "excess": z} for x, y, z in found]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind)], names=["doc_id", "score", "n_passages", "passages"])

    return score


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) of docs(doc_id, text).

    passages are the significant segments, in tokens. Null and empty texts have no segment
    and get the score of no evidence; without a model every score is 0. Repeated rows come
    back once each, with equal scores; other columns are left out. held_out is false for a
    null doc_id.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_score(model)), "doc_id long, score double, n_passages int, passages array<struct<start: long, end: long, excess: double>>")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "passages")


def _clean(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = [probability(m, s)[0] < THRESHOLD for _, (s,) in _each([m], b)]
            yield b.filter(pa.array(stays, pa.bool_()))

    return clean


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns of them, without the rows that score() would predict as toxic. Null texts stay; without usable labels all do."""
    bounded_batches(docs.sparkSession)
    m = fit(docs, labels)
    return docs.mapInArrow(tidy(_clean(m)), docs.schema) if m else docs


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
