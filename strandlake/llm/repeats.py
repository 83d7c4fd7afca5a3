"""Exchange that brings together all windows of a corpus which may repeat in another document.

A window is W consecutive units (bytes or words) of one document. Both repeat operators
(relative Lempel-Ziv and suffix-array dedup) need, for every window, whether its content
also starts in a document with a smaller id. Shuffling every window costs many times the
input, so the exchange works in four steps, each linear in the input:

1. Documents are dealt to buckets by a hash of their id. In each bucket every window picks
   its minimiser, the smallest hash among its grams of K units. Consecutive windows with
   one minimiser form a run. Equal windows have equal minimisers.
2. Buckets send 4-byte fingerprints of their minimisers to parts (by hash), which answer
   with a bit for each: does it occur in two documents? A window whose minimiser doesn't,
   cannot repeat.
3. For the rest, buckets send the content of whole runs (one copy for each content, with
   its smallest document) to the part of the minimiser, where a *block* procedure finds
   which of the run's windows start in a smaller document, and answers with a bit mask.
4. Buckets apply the masks, and cut out covered units.

A content that a third of all documents hold travels once for each bucket. A minimiser with
very many runs is hot: parts add up how many runs each has, and answer so with a second bit;
runs of a hot one are split into their single windows, each keyed by the hash of its whole
content, so that different windows spread over all parts and only equal ones stay together.
Buckets, parts and messages are bounded blobs; no step gathers a key's rows from all
documents. The buckets' text is shuffled once; Spark reuses that exchange for all three
passes. The number of tasks follows from the size of the text, so a task's data is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from strandlake.llm.common import MOST_SPREAD, as_column, even_keys, named, pieces, tasks, text_bytes, tidy

#: Text of a bucket, and of all buckets for which one part answers, at least; large inputs have parts of up to GROWS times as much, as every bucket may write to every part.
BUCKET_BYTES, PART_BYTES, GROWS = 8 << 20, 12 << 20, 8
#: Text of the buckets of a task, at least and at most.
TASK_BYTES = (16 << 20, 192 << 20)
#: Runs of one minimiser from which on they are split.
HOT = 16_384
#: Window starts that are hashed at a time; longer documents go in several slices.
SLICE = 1 << 17
#: Stands for a null id, and sorts last as nulls do.
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(20140622)
_BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_POWERS: list[np.ndarray] = []
#: ASCII white space of the word definition: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Units:
    """What a window consists of. window - gram + 1 is at most 32, the bits of a mask."""

    words: bool
    window: int
    gram: int

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, b, np.uint64))]) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], for many overlapping spans at once."""
    power, inverse = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buf] * power[: len(buf)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * inverse[start])


class Corpus:
    """The documents of a bucket, in order of doc_id: one buffer of bytes, and the units in it."""

    def __init__(self, table: pa.Table, units: Units):
        table = table.combine_chunks().sort_by("doc_id")
        ids = table["doc_id"]
        self.ids = ids.fill_null(NO_ID).to_numpy() if ids.null_count else ids.to_numpy()
        text = table["text"].cast(pa.large_binary())
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = text.fill_null(b"") if text.null_count else text
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(text) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if units.words:
            self.buf, self.start, self.end, self.bounds = split_words(raw, offsets)
        else:
            self.buf, self.start, self.end, self.bounds = raw, None, None, offsets
        self.n = int(self.bounds[-1])

    def cut(self, a: int, b: int) -> bytes:
        """Bytes of the units a to b."""
        if self.start is None:
            return self.buf[a:b].tobytes()
        return self.buf[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents joined by one space, their starts and ends, and the first word of each document."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return raw, none, none, np.zeros(len(offsets), np.int64)
    blank = SPACE[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = ~blank[edges]
    last = ~blank
    last[:-1] &= blank[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=to[1:])
    buf = np.full(int(to[-1]), 32, np.uint8)
    letters = np.flatnonzero(~blank)
    buf[letters - np.repeat(begin - to[:-1], size)] = raw[letters]
    return buf, to[:-1], to[:-1] + size, np.searchsorted(begin, offsets)


@dataclass
class Runs:
    """Runs of windows with one minimiser: first unit, number of windows, minimiser, document's place in the bucket."""

    start: np.ndarray
    count: np.ndarray
    value: np.ndarray
    doc: np.ndarray


def runs_of(c: Corpus, u: Units) -> Runs:
    found: list[tuple] = []
    doc_of_unit = np.repeat(np.arange(len(c.bounds) - 1, dtype=np.int32), np.diff(c.bounds))
    for a in range(0, c.n - u.window + 1, SLICE):
        b = min(a + SLICE, c.n - u.window + 1)
        n = b - a  # window starts a .. b - 1; their grams start at a .. b + span - 2
        if c.start is None:
            at = np.arange(n + u.span - 1)
            h = spans_hash(c.buf[a : b + u.window - 1], at, at + u.gram)
        else:
            low = c.start[a]
            h = spans_hash(c.buf[low : c.end[b + u.window - 2]], c.start[a : b + u.span - 1] - low, c.end[a + u.gram - 1 : b + u.window - 1] - low)
        least, width = h, 1
        while 2 * width <= u.span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < u.span:
            least = np.minimum(least[: n], least[u.span - width : u.span - width + n])
        doc = doc_of_unit[a:b]
        valid = doc_of_unit[a + u.window - 1 : b + u.window - 1] == doc
        new = np.ones(n + 1, bool)
        new[1:n] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
        edge = np.flatnonzero(new)
        size = np.diff(edge)
        if len(long := np.flatnonzero(size > u.span)):  # periodic text: cut into runs that a mask can hold
            for i in long:
                new[edge[i] : edge[i + 1] : u.span] = True
            edge = np.flatnonzero(new)
            size = np.diff(edge)
        edge = edge[:-1]
        keep = valid[edge]
        edge, size = edge[keep], size[keep]
        found.append((edge + a, size.astype(np.int32), least[edge], doc[edge]))
    if not found:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def fingerprints(r: Runs, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, fingerprint) keys in order, whether each occurs in two documents, the logarithm of its runs, rounded up, and each run's key."""
    key = (r.value % np.uint64(parts)) << np.uint64(32) | r.value >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], r.doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1 if len(at) else at
    several = doc[at] != doc[last]  # runs came in document order
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return key[at], several, np.ceil(np.log2(last - at + 1)).astype(np.uint8), which


def _by_part(key: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))


MESSAGE = "bucket int, part int, kind int, n int, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, _ARROW.types, strict=True)], schema=_ARROW)


def _bucket(t: pa.Table) -> int:
    return t["bucket"][0].as_py()


def _ask(u: Units, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Step 2, buckets: which minimisers occur here, and which of them in two documents."""

    def ask(table: pa.Table) -> pa.Table:
        key, several, many, _ = fingerprints(runs_of(Corpus(table, u), u), parts)
        low, cut, bucket = key.astype(np.uint32), _by_part(key, parts), _bucket(table)
        many = many << 1 | several
        return _messages([(bucket, p, 0, b - a, low[a:b].tobytes() + many[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a])

    return ask


def _answer(hot: int) -> Callable[[pa.Table], pa.Table]:
    """Step 2, parts: which fingerprints occur in two documents of any buckets, and which of them have very many runs."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        key = np.concatenate([np.frombuffer(r["data"], np.uint32, r["n"]) for r in rows])
        many = np.concatenate([np.frombuffer(r["data"], np.uint8, r["n"], 4 * r["n"]) for r in rows])
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        group = np.cumsum(new) - 1
        repeats = np.bincount(group) > 1
        repeats[group[(many[order] & 1).astype(bool)]] = True
        runs = np.bincount(group, np.exp2(many[order] >> 1))
        out = np.empty((2, len(s)), bool)
        out[:, order] = repeats[group], (runs >= hot)[group]
        at = np.cumsum([0] + [r["n"] for r in rows])
        return _messages([(r["bucket"], r["part"], 1, r["n"], np.packbits(out[:, a : a + r["n"]]).tobytes()) for r, a in zip(rows, at, strict=False)])

    return answer


def _repeating(c: Corpus, r: Runs, u: Units, replies: list[dict], parts: int) -> Runs:
    """The runs whose minimiser occurs in two documents, those of hot ones split into windows."""
    key, _, _, which = fingerprints(r, parts)
    bits = np.zeros((2, len(key)), bool)
    cut = _by_part(key, parts)
    for x in replies:
        if x["kind"] == 1:
            bits[:, cut[x["part"]] : cut[x["part"] + 1]] = np.unpackbits(np.frombuffer(x["data"], np.uint8), count=2 * x["n"]).reshape(2, -1)
    repeats, hot = bits[:, which]
    kept = np.flatnonzero(repeats & ~hot)
    calm = Runs(r.start[kept], r.count[kept], r.value[kept], r.doc[kept])
    split = np.flatnonzero(repeats & hot)
    if not len(split):
        return calm
    count = r.count[split]
    start = np.repeat(r.start[split] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    doc = np.repeat(r.doc[split], count)
    value = np.empty(len(start), np.uint64)
    for a in range(0, len(start), SLICE):  # starts are in order, and a hash may span their whole range
        some = start[a : a + SLICE]
        first, last = (some, some + u.window) if c.start is None else (c.start[some], c.end[some + u.window - 1])
        for i, j in _near(first, 8 * SLICE):
            low = first[i]
            value[a + i : a + j] = spans_hash(c.buf[low : last[j - 1]], first[i:j] - low, last[i:j] - low)
    both = [np.concatenate(x) for x in ((calm.start, start), (calm.count, np.ones(len(start), np.int32)), (calm.value, value), (calm.doc, doc))]
    order = np.argsort(both[0])  # in order of documents, as before
    return Runs(*(x[order] for x in both))


def _near(places: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Slices of ascending places, each within `reach`."""
    out, i = [], 0
    while i < len(places):
        j = int(np.searchsorted(places, places[i] + reach, side="right"))
        out.append((i, j))
        i = j
    return out


def _contents(c: Corpus, r: Runs, u: Units, parts: int) -> tuple[list, np.ndarray, list[bool]]:
    """Distinct contents of the runs as (part, bytes, first run); each run's content; whether it is in that content's first document."""
    seen: dict[bytes, int] = {}
    firsts: list[tuple[int, bytes, int]] = []
    which = np.empty(len(r.start), np.int64)
    own: list[bool] = []
    start, stop = r.start, r.start + r.count + (u.window - 1)
    if c.start is not None and len(start):
        start, stop = c.start[start], c.end[stop - 1]
    ids = c.ids.tolist()
    data, part, doc = c.buf.tobytes(), (r.value % np.uint64(parts)).tolist(), r.doc.tolist()
    for i, (a, b, p, d) in enumerate(zip(start.tolist(), stop.tolist(), part, doc, strict=True)):
        s = data[a:b]
        k = seen.setdefault(s, len(firsts))
        if k == len(firsts):
            firsts.append((p, s, i))
        which[i] = k
        own.append(ids[d] == ids[doc[firsts[k][2]]])
    return firsts, which, own


def _send(u: Units, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 3, buckets: contents of runs that may repeat, with the smallest document of each."""

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _messages([])
        c = Corpus(table, u)
        r = _repeating(c, runs_of(c, u), u, replies.to_pylist(), parts)
        to: dict[int, list[tuple[bytes, int]]] = {}
        for p, s, i in _contents(c, r, u, parts)[0]:
            to.setdefault(p, []).append((s, i))
        rows = []
        for p, x in to.items():
            i = np.array([k for _, k in x])
            head = r.value[i].tobytes() + c.ids[r.doc[i]].astype(np.int64).tobytes() + np.array([len(s) for s, _ in x], np.uint32).tobytes()
            rows.append((_bucket(table), p, 2, len(x), head + b"".join(s for s, _ in x)))
        return _messages(rows)

    return send


@dataclass
class Block:
    """Distinct contents that came to one part: the minimiser, smallest document and bytes of each."""

    value: np.ndarray
    doc: np.ndarray
    content: list[bytes]


#: Of each content, a mask of the windows that also start in a document smaller than the content's own smallest one.
BlockProcedure = Callable[[Block, Units], np.ndarray]


def _find(u: Units, procedure: BlockProcedure) -> Callable[[pa.Table], pa.Table]:
    """Step 3, parts: equal contents of several buckets become one, and the procedure compares what shares a minimiser."""

    def find(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        value, doc, sent = [], [], []
        for row in sorted(table.to_pylist(), key=lambda x: x["bucket"]):
            n, data = row["n"], row["data"]
            v, d = np.frombuffer(data, np.uint64, n).tolist(), np.frombuffer(data, np.int64, n, offset=8 * n).tolist()
            ends = (np.cumsum(np.frombuffer(data, np.uint32, n, offset=16 * n), dtype=np.int64) + 20 * n).tolist()
            a, which = 20 * n, []
            for x, y, b in zip(v, d, ends, strict=True):
                k = seen.setdefault(data[a:b], len(doc))
                a = b
                if k == len(doc):
                    value.append(x)
                    doc.append(y)
                elif y < doc[k]:
                    doc[k] = y
                which.append(k)
            sent.append((row["bucket"], row["part"], np.array(which), np.array(d)))
        content = list(seen)
        value, doc = np.array(value, np.uint64), np.array(doc, np.int64)
        mask = np.zeros(len(content), np.uint32)
        _, group, size = np.unique(value, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(size[group] > 1)  # alone under its minimiser: no other content holds its windows
        if len(shared):
            shared = shared[np.lexsort((shared, group[shared]))]
            mask[shared] = procedure(Block(value[shared], doc[shared], [content[i] for i in shared]), u)
        return _messages([(b, p, 3, len(w), np.where(d > doc[w], np.uint32(0xFFFFFFFF), mask[w]).astype(np.uint32).tobytes()) for b, p, w, d in sent])

    return find


def removed(c: Corpus, r: Runs, u: Units, replies: list[dict], parts: int) -> np.ndarray:
    """Step 4: of each unit of the bucket, whether a repeated window covers it."""
    cover = np.zeros(c.n + 1, np.int32)
    r = _repeating(c, r, u, replies, parts)
    if len(r.start):
        firsts, which, own = _contents(c, r, u, parts)
        place: dict[int, list[int]] = {}
        for k, (p, _, _) in enumerate(firsts):
            place.setdefault(p, []).append(k)
        mask = np.zeros(len(firsts), np.uint32)
        for x in replies:
            if x["kind"] == 3:
                mask[place[x["part"]]] = np.frombuffer(x["data"], np.uint32)
        bits = np.where(own, mask[which], np.uint32(0xFFFFFFFF)).astype(np.uint32)
        some = np.flatnonzero(bits)
        for k in range(int(r.count.max())):
            hit = some[(r.count[some] > k) & (bits[some] >> np.uint32(k) & np.uint32(1)).astype(bool)]
            at = r.start[hit] + k
            cover[at] += 1  # runs are disjoint: no place comes twice
            cover[at + u.window] -= 1
    return np.cumsum(cover[:-1]) > 0


def _finish(u: Units, parts: int, keep: str, carried: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=_result(keep))  # no rows: the type of what is carried doesn't matter
        table = table.combine_chunks().sort_by("doc_id")
        c = Corpus(table, u)
        gone = removed(c, runs_of(c, u), u, replies.to_pylist(), parts)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = c.bounds[:-1][c.bounds[:-1] < c.n]
        begins[starts] = gone[starts]  # a removed run ends with its document
        at = np.flatnonzero(begins)
        spans = np.searchsorted(at, c.bounds)
        left = np.zeros(c.n + 1, np.int32)
        np.cumsum(~gone, out=left[1:])
        stays = c.buf[~gone] if c.start is None else None
        rows = []
        ids, nulls = table["doc_id"].to_pylist(), table["text"].is_null().to_pylist()
        for i, (a, b) in enumerate(zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True)):
            n = b - a - int(left[b] - left[a])
            begin = at[spans[i] : spans[i + 1]].tolist()
            if not n:
                text = c.cut(a, b)
            elif stays is not None:
                text = stays[left[a] : left[b]].tobytes()
            else:
                text = b" ".join(c.buf[c.start[k] : c.end[k]].tobytes() for k in (np.flatnonzero(~gone[a:b]) + a).tolist())
            ends = []
            for k in begin:  # a span ends at the next unit that stays, or with the document
                e = int(np.searchsorted(left, left[k], side="right")) - 1
                ends.append(min(e, b))
            row = {"doc_id": ids[i], "n_units": b - a, "n_removed": n, "spans": [{"start": k - a, "end": e - a} for k, e in zip(begin, ends, strict=True)], "kept_sha256": hashlib.sha256(text).hexdigest()}
            if keep:
                row["kept"] = text if keep == "bytes" else None if nulls[i] else text.decode(errors="ignore")
            rows.append(row)
        out = pa.Table.from_pylist(rows, schema=_result(keep))
        return out.append_column("carried", table["carried"]) if carried else out

    return finish


def _result(keep: str) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())]
    return pa.schema(fields + [("kept", pa.binary() if keep == "bytes" else pa.string())] * bool(keep))


def cut_repeats(docs: DataFrame, u: Units, procedure: BlockProcedure, keep: str = "", carry: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_units, n_removed, spans, kept_sha256[, kept]) of docs(doc_id long, text string or binary).

    spans are the maximal removed runs in units of the document; kept is what remains, as
    "bytes", or as "text" without characters that lost some of their bytes; with carry the
    row's columns of these names come along in the struct `carried`.
    doc_id decides which copy stays, so it should be unique; rows that share an id count as
    one document and come back as separate rows. A null id counts as the largest. Null text: empty.
    """
    total = text_bytes(docs)
    buckets, parts = pieces(total, bucket_bytes), max(64, tasks(total, part_bytes, GROWS * part_bytes))
    by_bucket = by_part = tasks(total, *TASK_BYTES)
    # keys that Spark deals to tasks evenly; a key modulo their number is the bucket or part
    number = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(buckets)).cast("int")
    bucket = as_column(even_keys(buckets, by_bucket))[number] if buckets <= MOST_SPREAD else number
    keys = even_keys(parts, by_part)

    def to_parts(messages: DataFrame) -> DataFrame:
        return messages.withColumn("part", as_column(keys)[F.col("part")] if parts <= MOST_SPREAD else F.col("part")).repartition(by_part, "part")

    def to_buckets(messages: DataFrame) -> DataFrame:
        return messages.repartition(by_bucket, "bucket").groupBy("bucket")

    dealt = docs.select(bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *([F.struct(*map(named, carry)).alias("carried")] if carry else [])).repartition(by_bucket, "bucket")
    asked = to_parts(dealt.groupBy("bucket").applyInArrow(tidy(_ask(u, parts)), MESSAGE))
    answered = asked.groupBy("part").applyInArrow(tidy(_answer(hot)), MESSAGE).withColumn("part", F.col("part") % parts)
    sent = to_parts(dealt.groupBy("bucket").cogroup(to_buckets(answered)).applyInArrow(tidy(_send(u, parts)), MESSAGE))
    found = sent.groupBy("part").applyInArrow(tidy(_find(u, procedure)), MESSAGE).withColumn("part", F.col("part") % parts)
    schema = _parse_datatype_string("doc_id long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string" + (f", kept {'binary' if keep == 'bytes' else 'string'}" if keep else ""))
    if carry:
        schema = schema.add("carried", docs.select(F.struct(*map(named, carry)).alias("c")).schema["c"].dataType)
    return dealt.groupBy("bucket").cogroup(to_buckets(answered.union(found))).applyInArrow(tidy(_finish(u, parts, keep, bool(carry))), schema)
