"""Packing of tokenized documents into windows by the sum-of-squares rule.

A document's tokens are cut into full windows and a remainder. The remainder goes, online,
into the partially filled window (or a new one) for which the sum over all fill levels of
the squared number of windows at that level gets smallest (Csirik et al., 2006). An array
of counts by level tells that; a stack for each level holds the windows.

Every task packs what it reads, so nothing is shuffled. At its end, and whenever more than
OPEN windows stand partially filled (as where nearly all remainders are longer than half a
window), it cuts what stands in them into full ones; the last rest, below one window, is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, chunks, gather, table, tidy

WINDOW, END = 1024, 0
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a generation of words, of which a worker remembers two, words that the library takes at a time, and bytes of text that are tokenized at a time.
REMEMBERED, AT_ONCE, CHUNK = 64 << 20, 5000, 4 << 20
#: What a remembered word takes beside its bytes and its ids, about, and the bytes of the longest word that is remembered.
OVERHEAD, LONGEST = 140, 64
#: Windows that may stand partially filled in a task.
OPEN = 4096

#: Words whose cuts by the byte-level pre-tokenizer are known: Latin letters, ASCII digits, ASCII signs but the apostrophe, which opens contractions, and single line ends within.
PLAIN = r"\A[!-&(-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+(\n[!-&(-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)*\z"
#: Kinds of their bytes, at each change of which a cut is: 0 signs, 1 letters, 2 digits, 3 line ends, 4 the space before a word.
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]], KIND[48:58], KIND[10], KIND[32] = 1, 2, 3, 4
#: The characters that stand for bytes in byte-level files: printable ones for themselves, the others from U+0100 on.
LETTER = np.arange(256, dtype=np.uint16)
LETTER[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
#: First bytes that white space may have, last ones, and those before a last byte that isn't ASCII.
OPENS, CLOSES, INNER = np.zeros((3, 256), bool)
OPENS[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = CLOSES[[*range(9, 14), *range(28, 33)]] = INNER[[0xC2, 0x80, 0x81, 0x9A]] = True


class Words:
    """The ids a worker remembers of words, in two generations of `room` bytes: a full young one becomes the old one, and words still in use come back from there. Long words aren't remembered."""

    def __init__(self, room: int) -> None:
        self.room, self.used = room, 0
        #: Of each word: start << 16 | number of its ids in its generation's.
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.ids = self.old_ids = np.zeros(0, np.uint32)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Of each word start << 16 | number of its ids in those of the young generation with those of the old one behind, -1 where it isn't remembered."""
        found = np.fromiter(map(self.young.get, words, repeat(-1)), np.int64, len(words))
        if self.old:
            left = np.flatnonzero(found < 0)
            old = np.fromiter(map(self.old.get, [words[k] for k in left.tolist()], repeat(-1)), np.int64, len(left))
            found[left] = np.where(old < 0, -1, old + (len(self.ids) << 16))
        return found

    def put(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers words whose ids start there among `ids`; all of one call stay in one generation."""
        kept = [k for k, w in enumerate(words) if len(w) <= LONGEST]
        words, starts, sizes = [words[k] for k in kept], starts[kept], sizes[kept]
        self.young.update(zip(words, (len(self.ids) + np.cumsum(sizes) - sizes << 16 | sizes).tolist(), strict=True))
        self.ids = np.concatenate([self.ids, gather(ids, starts, sizes)])
        self.used += OVERHEAD * len(words) + sum(map(len, words)) + 4 * int(sizes.sum())
        if self.used > self.room:
            self.young, self.old, self.used = {}, self.young, 0
            self.ids, self.old_ids = np.zeros(0, np.uint32), self.ids


def margins(words: pa.StringArray, as_bytes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word whether it ends with white space, starts with it, is empty; empty ones do all."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    before, after, empty = np.zeros((3, len(words)), bool)
    empty[:] = ends[1:] == ends[:-1]
    some = np.flatnonzero(~empty)
    first, last = data[ends[some]], data[ends[some + 1] - 1]
    inner = data[np.maximum(ends[some + 1] - 2, ends[some])]
    before[empty] = after[empty] = True
    for k in some[OPENS[first] | CLOSES[last] | (last > 127) & INNER[inner]].tolist():
        w = as_bytes[k].decode()
        before[k], after[k] = w[-1].isspace(), w[0].isspace()
    return before, after, empty


class ByteBpe:
    """Token ids of texts, by a byte-level BPE file of the tokenizers library, which makes them all.

    Its pre-tokenizer never joins what stands before a space with the space, so ids of
    " word" don't depend on its context: each word is asked for once, many in one call, and
    remembered. Only where white space meets white space at a space may it be joined; such
    texts are encoded whole, as are all texts if the file splits or normalizes otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_words = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        known = self.library.get_vocab(with_added_tokens=True)
        self.starts_word = np.zeros(max(known.values(), default=0) + 1, bool)
        for token, k in known.items():
            self.starts_word[k] = token.startswith("\u0120")  # fixed value: how these files write a space
        #: The same model, for text that is cut at spaces and written as the file's characters already.
        self.precut = Tokenizer(self.library.model)
        self.precut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.cuts_known = all(t.get("special") for t in spec.get("added_tokens") or [])  # others would be found within words
        self.words = Words(REMEMBERED)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.ids(texts)]

    def joined(self, words: list[bytes]) -> np.ndarray:
        return self.ids([b" ".join([b"", *words]).decode()])[0]

    def plain(self, words: list[bytes]) -> np.ndarray:
        """Ids of PLAIN words, each with a space before it, cut as the pre-tokenizer does: saves the library its search and its account of places."""
        text = np.frombuffer(b" ".join([b"", *words]), np.uint8)
        kind = KIND[text]
        cut = kind == 4
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 4)
        out = np.full(len(text) + np.count_nonzero(cut), 32, "<u2")
        out[np.arange(len(text)) + np.cumsum(cut)] = LETTER[text]
        return np.array(self.precut.encode_batch_fast([out.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, np.uint32)

    def spaced(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of " word" for all words, and where each word's start among them and how many they are; plain: whether it is of PLAIN."""
        texts = {k: words[k].decode() for k in np.flatnonzero(~plain).tolist() if words[k]}
        joined = [k for k, w in texts.items() if w.strip() == w]
        rest = [k for k, w in texts.items() if w.strip() != w]
        found = self.ids([" " + texts[k] for k in rest])
        order, sizes = [np.array(rest, np.int64)], np.zeros(len(words), np.int64)
        sizes[rest] = list(map(len, found))
        for some, ask in ((np.flatnonzero(plain), self.plain), (np.array(joined, np.int64), self.joined)):
            for a in range(0, len(some), AT_ONCE):
                at = some[a : a + AT_ONCE]
                ids = ask([words[k] for k in at.tolist()])
                firsts = np.flatnonzero(self.starts_word[ids])
                if len(firsts) != len(at):
                    raise ValueError("a token starts with a space, and stands within a word")
                sizes[at] = np.diff(firsts, append=len(ids))
                order.append(at)
                found.append(ids)
        all_at, starts = np.concatenate(order), np.zeros(len(words), np.int64)
        starts[all_at] = np.cumsum(sizes[all_at]) - sizes[all_at]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), starts, sizes

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null: none."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return self.whole(texts.to_pylist())
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at, first = coded.indices.to_numpy().astype(np.int64), np.zeros(len(coded) + 1, bool)
        text_starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        first[text_starts[:-1]] = True
        # white space meets at a space
        before, after, empty = margins(coded.dictionary, words)
        meets = np.zeros(len(at) + 1, bool)
        meets[1:-1] = before[at[:-1]] & after[at[1:]] & ~first[1:-1]
        meets[:-1] |= empty[at] & ~first[:-1]
        odd = np.flatnonzero(np.add.reduceat(meets, text_starts[:-1]) > 0) if len(text_starts) > 1 else np.zeros(0, int)
        # the table: words after a space that are remembered, that are new, words at the start of a text, whole texts
        found = self.words.find(words)
        starts, sizes = found >> 16, found & 0xFFFF
        new = np.flatnonzero(found < 0)
        asked = [words[k] for k in new.tolist()]
        plain = pc.match_substring_regex(coded.dictionary.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False) if self.cuts_known else np.zeros(len(new), bool)
        young = len(self.words.ids)
        again = np.flatnonzero((found >= 0) & (starts >= young) & (sizes > 0))
        learned, learned_starts, sizes[new] = self.spaced(asked, plain)
        known = np.concatenate([self.words.ids, self.words.old_ids, learned])
        starts[new] = len(known) - len(learned) + learned_starts
        fresh = np.concatenate([again, new])
        self.words.put([words[k] for k in fresh.tolist()], known, starts[fresh], sizes[fresh])
        opening, where = np.unique(at[text_starts[:-1]], return_inverse=True)
        at[text_starts[:-1]] = len(words) + where
        at[text_starts[odd]] = len(words) + len(opening) + np.arange(len(odd))
        texts_ids = self.ids([words[k].decode() for k in opening.tolist()]) + self.ids(texts.take(pa.array(odd)).to_pylist())
        more = np.array(list(map(len, texts_ids)), np.int64)
        starts, sizes = np.concatenate([starts, len(known) + np.cumsum(more) - more]), np.concatenate([sizes, more])
        lengths = sizes[at]
        for k in odd.tolist():
            lengths[text_starts[k] + 1 : text_starts[k + 1]] = 0
        all_ids = gather(np.concatenate([known, *texts_ids]), starts[at], lengths)
        ends = np.r_[0, np.cumsum(lengths)][text_starts].tolist()
        return [all_ids[i:j].tobytes() for i, j in zip(ends, ends[1:])]


_TOKENIZERS: dict[str, ByteBpe] = {}


def tokenizer(path: str | None) -> ByteBpe:
    """One for each worker process, which keeps its words over the tasks."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBpe(path)
    return _TOKENIZERS[path]


#: A piece: doc_id, start, length, ids as bytes, the document's tokens.
Piece = tuple[int | None, int, int, bytes, int]


class SumOfSquares:
    """Packs pieces online; closed windows come out of add() and close() as lists of pieces."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.standing = 0

    def level(self, size: int) -> int:
        """The level of the window to take, 0 for a new one: the least change of the sum of squares; of equals the fullest."""
        n = self.count
        change = 2 * n[size : self.window + 1] + 1 - (2 * n[: self.window - size + 1] - 1)
        change[-1] = 1 - 2 * n[self.window - size]  # a full window counts no more
        change[0] = 2 * n[size] + 1
        change[1:][n[1 : self.window - size + 1] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def add(self, piece: Piece) -> list[Piece] | None:
        """The window that gets full, if one does."""
        size = piece[2]
        if size == self.window:
            return [piece]
        level = self.level(size)
        pieces = self.open[level].pop() if level else []
        self.count[level] -= bool(level)
        self.standing -= bool(level)
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.put(level + size, pieces)
        return None

    def put(self, level: int, pieces: list[Piece]) -> None:
        self.open[level].append(pieces)
        self.count[level] += 1
        self.standing += 1

    def drain(self) -> Iterator[list[Piece]]:
        """Full windows cut from all that stand partially filled, the fullest first; the rest stands as one."""
        rest: list[Piece] = []
        size = 0
        standing, self.open = self.open, [[] for _ in self.open]
        self.count[:], self.standing = 0, 0
        for pieces in (p for level in reversed(standing) for p in level):
            for doc, start, length, ids, total in pieces:
                while size + length >= self.window:
                    n = self.window - size
                    yield [*rest, (doc, start, n, ids[: 4 * n], total)]
                    rest, size, start, length, ids = [], 0, start + n, length - n, ids[4 * n :]
                if length:
                    rest.append((doc, start, length, ids, total))
                    size += length
        if size:
            self.put(size, rest)

    def close(self) -> Iterator[list[Piece]]:
        """Full windows, and the last rest in sequences whose lengths are powers of two."""
        yield from self.drain()
        rest = [p for level in self.open for pieces in level for p in pieces]
        size = sum(p[2] for p in rest)
        while size:
            n, taken = 1 << size.bit_length() - 1, []
            size -= n
            while n:
                doc, start, length, ids, total = rest.pop(0)
                k = min(n, length)
                taken.append((doc, start, k, ids[: 4 * k], total))
                if k < length:
                    rest.insert(0, (doc, start + k, length - k, ids[4 * k :], total))
                n -= k
            yield taken


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _pack(window: int, path: str | None, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = tokenizer(path), SumOfSquares(window), struct.pack("<I", END)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def closed(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, ids, total in pieces:
                rows.append((doc, start, length, crc32(ids), total, sequence, offset, ids if keep else None))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_PIECES), _PIECES, strict=True)], schema=_PIECES)
            rows.clear()
            return out if keep else out.select(_PIECES.names[:-1])

        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        if done := packer.add((doc, start, len(piece) // 4, piece, total)):
                            closed(done)
                        if packer.standing > OPEN:
                            for done in packer.drain():
                                closed(done)
                        if len(rows) >= AT_ONCE:
                            yield flush()
                yield flush()
        for pieces in packer.close():
            closed(pieces)
        yield flush()

    return pack


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, keep: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of docs(doc_id long, text).

    Each id of each document, and the end id 0 after them, lies in exactly one piece. Null
    and empty texts are the end id alone. Repeated rows are packed once each; an empty
    table gives no piece; other columns are left out. ids: little-endian unsigned 32-bit.
    sequence_id numbers the sequences within a task, the task's number in its upper bits.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_pack(window, path, keep)), schema)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep=False)
