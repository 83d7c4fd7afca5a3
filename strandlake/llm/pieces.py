"""SentencePiece encoding and decoding by a Viterbi pass over a trie of words.

Text is marked as the library does (spaces become U+2581, one is put before), and cut into
words, each the marks before it and what follows up to the next mark; no piece of the
vocabulary goes beyond one. The distinct words of a chunk of text are sorted, which is the
depth-first order of their trie: each word shares its leading characters with the word
before, and the forward states of that prefix stay on the stack and are used again.

The forward state of a prefix is the last piece of its best segmentation. What "best" means
is said by the model file's type:
* unigram: the state also has the sum of the pieces' log probabilities, and the largest wins;
  of equal sums that with the longest last piece (the library's choice among these depends on
  how its single-precision sums were rounded over the text before).
* byte-pair (the public file): its scores are ranks of merges, whose sum means nothing, so no
  score is carried. In its place the recurrence asks which last piece is *stable*: merging the
  text of the prefix's last piece and of the last piece before it gives these two back. This
  is exact, as merging works pair by pair: a segmentation is the one merging makes if and
  only if each piece and each pair of neighbours is what merging makes of its own text, and
  the merge result is unique, so exactly one piece that ends at a place passes.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import Memory, bounded_batches, chunks, gather, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of a generation of words, of which a worker remembers two, pairs of pieces it has judged, and bytes of text it encodes at a time.
REMEMBERED, PAIRS, CHUNK = 64 << 20, 400_000, 4 << 20
#: Fixed values of the model format: places of the trainer's part and of its model type, the type's names, what an unknown character costs below the worst piece.
TRAINER, MODEL_TYPE, TYPES, UNKNOWN_COST = 2, 3, {1: "unigram", 2: "bpe"}, 10.0
#: Fixed values of the model format: places of a piece, its type and of the normalizer's part; of that the fields that are read, with their defaults and what is supported.
PIECE, PIECE_TYPE, USER_DEFINED, NORMALIZER = 1, 3, 4, 3
NORMALIZER_FIELDS = (("precompiled_charsmap", 2, b"", b""), ("add_dummy_prefix", 3, 1, 1), ("remove_extra_whitespaces", 4, 1, 0), ("escape_whitespaces", 5, 1, 1))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


def model_type(file: bytes) -> str:
    """"unigram" (also if the file doesn't say) or "bpe"; other kinds are refused."""
    trainer = b"".join(v for k, v in _fields(file) if k == TRAINER and isinstance(v, bytes))
    kind = ([1] + [v for k, v in _fields(trainer) if k == MODEL_TYPE])[-1]
    if kind not in TYPES:
        raise ValueError("only unigram and byte-pair models are supported")
    return TYPES[kind]


def check_normalizer(file: bytes) -> None:
    """Refuses model files that change the text before it is cut (mapped characters, extra spaces removed, no mark put before it, spaces kept) or have pieces of the user's own, as ids would differ from the library's."""
    spec = b"".join(v for k, v in _fields(file) if k == NORMALIZER and isinstance(v, bytes))
    told = dict(_fields(spec))
    wrong = [name for name, field, default, wanted in NORMALIZER_FIELDS if told.get(field, default) != wanted]
    if any(dict(_fields(v)).get(PIECE_TYPE) == USER_DEFINED for k, v in _fields(file) if k == PIECE and isinstance(v, bytes)):
        wrong.append("user-defined pieces")
    if wrong:
        raise ValueError(f"models with these parts of a normalizer aren't supported: {', '.join(wrong)}")


codecs.register_error("replace_each_byte", lambda e: ("\ufffd", e.start + 1))  # as the library does


class Pieces:
    """The vocabulary of a model file, and the forward pass over it."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            file = f.read()
        library = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.unigram = model_type(file) == "unigram"
        check_normalizer(file)
        self.text, self.byte, self.score, self.id = {}, {}, {}, {}
        for k in range(library.get_piece_size()):
            piece = library.id_to_piece(k)
            self.score[k] = library.get_score(k)
            if library.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
            elif not (library.is_control(k) or library.is_unknown(k) or library.is_unused(k)):
                self.text[k], self.id[piece] = piece, k
        self.unknown = library.unk_id()
        self.longest = max(map(len, self.id))
        self.ending: dict = {}  # a trie of the pieces, read from their ends; the key "" marks a piece
        for piece in self.id:
            node = self.ending
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        self.byte_of = {k: b for b, k in self.byte.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces go beyond a word")
        self.words = Memory(REMEMBERED)
        self.whole: dict[str, bool] = {}
        self.packed = {piece: struct.pack("<i", k) for piece, k in self.id.items()}
        self.stable: dict[tuple[str, str], bool] = {}
        self.worst = min((self.score[k] for k in self.id.values()), default=0.0) - UNKNOWN_COST
        # bytes of each id: of its piece, marks being spaces; of a byte piece the byte itself
        written = [b""] * library.get_piece_size()
        for k, piece in self.text.items():
            written[k] = piece.replace(MARK, " ").encode()
        for k, b in self.byte_of.items():
            written[k] = bytes([b])
        if 0 <= self.unknown < len(written):
            written[self.unknown] = " ⁇ ".encode()
        self.size = np.array([len(w) for w in written], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.opens = np.array([self.text.get(k, "").startswith(MARK) for k in range(len(written))], bool)

    def keeps_border(self, left: str, right: str) -> bool:
        """Whether the merge rule (the pair of neighbours with the best score becomes one, the leftmost of equals) makes left and right of their characters, and never joins the two."""
        parts, border, known, score = [*left, *right], len(left), self.id, self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = known.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                return parts == [p for p in (left, right) if p]
            if at == border - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            border -= at < border

    def last_piece(self, word: str, end: int, last: list[int], score: list[float]) -> int:
        """Forward state of word[:end], given those of shorter prefixes: the length of the last piece; the score is appended, for unigram models."""
        if self.unigram:
            best, value = 1, score[end - 1] + self.worst  # a character outside the vocabulary
            for n in range(1, min(self.longest, end) + 1):
                k = self.id.get(word[end - n : end])
                if k is not None and (n == 1 or score[end - n] + self.score[k] >= value):
                    best, value = n, score[end - n] + self.score[k]
            score.append(value)
            return best
        node, fits = self.ending, []
        for n in range(1, end + 1):
            node = node.get(word[end - n])
            if node is None:
                break
            if "" in node:
                fits.append((n, node[""]))
        if not fits or fits[0][0] > 1:
            fits.insert(0, (1, word[end - 1]))
        stable, whole = self.stable, self.whole
        for n, piece in reversed(fits):
            if n > 1:
                good = whole.get(piece)
                if good is None:
                    good = whole[piece] = self.keeps_border("", piece)
                if not good:
                    continue
            before = last[end - n]
            if not before:
                return n
            left = word[end - n - before : end - n]
            good = stable.get((left, piece))
            if good is None:
                if len(stable) > PAIRS:
                    stable.clear()
                good = stable[left, piece] = self.keeps_border(left, piece)
            if good:
                return n
        raise AssertionError("merging gives each prefix a last piece")

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of the words, depth-first over their trie."""
        found: dict[str, bytes] = {}
        before, last, score, packed = "", [0], [0.0], self.packed
        for word in sorted(words):
            shared = len(os.path.commonprefix([before, word]))
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last.append(self.last_piece(word, end, last, score))
            out, end = [], len(word)
            while end:
                piece = word[end - last[end] : end]
                out.append(packed.get(piece) or struct.pack(f"<{len(k := self.ids(piece))}i", *k))
                end -= last[end]
            out.reverse()
            found[word] = b"".join(out)
            before = word
        return found

    def ids(self, piece: str) -> list[int]:
        """Id of a piece; of a character outside the vocabulary its bytes, or the unknown id."""
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte[b] for b in piece.encode()] if self.byte else [self.unknown]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [marked_words(t) for t in texts]
        words = list(set().union(*cut))
        ids = dict(zip(words, self.ids_of(words), strict=True))
        out = [b"".join(map(ids.__getitem__, c)) for c in cut]
        return [self.fused(x) for x in out] if self.unigram and not self.byte else out

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of marked words, remembered or learned."""
        found = self.words.known(words)
        new = [k for k, x in enumerate(found) if x is None]
        learned = self.learn([words[k] for k in new])
        for k in new:
            found[k] = learned[words[k]]
        self.words.put(list(learned), list(learned.values()))
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and end; null: none.

        Words are told apart and made one by Arrow; texts whose words may have other than one
        mark before them go the way of encode().
        """
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy().astype(np.int64)
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        odd = np.fromiter((not w or MARK in w for w in words), bool, len(words))
        rest = np.flatnonzero(np.add.reduceat(odd[at].astype(np.int64), starts[:-1]) > 0)
        if self.unigram and not self.byte:
            rest = np.arange(len(texts))  # unknown characters may meet over a text
        ids = [b""] * len(words)
        plain = np.flatnonzero(~odd).tolist()
        for k, x in zip(plain, self.ids_of([MARK + words[k] for k in plain]), strict=True):
            ids[k] = x
        at[starts[rest]] = len(ids) + np.arange(len(rest))
        ids += self.encode(texts.take(pa.array(rest)).to_pylist())
        skipped = np.zeros(len(at), bool)
        for k in rest.tolist():
            skipped[starts[k] + 1 : starts[k + 1]] = True
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lengths = np.where(skipped, 0, size[at])
        values = gather(np.frombuffer(b"".join(ids), np.int32), (np.cumsum(size) - size)[at], lengths)
        return values, np.r_[0, np.cumsum(lengths)][starts]

    def fused(self, ids: bytes) -> bytes:
        """Unigram models give a run of unknown characters one id."""
        k = np.frombuffer(ids, np.int32)
        unknown = k == self.unknown
        return k[~(unknown & np.r_[False, unknown[:-1]])].tobytes() if unknown.any() else ids

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids[ends[0]:ends[1]], ids[ends[1]:ends[2]] and so on. Ids that the vocabulary hasn't got give nothing."""
        ids = ids[ends[0] : ends[-1]].astype(np.int64)
        ends = ends - ends[0]
        known = (ids >= 0) & (ids < len(self.size))
        ids = np.where(known, ids, 0)
        size = np.where(known, self.size[ids], 0)
        at = np.r_[0, np.cumsum(size)][ends].tolist()
        written = gather(self.written, self.start[ids], size).tobytes()
        out, silent = [], np.r_[0, np.cumsum(size == 0)][ends].tolist()
        for i, j, a, b, s, t in zip(ends.tolist(), ends[1:].tolist(), at, at[1:], silent, silent[1:]):
            kept = ids[i:j][known[i:j]]
            try:
                text = written[a:b].decode() if s == t else self.mended(kept.tolist())
            except UnicodeDecodeError:  # byte pieces that are no text: each run by itself
                text = self.mended(kept.tolist())
            shown = kept[self.size[kept] > 0]
            out.append(text[1:] if len(shown) and self.opens[shown[0]] else text)
        return out

    def mended(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for k in [*ids, -1]:
            if k in self.byte_of:
                pending.append(self.byte_of[k])
                continue
            out.append(pending.decode(errors="replace_each_byte"))
            pending.clear()
            if k >= 0:
                out.append(self.written[self.start[k] : self.start[k] + self.size[k]].tobytes().decode())
        return "".join(out)


def marked_words(text: str) -> list[str]:
    """Words of the marked text, each with the marks before it. Empty text: none."""
    if not text:
        return []
    words, marks = [], MARK
    for w in text.replace(" ", MARK).split(MARK):
        if w:
            words.append(marks + w)
            marks = MARK
        else:
            marks += MARK
    return words + [marks[:-1]] * (len(marks) > 1)


_MODELS: dict[str, Pieces] = {}


def model(path: str | None = None) -> Pieces:
    """One for each worker process, which keeps its words over the tasks."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _encode(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                values, ends = m.encode_column(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], names=["doc_id", "ids"])

    return encode


def _decode(path: str | None, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch.column("ids")
            texts = m.decode(pc.fill_null(ids.values, -1).to_numpy(zero_copy_only=False), ids.offsets.to_numpy())
            null = ids.is_null().to_pylist()
            column = pa.array([None if n else t for t, n in zip(texts, null, strict=True)], pa.string())
            if digest:
                column = pa.array([None if n else hashlib.sha256(t.encode()).hexdigest() for t, n in zip(texts, null, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, column], names=["doc_id", "ids", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "text"])

    return decode


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text). Null and empty texts: no ids. Repeated rows come back once each; other columns are left out; an empty table gives an empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids). Null ids: null; ids outside the vocabulary, null ones among them, and control ids: nothing. Repeated rows come back once each; other columns are left out; an empty table gives an empty one."""
    bounded_batches(encoded.sparkSession)
    return _coded(encoded).mapInArrow(_decode(path, False), "doc_id long, text string")


def _coded(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))


def op8_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): every document encoded, and its ids decoded again; the digest is that of the decoded text in UTF-8."""
    return _coded(encode(table(spark, sf_dir, "documents"))).mapInArrow(_decode(None, True), "doc_id long, ids array<int>, decoded_sha256 string")
