"""Toxicity, packing, SentencePiece, HTML, media and sharding."""

import hashlib
import html
import os
import random
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import html_text, jpeg, media, packing, pieces, queries, sharding, toxicity
from strandlake.llm.common import table
from tests.llm.conftest import SF


def all_maximal(s):
    """By the definition: the best segment (the first shortest of equals), then the same left and right of it."""
    total = np.r_[0, np.cumsum(s)]
    best = max(((total[b] - total[a], -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a = -best[2]
    b = a - best[1]
    return all_maximal(s[:a]) + [(a, b)] + [(b + x, b + y) for x, y in all_maximal(s[b:])]


def test_maximal_segments():
    r = random.Random(2)
    for _ in range(300):
        s = np.array([r.choice([-3.1, -2.3, -1.7, 0.9, 1.3, 2.9]) + r.random() / 100 for _ in range(r.randint(0, 14))])
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == all_maximal(s)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    benign = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    bad = ["zorblat" + x for x in ("", "en", "ish", "y")] + ["quux", "vile"]
    rows, labels = [], []
    for k in range(1200):
        words = [r.choice(benign) for _ in range(r.randint(10, 120))]
        toxic = int(k % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(r.randint(0, len(words)), r.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    rows += [(5000, None), (5001, ""), (5002, "zorblatter zorblatest zorblated")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_toxic_documents_are_told_from_clean_ones(spark, labelled):
    docs, labels = labelled
    m = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 5000]
    assert {r.doc_id for r in got.values() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert got[5002].predicted == 1 and got[5000].predicted == 0 and 0 <= got[5001].score < 0.3
    assert got[5002].passages
    clean = toxicity.without_toxic(docs, labels)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, r in got.items() if not r.predicted)


def test_labels_of_held_out_rows_change_nothing(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.toxic == b.toxic).all() and (a.decay, a.scale, a.intercept, a.slope) == (b.decay, b.scale, b.intercept, b.slope)


def test_scores_by_brute_force(spark, labelled):
    docs, labels = labelled
    m = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    known = {r.doc_id: r.toxic for r in labels.where("doc_id is not null and toxic is not null").collect()}

    def cell(k, text):  # where the operator's hash puts a prefix or a token
        b = np.frombuffer(text, np.uint8)
        return int(toxicity.cells(b, np.array([0]), np.array([len(b)]))[-1, 0]) if k == len(toxicity.PREFIXES) else int(toxicity.cells(np.r_[b, b[:1]], np.array([0]), np.array([len(b) + 1]))[k, 0])

    def levels(token):
        t = token.encode()
        return [cell(k, t[:n]) for k, n in enumerate(toxicity.PREFIXES) if len(t) > n] + [cell(len(toxicity.PREFIXES), t)]

    def words(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), text))

    toxic, every = {}, {}
    for i, t in texts.items():
        if i in known and zlib.crc32(str(i).encode()) % 4 in (0, 1):
            for c in (c for w in words(t) for c in levels(w)):
                every[c] = every.get(c, 0) + 1
                toxic[c] = toxic.get(c, 0) + known[i]
    assert {c: n for c, n in enumerate(m.all) if n} == every and all(m.toxic[c] == n for c, n in toxic.items())
    base = sum(toxic.values()) / sum(every.values())
    for i, t in list(texts.items())[::7] + [(5000, texts[5000]), (5001, texts[5001]), (5002, texts[5002])]:
        s = []
        for w in words(t):
            p = base
            for c in levels(w):
                p = (toxic.get(c, 0) + m.prior * p) / (every.get(c, 0) + m.prior)
            p = min(max(p, 1e-6), 1 - 1e-6)
            s.append(np.log(p / (1 - p)) - np.log(base / (1 - base)) - m.drift)
        found = [m.decay * sum(s[a:b]) - np.log(max(len(s), 1)) - m.scale for a, b in all_maximal(s)]
        want = 1 / (1 + np.exp(-(m.intercept + m.slope * sum(max(x, 0) for x in found))))
        assert got[i].score == pytest.approx(want, abs=1e-5) and got[i].predicted == (want >= toxicity.THRESHOLD)
        assert got[i].n_passages == sum(x >= toxicity.SIGNIFICANT for x in found)


def test_choices_are_made_without_held_out_rows(spark, labelled):
    docs, labels = labelled
    m = toxicity.fit(docs, labels)
    assert (m.prior, m.drift) in {(p, d) for p in toxicity.PRIORS for d in toxicity.DRIFTS}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = toxicity.fit(docs.where(~held), labels.where(~held))
    assert (m.prior, m.drift, m.decay, m.intercept, m.slope) == pytest.approx((other.prior, other.drift, other.decay, other.intercept, other.slope))


def test_decay_of_scores():
    value = (np.arange(toxicity.BINS) - toxicity.BINS // 2) * toxicity.SCORE_STEP
    for places, weights in (((100, 260), (90, 10)), ((250, 257), (999, 1)), ((0, 511), (10**9, 1)), ((200, 300, 400), (50, 3, 1))):
        w = np.zeros(toxicity.BINS)
        w[list(places)] = weights
        root = toxicity.decay_of(value, w)
        got = sum(n * np.exp(root * value[k]) for k, n in zip(places, weights)) / sum(weights)
        assert root > 0 and (abs(got - 1) < 1e-6 or root > 60)
    assert toxicity.decay_of(value, np.zeros(toxicity.BINS)) == 1.0


def test_counts_add_up_over_many_tasks(spark, labelled, monkeypatch):
    docs, labels = labelled
    rows = docs.join(labels.where("toxic is not null"), "doc_id").select(F.col("text").cast("binary").alias("text"), "toxic")
    one = toxicity.counted_cells(rows.coalesce(1))
    monkeypatch.setattr(toxicity, "FAN", 2)
    many = toxicity.counted_cells(rows.repartition(9))
    assert all((a == b).all() for a, b in zip(one, many, strict=True)) and one[1].sum() > 0


def test_repeated_rows_clashing_columns_and_no_rows(spark, labelled):
    docs, labels = labelled
    m = toxicity.fit(docs, labels)
    odd = docs.where("doc_id in (0, 1)").union(docs.where("doc_id in (0, 1)")).selectExpr("*", "1 as toxic", "2 as score", "3 as half")
    assert len({(r.doc_id, r.score) for r in toxicity.score(odd, m).collect()}) == 2 and toxicity.score(odd, m).count() == 4
    assert toxicity.score(odd.limit(0), m).count() == 0
    kept = toxicity.without_toxic(docs.selectExpr("*", "1 as toxic", "2 as half"), labels)
    assert kept.columns == ["doc_id", "text", "toxic", "half"] and {r.doc_id for r in kept.where("doc_id >= 5000").collect()} >= {5000, 5001}
    assert toxicity.fit(docs.limit(0), labels) is None


def test_no_labels(spark, labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_packing_keeps_every_id_once(odd_docs, odd_texts):
    tk = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tk.encode_special_tokens = True
    rows = packing.pack(odd_docs, 64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(odd_texts)
    for i, t in odd_texts.items():
        ids, at = tk.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            want = struct.pack(f"<{r.length}I", *ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(want), want)
            at += r.length
        assert at == len(ids)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        n = sum(r.length for r in s)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and (n == 64 or n & (n - 1) == 0)


def test_level_choice_has_the_least_sum_of_squares():
    r = random.Random(9)
    p = packing.SumOfSquares(16)
    for _ in range(400):
        size, count = r.randint(1, 15), p.count.copy()

        def cost(level, size=size, count=count):
            n = count.copy()
            n[level] -= bool(level)
            if level + size < 16:
                n[level + size] += 1
            return int((n[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 17 - size) if count[h]]
        assert cost(p.level(size)) == min(map(cost, options))
        p.add((0, 0, size, b"\0" * 4 * size, size))
        assert [len(x) for x in p.open] == p.count.tolist()


def test_tokenizer_on_white_space():
    tk = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tk.encode_special_tokens = True
    e = packing.tokenizer(None)
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "Bc", "'s", "12", "!?", " ", " ", "  ", "\n", "\t", "\x1c", "\u2009", "é", "日", "<|endoftext|>"]) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    want = [struct.pack(f"<{len(x)}I", *x) for x in (tk.encode(t, add_special_tokens=False).ids for t in texts)]
    assert e.encode(pa.array([*texts, None])) == [*want, b""]
    assert e.encode(pa.array([], pa.string())) == []
    assert e.encode(pa.array(["x", *texts])[1:]) == want  # a slice, whose offsets start elsewhere


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "日" * 700_000, "a" + " b" * 700_000])
def test_tokenizer_on_very_long_runs(text):
    e = packing.tokenizer(None)
    assert e.encode(pa.array([text, "x y"])) == e.whole([text, "x y"])
    assert e.words.used <= e.words.room


def test_plain_words_pass_the_pre_tokenizer_by():
    e, r = packing.ByteBpe(public_tokenizers.path(packing.TOKENIZER)), random.Random(5)
    texts = ["".join(r.choice("abcdeéñ.,1\n") for _ in range(9)).strip() for _ in range(5000)]
    want, library = e.whole(["a " + " ".join(texts)]), e.library
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    e.library = Counting()
    assert e.encode(pa.array(["a " + " ".join(texts)])) == want
    assert sum(map(len, asked)) < sum("\n\n" in t for t in texts) * 10 + 100


def test_cuts_within_plain_words_are_the_librarys():
    e, r = packing.ByteBpe(public_tokenizers.path(packing.TOKENIZER)), random.Random(6)
    signs, letters = [chr(c) for c in range(33, 127)], [chr(c) for c in range(0xA0, 0x260)]
    words = [a + b for a in signs for b in [*signs, "\n.", "\nA"]] + [x for c in letters for x in (c, f"a{c}", f"{c}1", f"!{c}", f"{c}\n{c}")]
    words += ["".join(r.choice([*signs, *letters, "\n", "aß", "日", "'ll"]) for _ in range(r.randint(1, 8))) for _ in range(20000)]
    texts = [f"x {w} y" for w in words]
    assert e.encode(pa.array(texts)) == e.whole(texts)
    assert e.encode(pa.array(texts)) == e.whole(texts)  # as remembered


def test_words_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20000)
    e, r = packing.ByteBpe(public_tokenizers.path(packing.TOKENIZER)), random.Random(7)
    for _ in range(60):
        texts = [" ".join(str(int(r.paretovariate(0.4)) % 10**6) + "é" for _ in range(30)) for _ in range(3)]
        assert e.encode(pa.array(texts)) == e.whole(texts)
        assert e.words.used <= e.words.room and e.words.young.keys() | e.words.old.keys()
    assert e.words.old


def test_white_space_of_all_kinds_at_a_space():
    e = packing.tokenizer(None)
    space = [c for c in map(chr, range(0x11000)) if c.isspace()]
    words = [*space, *(f"a{c}" for c in space), *(f"{c}a" for c in space), "", "é", "à", "日", "“", "‐", "a", "¿"]
    texts = [f"{a} {b}" for a in words for b in words]
    assert e.encode(pa.array(texts)) == e.whole(texts)
    coded = pa.array(["-", *words])[1:]
    before, after, empty = packing.margins(coded, [w.encode() for w in words])
    assert before.tolist() == [not w or w[-1].isspace() for w in words] and after.tolist() == [not w or w[0].isspace() for w in words] and empty.tolist() == [not w for w in words]


def test_open_windows_are_bounded():
    r = random.Random(4)
    p, seen = packing.SumOfSquares(64), []
    for doc in range(3000):  # remainders over half a window never meet another
        n = r.randint(40, 63)
        done = [p.add((doc, 0, n, b"....".replace(b".", bytes([doc % 251])) * n, n))]
        if p.standing > 50:
            done += p.drain()
        seen += [x for x in done if x]
        assert p.standing == sum(map(len, p.open)) == p.count.sum() <= 51
    seen += p.close()
    held = {}
    for pieces_ in seen:
        for doc, start, n, ids, total in pieces_:
            assert len(ids) == 4 * n and set(ids) == {doc % 251}
            held.setdefault(doc, []).append((start, n, total))
    for at in held.values():
        at.sort()
        assert [s for s, _, _ in at] == [0, *np.cumsum([n for _, n, _ in at])[:-1]] and sum(n for _, n, _ in at) == at[0][2]
    assert len(held) == 3000 and sum(sum(p[2] for p in x) != 64 for x in seen) <= 7


def test_packing_of_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x")] * 3 + [(None, None, "y")], "doc_id long, text string, ids string")
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 1)] + [(1, 3)] * 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_pieces_are_the_librarys_and_decode_again(odd_docs, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    got = pieces.encode(odd_docs)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: library.encode(t or "") for i, t in odd_texts.items()}
    assert {r.doc_id: r.text for r in pieces.decode(got).collect()} == {i: t or "" for i, t in odd_texts.items()}
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "e", "the", "ing", " ", "  ", "\n", "é", "🎉", "<s>", "▁", "ss", "aaa"]) for _ in range(r.randint(0, 15))) for _ in range(800)]
    assert [np.frombuffer(b, np.int32).tolist() for b in pieces.model().encode(texts)] == [library.encode(t) for t in texts]
    for part in (pa.array(texts), pa.array(["x", *texts])[1:], pa.array([], pa.string())):
        values, ends = pieces.model().encode_column(part)
        assert [values[i:j].tolist() for i, j in zip(ends, ends[1:])] == [library.encode(t) for t in part.to_pylist()]


def unigram_model(path, pieces_, normalizer=((1, b"identity"), (3, 1), (4, 0), (5, 1)), kind=1):
    """A model file: unknown id 0, the given pieces with their log probabilities; normally with identity normalization."""

    def field(k, value):
        if isinstance(value, int):
            return bytes([k << 3, value])
        if isinstance(value, float):
            return bytes([k << 3 | 5]) + struct.pack("<f", value)
        assert len(value) < 128
        return bytes([k << 3 | 2, len(value)]) + value

    body = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    body += b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s in pieces_)
    body += field(2, field(3, 1)) + field(3, b"".join(field(*x) for x in normalizer))
    path.write_bytes(body)
    return str(path)


def test_models_that_change_the_text_are_refused(tmp_path):
    made = [("▁", -1.0), ("a", -2.0)]
    for k, (spec, word) in enumerate([(((3, 1),), "extra"), (((4, 0), (3, 0)), "dummy"), (((4, 0), (5, 0)), "escape"), (((4, 0), (2, b"map")), "charsmap"), ((), "extra")]):
        file = tmp_path / f"{k}.model"
        unigram_model(file, made, spec)
        with pytest.raises(ValueError, match=word):
            pieces.check_normalizer(file.read_bytes())
    unigram_model(tmp_path / "own.model", made, kind=4)
    with pytest.raises(ValueError, match="user-defined"):
        pieces.check_normalizer((tmp_path / "own.model").read_bytes())
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        pieces.check_normalizer(f.read())


def test_unigram_models_are_the_librarys(tmp_path, spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b", "ab", "c", "z", "zz", " ", "  ", "abc"]) for _ in range(r.randint(0, 12))) for _ in range(600)]
    for n in range(4):
        made = sorted({"".join(r.choice("▁abc") if not k else r.choice("abc") for k in range(r.randint(1, 4))) for _ in range(25)} | {"▁", "a", "b"})
        path = unigram_model(tmp_path / f"{n}.model", [(p, -r.random() * 9 - 0.5) for p in made])
        library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
        assert own.unigram
        same = 0
        for b, t in zip(own.encode(texts), texts):
            got, want = np.frombuffer(b, np.int32).tolist(), library.encode(t)
            same += got == want
            assert sorted(got) == sorted(want)  # the order of pieces may differ where sums are equal
        assert same >= 0.98 * len(texts)
    docs = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    assert {x.doc_id: sorted(x.ids) for x in pieces.encode(docs, path).collect()} == {k: sorted(library.encode(t)) for k, t in enumerate(texts[:20])}
    assert not pieces.model().unigram


def test_decoding_of_odd_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    r, m = random.Random(8), pieces.model()
    lists = [[r.choice([0, 1, 2, 3, 100, 140, 200, 230, 29871, r.randrange(32000)]) for _ in range(r.randint(0, 9))] for _ in range(500)]
    ends = np.r_[0, np.cumsum([len(x) for x in lists])]
    assert m.decode(np.array([k for x in lists for k in x]), ends) == [library.decode(x) for x in lists]
    rows = [(1, [450, None, 99999, -5]), (1, [450, None, 99999, -5]), (None, None), (2, [])]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("*", "1 as text")).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got if x.text is not None) == [(1, library.decode([450]))] * 2 + [(2, "")]
    assert [x.text for x in got if x.doc_id is None] == [None]


def test_pieces_query(spark):
    docs = {x.doc_id: x.text or "" for x in table(spark, SF, "documents").collect()}
    got = pieces.op8_shared_prefix_viterbi(spark, SF).collect()
    assert {x.doc_id: x.decoded_sha256 for x in got} == {i: hashlib.sha256(t.replace("▁", " ").encode()).hexdigest() for i, t in docs.items()}
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_remembered_are_bounded_by_bytes():
    m = pieces.model()
    r = random.Random(2)
    line = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(2000))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert [np.frombuffer(b, np.int32).tolist() for b in m.encode([line])] == [library.encode(line)]
    assert "▁" + line not in m.words.young and m.words.used <= m.words.room


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


@pytest.mark.parametrize("bits", [10, 1 << 30])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_text, "TRACE_BITS", bits)
    r = random.Random(bits)
    for _ in range(1000):
        a, b = ([r.choice(x) for _ in range(r.randrange(12))] for x in ("abcde", "abcdf"))
        x, y = html_text.shared(a, b)
        assert len(x) == len(y) == lcs(a, b) and [a[i] for i in sorted(x)] == [b[i] for i in sorted(y)]


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = html_text.extract(table(spark, SF, "pages")).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert (r.text, r.n_chars) == (t := "\n".join(b for b in blocks if b), len(t))


def test_boilerplate_of_pages_without_an_article(spark):
    page = "<html><body class='with-menu'><div id=top>Site name</div><div class='site-menu'>Home</div><div>{}</div><p>All rights &copy;</p><form>Name</form><section class=comments><p>Nice!</p></section><!-- x --><script>if (a<b) x='</p>'</script></body></html>"
    rows = [(1, "http://h/a/10", page.format("First  text<br>goes on")), (2, "http://h/a/11", page.format("Second &amp; text")), (3, "http://other/", "<p>Alone<p>here"), (4, None, None), (5, "http://h/a/12", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First text goes on", 2: "Second & text", 3: "Alone\nhere", 4: "", 5: ""}
    copies = spark.createDataFrame([(1, "http://h/x", "<p>Same</p>"), (2, "http://h/x", "<p>Same</p>")], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(copies).collect()} == {"Same"}
    assert html_text.extract(copies.limit(0)).count() == 0


TEMPLATE = "<html><body><div>Site name</div><main><div>Sections of the site</div>{}<div>All rights reserved</div></main></body></html>"
STORY = "<article><h1>{0}</h1><div class=line>By the staff of the site</div><p>Prose of {0}.</p><p>A saying that both quote.</p><div>Follow us for more</div></article>"


def extracted(spark, *rows_):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(list(rows_), "page_id long, url string, html string")).collect()}


def test_differencing_decides_the_text(spark, monkeypatch):
    one, two = TEMPLATE.format(STORY.format("One")), TEMPLATE.format(STORY.format("Two, which is longer"))
    got = extracted(spark, (1, "http://h/a/1", one), (2, "http://h/a/2", two))
    assert got == {1: "One\nProse of One.\nA saying that both quote.", 2: "Two, which is longer\nProse of Two, which is longer.\nA saying that both quote."}
    plain = [(k, f"http://h/b/{k}", TEMPLATE.format(f"<div>Text number {k}</div>")) for k in range(3)]
    assert extracted(spark, *plain) == {k: f"Text number {k}" for k in range(3)}
    # without a page to compare with, or if nothing were shared, template stays
    assert extracted(spark, (1, "http://h/a/1", one))[1] == "One\nBy the staff of the site\nProse of One.\nA saying that both quote.\nFollow us for more"
    a, b = (html_text.Page(k, "", "h", "/", *map(list, zip(*html_text.lines(h), strict=True))) for k, h in enumerate((one, two)))
    assert "Follow us" not in html_text.main_text(a, [b])[0]
    monkeypatch.setattr(html_text, "shared", lambda a, b: (set(), set()))
    assert "Follow us" in html_text.main_text(a, [b])[0]


def test_copies_are_compared_with_the_other_neighbour(spark):
    body = "<div>" + "A long text that stands on two pages. " * 9 + "</div>"
    rows = [(1, "http://h/a/x1", TEMPLATE.format(body)), (2, "http://h/a/x2", TEMPLATE.format(body + "<div>One more line</div>")), (3, "http://h/b", TEMPLATE.format("<div>Another</div>")), (0, "http://h/a/a", TEMPLATE.format("<div>First</div>"))]
    long = " ".join(["A long text that stands on two pages."] * 9)
    assert extracted(spark, *rows) == {0: "First", 1: long, 2: long + "\nOne more line", 3: "Another"}


def test_repeated_pages_and_other_columns(spark):
    rows = [(1, "http://h/1", "<p>One</p><p>Same</p>", "x")] * 2 + [(2, "http://h/2", "<p>Two</p><p>Same</p>", "y"), (None, "http://h/3", "<p>Three</p><p>Same</p>", "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "Three"), (1, "One"), (1, "One\nSame"), (2, "Two")]


@pytest.mark.parametrize("page, want", [
    ('<p>x <a title="5" class=z y">quote" here</a> tail</p>', "x quote\" here tail"),
    ('<p>a <b title="no end>bold</b> c</p>', "a bold c"),
    ("<p>1 < 2 <3 and </ p> & 4</p><p>next", "1 < 2 <3 and & 4\nnext"),
    ("<p>one<!-- never ends <p>two", "one"),
    ("<p>one<!d <p>two", "onetwo"),
    ("<P CLASS = 'Comment'>no<P>yes<script>x</SCRIPT >", "yes"),
    ("<div/>a<br/>b<a b=c/>d</a>", "a bd"),
    ("<p a='>'>x</p a='y'>z", "x\nz"),
    ("a<", "a<"), ("<a ", ""), ("<a b", ""), ("<a b=", ""), ("<a b='", ""), ("</", "</"), ("</a", ""), ("<!--", ""),
])
def test_markup(page, want):
    assert "\n".join(t for t, k in html_text.lines(page) if k != html_text.NEVER) == want


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 100_000 + "</i>" * 100_000, "<!--" * 200_000, "<a b='" * 200_000, "<a b=\"'" * 200_000, "<nav>" * 50_000 + "<article>" * 50_000, "<" * 500_000, "</script" * 200_000, "<script>" * 200_000, "<p><li>" * 100_000, "<i><p></i>" * 50_000, "<a =" * 200_000, "& " * 300_000])
def test_markup_is_read_in_linear_time(page):
    began = time.process_time()
    html_text.lines(page)
    assert time.process_time() - began < 5


def test_neighbours_of_a_large_host(spark, monkeypatch):
    page = "<div>Site name</div><div>{}</div><div>All rights</div>"
    urls = [f"https://h/en/{k}/" for k in range(1100)] + [f"https://h/x/{k}/index.html" for k in range(100)] + [f"https://h{k % 7}/{k}" for k in range(50)] + ["https://h/one?p=%d" % k for k in range(50)]
    rows = [(k, u, page.format(f"Text {k}")) for k, u in enumerate(urls)] + [(None, None, page.format("Text -1")), (None, "", page.format("Text -2"))]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    order = sorted((html_text.Page(i, u, *html_text.place(u), *map(list, zip(*html_text.lines(h), strict=True))) for i, u, h in rows), key=lambda p: (p.key, p.path, p.page_id is not None, p.page_id or 0, p.url is not None, p.url or "", p.text))
    want = sorted((*html_text.main_text(p, html_text._nearest(b, p, a)), p.url or "") for b, p, a in zip([None, *order], order, [*order[1:], None]))
    assert sum(w[1] == 2 for w in want) == len(rows)
    for ranges in (1, 3, 400):
        monkeypatch.setattr(html_text, "RANGES", ranges)
        assert sorted((r.text, r.n_shared, r.url or "") for r in html_text.extract(given).collect()) == want


@pytest.mark.parametrize("data", [b"", b"abc", bytes(range(256)) * 40, b"\xff" * 3000, "é€ text ".encode() * 3000])
def test_media_round_trip(data):
    payload = media.padded(data)
    back, clips = media.features(media.write_avi(payload))
    assert back == payload and len(payload) % 64 == 0
    assert clips[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(clips, clips[1:], strict=False))


def test_damaged_media():
    f = media.write_avi(media.padded(b"x" * 100))
    with pytest.raises(ValueError):
        media.features(b"RIFX" + f[4:])


def test_inverse_transform_and_shots():
    p = np.zeros((1, media.FRAME_BYTES), np.uint8)
    block = media.samples(p)[0, 0]
    c = np.full((8, 8), 256.0)
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    assert np.abs(block - np.clip(np.rint(basis.T @ c @ basis + 128), 0, 255)).max() <= 1
    h = np.zeros((10, media.LEVELS), int)
    h[:4, 3], h[4:, 9] = 1024, 1024
    assert media.shots(h) == [(0, 4), (4, 10)]


def test_media_query(spark, odd_docs, odd_texts):
    stored = media.store(odd_docs)
    clips = media.clips(stored).collect()
    assert {r.doc_id for r in clips} == set(odd_texts)
    for r in stored.collect():
        assert media.features(bytes(r.media))[0] == media.padded((odd_texts[r.doc_id] or "").encode())
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").collect()}
    for r in media.op3_avi_motion_jpeg(spark, SF).collect():
        p = media.padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def codes(lengths, symbols):
    """Huffman codes by symbol, as strings of bits."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        code <<= 1
        for s in symbols[at : at + n]:
            out[s] = f"{code:0{bits}b}"
            code += 1
        at += n
    return out


def jpeg_frame(r, width, height, sampling, tables=True, restart=0, apart=False):
    """A frame of random coefficients, and its first component's samples by the transform's definition."""
    own = [(0, 0, 0, 0, 12, *[0] * 11), bytes(range(12))], [(0, 0, 0, 0, 0, 0, 0, 162, *[0] * 8), bytes([0, 0xF0, *(a << 4 | b for a in range(16) for b in range(1, 11))])]

    def known(kind, number):
        if tables:
            return codes(*own[kind])
        found = {}
        for k, (bits, s) in enumerate(jpeg.standard(kind, number)):
            if bits:
                found.setdefault(s, f"{k:016b}"[:bits])
        return found

    def seg(marker, body):
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    def number(v):
        size = abs(v).bit_length()
        return size, (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    top_x, top_y = max(x for x, _ in sampling), max(y for _, y in sampling)
    quant = [[r.randint(1, 9) for _ in range(64)] for _ in range(2)]
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + b"".join(seg(0xDB, bytes([16 * k + k]) + (struct.pack(">64H", *q) if k else bytes(q))) for k, q in enumerate(quant))
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, x << 4 | y, min(c, 1)]) for c, (x, y) in enumerate(sampling)))
    if tables:
        out += b"".join(seg(0xC4, bytes([kind << 4 | n]) + bytes(own[kind][0]) + own[kind][1]) for kind in (0, 1) for n in (0, 1))
    out += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    units_x, units_y = -(-width // (8 * top_x)), -(-height // (8 * top_y))
    grids = [[[[0] * 64 for _ in range(units_x * x)] for _ in range(units_y * y)] for x, y in sampling]
    for g in grids:
        for row in g:
            for block in row:
                block[0] = r.randint(-60, 60)
                for _ in range(r.randint(0, 6)):
                    block[r.randint(1, 63)] = r.randint(-9, 9)

    def scan(components):
        nonlocal out
        out += seg(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 17 * min(c, 1)]) for c in components) + bytes([0, 63, 0]))
        if len(components) == 1:
            c = components[0]
            rows_, columns = -(-(-(-height * sampling[c][1] // top_y)) // 8), -(-(-(-width * sampling[c][0] // top_x)) // 8)
            order = [[(c, a, b)] for a in range(rows_) for b in range(columns)]
        else:
            order = [[(c, a * sampling[c][1] + y, b * sampling[c][0] + x) for c in components for y in range(sampling[c][1]) for x in range(sampling[c][0])] for a in range(units_y) for b in range(units_x)]
        for s, at in enumerate(range(0, len(order), restart or len(order))):
            bits, last = "", {}
            for c, a, b in (u for unit in order[at : at + (restart or len(order))] for u in unit):
                dc, ac, block = known(0, min(c, 1)), known(1, min(c, 1)), grids[c][a][b]
                size, v = number(block[0] - last.get(c, 0))
                last[c] = block[0]
                bits += dc[size] + v
                run = 0
                for k in range(1, 64):
                    if not any(block[k:]):
                        bits += ac[0]
                        break
                    if not block[k]:
                        run += 1
                        continue
                    bits += ac[0xF0] * (run // 16)
                    size, v = number(block[k])
                    bits += ac[run % 16 << 4 | size] + v
                    run = 0
            bits += "1" * (-len(bits) % 8)
            out += (bytes([0xFF, 0xD0 + (s - 1) % 8]) if s else b"") + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    for components in [[c] for c in range(len(sampling))] if apart else [list(range(len(sampling)))]:
        scan(components)
    out += b"\xff\xd9"
    high, wide = -(-height * sampling[0][1] // top_y), -(-width * sampling[0][0] // top_x)
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    want = np.zeros((8 * len(grids[0]), 8 * len(grids[0][0])))
    for a, row in enumerate(grids[0]):
        for b, block in enumerate(row):
            c = np.zeros(64)
            c[jpeg.ZIGZAG] = np.array(block) * quant[0]
            want[8 * a : 8 * a + 8, 8 * b : 8 * b + 8] = basis.T @ c.reshape(8, 8) @ basis + 128
    return out, np.clip(np.rint(want), 0, 255)[:high, :wide]


JPEGS = [((16, 8), [(1, 1)], {}), ((33, 21), [(2, 2), (1, 1), (1, 1)], {}), ((40, 17), [(2, 1), (1, 1), (1, 1)], {"restart": 2}), ((19, 30), [(1, 1)] * 3, {"tables": False}), ((35, 18), [(2, 2), (1, 1), (1, 1)], {"apart": True, "restart": 3})]


@pytest.mark.parametrize("size, sampling, more", JPEGS)
def test_jpeg_frames_of_any_profile(size, sampling, more):
    frame, want = jpeg_frame(random.Random(str(size)), *size, sampling, **more)
    got = jpeg.luminance(frame)
    assert got.shape == want.shape and np.abs(got - want).max() <= 1
    for cut in range(0, len(frame) - 2, 37):
        with pytest.raises(ValueError):
            jpeg.luminance(frame[:cut])


def other_avi(frames, index=True, absolute=False, fps=10):
    """A file of another maker: a sound stream first, junk, sound between the frames, frames of any size."""
    def chunk(name, body):
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    sound = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + bytes(44)))
    video = chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsMJPG" + bytes(12) + struct.pack("<II", 1, fps) + bytes(28)))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + sound + video) + chunk(b"JUNK", b"abc")
    movi, rows = b"movi", []
    for f in frames:
        for name, body in ((b"00wb", b"snd"), (b"01dc", f)):
            rows.append((name, 16, len(movi) + (12 + len(head) + 8 if absolute else 0), len(body)))
            movi += chunk(name, body)
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", movi) + (chunk(b"idx1", b"".join(struct.pack("<4sIII", *x) for x in rows)) if index else b""))


def test_clips_of_other_files(spark):
    r = random.Random(9)
    dark, light = ([jpeg_frame(random.Random(s), 24, 16, [(2, 1), (1, 1), (1, 1)])[0]] * 5 for s in (1, 2))
    files = [other_avi(dark + light), other_avi(dark + light, absolute=True), other_avi(dark + light, index=False)]
    for f in files:
        assert [(c["start_ms"], c["end_ms"], c["frames"]) for c in media.clips_of(f)] == [(0, 500, 5), (500, 1000, 5)]
    bad = [None, b"", b"RIFF", b"text", files[0][:300], other_avi([b"no frame"]), other_avi([dark[0][:90]]), other_avi([])]
    bad += [files[0][:k] + bytes([r.randrange(256)]) + files[0][k + 1 :] for k in range(0, 400, 3)]  # may still be readable, mustn't raise
    for f in bad:
        media.clips_of(f)
    assert not any(map(media.clips_of, bad[:8]))
    rows = spark.createDataFrame([(1, bytearray(files[0]), 3)] * 2 + [(2, bytearray(b"bad"), 3), (None, None, 3)], "doc_id long, media binary, clip int")
    assert sorted((x.doc_id, x.clip, x.frames) for x in media.clips(rows).collect()) == [(1, 0, 5), (1, 0, 5), (1, 1, 5), (1, 1, 5)]


def test_media_digest_by_its_definition(spark):
    texts = ["", None, "a", "a", "word " * 30_000, "\x00" * 64, "é" * 700]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(2, "a", "y")], "doc_id long, text string, media string")
    got = docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(media._digest(), media.DIGEST).collect()
    assert len(got) == 8
    for x in got:
        text = (texts[x.doc_id] or "").encode()
        file = media.write_avi(media.padded(text))
        whole = media.padded(text)
        counts = []
        for a in range(0, len(whole), media.FRAME_BYTES):
            c = np.zeros((media.BLOCKS, 64))
            part = np.frombuffer(whole[a : a + media.FRAME_BYTES].ljust(media.FRAME_BYTES, b"\0"), np.uint8).reshape(-1, 64)
            c[:, jpeg.ZIGZAG] = part + 256.0
            k = np.arange(8)
            basis = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
            s = np.clip(np.rint(basis.T @ c.reshape(-1, 8, 8) @ basis + 128), 0, 255)
            counts.append(np.bincount((s // 8).astype(int).ravel(), minlength=32))
        cuts = media.shots(np.array(counts))
        longest = max(b - a for a, b in cuts)
        assert (x.media_bytes, x.media_sha256, x.payload_sha256, x.n_bytes) == (len(file), hashlib.sha256(file).hexdigest(), hashlib.sha256(whole).hexdigest(), len(text))
        assert x.feature.startswith(f"frames={len(counts)};shots={len(cuts)};longest={longest};brightness=")
        a, b = cuts[0]
        mean = (np.sum(counts[a:b], axis=0) @ (8 * np.arange(32) + 4)) / np.sum(counts[a:b])
        assert float(x.feature.rsplit("=", 1)[1]) == pytest.approx(mean, abs=0.2)
    assert len({(x.media_sha256, x.feature) for x in got if texts[x.doc_id] == "a"}) == 1
    assert docs.limit(0).selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(media._digest(), media.DIGEST).count() == 0


def test_lookup_table_by_turns():
    shards, slots = tuple("abcde"), 101
    owner = sharding.lookup_table(shards, slots)
    order = [[(sharding._hash(f"{s}/offset") % slots + j * (sharding._hash(f"{s}/step") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    want, taken = {}, 0
    while taken < slots:
        for k, prefers in enumerate(order):
            if taken < slots:
                want[next(x for x in prefers if x not in want)] = k
                taken += 1
    assert owner == [want[x] for x in range(slots)]
    counts = [owner.count(k) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(shards[:-1], slots)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 4)
    assert moved < 0.35 * slots


def test_placement_is_native_and_that_of_sql(spark):
    got = sharding.op5_lookup_sharding(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_lookup_sharding"]).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "slot", "shard").collect())) == sorted(want)
    nulls = spark.createDataFrame([(None, "a", "b"), (1, "a", "b"), (1, "a", "b")], "doc_id long, slot string, shard string")
    assert sorted((r.doc_id or 0, r.slot, r.shard) for r in sharding.place(nulls).collect())[0][:2] == (0, 0) and sharding.place(nulls).count() == 3
    assert sharding.place(nulls.limit(0)).count() == 0
    for key in ("slot", "shard"):
        out = sharding.place(nulls, key)
        assert out.columns == [f"key_{key}", "slot", "shard"] and len(set(out.collect())) == 1


def test_tokenizer_path_is_a_parameter(odd_docs, tmp_path):
    path = str(tmp_path / "copy.json")
    os.symlink(public_tokenizers.path(packing.TOKENIZER), path)
    assert packing.pack(odd_docs, 64, path).count() == packing.pack(odd_docs, 64).count()
