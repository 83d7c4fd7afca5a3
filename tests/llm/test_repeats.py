"""Both repeat operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, relative_lz, suffix_dedup
from strandlake.llm.common import table
from tests.llm.conftest import SF


def covered(units, window):
    first = {}
    for i in sorted(units):
        for k in range(len(units[i]) - window + 1):
            first.setdefault(units[i][k : k + window], i)
    out = {}
    for i, u in units.items():
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if first[u[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        out[i] = gone
    return out


def spans(gone):
    edges = np.flatnonzero(np.diff([False, *gone, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def check(rows, units, window, join):
    gone = covered(units, window)
    assert len(rows) == len(units)
    for r in rows:
        kept = join(u for u, g in zip(units[r.doc_id], gone[r.doc_id], strict=True) if not g)
        assert (r.n_units, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256) == (len(gone[r.doc_id]), sum(gone[r.doc_id]), spans(gone[r.doc_id]), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("window", [13, 5])
def test_words(odd_docs, odd_texts, window):
    units = {i: tuple(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in odd_texts.items()}
    check(relative_lz.dedup(odd_docs, window).collect(), units, window, b" ".join)


@pytest.mark.parametrize("window", [50, 7])
def test_bytes(odd_docs, odd_texts, window):
    units = {i: (t or "").encode() for i, t in odd_texts.items()}
    check(suffix_dedup.dedup(odd_docs, window).collect(), units, window, bytes)


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_minimisers_are_split(odd_docs, odd_texts, hot):
    units = {i: (t or "").encode() for i, t in odd_texts.items()}
    check(suffix_dedup.dedup(odd_docs, 50, hot=hot).collect(), units, 50, bytes)
    words = {i: tuple(re.findall(rb"[^\x20\x09-\x0D]+", u)) for i, u in units.items()}
    check(relative_lz.dedup(odd_docs, 13, hot=hot).collect(), words, 13, b" ".join)


def test_a_phrase_in_many_contexts(spark):
    r = random.Random(7)
    phrase = "one phrase of twenty!"
    texts = ["".join(r.choice("abcdef ") for _ in range(40)) + phrase + "".join(r.choice("abcdef ") for _ in range(40)) for _ in range(400)]
    texts += [t[10:70] for t in texts[:60]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (8, 1 << 20):
        check(suffix_dedup.dedup(d, 50, hot=hot).collect(), {k: t.encode() for k, t in enumerate(texts)}, 50, bytes)


@pytest.mark.parametrize("window", [230, 400])
def test_long_windows(spark, window):
    r = random.Random(3)
    base = bytes(r.choice(b"xyz ") for _ in range(900)).decode()
    texts = [base, base[100:600], "q" + base[300:] + base[:250], base[:window], base[1 : window - 1]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(suffix_dedup.dedup(d, window).collect(), {k: t.encode() for k, t in enumerate(texts)}, window, bytes)


def test_whole_tables(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    gone = covered({i: t.encode() for i, t in docs.items()}, 50)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.op6_suffix_array_dedup(spark, SF).collect()}
    assert got == {i: sum(g) for i, g in gone.items()}
    gone = covered({i: tuple(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for i, t in docs.items()}, 13)
    got = {r.doc_id: r.n_removed for r in relative_lz.op2_relative_lempel_ziv(spark, SF).collect()}
    assert got == {i: sum(g) for i, g in gone.items()}


def test_repeated_ids_nulls_and_empty_table(spark):
    rows = [(1, "x" * 60), (1, "x" * 60), (2, "x" * 60), (None, "x" * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in suffix_dedup.dedup(d).collect()) == [(1, 0), (1, 0), (2, 60), (9, 60)]
    assert suffix_dedup.dedup(d.limit(0)).count() == 0
    assert relative_lz.dedup(d.limit(0)).count() == 0
    words = spark.createDataFrame([(i, "a b c d e f g h i j k l m n", "x") for i in (1, 1, 2, None)], "doc_id long, text string, bucket string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in relative_lz.dedup(words).collect()) == [(1, 0), (1, 0), (2, 14), (9, 14)]


def test_texts_without_repeats_keep_all_columns(odd_docs, odd_texts):
    out = suffix_dedup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    gone = covered({i: (t or "").encode() for i, t in odd_texts.items()}, 50)
    for i, t in odd_texts.items():
        want = None if t is None else bytes(b for b, g in zip(t.encode(), gone[i], strict=True) if not g).decode(errors="ignore")
        assert rows[i].text == want and (t is None or rows[i].n_chars == len(want))


def test_collection_index_is_a_suffix_array():
    r = random.Random(1)
    docs = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(40)]
    owner, length, lcp = suffix_dedup.collection_index(docs)
    got = [docs[o][len(docs[o]) - n :] for o, n in zip(owner, length, strict=True)]
    assert got == sorted(d[k:] for d in docs for k in range(len(d) + 1))
    for a, b, n in zip(got, got[1:], lcp[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_greedy_factors():
    ref = relative_lz.Reference(3)
    assert ref.factors(b"a b c d e f".split(), 1) == []
    assert ref.factors(b"x b c d e y c d e".split(), 2) == [(1, 4, 0, 1), (6, 3, 0, 2)]
    assert ref.factors(b"x b c".split(), 3) == [(0, 3, 1, 0)]


def test_keys_are_dealt_evenly(spark):
    for n, partitions in ((64, 16), (100, 85), (7, 3)):
        keys = common.even_keys(n, partitions)
        assert (keys % n == np.arange(n)).all()
        d = spark.createDataFrame([(int(k),) for k in keys], "k int")
        assert {r.k: r.h for r in d.select("k", F.hash("k").alias("h")).collect()} == dict(zip(keys.tolist(), common.spark_hash(keys).tolist(), strict=True))
        at = {r.k: r.p for r in d.repartition(partitions, "k").select("k", F.spark_partition_id().alias("p")).collect()}
        assert [at[k] for k in keys.tolist()] == [i % partitions for i in range(n)]
        assert spark.range(1).select(common.as_column(keys).alias("a")).first().a == keys.tolist()
