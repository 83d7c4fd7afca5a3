"""Spelling variants against brute force, SQL and the SQL's definition of near."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from strandlake.llm import spelling

from .conftest import SF


def brute_words(docs, least=7, count=2):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, ratio=10):
    words = brute_words(docs)
    rows, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        rows[w] = (n, len(others))
    out = {}
    for w, (n, m) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, m, words[form[w]] if form[w] else None)
    return out


def test_variants_by_brute_force(spark):
    r = random.Random(5)
    letters = "abcdefgàéÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(25)]
    long = ["".join(r.choice(letters) for _ in range(n)) for n in (63, 64, 65, 66, 200, 3000)] + ["a" * 5000]

    def changed(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])

    docs = [(None, None), (1, ""), (2, "1 2 3"), (None, base[0] * 2)]
    for k in range(60):
        words = [r.choice(base) for _ in range(40)] + [changed(r.choice(base)) for _ in range(15)] + [changed(w) for w in long] + long * 2
        words += [w.upper() if r.random() < 0.2 else w for w in base[:3] * 12]
        docs.append((r.choice([k, k, None]), " ".join(words) if k % 2 else "\n-".join(words)))
    docs += docs[-5:]
    docs += [(1000 + k, "chainabcd " + "chainabxd " * 12 + "chainayxd " * 150) for k in range(3)]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], "doc_id long, text string, word string, n int, key string, `form.a` int")
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(docs)
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got.collect()} == want
    assert any(len(w) > 64 and v[0] for w, v in want.items()) and any(v[0] and v[0] != v[1] for v in want.values())


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "word " * 9)], "doc_id long, text string")).count() == 0


def test_hashes_are_those_of_the_texts():
    r = random.Random(1)
    for _ in range(50):
        w = "".join(r.choice("abé") for _ in range(r.randint(2, 12)))
        texts = dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w)))
        hashes = spelling.hashed_deletions(w)
        assert hashes[1:].tolist() and set(hashes[1:].tolist()) == {int(spelling.hashed_deletions(t)[0]) for t in texts}
        assert len(np.unique(hashes[1:])) == len(hashes) - 1 == len(texts)


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(spelling.oracle_sql()).df().sort_values("word").reset_index(drop=True)
    ours = spelling.op11_symmetric_delete(spark, SF).toPandas().sort_values("word").reset_index(drop=True)
    pd.testing.assert_frame_equal(ours, theirs[ours.columns], check_dtype=False)
    assert ours.form.notna().any()
