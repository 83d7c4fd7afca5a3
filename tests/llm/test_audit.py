"""The filter audit against a run of every order over every document."""

import re
from itertools import permutations

import duckdb
import pandas as pd

from strandlake.llm import audit

from .conftest import SF


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    parts = {}
    for doc_id, text, source in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        copy = doc_id is not None and any(i is not None and i < doc_id for i, t, _ in docs if (t or "") == text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}
        parts.setdefault(source or "", []).append((doc_id, {f for f, v in fails.items() if v}))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                here = [(i, s) for i, s in left if f in s]
                left = [x for x in left if f not in x[1]]
                failing = [s for _, s in rows if f in s]
                total[f] += len(here)
                out[part, "".join(order), k + 1] = [len(left), len(here), len(failing) - len(here), sum(s == {f} for s in failing), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
        for (p, order, k), figures in out.items():
            if p == part:
                figures.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", long, long + " $", long + " A" * 100, "AB cd", "x " * 300, "X% " * 300, "\x0b\x0c one\ttwo", "a" * 50_000, long + " é\x1fA"]
    docs = [(k * 7 % 53 if k % 9 else None, texts[k % len(texts)], [None, "", "s1", "s2", "s|3"][k % 5]) for k in range(90)]
    docs += docs[:20]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    df = spark.createDataFrame([(*d, 9, "m", 1, b"s", 0, True) for d in docs], "doc_id long, text string, source string, n int, mask string, part int, sha binary, step int, `a.b` boolean")
    said = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(df, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert rows == brute(docs, labels)
    assert got.count() == 600 * 4


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(none, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(None, None, None)], none.schema), labels).collect()
    assert len(one) == 600 and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    key = ["part", "filter_order", "step"]
    theirs = con.sql(audit.oracle_sql()).df().sort_values(key).reset_index(drop=True)
    ours = audit.op12_filter_interaction(spark, SF).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(ours, theirs[ours.columns], check_dtype=False)
