"""SimHash components and the embedding join against brute force."""

import numpy as np
import pytest
import xxhash

from strandlake.llm import embedding_join, simhash
from strandlake.llm.common import components


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def smallest(ids, linked):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_by_brute_force(odd_docs, odd_texts):
    fp = {i: brute_fingerprint(t) for i, t in odd_texts.items()}
    want = smallest(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = simhash.near_duplicates(odd_docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert len(got) == len(fp)
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in fp if want[i] == i)


def test_links_of_dense_groups():
    import pyarrow as pa

    r = np.random.default_rng(3)
    for n in (10, 200, 1500):
        base = int(r.integers(1 << 62))
        fps = np.unique([base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(43, 64, (n, 3))]).astype(np.uint64)
        fps = np.unique(np.r_[fps, r.integers(1 << 62, size=20, dtype=np.uint64)])
        ids = np.arange(len(fps))
        keys, reps, vals = [], [], []
        for i, f in enumerate(fps.tolist()):
            for s in range(3):
                low, bits = simhash.RING[(s + 1) % 3]
                half = bits // 2
                seg = f >> simhash.RING[s][0] & ((1 << simhash.RING[s][1]) - 1)
                for k, (at, w) in enumerate(((low, half), (low + half, bits - half))):
                    keys.append(seg << 20 | (f >> at & ((1 << w) - 1)) << 4 | 2 * s + k)
                    reps.append(i)
                    vals.append(f)
        t = pa.table({"key": pa.array(keys, pa.int64()), "fp": pa.array(np.array(vals, np.uint64).view(np.int64)), "rep": pa.array(reps, pa.int64())})
        found = simhash._links(t).to_pylist()
        near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
        assert smallest(ids.tolist(), [(x["u"], x["v"]) for x in found]) == smallest(ids.tolist(), near.tolist())


def test_frequent_fingerprints_repeated_rows_and_null_ids(spark, monkeypatch):
    rows = [(k, "one two three four", 1) for k in range(50)] + [(7, "one two three four", 2), (None, "one two three four", 3), (None, "alone here", 4), (60, None, 5), (61, "", 6), (70, "quite another text of words", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    for hot in (simhash.HOT, 2, 0.5):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = simhash.near_duplicates(d).collect()
        assert len(got) == len(rows)
        assert {x.component_id for x in got if x.doc_id is not None and x.doc_id < 50} == {0}
        assert {x.component_id for x in got if x.doc_id in (60, 61)} == {60} and [x.component_id for x in got if x.doc_id == 70] == [70]
        assert sorted(x.component_id is None for x in got if x.doc_id is None) == [False, True]
    assert sorted((x.doc_id is None, x.doc_id) for x in simhash.one_of_each(d).collect()) == [(False, 0), (False, 60), (False, 70), (True, None), (True, None)]


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 5), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {k: 100 for k in range(100, 161)} | {3: 3, 5: 3}


def test_range_join_by_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 16))
    vectors = [c + r.normal(size=16) * s for c in centres for s in (0.02, 0.05, 0.08, 0.1, 0.12)] + list(r.normal(size=(40, 16)))
    vectors += [vectors[0], vectors[0] * 2, vectors[7]]
    rows = [(3 * k + 1, [float(x) for x in v], k % 2) for k, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] + [1.0] * 15, 0), (1004, [None] + [1.0] * 15, 0), (1005, [1.0, 2.0], 0), (1006, [float("inf")] * 16, 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    m = np.array(vectors)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [x[0] for x in rows]
    want = smallest(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    saved = embedding_join.PER_PIVOT, embedding_join.SIDE_BYTES
    try:
        for per, side in (saved, (20, 0), (1000, 0)):
            monkeypatch.setattr(embedding_join, "PER_PIVOT", per)
            monkeypatch.setattr(embedding_join, "SIDE_BYTES", side)
            monkeypatch.setattr(embedding_join, "AT_ONCE", 1 << 21 if side else 50)
            monkeypatch.setattr(embedding_join, "LEAST", 256 if side else 8)
            got = {x.vec_id: x for x in embedding_join.range_join(d).collect()}
            assert len(got) == len(rows) + len(odd)
            for k, i in enumerate(ids):
                assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), want[i], want[i] == i)
            for i, _, _ in odd:
                assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    finally:
        monkeypatch.undo()
    assert embedding_join.range_join(d.limit(0)).count() == 0


def test_range_join_of_extreme_magnitudes_and_odd_rows(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [3e-200, 3e-200]), (4, [5.0, 5.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 0.0]), (7, [1.0, 1.0, 0.0]), (8, [-2.0, -2.0]), (None, [1.0, 1.0]), (None, None), (4, [5.0, 5.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as rep", "2 as weight")
    got = embedding_join.range_join(d).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got if x.vec_id) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (4, 4, 1), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8)]
    assert [(x.n_links, x.component_id, x.kept) for x in got if x.vec_id is None] == [(0, None, True)] * 2 and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_range_join_of_parallel_vectors(spark, monkeypatch, kind):
    """Multiples of one direction, of which several are pivots, vectors near it, and one vector in very many rows."""
    r = np.random.default_rng(2)
    base = r.normal(size=64)
    vectors = [base * s for s in [3.0, 0.1, *r.random(1500)]] + [base + r.normal(size=64) * np.linalg.norm(base) * s / 8 for s in r.random(600) * 0.6] + [base * 0.3] * 700 + list(r.normal(size=(100, 64)))
    vectors = np.array(vectors).astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")
    m = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = m @ m.T
    np.fill_diagonal(cosine, -1)
    assert not ((cosine > 0.95 - 1e-12) & (cosine < 0.95 + 1e-12)).any()
    near = cosine >= 0.95
    want = smallest(range(len(m)), np.argwhere(np.triu(near)).tolist())
    monkeypatch.setattr(embedding_join, "PER_PIVOT", 40)
    for threshold, hot in ((1 - 1e-6, 10_000), (2, 3), (2, 10_000)):  # 2: no pivot is dropped
        monkeypatch.setattr(embedding_join, "apart", lambda p, t=threshold: p if t > 1 else p[[0, *[k for k in range(1, len(p)) if (p[:k] @ p[k]).max() <= t]]])
        monkeypatch.setattr(embedding_join, "HOT", hot)
        got = {x.vec_id: x for x in embedding_join.range_join(d).collect()}
        assert len(got) == len(vectors)
        assert [got[k].n_links for k in range(len(m))] == near.sum(axis=1).tolist()
        assert {k: x.component_id for k, x in got.items()} == want


def test_pivots_are_apart():
    p = np.array([[1.0, 0], [1, 1e-9], [0, 1], [1, 0], [0.6, 0.8], [1e-5, 1]])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    assert embedding_join.apart(p).tolist() == p[[0, 2, 4]].tolist()


def test_bounds_lose_no_pair():
    r = np.random.default_rng(1)
    for dim in (3, 16, 40):
        m = r.normal(size=(300, dim)) * r.random(dim) ** 3
        m[150:] = m[:150] + r.normal(size=(150, dim)) * 0.05 * np.linalg.norm(m[:150], axis=1, keepdims=True) / dim**0.5
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        turned = embedding_join.directions(m[:20])
        assert np.allclose(turned @ turned.T, np.eye(dim))
        want = {(i, k) for i, k in np.argwhere(m @ m.T >= 0.95) if i < k}
        got = [(i, k) for x, y in embedding_join.close_pairs(m, m, turned, 0.95, True) for i, k in zip(x.tolist(), y.tolist())]
        assert len(got) == len(want) and set(got) == want
        halves = {(i, k) for x, y in embedding_join.close_pairs(m[:150], m[150:], turned, 0.95, False) for i, k in zip(x.tolist(), y.tolist())}
        assert halves == {(i, k - 150) for i, k in want if i < 150 <= k}
