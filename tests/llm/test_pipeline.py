"""The pipeline's stages on one another's output, against a run in plain Python."""

import struct
import zlib

import corpus_pipeline
import public_tokenizers
from strandlake.llm import packing, toxicity
from tests.llm.conftest import SF
from tests.llm.test_near import brute_fingerprint, smallest
from tests.llm.test_repeats import covered
from tokenizers import Tokenizer


def run_stages(spark, docs, folder):
    """What each stage left, rows reread from Parquet as the driver does."""
    found = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        found.append(docs)
    return found


def check_stages(spark, docs, folder):
    rows = {r.doc_id: r for r in docs.collect()}
    toxic, near, cut, packed = run_stages(spark, docs, folder)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # 1: the scores themselves are tested by brute force elsewhere; the stage takes out those that reach the threshold
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    kept = {i: r for i, r in rows.items() if scores[i] < toxicity.THRESHOLD}
    assert toxic.columns == docs.columns and {r.doc_id: r for r in toxic.collect()} == kept
    # 2: all pairs of fingerprints
    prints = {i: brute_fingerprint(r.text) for i, r in kept.items()}
    ids = sorted(prints)
    first = smallest(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    kept = {i: r for i, r in kept.items() if first[i] == i}
    assert near.columns == docs.columns and {r.doc_id: r for r in near.collect()} == kept
    # 3: all windows of 50 bytes
    gone = covered({i: (r.text or "").encode() for i, r in kept.items()}, 50)
    texts = {i: None if r.text is None else bytes(b for b, g in zip(r.text.encode(), gone[i], strict=True) if not g).decode(errors="ignore") for i, r in kept.items()}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and {i: r.text for i, r in got.items()} == texts
    for i, r in got.items():
        assert all(r[c] == kept[i][c] for c in docs.columns if c not in ("text", "n_chars")) and (r.text is None or r.n_chars == len(r.text))
    # 4: the library's ids, each in one piece, in windows without padding
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    library.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        s.sort()
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and (total == packing.WINDOW or total & (total - 1) == 0)
    assert max(map(len, sequences.values())) > 1


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_stages(spark, docs, tmp_path)
    assert corpus_pipeline.run(spark, SF).columns == [c for c in spark.read.parquet(str(tmp_path / "3")).columns]


def test_stages_on_odd_documents(spark, odd_docs, tmp_path):
    check_stages(spark, odd_docs.selectExpr("*", "1 as toxic", "2 as rep", "3 as bucket", "4 as node", "5 as `a.b`", "6 as `text.x`", "7 as `a``c`"), tmp_path)


def test_repeated_rows_and_an_empty_table(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs.union(docs.limit(5)).union(docs.where("doc_id = 1").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars")), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
        frame.count()
