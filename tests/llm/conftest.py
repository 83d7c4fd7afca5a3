import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and white-space texts, ties, repeated rows, copies, near copies, a long text, columns with clashing names."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(300)] + ["é", "日本", "ß"]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    shared, base = words(40), words(200)
    texts = [None, "", " \t\n ", "one", "one two", "a" * 200, "ab " * 100]
    texts += [" ".join(words(r.randint(1, 120))) for _ in range(20)]
    texts += [" ".join(words(30) + shared + words(30)) for _ in range(6)]
    texts += [" ".join(base)] * 4 + [" ".join(base[:k] + ["x"] + base[k:]) for k in (10, 100, 190)]
    texts += ["\n".join(words(4000)) + "  end \n\n x", "Line one\nLine  two\t" * 20]
    rows = [(k * 3 + 1, t, "en", f"s{k % 2}", len(t or ""), k, "f") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, fp string")


@pytest.fixture(scope="session")
def odd_texts(odd_docs):
    return {r.doc_id: r.text for r in odd_docs.collect()}
