import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldspark.llm import tokencount
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b\n\n c\t\t", "don't we'll they've 'S", "é́ 漢字 🙂🙂   \x1c\x85 b", "x  <|endoftext|>  <|endof", "1234567   　c ''s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokencount.PrefixCounter(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix(counter, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abtheing  \n\t'sl1.é漢<|>") for _ in range(120)) for _ in range(40)]
    for text in texts:
        table = counter.table(text)
        for n in range(len(text) + 1):
            assert table.at(n) == count(library, text[:n]), (text, n)


def test_prefixes_of_a_piece(counter, library):
    for piece in ["internationalization", " unbelievably", "zzzzzzzzqqq", "漢字かな", "=" * 70, "a" * 3000]:
        raw, got = piece.encode(), counter.prefixes(piece.encode())
        assert got[0] == 0 and len(got) == len(raw) + 1
        for n in range(1, min(len(piece), 200) + 1):
            assert got[len(piece[:n].encode())] == count(library, piece[:n])
        assert got[-1] == count(library, piece)


def test_fit(counter, library):
    """Against every cut of the text, by the library."""
    rng = random.Random(8)
    texts = ["The quick brown fox doesn't   jump\n\nover unbelievably lazy dogs 漢字 " * 2, "we're 'll 're x", "!!<|endoftext|>!!  <|endoftext|>\n"]
    texts += [" " * 90 + "a" + " " * 40, "\n" * 70 + "b", "internationalization" * 9, "0123456789" * 20, "漢字かな" * 15, "a" * 150, "=" * 130 + "<|endoftext|>"]
    texts += ["".join(rng.choice(["ab", " ", "  ", "\n", "!", "'re", "'", "12", "漢", "<|endoftext|>", "<|", "é", "ing"]) for _ in range(40)) for _ in range(25)]
    for text in texts:
        counts = [count(library, text[:m]) for m in range(len(text) + 1)]
        table = counter.table(text)
        assert [table.at(m) for m in range(len(text) + 1)] == counts, text
        for budget in sorted({0, 1, 2, 5, 17, counts[-1] - 1, counts[-1], counts[-1] // 2, 1000}):
            want = max((m for m, n in enumerate(counts) if n <= budget), default=0)
            assert table.fit(budget) == want, (text, budget)


@pytest.mark.parametrize("text", ["a" * 20000, "0123456789" * 600, "internationalization" * 500, "漢字かな" * 2000, " " * 20000 + "x", "=-" * 9000])
def test_fit_in_a_long_piece(counter, library, text):
    table = counter.table(text)
    for budget in (1, 128, 512):
        n = table.fit(budget)
        assert count(library, text[:n]) <= budget
        assert n == len(text) or all(count(library, text[:m]) > budget for m in range(n + 1, min(len(text), n + 40) + 1))
    assert table.fit(10**6) == len(text)


def test_stored_tables(spark, counter):
    texts = [*ODD, "a" * 3000, "  ".join(["internationalization" * 9, "0123456789" * 20, " " * 99]), "don't " * 200]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b c d e f g h", 1), (77, None, 1)], "doc_id long, text string, sums int")
    tables = tokencount.prefix_tables(docs, PATH)
    plain = sorted(map(tuple, tokencount.truncate(docs, PATH, 7).collect()), key=str)
    stored = sorted(map(tuple, tokencount.truncate(docs, PATH, 7, tables).collect()), key=str)
    want = [(r.doc_id, (r.text or "")[: counter.table(r.text or "").fit(7)]) for r in docs.collect()]
    assert plain == stored == sorted(want, key=str)
    kept = {r.doc_id: r for r in tables.collect()}
    assert [len(x.counts) for x in kept[len(ODD)].inner] == [3001]
    assert tokencount.truncate(docs.limit(0), PATH, 7).count() == 0


def test_tables(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), count(library, r.text)) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, PATH).collect()}
    assert got == want
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (1, " ", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(odd, PATH, 3).collect()), key=str)
    want = [(i, len((t or "").encode()), count(library, t or ""), count(library, t or "") > 3) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    tables = {r.doc_id: r for r in tokencount.prefix_tables(odd.where("doc_id is not null"), PATH).collect()}
    assert all(tables[i].ends[-1] == len(t) and tables[i].sums[-1] == count(library, t) for i, t in enumerate(ODD))
    cut = {r.doc_id: r.text for r in tokencount.truncate(odd.where("doc_id is not null"), PATH, 4).collect()}
    assert all(ODD[i].startswith(cut[i]) and count(library, cut[i]) <= 4 for i in cut)
    assert tokencount.count_tokens(odd.limit(0), PATH).count() == 0
