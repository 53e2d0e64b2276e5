import random
import re

import pytest

from foldspark.llm import substrdedup
from tests.conftest import SF_SMALL


def brute(rows, length=20):
    """(doc_id, n_words, n_removed, text) by the first start of every window."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    place = lambda n: (words[n][0] is None, words[n][0] or 0)
    first = {}
    for n, (_, w) in enumerate(words):
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, ((True, 1 << 64), 0)), (place(n), i))
    out = []
    for n, (d, w) in enumerate(words):
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < (place(n), i) for j in range(i, i + length)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


def test_matching_statistics():
    rng = random.Random(4)
    for _ in range(60):
        automaton, before = substrdedup.SuffixAutomaton(), []
        for _ in range(6):
            word = [rng.choice("abc") for _ in range(rng.randrange(25))]
            automaton.start()
            for n, c in enumerate(word):
                got = automaton.add(c)
                ended = ["".join(x) for x in before] + ["".join(word[:n])]
                want = max((k for k in range(n + 2) if any("".join(word[n + 1 - k : n + 1]) in x for x in ended)), default=0)
                assert got == want
            before.append(word)


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(substrdedup.dedup_substrings(docs))
    assert got == sorted(brute(rows), key=str)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("frequent", [2, 1024])
def test_planted(spark, monkeypatch, frequent):
    monkeypatch.setattr(substrdedup, "FREQUENT", frequent)
    rng = random.Random(frequent)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (19, 20, 21, 40, 70)]
    rows = []
    for i in range(120):
        w = fresh(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages) + fresh(rng.randrange(12))
        if rng.random() < 0.3:
            w += fresh(rng.randrange(1, 5)) * rng.randrange(2, 30)  # periodic
        if rows and rng.random() < 0.3:
            w = rng.choice(rows)[1].split()  # a near copy
            w[rng.randrange(len(w))] = "edit"
        rows.append((1000 - i, "\n ".join(w) + "\tend"))
    rows += [(2000 + i, rows[3][1]) for i in range(5)] + [(5, None), (6, ""), (7, "a b a b " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _cuts string")
    assert rows_of(substrdedup.dedup_substrings(docs)) == sorted(brute(rows), key=str)


def test_ties_and_nulls(spark):
    text = " ".join(f"t{i}" for i in range(45))
    other = " ".join(f"o{i}" for i in range(45))
    rows = [(4, text), (4, text), (9, text), (None, text), (None, other), (None, other), (3, "short text"), (4, other + " x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    out = substrdedup.dedup_substrings(docs)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"]
    got = rows_of(out)
    assert got == sorted(brute(rows), key=str)
    assert substrdedup.dedup_substrings(docs.limit(0)).count() == 0


def test_matches_sql(spark):
    import duckdb

    from foldspark.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    got = sorted(map(tuple, queries.op7_substring_dedup(spark, SF_SMALL).collect()))
    assert got == sorted(con.execute(substrdedup.SQL).fetchall())
