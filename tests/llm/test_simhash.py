import numpy as np
import pytest
import re
import xxhash

from foldspark.llm import simhash
from tests.conftest import SF_SMALL


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints):
    """{doc_id: component} by comparing every pair."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    want = brute(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_planted_chains(spark, monkeypatch):
    """Chains of fingerprints 1 to 4 bits apart, in one hot bucket that is cut into tiles."""
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 1 << 63))
    prints = {}
    for i in range(600):
        x = base if i % 2 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(64, size=int(rng.integers(0, 5)), replace=False):
            x ^= 1 << int(b)
        prints[i] = x
    want = brute(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = {}
    for i, x in prints.items():
        classes.setdefault(signed(x), i)
    df = spark.createDataFrame(list(classes.items()), "fp long, node long")
    roots = {r.node: r.root for r in simhash.connected_components(simhash.links(df)).collect()}
    for x, i in classes.items():
        assert roots.get(i, i) == want[i]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "ÀB c", "a b c d e f g " * 30000])
def test_odd_texts(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_print(text)


def test_odd_tables(spark):
    rows = [(5, "x y z", "q"), (3, "x y z", None), (None, "x y z", None), (7, None, None), (2, "", None), (5, "x y z", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 2, 2), (False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 7, 2), (True, None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = [(r.doc_id, r.component_id) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [(2, None), (3, None), (None, None)]
