"""Hashes against published vectors and plain versions; codecs by round trip; generators."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.functions import codecs, hashing
from foldspark.sources.datagen import generate

TEXTS = ["", "a", "ab", "abc", "test", "héllo wörld", "x" * 255, "Four score and seven years ago", "reretion.", "innden$$$", None]
M = 0xFFFFFFFF


def plain_murmur2(data, seed):
    m, h = 0x5BD1E995, seed ^ len(data)
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        k = k * m & M
        k = (k ^ k >> 24) * m & M
        h = h * m & M ^ k
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & M
    h = (h ^ h >> 13) * m & M
    return h ^ h >> 15


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def column(df, c):
    return [r[0] for r in df.select("i", c.alias("h")).orderBy("i").select("h").collect()]


@pytest.mark.parametrize("seed", [0, 42])
def test_murmur2(texts, seed):
    assert column(texts, hashing.murmur2(F.col("t"), seed)) == [None if t is None else plain_murmur2(t.encode(), seed) for t in TEXTS]


def test_murmur2_vectors(texts):
    got = dict(zip(TEXTS, column(texts, hashing.engine_hash(F.col("t"))), strict=True))
    assert got[""] == 275804818 and got["test"] == 701388998 and got["reretion."] == got["innden$$$"] == 2878500342


def test_lookup3_published_vectors():
    block = np.frombuffer(b"Four score and seven years ago", np.uint8)[None, :]
    assert [int(h[0]) for h in hashing.lookup3_block(block, 0, 0)] == [0x17770551, 0xCE7226E6]
    assert [int(h[0]) for h in hashing.lookup3_block(block, 0, 1)] == [0xE3607CAE, 0xBD371DE4]
    assert [int(h[0]) for h in hashing.lookup3_block(block, 1, 0)] == [0xCD628161, 0x6CBEA4B3]
    empty = np.zeros((1, 0), np.uint8)
    assert [int(h[0]) for h in hashing.lookup3_block(empty, 0xDEADBEEF, 0)] == [0xBD5B7DDE, 0xBD5B7DDE]


def test_bob_columns(texts):
    one = column(texts, hashing.bob(F.col("t")))
    both = column(texts, hashing.bob2(F.col("t")))
    assert one == [None if h is None else h["idx1"] for h in both]
    assert column(texts, hashing.hash_by("bob", F.col("t"))) == one


def test_fnv1_published_vectors(spark):
    df = spark.createDataFrame([(0, ""), (1, "a"), (2, "foobar")], "i int, t string")
    assert column(df, hashing.fnv1(F.col("t"))) == [0x811C9DC5, 0x050C5D7E, 0x31F0B262]


def test_fnv_variants_published_vectors(spark):
    df = spark.createDataFrame([(0, ""), (1, "a"), (2, "foobar"), (3, None)], "i int, t string")
    assert column(df, hashing.fnv1a(F.col("t"))) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]
    unsigned = lambda c: [None if h is None else h % (1 << 64) for h in column(df, c)]
    assert unsigned(hashing.fnv1_64(F.col("t"))) == [0xCBF29CE484222325, 0xAF63BD4C8601B7BE, 0x340D8765A4DDA9C2, None]
    assert unsigned(hashing.fnv1_64(F.col("t"), True)) == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]


def test_digram(spark):
    rows = ["long-a", "a-long", "same-size", "plain", "-", "a-b-c"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")

    def plain(t):
        if "-" not in t:
            return plain_murmur2(t.encode(), 42)
        a, b = t.split("-", 1)
        h1, h2 = (plain_murmur2(x.encode(), 42) for x in (a, b))
        h = (h1 + (h2 & 1023) if len(a) > len(b) else (h1 & 1023) + h2 + 1) & M
        return M - 1 if h == M else h

    assert column(df, hashing.digram(F.col("t"))) == [plain(t) for t in rows]


def test_nullhash(spark):
    rows = ["", "abc", "abcd", "zabcd", "é€é€", "abcdefgh"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    for shift in (0, 2, 9):

        def plain(t, shift=shift):
            raw = t.encode()
            end = len(raw) - shift
            if end < 4:
                return 0
            return sum((b - 256 if b > 127 else b) << s for b, s in zip(raw[end - 4 : end], (24, 16, 8, 0), strict=True)) & M

        assert column(df, hashing.nullhash(F.col("t"), shift)) == [plain(t) for t in rows]


def test_integer_hashes_spread(spark):
    df = spark.range(2000).select(F.col("id").cast("int").alias("i"))
    for f in (hashing.hashint_1, hashing.hashint_2, hashing.hashint_half):
        got = column(df, f(F.col("i")))
        assert len(set(got)) == 2000 and all(0 <= h <= M for h in got)


def test_rle(spark):
    rows = [[5, 5, 5, 2, 7, 7], [9], [], [1, 2, 1, 2], [None, None, 3]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t array<long>")
    coded = column(df, codecs.rle_encode(F.col("t")))
    assert coded[:4] == [[5, 3, 2, 1, 7, 2], [9, 1], [], [1, 1, 2, 1, 1, 1, 2, 1]]
    assert column(df, codecs.rle_decode(codecs.rle_encode(F.col("t")))) == rows


def test_delta_tables(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 3, 10, 4000000000])] + [("b", 0, 7)], "k string, i int, v long")
    made = codecs.delta_table(df, ["k"], "i", "v")
    back = codecs.undelta_table(made, ["k"], "i", "delta")
    assert sorted((r.k, r.i, r.value) for r in back.collect()) == sorted((r.k, r.i, r.v) for r in df.collect())


def test_packing():
    rng = random.Random(0)
    for n in (0, 1, 2, 31, 32, 33, 1000):
        for top in (1, 255, M):
            values = np.array(sorted(rng.randrange(top + 1) for _ in range(n)), np.int64)
            assert codecs.unpack(codecs.pack(values)).tolist() == values.tolist()
    assert codecs.unpack(codecs.pack(np.array([3, 3, 10, 4000000000]))).tolist() == [3, 3, 10, 4000000000]
    with pytest.raises(ValueError):
        codecs.pack(np.array([2, 1]))


def test_packing_continues_outliers():
    """One wide delta does not widen the others; what cannot have been packed is refused."""
    values = np.cumsum(np.array([3] * 1000 + [1 << 31] + [2] * 1000))
    raw = codecs.pack(values)
    assert codecs.unpack(raw).tolist() == values.tolist()
    assert int(np.frombuffer(raw, "<u4")[0]) == 2 and len(raw) < 2001 * 3 / 8 + 40 < 2001 * 33 / 8
    # by hand: deltas 1 and 6 at width 2: 01|0, then 10|1 and 01|0
    assert codecs.unpack(np.array([2, 9, 0b010_101_010 << 23], "<u4").tobytes()).tolist() == [1, 7]
    for bad in (b"", raw[:-1], raw[:-4], np.array([0, 0], "<u4").tobytes(), np.array([40, 0, 1], "<u4").tobytes(), np.array([2, 3, 1 << 29], "<u4").tobytes(), np.array([2, 3, 1], "<u4").tobytes()):
        with pytest.raises(ValueError):
            codecs.unpack(bad)
    with pytest.raises(ValueError):
        codecs.unpack(np.array([31, 0, *[M] * 32], "<u4").tobytes())


def test_tables_with_ties(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 1, 3), ("a", 2, 9), ("a", 2, 9)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(3)
    runs = sorted((r.run, r.v, r.n) for r in codecs.rle_table(df, ["k"], "i", "v").collect())
    assert runs == [(1, 3, 1), (2, 5, 2), (3, 9, 2)]
    rows = [("a", 1, n, v) for n, v in enumerate([5, 1, 9, 9, 2])]
    total = spark.createDataFrame(rows, "k string, i int, n int, v long").repartition(3)
    back = codecs.undelta_table(codecs.delta_table(total, ["k"], ["i", "n"], "v"), ["k"], ["i", "n"], "delta").collect()
    assert {r.n: r.value for r in back} == {n: v for _, _, n, v in rows}


# Numbers and their hashes (six shifts, seven shifts, half avalanche), computed by hand from the published functions.
INTEGER_HASHES = {
    0: (1800329511, 0, 2901400889),
    1: (3028713910, 3266786691, 3961971922),
    2: (3798448204, 3910079064, 1979596172),
    12345: (3058842707, 43351985, 3407062328),
    2147483647: (3948364977, 3609731332, 693862245),
    2147483648: (2122005522, 3261318340, 2540690745),
    4294967295: (4268016002, 3582354520, 1088126821),
    3735928559: (2146495194, 561645252, 402221532),
}


def test_integer_hash_vectors(spark):
    df = spark.createDataFrame(list(enumerate(INTEGER_HASHES)), "i int, x long")
    for k, f in enumerate((hashing.hashint_1, hashing.hashint_2, hashing.hashint_half)):
        assert column(df, f(F.col("x"))) == [h[k] for h in INTEGER_HASHES.values()]


def test_bits(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0, 1, 255, M])], "i int, x long")
    assert column(df, codecs.nlz(F.col("x"))) == [32, 31, 24, 0]
    assert column(df, codecs.low_mask(codecs.bit_width(F.col("x")))) == [0, 1, 255, M]
    assert column(df, codecs.lz4_bound(F.col("x")))[2] == 255 + 1 + 16
    assert abs(column(df, codecs.log26(F.lit(676.0)))[0] - 2) < 1e-9


@pytest.mark.parametrize("power", [None, 1.0])
def test_generator(spark, power):
    df = generate(spark, 5000, 100, 8, power, seed=1)
    keys = [r.key for r in df.collect()]
    assert len(keys) == 5000 and all(len(k) == 8 and k.isalpha() and k.islower() for k in keys)
    assert len(set(keys)) == len({k[:2] for k in keys}) <= 26 * 4  # the filler adds no keys
    assert sorted(keys) == sorted(r.key for r in generate(spark, 5000, 100, 8, power, seed=1).repartition(3).collect())
    top = max(keys.count(k) for k in set(keys))
    assert (top > 400) == (power is not None)
    with pytest.raises(ValueError):
        generate(spark, 1, 10_000, 2)
