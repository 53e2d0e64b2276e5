"""Contract and laws of the fold."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from foldspark.operators.accumulator import HASH, Accumulator, partition_report
from foldspark.operators.opaque import divide, opaque_aggregate
from foldspark.plans import spec as specs
from foldspark.plans.engine import aggregate, finish, merge_partials, partial, partials_by, reaggregate
from foldspark.plans.spec import AggSpec, StateCol
from foldspark.sources.staging import decode_batch, shared_path

SCHEMA = "key string, count long"


def counts(merge="sum"):
    return AggSpec({"key": F.col("key")}, (StateCol("count", F.col("count"), merge),))


def as_dict(df):
    return {r["key"]: r["count"] for r in df.collect()}


def acc_of(spark, rows, **options):
    acc = Accumulator(spark, counts(), **options)
    acc.bulk_insert(spark.createDataFrame(rows, SCHEMA))
    return acc


def test_one_record(spark):
    acc = Accumulator(spark, counts())
    assert acc.snapshot() is None and list(acc.cursor()) == []
    acc.insert({"key": "test", "count": 1})
    acc.insert(Row(key="test", count=2))
    assert as_dict(acc.snapshot()) == {"test": 3}


def test_same_key_ten_times(spark):
    assert as_dict(acc_of(spark, [("test", 1)] * 10).snapshot()) == {"test": 10}


def test_empty_input(spark):
    assert acc_of(spark, []).snapshot().count() == 0


@pytest.mark.parametrize("staged", [False, True])
def test_keys_of_all_kinds(spark, staged):
    rows = [("", 1), ("", 2), (None, 1), (None, 2), ("a\0b", 1), ("a\0c", 1), ("reretion.", 1), ("innden$$$", 1), ("rrci.", 1), ("thndeaha.", 2), ("x" * 200, 7)]
    got = as_dict(acc_of(spark, rows, staged=staged).snapshot())
    assert got == {"": 3, None: 3, "a\0b": 1, "a\0c": 1, "reretion.": 1, "innden$$$": 1, "rrci.": 1, "thndeaha.": 2, "x" * 200: 7}


def test_hash_order_pages_and_cursor(spark):
    acc = acc_of(spark, [(f"k{i}", i) for i in range(50)] + [("reretion.", 1), ("innden$$$", 1)])
    rows = list(acc.cursor())
    order = [(r[HASH], r["key"]) for r in rows]
    assert len(rows) == 52 and order == sorted(order)
    pages, after = [], None
    while page := acc.read(limit=7, after=after).collect():
        pages += page
        after = (page[-1][HASH], page[-1]["key"])
    assert [r["key"] for r in pages] == [k for _, k in order]
    assert acc.read(limit=3).count() == 3
    assert sum(r["elements"] for r in partition_report(acc.snapshot()).collect()) == 52


def test_drain_and_snapshots(spark):
    acc = acc_of(spark, [("a", 1)])
    cursor, first = acc.cursor(), acc.snapshot()
    acc.bulk_insert(spark.createDataFrame([("a", 5), ("b", 1)], SCHEMA))
    assert as_dict(first) == {"a": 1} and [r["count"] for r in cursor] == [1]
    assert as_dict(acc.drain()) == {"a": 6, "b": 1}
    assert acc.drain() is None
    acc.bulk_insert(spark.createDataFrame([("c", 1)], SCHEMA))
    assert as_dict(acc.drain()) == {"c": 1}


def test_compaction_changes_nothing(spark):
    acc = acc_of(spark, [("a", 1), ("b", 2)], staged=True)
    acc.bulk_insert(spark.createDataFrame([("a", 5)], SCHEMA))
    acc.compact()
    assert len(acc.parts) == 1 and as_dict(acc.snapshot()) == {"a": 6, "b": 2}


def test_many_inserts_hold_few_tables(spark):
    """A thousand inserts: few tables at any time, and the same result."""
    acc = Accumulator(spark, counts(), fan=10)
    one, states = spark.createDataFrame([("test", 1), ("other", 2)], SCHEMA), None
    states = partial(one, counts())
    states.write.mode("overwrite").parquet(path := f"{shared_path(spark, 'one')}")
    states, first = spark.read.schema(states.schema).parquet(path), None
    for n in range(1000):
        acc.insert_states(states)
        assert len(acc.parts) < 10 * 4
        first = acc.snapshot() if n == 41 else first
    assert len(acc.parts) == 1 and as_dict(acc.snapshot()) == {"test": 1000, "other": 2000}
    assert as_dict(first) == {"test": 42, "other": 84}
    for n in range(12):
        acc.insert({"key": f"k{n}", "count": n})
    acc.compact()
    assert len(acc.parts) == 1 and len(as_dict(acc.snapshot())) == 14


def test_pages_are_of_one_snapshot(spark):
    acc = acc_of(spark, [(f"k{i % 60}", i) for i in range(300)] + [(None, 1)])
    want = [(r[HASH], r["key"], r["count"]) for r in acc.cursor()]
    pages = acc.pages(7)
    got = [next(pages)]
    acc.insert({"key": "late", "count": 1})
    got += list(pages)
    assert [len(p) for p in got] == [7] * 8 + [5]
    assert [(r[HASH], r["key"], r["count"]) for p in got for r in p] == want
    assert list(Accumulator(spark, counts()).pages(3)) == []
    assert acc.read(after=(want[-1][0], want[-1][1])).count() <= 1


def test_one_pass_over_many_batches(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], SCHEMA)
    parts = partials_by(df, counts(), F.pmod(F.col("count"), F.lit(3)), 3)
    assert [as_dict(p) for p in parts] == [{"b": 3}, {"a": 1, None: 4}, {"a": 2}]
    with pytest.raises(Exception, match="no batch"):
        partials_by(df, counts(), F.col("count"), 3)


def test_the_hash_has_its_name(spark):
    with pytest.raises(ValueError):
        Accumulator(spark, AggSpec({"key_hash": F.col("key")}, (StateCol("n", F.lit(1)),)))


def test_best_by_and_sketches(spark):
    rows = [("a", 5), ("a", 9), ("b", None), ("a", 9), ("b", 2)]
    spec = AggSpec(
        {"key": F.col("key")},
        (specs.best_by("top", F.col("count") % 4, F.col("count")), specs.best_by("low", F.col("count"), F.col("count"), False), StateCol("t", F.col("count"), "theta_union"), StateCol("q", F.col("count"), "kll_merge")),
        {"top": F.col("top.value"), "low": F.col("low.value"), "about": F.theta_sketch_estimate("t"), "median": F.kll_sketch_get_quantile_bigint("q", F.lit(0.5))},
    )
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [partial(df.where(c), spec) for c in ("key = 'a' and count < 6", "not (key = 'a' and count < 6)")]
    got = {r["key"]: (r["top"], r["low"], r["about"], r["median"]) for r in finish(merge_partials(parts, spec), spec).collect()}
    assert got == {"a": (9, 5, 2, 9), "b": (2, None, 1, 2)}


def test_a_merge_of_one_s_own(spark):
    """Bytes as states: the longest run of the letter x, kept as text in bytes."""
    name = f"longest_{random.random()}"
    specs.register_merge(name, lambda c: F.max(c), lambda c: F.max(F.regexp_extract(c, "x*", 0).cast("binary")))
    with pytest.raises(ValueError):
        specs.register_merge(name, F.max)
    spec = AggSpec({"key": F.lit(1)}, (StateCol("run", F.col("t"), name),), {"n": F.octet_length("run")})
    parts = [partial(spark.createDataFrame([(t,)], "t string"), spec) for t in ("xx", "xxxx", "x")]
    assert [r["n"] for r in finish(merge_partials(parts, spec), spec).collect()] == [4]


def test_load_by_name(spark):
    made = specs.load("tests.test_engine:counts")
    assert specs.load("tests.test_engine:counts") is made and specs.registered("tests.test_engine:counts") is made
    for bad, error in (("nothing", ValueError), ("no.such.module:x", ImportError), ("tests.test_engine:as_dict", TypeError)):
        with pytest.raises(error):
            specs.load(bad)


def test_wrong_batches_are_refused(spark):
    acc = acc_of(spark, [("a", 1)])
    with pytest.raises(ValueError):
        acc.bulk_insert(spark.createDataFrame([("a", "x")], "key string, count string"))
    with pytest.raises(ValueError):
        merge_partials([spark.createDataFrame([("a",)], "key string")], counts())


def test_wrong_specs_are_refused(spark):
    with pytest.raises(ValueError):
        AggSpec({}, (StateCol("n", F.lit(1)),))
    with pytest.raises(ValueError):
        AggSpec({"k": F.col("k")}, (StateCol("k", F.lit(1)),))
    with pytest.raises(ValueError):
        AggSpec({"k": F.col("k")}, (StateCol("n", F.lit(1), "concat"),))


def test_registry(spark):
    specs._registry.clear()
    made = specs.register("counts", counts())
    assert specs.registered("counts") is made
    with pytest.raises(ValueError):
        specs.register("counts", counts())


def test_uint32_wraps(spark):
    rows = spark.createDataFrame([("k", 4294967295), ("k", 2)], SCHEMA)
    assert as_dict(aggregate(rows, counts("uint32_sum"))) == {"k": 1}
    assert as_dict(aggregate(rows, counts())) == {"k": 4294967297}


@pytest.mark.parametrize("merge", ["sum", "min", "max", "bit_or", "bit_and", "bit_xor", "uint32_sum"])
def test_batches_and_levels_do_not_show(spark, merge):
    rng = random.Random(merge)
    rows = [(rng.choice("abcdefgh"), rng.randrange(1 << 33)) for _ in range(300)]
    whole = as_dict(aggregate(spark.createDataFrame(rows, SCHEMA), counts(merge)))
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    parts = [partial(spark.createDataFrame(b, SCHEMA).repartition(rng.randrange(1, 5)), counts(merge)) for b in batches]
    assert as_dict(merge_partials(parts[::-1], counts(merge))) == whole
    assert as_dict(reaggregate(parts, counts(merge), 2)) == whole


def test_sets_and_sketches(spark):
    rows = spark.createDataFrame([("a", i % 7) for i in range(50)] + [("b", 1)], SCHEMA)
    spec = AggSpec(
        {"key": F.col("key")},
        (StateCol("s", F.col("count"), "set_union"), StateCol("h", F.col("count"), "hll_union")),
        {"n": F.size("s"), "about": F.hll_sketch_estimate("h")},
    )
    parts = [partial(rows.where(c), spec) for c in ("count < 4", "count >= 2")]
    got = {r["key"]: (r["n"], r["about"]) for r in finish(merge_partials(parts, spec), spec).collect()}
    assert got == {"a": (7, 7), "b": (1, 1)}


@pytest.mark.parametrize("limit", [2, 1000])
def test_opaque_merge(spark, limit):
    rows = [(random.Random(i).choice(["a", "b", "c", None]), i) for i in range(200)]
    merge = lambda a, b: {"count": max(a["count"], b["count"])}
    got = as_dict(opaque_aggregate(spark.createDataFrame(rows, SCHEMA).repartition(5), "key", merge, limit))
    want = {}
    for k, v in rows:
        want[k] = max(want.get(k, v), v)
    assert got == want
    assert opaque_aggregate(spark.createDataFrame([], SCHEMA), "key", merge).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-(10**9), 10**9)), max_size=20), st.integers(1, 9))
def test_divided_states_merge_back(spark, rows, pieces):
    states = partial(spark.createDataFrame(rows, SCHEMA), counts())
    split = divide(states, "count", pieces)
    assert split.count() == pieces * len({k for k, _ in rows})
    assert as_dict(merge_partials([split], counts())) == as_dict(states)


def test_bad_records_are_set_aside(spark):
    lines = spark.createDataFrame([('{"key": "a", "count": 1}',), ("{broken",), ('{"key": "b", "count": 2}',)], "value string")
    good, bad = decode_batch(lines, SCHEMA)
    assert as_dict(good) == {"a": 1, "b": 2} and [r["value"] for r in bad.collect()] == ["{broken"]
