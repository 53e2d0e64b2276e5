"""The engine's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, hashing
from .operators.accumulator import Accumulator
from .operators.opaque import divide, opaque_aggregate
from .plans.engine import aggregate, distinct_keys, finish, merge_partials, partial, partials_by, reaggregate
from .plans.spec import AggSpec, StateCol, count, exact_sum
from .sources import wire
from .sources.datagen import generate
from .sources.staging import read_table as read
from .sources.staging import shared_path, spread
from .streaming import ingest, metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def by(*columns: str) -> dict[str, Column]:
    return {c: F.col(c) for c in columns}


def words(docs: DataFrame) -> DataFrame:
    """One row a word: runs between spaces, tabs and line ends."""
    return spread(docs.select("text")).select(F.explode(F.split("text", "[ \\t\\r\\n]+")).alias("word")).where("word <> ''")


def per_word() -> AggSpec:
    return AggSpec(by("word"), (count(),))


def per_event() -> AggSpec:
    return AggSpec(by("event_type"), (count(),))


def quantity(key: str) -> AggSpec:
    states = (exact_sum("l_quantity", "qty"), count())
    return AggSpec(by(key), states, {"sum_qty": F.col("qty").cast("double"), "n": F.col("n")})


@query
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(words(read(spark, sf_dir, "documents")), per_word())


@query
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(read(spark, sf_dir, "events"), per_event())


@query
def sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggSpec(
        by("l_returnflag", "l_linestatus"),
        (exact_sum("l_quantity", "qty"), exact_sum("l_extendedprice", "price")),
        {"sum_qty": F.col("qty").cast("double"), "sum_price": F.col("price").cast("double")},
    )
    return aggregate(read(spark, sf_dir, "lineitem"), spec)


@query
def min_max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = [StateCol(f"{m}_{c}", F.col(c), m) for c in ("user_id", "ts") for m in ("min", "max")]
    return aggregate(read(spark, sf_dir, "events"), AggSpec(by("event_type"), tuple(states)))


@query
def avg_pair_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggSpec(by("l_returnflag"), (exact_sum("l_quantity", "s"), count()), {"avg_qty": F.col("s").cast("double") / F.col("n")})
    return aggregate(read(spark, sf_dir, "lineitem"), spec)


@query
def variance_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_custkey").cast("decimal(20,0)")
    states = (count(), StateCol("s", x), StateCol("q", (x * x).cast("decimal(28,0)")))
    n, s, q = (F.col(c).cast("double") for c in ("n", "s", "q"))
    return aggregate(read(spark, sf_dir, "orders"), AggSpec(by("o_orderstatus"), states, {"n": F.col("n"), "var": q / n - (s / n) * (s / n)}))


@query
def bitor_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = tuple(StateCol(f"bits_{m}", F.col("o_custkey"), f"bit_{m}") for m in ("or", "and", "xor"))
    return aggregate(read(spark, sf_dir, "orders"), AggSpec(by("o_orderpriority"), states))


@query
def distinct_set_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggSpec(by("l_returnflag"), (StateCol("suppliers", F.col("l_suppkey"), "set_union"),), {"n_suppliers": F.size("suppliers").cast("long")})
    return aggregate(read(spark, sf_dir, "lineitem"), spec)


@query
def high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(read(spark, sf_dir, "lineitem"), quantity("l_orderkey"))


@query
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(read(spark, sf_dir, "lineitem"), quantity("l_returnflag"))


@query
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(read(spark, sf_dir, "lineitem"), AggSpec(by("l_suppkey", "l_linenumber"), (count(),)))


@query
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(read(spark, sf_dir, "documents"), AggSpec({"lang": F.lower("lang")}, (count(),)))


@query
def bulk_insert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each of the line numbers 1 to 3 and one for all others, dealt in one pass."""
    spec = quantity("l_returnflag")
    acc = Accumulator(spark, spec)
    batch = F.when(F.col("l_linenumber").isin(1, 2, 3), F.col("l_linenumber")).otherwise(0)
    for states in partials_by(read(spark, sf_dir, "lineitem"), spec, batch, 4):
        acc.insert_states(states)
    return acc.snapshot()


@query
def two_source_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggSpec(by("nation"), (count(),))
    acc = Accumulator(spark, spec)
    for table, column in (("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        acc.bulk_insert(read(spark, sf_dir, table).select(F.col(column).alias("nation")))
    return acc.snapshot()


@query
def multi_level_reagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    spec = quantity("l_returnflag")
    parts = partials_by(items, spec, F.pmod(F.coalesce("l_partkey", F.lit(0)), F.lit(8)), 8)
    return finish(reaggregate(parts, spec, 2), spec)


@query
def distinct_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_keys(read(spark, sf_dir, "events"), AggSpec(by("user_id"), (count(),)))


@query
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_keys(read(spark, sf_dir, "events"), AggSpec(by("user_id"), (count(),))).agg(F.count("user_id").alias("n_users"))


@query
def divide_remerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggSpec(by("l_returnflag"), (count(),))
    return merge_partials([divide(partial(read(spark, sf_dir, "lineitem"), spec), "n", 7)], spec)


@query
def opaque_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = read(spark, sf_dir, "events").select("event_type", F.lit(1).cast("long").alias("n"), F.col("user_id").alias("top"))

    def merge(a: dict, b: dict) -> dict:
        tops = [x for x in (a["top"], b["top"]) if x is not None]
        return {"n": a["n"] + b["n"], "top": max(tops) if tops else None}

    return opaque_aggregate(states, "event_type", merge)


@query
def uint32_wrap_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("l_partkey") * F.lit(1_000_003)
    return aggregate(read(spark, sf_dir, "lineitem"), AggSpec(by("l_returnflag"), (StateCol("wrapped", big, "uint32_sum"),)))


@query
def colliding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, and once more two pairs of words with equal hashes: keys are told apart by equality."""
    clashing = spark.range(1).select(F.explode(F.array(*map(F.lit, ("reretion.", "innden$$$", "rrci.", "thndeaha.")))).alias("word"))
    return aggregate(words(read(spark, sf_dir, "documents")).unionByName(clashing), per_word())


@query
def read_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = Accumulator(spark, per_word())
    acc.bulk_insert(words(read(spark, sf_dir, "documents")))
    return acc.read(limit=100)


def _side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """(event_type, n_first, n_second) of two counts."""
    counts = [df.select("event_type", F.lit(k).alias("k"), "n") for k, df in enumerate((first, second))]
    sums = [F.sum(F.when(F.col("k") == k, F.col("n"))).alias(name) for k, name in enumerate(("n_first", "n_second"))]
    return counts[0].unionByName(counts[1]).groupBy("event_type").agg(*sums)


@query
def drain_and_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of all events: nothing of the first is left in the second."""
    events, acc = read(spark, sf_dir, "events"), Accumulator(spark, per_event())
    epochs = []
    for _ in range(2):
        acc.bulk_insert(events)
        epochs.append(acc.drain())
    return _side_by_side(*epochs)


@query
def snapshot_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot after all events, and one after they came again: the first does not change."""
    events, acc = read(spark, sf_dir, "events"), Accumulator(spark, per_event())
    snapshots = []
    for _ in range(2):
        acc.bulk_insert(events)
        snapshots.append(acc.snapshot())
    return _side_by_side(*snapshots)


@query
def murmur2(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = words(read(spark, sf_dir, "documents")).distinct()
    return keys.select("word", hashing.engine_hash(F.col("word")).alias("hash"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name")


@query
def digram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.regexp_replace("p_name", " ", "-")
    return _names(spark, sf_dir).select("p_partkey", hashing.digram(pair).alias("hash"))


@query
def nullhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", *(hashing.nullhash(F.col("p_name"), n).alias(f"h{n}") for n in (0, 2, 50)))


@query
def bob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", hashing.bob(F.col("p_name")).alias("hash"))


@query
def bob2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", hashing.bob2(F.col("p_name")).alias("h")).select("p_partkey", "h.idx1", "h.idx2")


@query
def fnv1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hashing.fnv1(F.col("lang")).alias("hash"))


@query
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hashing.fnv1a(F.col("source")).alias("hash"))


def _int_hash(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: read(spark, sf_dir, "orders").select("o_orderkey", f(F.col("o_orderkey")).alias("hash"))


for _name in ("hashint_1", "hashint_2", "hashint_half"):
    QUERIES[_name] = _int_hash(getattr(hashing, _name))


@query
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.rle_table(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order keys, ascending, and their priorities' numbers in that order."""
    number = F.substring("o_orderpriority", 1, 1).cast("long")
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", number.alias("p")))).alias("x")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(pairs).select("o_custkey", F.col("x.o_orderkey").alias("keys"), F.col("x.p").alias("p"))


@query
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _arrays(spark, sf_dir).withColumn("coded", codecs.rle_encode(F.col("p")))
    return coded.select("o_custkey", F.size("p").cast("long").alias("n"), codecs.rle_decode(F.col("coded")).eqNullSafe(F.col("p")).alias("same"))


@query
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.delta_table(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _arrays(spark, sf_dir).withColumn("packed", codecs.delta_pack(F.col("keys")))
    return made.select("o_custkey", F.size("keys").cast("long").alias("n"), codecs.delta_unpack(F.col("packed")).eqNullSafe(F.col("keys")).alias("same"))


@query
def bit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", codecs.nlz(key).alias("nlz"), codecs.bit_width(key).alias("bits"), codecs.lz4_bound(key).alias("bound"))


@query
def gen_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(generate(spark, 100_000, 10_000, 8), AggSpec(by("key"), (StateCol("count", F.col("count")),)))


@query
def gen_powerlaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(generate(spark, 100_000, 10_000, 8, power=1.0), AggSpec(by("key"), (StateCol("count", F.col("count")),)))


def _law(keys: DataFrame, letters: int) -> DataFrame:
    """What must hold of generated keys: rows, length, letters of the prefix, and a filler that adds no keys.

    The prefix is two letters and one of the first ``letters``.
    """
    prefix = F.substring("key", 1, 3)
    odd = ~F.col("key").rlike(f"^[a-z][a-z][a-{chr(96 + letters)}][a-z]*$")
    per_prefix = keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), F.sum("count").alias("count"), F.sum(odd.cast("long")).alias("odd"), F.min(F.length("key")).alias("short"), F.max(F.length("key")).alias("long"))
    return per_prefix.agg(
        F.sum("count").alias("total"),
        F.min("short").alias("shortest"),
        F.max("long").alias("longest"),
        F.sum("odd").alias("odd_keys"),
        F.sum(F.col("n") - 1).alias("keys_beyond_prefixes"),
        (F.count("*") > 0.98 * 26 * 26 * letters).alias("nearly_all_prefixes"),
        (F.max("count") > 20 * F.sum("count") / (26 * 26 * letters)).alias("skewed"),
    )


@query
def gen_uniform_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _law(gen_uniform(spark, sf_dir), 15)


@query
def gen_powerlaw_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _law(gen_powerlaw(spark, sf_dir), 15).drop("nearly_all_prefixes")


@query
def load_replay_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came through a replay, by the first letters of their keys being letters at all."""
    return load_replay(spark, sf_dir).groupBy(F.length("key").alias("length")).agg(F.sum("count").alias("total"))


@query
def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_complete(ingest.file_stream(spark, sf_dir, "events"), per_event())[0]


@query
def stream_foreach_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_partials(ingest.file_stream(spark, sf_dir, "events", 1), per_event())[0]


@query
def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_rows(spark, ingest.run_partials(ingest.file_stream(spark, sf_dir, "events"), per_event())[1])


@query
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit(1).cast("long").alias("count"))
    back = wire.accepted(wire.decode(wire.encode(records, 1000)))
    return aggregate(back, AggSpec(by("key"), (StateCol("n", F.col("count"), "uint32_sum"),)))


@query
def load_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated batches sent to a watched folder and folded by the stream that watches it."""
    folder = shared_path(spark, "load")
    ingest.send_batches([generate(spark, 10_000, 100, 6, seed=n) for n in range(3)], folder)
    stream = ingest.watched_stream(spark, folder, "key string, count long", 8)
    return ingest.run_partials(stream, AggSpec(by("key"), (StateCol("count", F.col("count")),)))[0]
