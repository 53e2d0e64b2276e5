"""DuckDB SQL for the engine's own queries."""

from __future__ import annotations

from .functions import hashing

WORDS = "(SELECT unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS word FROM documents)"
EVENT_COUNT = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
FLAG = "SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1"
MASK = hashing.MASK


def murmur2_sql(text: str, seed: int) -> str:
    """MurmurHash2 of an ASCII or UTF-8 string expression, by its bytes in hex."""
    mul = lambda x: f"(({x}) * {hashing.MURMUR2_M} & {MASK})"
    byte = lambda i: f"('0x' || substr(hx, 2 * ({i}) + 1, 2))::BIGINT"
    word = f"({byte('4*i')} + {byte('4*i+1')} * 256 + {byte('4*i+2')} * 65536 + {byte('4*i+3')} * 16777216)"
    mixed = f"list_transform(list_transform(list_transform(range(0, n // 4), lambda i: {word}), lambda k: {mul('k')}), lambda k: {mul('xor(k, k >> 24)')})"
    body = f"list_reduce(list_prepend(xor(n, {seed}), {mixed}), lambda h, k: xor({mul('h')}, k))"
    at = "4 * (n // 4)"
    tail = f"{byte(at)}"
    tail2, tail3 = f"{tail} + {byte(at + ' + 1')} * 256", f"{tail} + {byte(at + ' + 1')} * 256 + {byte(at + ' + 2')} * 65536"
    step = f"CASE n % 4 WHEN 0 THEN h0 WHEN 1 THEN {mul(f'xor(h0, {tail})')} WHEN 2 THEN {mul(f'xor(h0, {tail2})')} ELSE {mul(f'xor(h0, {tail3})')} END"
    inner = f"SELECT *, {body} AS h0 FROM (SELECT *, hex({text}) AS hx, strlen({text})::BIGINT AS n FROM src)"
    mixed_end = f"SELECT *, {mul('xor(h1, h1 >> 13)')} AS h2 FROM (SELECT *, {step} AS h1 FROM ({inner}))"
    return f"SELECT *, xor(h2, h2 >> 15) AS hash FROM ({mixed_end})"


def _engine(text: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN hash = {MASK} THEN {MASK - 1} ELSE hash END AS hash) FROM ({murmur2_sql(text, 42)})"


def _int_hash(steps: list) -> str:
    """The steps of ``hashing._chain`` as nested queries."""
    q = f"SELECT o_orderkey, o_orderkey & {MASK} AS a FROM orders"
    for constant, inner, amount, outer in steps:
        left = f"((a + {constant}) & {MASK})" if inner == "+" else f"xor(a, {constant})"
        moved = f"((a << {amount}) & {MASK})" if amount > 0 else f"(a >> {-amount})"
        new = f"xor({left}, {moved})" if outer == "^" else f"({left} {outer} {moved})"
        q = f"SELECT o_orderkey, {new} & {MASK} AS a FROM ({q})"
    return f"SELECT o_orderkey, a AS hash FROM ({q})"


def _nullhash(shift: int) -> str:
    byte = lambda k: f"('0x' || substr(hex(p_name), 2 * (strlen(p_name) - {shift} - {k}) + 1, 2))::BIGINT"
    return f"CASE WHEN strlen(p_name) - {shift} < 4 THEN 0 ELSE {byte(4)} * 16777216 + {byte(3)} * 65536 + {byte(2)} * 256 + {byte(1)} END AS h{shift}"


_DIGRAM = f"""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '-') AS t FROM part),
src AS (SELECT p_partkey, k, w FROM (SELECT p_partkey, 0 AS k, t AS w FROM p
  UNION ALL SELECT p_partkey, 1, string_split(t, '-')[1] FROM p UNION ALL SELECT p_partkey, 2, substr(t, length(string_split(t, '-')[1]) + 2) FROM p)),
h AS ({murmur2_sql("w", 42)}),
x AS (SELECT p_partkey, max(hash) FILTER (WHERE k = 0) AS h0, max(hash) FILTER (WHERE k = 1) AS h1, max(hash) FILTER (WHERE k = 2) AS h2,
  max(strlen(w)) FILTER (WHERE k = 1) AS l1, max(strlen(w)) FILTER (WHERE k = 2) AS l2 FROM h GROUP BY 1),
y AS (SELECT *, (CASE WHEN l1 > l2 THEN h1 + (h2 & 1023) ELSE (h1 & 1023) + h2 + 1 END) & {MASK} AS b FROM x)
SELECT p_partkey, CASE WHEN NOT contains(t, '-') THEN h0 WHEN b = {MASK} THEN {MASK - 1} ELSE b END AS hash FROM y JOIN p USING (p_partkey)"""



def _lookup3(groups: int = 8) -> str:
    """Jenkins lookup3 of p_name with seeds 0 by its bytes in hex, step by step; null for names of more than 12 bytes a group."""
    byte = lambda i: f"(CASE WHEN {i} < n THEN ('0x' || substr(hx, {2 * i + 1}, 2))::BIGINT ELSE 0 END)"
    word = lambda at: " + ".join(f"{byte(at + k)} * {256**k}" for k in range(4))
    turn = lambda v, k: f"((({v} << {k}) & 4294967295) | ({v} >> {32 - k}))"
    steps = ["SELECT p_partkey, hex(p_name) AS hx, strlen(p_name)::BIGINT AS n, (3735928559 + strlen(p_name)) & 4294967295 AS a, a AS b, a AS c FROM part"]

    def step(condition: str, **new: str) -> None:
        made = ", ".join(f"CASE WHEN {condition} THEN ({x}) & 4294967295 ELSE {v} END AS {v}" for v, x in new.items())
        steps.append(f"SELECT * REPLACE ({made}) FROM s{len(steps) - 1}")

    for g in range(groups):
        step(f"n > {12 * g}", **{v: f"{v} + {word(12 * g + 4 * k)}" for k, v in enumerate("abc")})
        for x, y, z, k in ("abc4", "bca6", "cab8", ("a", "b", "c", 16), ("b", "c", "a", 19), "cab4"):
            step(f"n > {12 * g + 12}", **{x: f"xor(({x} - {z}) & 4294967295, {turn(z, int(k))})", z: f"{z} + {y}"})
    for x, y, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        step("n > 0", **{x: f"xor({x}, {y}) - {turn(y, k)}"})
    step(f"n > {12 * groups}", b="NULL", c="NULL")
    return "WITH " + ", ".join(f"s{k} AS ({q})" for k, q in enumerate(steps)) + " SELECT p_partkey, {} FROM " + f"s{len(steps) - 1}"


_LAW = "SELECT 100000::BIGINT AS total, 8 AS shortest, 8 AS longest, 0::BIGINT AS odd_keys, 0::BIGINT AS keys_beyond_prefixes"

ORACLE: dict[str, str] = {
    "bob": _lookup3().format("c AS hash"),
    "bob2": _lookup3().format("c AS idx1, b AS idx2"),
    "gen_uniform_law": f"{_LAW}, true AS nearly_all_prefixes, false AS skewed",
    "gen_powerlaw_law": f"{_LAW}, true AS skewed",
    "load_replay_total": "SELECT 6 AS length, 30000::BIGINT AS total",
    "word_count": f"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1",
    "count_by_key": EVENT_COUNT,
    "sum_by_key": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, "
    "sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price FROM lineitem GROUP BY 1, 2",
    "min_max_by_key": "SELECT event_type, min(user_id) AS min_user_id, max(user_id) AS max_user_id, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY 1",
    "avg_pair_by_key": "SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*) AS avg_qty FROM lineitem GROUP BY 1",
    "variance_by_key": "SELECT o_orderstatus, n, q / n - (s / n) * (s / n) AS var FROM (SELECT o_orderstatus, count(*) AS n, "
    "sum(o_custkey)::DOUBLE AS s, sum(o_custkey * o_custkey)::DOUBLE AS q FROM orders GROUP BY 1)",
    "bitor_by_key": "SELECT o_orderpriority, bit_or(o_custkey) AS bits_or, bit_and(o_custkey) AS bits_and, bit_xor(o_custkey) AS bits_xor FROM orders GROUP BY 1",
    "distinct_set_by_key": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1",
    "high_cardinality": FLAG.replace("l_returnflag", "l_orderkey"),
    "low_cardinality": FLAG,
    "composite_key": "SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "canonical_key": "SELECT lower(lang) AS lang, count(*) AS n FROM documents GROUP BY 1",
    "bulk_insert_batches": FLAG,
    "two_source_insert": "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "multi_level_reagg": FLAG,
    "distinct_key_list": "SELECT DISTINCT user_id FROM events",
    "distinct_count": "SELECT count(DISTINCT user_id) AS n_users FROM events",
    "divide_remerge": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1",
    "opaque_merge": "SELECT event_type, count(*) AS n, max(user_id) AS top FROM events GROUP BY 1",
    "uint32_wrap_sum": "SELECT l_returnflag, (sum(l_partkey * 1000003) % 4294967296)::BIGINT AS wrapped FROM lineitem GROUP BY 1",
    "colliding_keys": f"SELECT word, count(*) AS n FROM (SELECT word FROM {WORDS} WHERE word <> '' UNION ALL "
    "SELECT unnest(['reretion.', 'innden$$$', 'rrci.', 'thndeaha.'])) GROUP BY 1",
    "read_limit": f"WITH src AS (SELECT word, count(*) AS c FROM {WORDS} WHERE word <> '' GROUP BY 1) "
    f"SELECT word, c AS n, hash AS key_hash FROM (SELECT word, c, hash FROM ({_engine('word')})) ORDER BY hash, word LIMIT 100",
    "drain_and_refill": "SELECT event_type, count(*) AS n_first, count(*) AS n_second FROM events GROUP BY 1",
    "snapshot_isolation": "SELECT event_type, count(*) AS n_first, 2 * count(*) AS n_second FROM events GROUP BY 1",
    "murmur2": f"WITH src AS (SELECT DISTINCT word FROM {WORDS} WHERE word <> '') SELECT word, hash FROM ({_engine('word')})",
    "digram": _DIGRAM,
    "nullhash": f"SELECT p_partkey, {_nullhash(0)}, {_nullhash(2)}, 0::BIGINT AS h50 FROM part",
    "fnv1": f"SELECT doc_id, list_reduce(list_prepend({hashing.FNV1_START}::BIGINT, list_transform(range(0, strlen(lang)), "
    f"lambda i: ('0x' || substr(hex(lang), 2 * i + 1, 2))::BIGINT)), lambda h, b: xor((h * {hashing.FNV1_PRIME}) & {MASK}, b)) AS hash FROM documents",
    "fnv1a": "SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen(source)), "
    "lambda i: ('0x' || substr(hex(source), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS hash FROM documents",
    "hashint_1": _int_hash(hashing.AVALANCHE_1),
    "hashint_2": _int_hash(hashing.AVALANCHE_2),
    "hashint_half": _int_hash(hashing.AVALANCHE_HALF),
    "rle_encode": "SELECT o_custkey, run::BIGINT AS run, o_orderstatus, count(*) AS n FROM (SELECT *, sum(new) OVER w AS run FROM (SELECT *, "
    "CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM orders "
    "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) GROUP BY 1, 2, 3",
    "rle_roundtrip": "SELECT o_custkey, count(*) AS n, true AS same FROM orders GROUP BY 1",
    "delta_encode": "SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders",
    "delta_roundtrip": "SELECT o_custkey, count(*) AS n, true AS same FROM orders GROUP BY 1",
    "bit_width": "SELECT o_orderkey, (32 - b)::INTEGER AS nlz, b::INTEGER AS bits, o_orderkey + o_orderkey // 255 + 16 AS bound FROM "
    "(SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END AS b FROM orders)",
    "stream_complete": EVENT_COUNT,
    "stream_foreach_partials": EVENT_COUNT,
    "wire_roundtrip": "SELECT event_type AS key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "ingest_metrics": "SELECT count(*) AS total_rows FROM events",
}
