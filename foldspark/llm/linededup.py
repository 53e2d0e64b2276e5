"""Line deduplication by sharded minimal perfect hashes.

1. One pass over the texts lists each document's distinct line keys as 128-bit
   hashes; lines themselves are never shuffled.
2. The hashes are counted (combined before the shuffle): documents holding the
   line, and the largest doc_id among them.
3. Recurrent hashes are sharded; each shard gets a minimal perfect hash which
   indexes flat arrays of fingerprints, counts and keepers.
4. Documents probe the arrays: their hashes go to the shard that can answer
   them, where the shard's arrays come first and the probes stream past.  The
   few lines that hold more than 1/``HOT`` of all entries are at most ``HOT``
   by counting; they alone are broadcast, so no shard gets a hot line's probes.
5. Only the hashes to drop go back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .scratch import Batches, lean, packed, parts, sliced, table, with_row

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Keys held by more than one in HOT of all (document, key) entries are broadcast; there are fewer than HOT of them.
HOT = 4096
#: Keys of one shard, about.
SHARD = 50_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it has fewer code points than ``min_chars``."""
    key = line.strip(SPACES).lower()  # bytes.lower() is A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _keys(min_chars: int):
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, "text"):
            ids, rows, h = batch.column("doc_id"), [], []
            for at, text in enumerate(batch.column("text")):
                if text.is_valid:
                    lines = text.as_buffer().to_pybytes().split(b"\n")
                    own = {xxhash.xxh3_128_digest(k) for x in lines if (k := line_key(x, min_chars)) is not None}
                    rows += [at] * len(own)
                    h += own
            pair = np.frombuffer(b"".join(h), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", "h1", "h2"]
            )

    return lean(run)


# ------------------------------------------------------- minimal perfect hash


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of bit arrays, ranked.

    Keys alone on their bit of a level are placed there, the others go on to
    the next level; the rank of the bit over all levels is the key's index.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for keys outside the set any index, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for n, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (_mix(keys[left], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(x) for x in self.levels], dtype=np.int64)
        return sizes.tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at, raw = [], 0, np.frombuffer(bits, dtype=np.uint8)
        for n in np.frombuffer(sizes, dtype=np.int64).tolist():
            levels.append(np.unpackbits(raw[at : at + (n + 7) // 8], count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels)


_INDEX = "shard long, kind int, sizes binary, bits binary, prints binary, counts binary, keepers binary, doc_id long, h1 long, h2 long"


def _build(batches: Batches) -> Batches:
    """Rows (shard, h1, h2, n, keeper) sorted by shard to one index row a shard."""

    def index(shard, h1, h2, n, keeper):
        keys = h1.view(np.uint64)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate(([True], np.diff(keys[order]) != 0))
        mph = PerfectHash.build(keys[order][first])
        at = mph.lookup(keys)
        prints, counts, keepers = (np.zeros(mph.size, np.int64) for _ in range(3))
        prints[at], counts[at], keepers[at] = h2, n, keeper
        sizes, bits = mph.dump()
        blobs = (sizes, bits, prints.tobytes(), counts.tobytes(), keepers.tobytes())
        empty = [pa.nulls(1, pa.int64())] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), *empty],
            ["shard", "kind", "sizes", "bits", "prints", "counts", "keepers", "doc_id", "h1", "h2"],
        )

    held = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h1", "h2", "n", "keeper")]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        edge = np.flatnonzero(np.diff(held[0])) + 1
        for a, b in zip([0, *edge[:-1]], edge, strict=False):
            yield index(int(held[0][a]), *(x[a:b] for x in held[1:]))
        if len(edge):
            held = [x[edge[-1] :] for x in held]
    if len(held[0]):
        yield index(int(held[0][0]), *held[1:])


def _probe(batches: Batches) -> Batches:
    """An index row, then its shard's probes, shard after shard, to (doc_id, h1, h2) that are to drop."""
    shard, mph = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        h1 = batch.column("h1").fill_null(0).to_numpy(zero_copy_only=False)
        h2 = batch.column("h2").fill_null(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (kinds[1:] == 0) | (kinds[:-1] == 0)) + 1).tolist(), len(shards)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if kinds[a] == 0:
                blob = [batch.column(c)[a].as_buffer().to_pybytes() for c in ("sizes", "bits", "prints", "counts", "keepers")]
                shard, mph = shards[a], PerfectHash.load(*blob[:2])
                prints, keepers = np.frombuffer(blob[2], np.int64), np.frombuffer(blob[4], np.int64)
            elif shard == shards[a]:  # else a shard without recurrent lines
                at = mph.lookup(h1[a:b].view(np.uint64))
                drop = (at >= 0) & (prints[at] == h2[a:b]) & (ids[a:b] < keepers[at])
                out.append(np.arange(a, b)[drop])
        if out:
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (ids, h1, h2)], ["doc_id", "h1", "h2"])


def _rewrite(min_chars: int):
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, "_text"):
            texts, lines_in, dropped = [], [], []
            for text, drops in zip(batch.column("_text"), batch.column("_drops"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                keep = lines
                if drops.is_valid:
                    gone = set(drops.as_py())
                    keep = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                texts.append(b"\n".join(keep) if len(keep) < len(lines) else raw)
                lines_in.append(len(lines))
                dropped.append(len(lines) - len(keep))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), kept, pa.array(lines_in, pa.int64()), pa.array(dropped, pa.int64())],
                ["row", "text", "n_lines", "n_dropped"],
            )

    return lean(run)


def drops(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, h1, h2): the line keys that each document loses.  ``docs(doc_id, text)`` with plain names."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    entries = table(source.mapInArrow(_keys(min_chars), "doc_id long, h1 long, h2 long"), "line-entries")
    lowest = F.lit(-(1 << 63))
    counted = entries.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.coalesce("doc_id", lowest)).alias("keeper"))
    recurrent = table(counted.where(F.col("n") >= min_docs), "recurrent-lines")
    total, many = entries.count(), recurrent.count()
    hot = recurrent.where(F.col("n") > F.lit(max(min_docs, total // HOT)))  # fewer than HOT keys, by counting
    rare = recurrent.where(F.col("n") <= F.lit(max(min_docs, total // HOT)))
    entries = entries.where("doc_id is not null")
    keys = ["h1", "h2"]
    from_hot = entries.join(F.broadcast(hot), keys).where(F.col("doc_id") < F.col("keeper")).select("doc_id", *keys)
    n = parts(spark)
    shard = F.pmod("h2", F.lit(max(8 * n, -(-many // SHARD)))).alias("shard")
    index = rare.select(shard, *keys, "n", "keeper").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(lean(_build), _INDEX)
    probes = entries.join(F.broadcast(hot.select(*keys)), keys, "left_anti").select(shard, F.lit(1).alias("kind"), "doc_id", *keys)
    both = index.unionByName(probes, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(lean(_probe), "doc_id long, h1 long, h2 long").unionByName(from_hot)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with recurrent lines dropped from ``text``; adds n_lines and n_dropped (replacing such columns).

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]``, A-Z in lower
    case.  Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents stay only in the largest doc_id that holds them, with all their
    lines there.  A null or empty text is one empty line and comes back empty.
    Each row counts as a document; rows that repeat the largest doc_id all
    keep the line.  A row with a null doc_id counts, keeps its lines and is
    never the largest.  Other columns come back as they are.
    """
    plain = docs.select("doc_id", "text")
    gone = drops(plain, min_docs, min_chars)
    # the digest of the key, as xxhash gives it: low half first in the pair of little-endian longs
    lists = gone.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_pairs")).select(F.col("doc_id").alias("_id"), "_pairs")
    bytes_of = lambda c: F.unhex(F.regexp_replace(F.lpad(F.hex(c), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))
    lists = lists.select("_id", F.transform("_pairs", lambda p: F.concat(bytes_of(p["h1"]), bytes_of(p["h2"]))).alias("_drops"))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    own = docs.select(packed(docs, rest), docs["doc_id"].cast("long").alias("_own"), docs["text"].cast("binary").alias("_text"))
    joined = own.join(lists, own["_own"] == lists["_id"], "left").select("row", "_text", "_drops")
    out = joined.mapInArrow(_rewrite(min_chars), with_row(joined, text=StringType(), n_lines=LongType(), n_dropped=LongType()))
    column = lambda c: F.col("text") if c == "text" else F.col("row")[c].alias(c)
    return out.select(*(column(c) for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


#: DuckDB SQL for the digests of ``dedup_lines`` over ``documents``.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT r, i, line, keeper IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j JOIN d USING (r) GROUP BY r"""
