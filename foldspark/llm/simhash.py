"""SimHash near-duplicates by bit-sliced comparison.

1. Each whole text becomes a 64-bit fingerprint: the bitwise majority of the
   XXH64 (seed 42) of its three-word shingles.
2. Equal fingerprints collapse into one class before anything is compared, so
   exact copies cost one row whatever their number.
3. Two fingerprints within the radius of 3 differ in at most 3 of 5 blocks, so
   they agree on 2 blocks.  Each class is dealt to the 10 block pairs; a bucket
   holds the classes which agree on about 26 bits.
4. A bucket is compared bit-sliced: 64 fingerprints form a block whose bit
   planes are stored vertically, one machine word per plane.  A query walks the
   planes; its differences are added to 64 carry-save counters at once, and a
   block is abandoned as soon as all of its lanes exceed the radius.
5. Buckets above ``TILE`` classes are cut into tiles and the tile pairs are
   dealt to separate tasks: no bucket is capped, none meets in one task.
6. Each bucket returns a spanning forest, not its pairs; components follow from
   the forests (see ``components``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Batches, lean, parts, sliced, table

RADIUS = 3
#: Most classes of one bucket side which are compared in one task step.
TILE = 2048
#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Majority fingerprint of a UTF-8 text; zero without words."""
    words = WORDS.findall(text.lower()) if text else []  # bytes.lower() is A-Z only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        h = np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        run = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -size] + 1))
        h = np.array(
            [digest(run[s:e], 42) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # a bounded unpacked block of a very long text
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Batches) -> Batches:
    for batch in sliced(batches, "text"):
        texts = batch.column("text")
        fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return picked.mapInArrow(lean(_fingerprints), "doc_id long, fp long")


# ------------------------------------------------------------------ comparison


def planes_of(fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical bit planes of groups: (planes[64, blocks], first block of each group, lanes in use of each block)."""
    blocks = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    lane = np.arange(len(fps)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    place = np.repeat(first, sizes) * 64 + lane
    total = int(blocks.sum())
    bits = np.zeros((total * 64, 64), dtype=np.uint8)
    bits[place] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    used = np.zeros(total * 64, dtype=np.uint8)
    used[place] = 1
    pack = lambda x: np.packbits(x.reshape(total, 64), axis=1, bitorder="little").view("<u8").reshape(total)
    return np.stack([pack(np.ascontiguousarray(bits[:, b])) for b in range(64)]), first, pack(used)


def within_radius(planes: np.ndarray, used: np.ndarray, query: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within the radius for each (query fingerprint, block): (index of the pair, word of lanes).

    ``ones`` and ``twos`` are the carry-save counters of the 64 lanes; a carry
    out of ``twos`` is a fourth difference and marks the lane for good.
    """
    live = np.arange(len(query))
    over = ~used[block]
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for b in range(64):
        x = planes[b][block] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            keep = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                live, query, block = live[keep], query[keep], block[keep]
                ones, twos, over = ones[keep], twos[keep], over[keep]
        if not len(live):
            break
    return live, ~over


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _link_groups(fps: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links (node, root) of complete groups that lie one after the other."""
    planes, first, used = planes_of(fps, sizes)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    blocks = -(-sizes // 64)
    per = np.repeat(blocks, sizes)  # blocks each row is compared with
    total = np.cumsum(per)
    at = 0
    left, right = [], []
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18), side="right")))
        row = np.repeat(np.arange(at, to), per[at:to])
        offset = np.arange(len(row)) - np.repeat(np.cumsum(per[at:to]) - per[at:to], per[at:to])
        group = np.searchsorted(start, row, side="right") - 1
        block = first[group] + offset
        live, lanes = within_radius(planes, used, fps[row], block)
        if len(live):
            hit = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(hit)
            a = row[live[i]]
            b = start[group[live[i]]] + offset[live[i]] * 64 + lane
            left.append(a[b > a])
            right.append(b[b > a])
        at = to
    if left:
        root = forest(len(fps), np.concatenate(left), np.concatenate(right))
        joined = root != np.arange(len(fps))
        yield nodes[joined], nodes[root[joined]]


def _compare(batches: Batches) -> Batches:
    """Rows (bucket, fp, node) sorted by bucket to spanning links (a, b)."""

    def complete(bucket, fp, node):
        edge = np.flatnonzero(np.diff(bucket)) + 1
        sizes = np.diff(np.concatenate(([0], edge, [len(bucket)])))
        many = np.repeat(sizes > 1, sizes)
        if many.any():
            for a, b in _link_groups(fp[many].view(np.uint64), node[many], sizes[sizes > 1]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp", "node")]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1], side="left"))  # the last bucket may go on
        if cut:
            yield from complete(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from complete(*held)


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that span all pairs of ``classes(fp, node)`` within the radius; fp is distinct."""
    spark = classes.sparkSession
    keys = []
    for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        part = [F.shiftrightunsigned("fp", BLOCKS[x][0]).bitwiseAND((1 << BLOCKS[x][1]) - 1) for x in (i, j)]
        keys.append(F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(part[0], 13)).bitwiseOR(part[1]))
    dealt = table(classes.select("fp", "node", F.explode(F.array(*keys)).alias("key")), "simhash-buckets")
    big = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    big = big.select("key", F.ceil(F.col("n") / F.lit(TILE)).cast("long").alias("tiles"))
    tagged = dealt.join(big, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    other = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    pairs = tagged.select("fp", "node", "key", mine.alias("mine"), F.explode(other).alias("other"))
    bucket = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    spread = pairs.select(bucket.alias("bucket"), "fp", "node").repartition(parts(spark), "bucket")
    return spread.sortWithinPartitions("bucket").mapInArrow(lean(_compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of at most 3
    differing bits.  Null and empty texts and texts of white space alone have
    fingerprint zero and link like any other.  Rows with a null doc_id get a
    fingerprint and a null component_id and link with nothing.  Repeated rows
    come back as often as they occur.  An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    prints = table(fingerprints(docs), "fingerprints")
    classes = table(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    roots = connected_components(links(classes))
    named = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns kept.

    The document whose doc_id names the component stays; rows with a null doc_id stay.
    Of rows that repeat a doc_id, all or none stay.
    """
    gone = near_duplicates(docs).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
