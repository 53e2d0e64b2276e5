"""Embedding near-duplicates by product quantisation with inverted lists.

1. Equal vectors collapse into one class with its count.  Each length of
   vectors is then indexed and searched by itself.
2. Coarse centroids, a shared second level of residual centroids and residual
   codebooks are fitted on a sample bounded by rows and bytes, taken by hash;
   every class is then indexed.  A list is a pair of centroids, one of each
   level, so that the number of lists grows with the square root of the classes
   beyond what the sample could fit at once.
3. A class is stored in the list of its nearest centroids, with the codes of
   its residual and the length of what the codes miss.
4. Each class probes the lists that can hold a partner.  A partner lies within
   ``r`` (the distance of unit vectors at the threshold) and on the list's side
   of the bisector between the two centroids.  What part of a displacement can
   point across a bisector depends on the data: 1 / sqrt(d) or so where vectors
   differ in all directions, all of it where they lie in few dimensions.  It is
   measured on the sample, on pairs within the radius that lie in different
   lists, and a list is probed if its side is at most as far away as all but a
   few of these need.  ``reach=1`` probes every list that can hold a partner.
5. In a list, asymmetric table look-ups give the distance to each member's
   codes.  A partner's is at most ``r`` plus what its codes miss; the rest is
   dropped (this loses no partner), and the exact cosine in double precision
   decides.
6. Long lists are cut into tiles of members and blocks of queries.  A task
   returns counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Batches, lean, parts, table
from .simhash import forest

THRESHOLD = 0.95
#: Classes the model is fitted on, at most, and their bytes in double precision.
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
#: Centroids of the first level and of the second, at most.
COARSE, FINE = 2048, 32
SUBSPACES = 8
#: Members and queries of one task step, at most.
TILE, BLOCK = 4096, 4096
#: A sample of fewer is not fitted to.
ENOUGH = 2048
#: Of the sample, vectors that are asked for pairs within the radius to fit the reach, and pairs that this takes.
ASKED, PAIRS = 4096, 1000
#: Share of them that the fitted reach covers, the room that is added, and the least part of the radius.
COVERED, MARGIN, LEAST = 0.9995, 1.1, 0.1
#: Room for rounding in single precision.
SLACK = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from a fixed random start; at most k centroids."""
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[a : a + 8192], centres) for a in range(0, len(x), 8192)])
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _beyond(x: np.ndarray, own: np.ndarray, centres: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """How far each row would have to move to get to each centroid's side of the bisector with its own."""
    square = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    rows = np.arange(len(x))
    out = (square - square[rows, own][:, None]) / (2 * apart[own])
    out[rows, own] = 0
    return out


def _apart(centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * centres @ centres.T, 1e-12))


class Model:
    """Centroids of two levels and codebooks of residuals."""

    def __init__(self, sample: np.ndarray, classes: int, threshold: float, reach: float | None = None):
        x = unit(sample)
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
        wanted = max(1, round(2 * np.sqrt(classes)))
        self.coarse = kmeans(x, max(1, min(len(x) // 16, wanted, COARSE)))
        own = _nearest(x, self.coarse)
        residual = x - self.coarse[own]
        self.fine = kmeans(residual, min(FINE, -(-wanted // len(self.coarse)))) if wanted > 2 * len(self.coarse) else np.zeros((1, x.shape[1]))
        residual = residual - self.fine[_nearest(residual, self.fine)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [kmeans(residual[:, cut], min(256, len(x))) for cut in self.cuts]
        self.apart, self.fine_apart = _apart(self.coarse), _apart(self.fine)
        self.reach = self._fitted(x, own) if reach is None else self.radius * min(1.0, reach)

    def _fitted(self, x: np.ndarray, own: np.ndarray) -> float:
        """How far across a bisector all but a few partners lie.

        Measured on the sample's own pairs within the radius where there are
        enough.  Else, of its nearest neighbours, the parts of displacements that
        point to near centroids, at the full radius; the radius itself where the
        sample is too small to tell, and lists are few.
        """
        if len(x) < ENOUGH or len(self.coarse) < 2:
            return self.radius
        crossed = []
        for at in range(0, min(len(x), ASKED), 256):
            ask = x[at : at + 256]
            i, j = np.nonzero(ask @ x.T >= 1 - self.radius**2 / 2)
            i, j = i[i + at != j], j[i + at != j]
            far = _beyond(ask, own[at : at + 256], self.coarse, self.apart)[i, own[j]]
            for a in range(0, len(i) if len(self.fine) > 1 else 0, 8192):  # and among the second level's, in the partner's list
                p, q = i[a : a + 8192], j[a : a + 8192]
                here, there = ask[p] - self.coarse[own[q]], x[q] - self.coarse[own[q]]
                second = _beyond(here, _nearest(here, self.fine), self.fine, self.fine_apart)[np.arange(len(p)), _nearest(there, self.fine)]
                far[a : a + 8192] = np.maximum(far[a : a + 8192], second)
            crossed.append(far)
        crossed = np.concatenate(crossed) if crossed else np.zeros(0)
        if len(crossed) >= PAIRS:
            return float(np.clip(MARGIN * np.quantile(crossed, COVERED), LEAST * self.radius, self.radius))
        ask = x[:1024]
        near = ((x[:8192] ** 2).sum(axis=1)[None, :] - 2 * ask @ x[:8192].T).argpartition(8, axis=1)[:, :9]
        moves = x[near] - ask[:, None, :]
        size = np.sqrt((moves**2).sum(axis=2))
        moves = moves / np.maximum(size, 1e-9)[:, :, None]
        square = (self.coarse**2).sum(axis=1)[None, :] - 2 * (ask @ self.coarse.T)
        others = np.argsort(square, axis=1)[:, :9]
        towards = self.coarse[others[:, 1:]] - self.coarse[others[:, :1]]
        towards /= np.maximum(np.sqrt((towards**2).sum(axis=2)), 1e-9)[:, :, None]
        parts = np.abs(np.einsum("qmd,qcd->qmc", moves, towards))[size > 1e-6]
        return self.radius * float(min(1.0, np.quantile(parts, 0.999))) if parts.size >= PAIRS else self.radius

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, number: int) -> np.ndarray:
        first, second = divmod(number, len(self.fine))
        return self.coarse[first] + self.fine[second]

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes miss) of unit vectors."""
        first = _nearest(x, self.coarse)
        residual = x - self.coarse[first]
        second = _nearest(residual, self.fine)
        residual = residual - self.fine[second]
        codes = np.stack([_nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        missed = sum(((residual[:, c] - b[codes[:, m]]) ** 2).sum(axis=1) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return first * len(self.fine) + second, codes, np.sqrt(missed)

    def probes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every list within reach of a row."""
        row, first = np.nonzero(_beyond(x, own // len(self.fine), self.coarse, self.apart) <= self.reach)
        if len(self.fine) == 1:
            return row, first
        rows, lists = [], []
        for at in range(0, len(row), 8192):  # the same question once more, among the second level's centroids
            r, c = row[at : at + 8192], first[at : at + 8192]
            residual = x[r] - self.coarse[c]
            i, second = np.nonzero(_beyond(residual, _nearest(residual, self.fine), self.fine, self.fine_apart) <= self.reach)
            rows.append(r[i])
            lists.append(c[i] * len(self.fine) + second)
        return np.concatenate(rows), np.concatenate(lists)

    def candidates(self, query: np.ndarray, centre: int, codes: np.ndarray, missed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs that the asymmetric distance cannot rule out."""
        residual = query - self.centre(centre)
        total = np.zeros((len(query), len(codes)), np.float32)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, cut]
            look_up = (part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None, :] - 2 * part @ book.T
            total += look_up.astype(np.float32)[:, codes[:, m]]
        return np.nonzero(total <= ((self.radius + missed) ** 2 + SLACK)[None, :].astype(np.float32))


def _classes(kind: str):
    """Rows to (vec_id, key, vec): a valid vector's bytes in its own precision and their key, else null."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, raws = [], []
            for x in batch.column("embedding"):
                values = x.values if x.is_valid else None
                key = raw = None
                if values is not None and not values.null_count:
                    own = values.to_numpy(zero_copy_only=False)
                    if np.isfinite(own).all() and own.any():
                        raw = own.astype(kind).tobytes()
                        key = xxhash.xxh3_128_digest(raw)
                keys.append(key)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "vec"])

    return run


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


_ROW = "list int, kind int, rep long, n long, vec binary, codes binary, missed double"


def _deal(model: Model, kind_of_vec: str):
    """Classes to member rows (kind 0) and one query row (kind 1) for each probed list."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                x = unit(_matrix(batch.column("vec"), kind_of_vec))
                own, codes, missed = model.index(x)
                row, to = model.probes(x, own)
                rep, n, vec = batch.column("rep"), batch.column("n"), batch.column("vec")
                take = pa.array(row)
                lists = pa.array(np.concatenate((own, to)).astype(np.int32))
                kind = pa.array(np.concatenate((np.zeros(len(own), np.int32), np.ones(len(to), np.int32))))
                join = lambda c: pa.concat_arrays([c, c.take(take)])
                coded = pa.concat_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.nulls(len(to), pa.binary())])
                left = pa.concat_arrays([pa.array(missed), pa.nulls(len(to), pa.float64())])
                yield pa.RecordBatch.from_arrays(
                    [lists, kind, join(rep), join(n), join(vec), coded, left], ["list", "kind", "rep", "n", "vec", "codes", "missed"]
                )

    return run


def _search(model: Model, threshold: float, kind_of_vec: str):
    """Tiles, members before queries, to rows (a, b, n): links of a when b is null, else a link that spans."""

    def links_of(members, queries) -> tuple:
        (centre, rep, n, x, codes, missed), (q_rep, q) = members, queries
        sums = np.zeros(len(q), np.int64)
        left, right = [], []
        for at in range(0, len(q), 256):
            i, j = model.candidates(q[at : at + 256], centre, codes, missed)
            i = i + at
            other = q_rep[i] != rep[j]
            i, j = i[other], j[other]
            for a in range(0, len(i), 1 << 16):
                i2, j2 = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                near = (q[i2] * x[j2]).sum(axis=1) >= threshold
                np.add.at(sums, i2[near], n[j2[near]])
                left.append(i2[near])
                right.append(j2[near])
        hit = np.flatnonzero(sums)
        nodes, at = np.unique(np.concatenate((q_rep[hit], rep)), return_inverse=True)
        place = np.zeros(len(q), np.int64)
        place[hit] = at[: len(hit)]
        root = forest(len(nodes), place[np.concatenate(left)], at[len(hit) :][np.concatenate(right)]) if left else np.arange(len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return q_rep[hit], sums[hit], nodes[moved], nodes[root[moved]]

    def run(batches: Batches) -> Batches:
        tile, members, held, done = None, None, [], False
        empty: list = []

        def flush(queries):
            centre = members[0][0]
            rep, n, x, codes, missed = (np.concatenate([m[k] for m in members]) for k in range(1, 6))
            a, sums, v, w = links_of((centre, rep, n, x, codes, missed), queries)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((a, v))),
                    pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(w)]),
                    pa.array(np.concatenate((sums, np.zeros(len(v), np.int64)))),
                ],
                ["a", "b", "n"],
            )

        for batch in batches:
            if not len(batch):
                continue
            tiles = batch.column("tile").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(tiles)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if tiles[a] != tile:
                    tile, members = tiles[a], empty[:]
                rep = part.column("rep").to_numpy(zero_copy_only=False)
                x = unit(_matrix(part.column("vec"), kind_of_vec))
                if kinds[a] == 0:
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(b - a, -1)
                    numbers = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n", "missed"))
                    n, missed = numbers
                    members.append((part.column("list")[0].as_py(), rep, n, x, codes, missed))
                elif members:
                    yield from flush((rep, x))

    return run


def _linked(classes: DataFrame, count: int, width: int, precision: str, threshold: float, sample: int, reach: float | None) -> DataFrame:
    """(_key, links, component) of ``count`` classes of one length."""
    rows = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    taken = classes.orderBy(F.xxhash64("key"), "key").limit(rows).select("vec").collect()  # bounded by rows and bytes
    model = Model(np.stack([np.frombuffer(r["vec"], precision) for r in taken]), count, threshold, reach)
    dealt = table(classes.select("rep", "n", "vec").mapInArrow(lean(_deal(model, precision)), _ROW), "vector-lists")
    # tiles of members and blocks of queries; a row for each list that needs several, which the model bounds
    sizes = dealt.groupBy("list").agg(*(F.ceil(F.sum((F.col("kind") == k).cast("int")) / size).cast("int").alias(name) for k, size, name in ((0, TILE, "tiles"), (1, BLOCK, "blocks"))))
    long = F.broadcast(sizes.where("tiles > 1 or blocks > 1"))
    known = dealt.join(long, "list", "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("tiles", "blocks")})
    own, across = (F.when(F.col("kind") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("tiles", "blocks"), ("blocks", "tiles")))
    spread = known.withColumn("mine", F.pmod(F.xxhash64("rep"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), across - 1)))
    member, query = (F.when(F.col("kind") == k, F.col("mine")).otherwise(F.col("other")) for k in (0, 1))
    tile = (F.col("list").cast("long") * 1_000_000 + member) * 1_000_000 + query
    spread = spread.select(tile.alias("tile"), "list", "kind", "rep", "n", "vec", "codes", "missed")
    found = spread.repartition(parts(classes.sparkSession), "tile").sortWithinPartitions("tile", "kind")
    found = table(found.mapInArrow(lean(_search(model, threshold, precision)), "a long, b long, n long"), "vector-links")
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    classes = classes.select("key", "rep", "n").join(sums, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    return classes.select(
        F.col("key").alias("_key"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("root", "rep").alias("component"),
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors(vec_id, embedding)``.

    n_links is the number of other rows with a cosine of at least
    ``threshold``, component_id the smallest vec_id reachable over links.
    Vectors that are null, zero or hold null or non-finite components link with
    nothing and are their own component.  Vectors of different lengths do not
    link with each other; every length present has an index of its own.  A row
    without a vec_id links with nothing, has no component and is not kept.  Rows
    that repeat a vec_id link like any others.  Other columns are ignored.

    ``reach`` is the part of the radius within which lists are probed; None fits
    it to the sample, 1 finds every link.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    precision = "<f4" if single else "<f8"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    named = rows.mapInArrow(lean(_classes(precision)), "vec_id long, key binary, vec binary")
    named = table(named, "vectors")
    valid = named.where("key is not null and vec_id is not null")
    classes = valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = table(classes, "vector-classes")
    lengths = {r["bytes"]: r["count"] for r in classes.groupBy(F.length("vec").alias("bytes")).count().collect()}  # one row a length
    several = [b for b, n in sorted(lengths.items()) if n > 1]
    alone = classes.where(~F.length("vec").isin(several))
    result = alone.select(F.col("key").alias("_key"), (F.col("n") - 1).alias("links"), F.col("rep").alias("component"))
    for b in several:
        result = result.unionByName(_linked(classes.where(F.length("vec") == b), lengths[b], b // int(precision[-1]), precision, threshold, sample, reach))
    joined = named.join(result, (F.col("key") == F.col("_key")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


#: DuckDB SQL for ``near_duplicates`` over ``embeddings``, comparing all pairs.
SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  AND list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.95),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM e LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id"""
