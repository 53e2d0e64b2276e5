import duckdb
import numpy as np
import pytest

from foldspark.llm import embdedup
from tests.conftest import SF


def brute(rows, threshold=0.95):
    ok = [
        (i, np.array(v, dtype=np.float64))
        for i, v in rows
        if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)
    ]
    x = np.stack([v / np.sqrt(v @ v) for _, v in ok])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(ok))
    for _ in range(len(ok)):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(ok))])
        if (new == root).all():
            break
        root = new
    return {i: (int(near[n].sum()), min(ok[m][0] for m in np.flatnonzero(root == root[n]))) for n, (i, _) in enumerate(ok)}


def as_rows(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_matches_sql(spark):
    got = sorted(map(tuple, embdedup.near_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(embdedup.SQL).fetchall())


@pytest.mark.parametrize("tile", [16, 4096])
def test_planted(spark, monkeypatch, tile):
    """Dense and sparse clusters, copies and scaled copies, in long lists cut into tiles and blocks."""
    monkeypatch.setattr(embdedup, "TILE", tile)
    monkeypatch.setattr(embdedup, "BLOCK", 3 * tile)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(700):
        v = centres[i % 12] + rng.normal(size=24) * (0.05, 0.2, 0.3, 1.0)[i % 4]
        rows.append((i, [float(np.float32(y)) for y in v]))
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000 + i, [2 * y for y in rows[8][1]]) for i in range(3)]
    got = as_rows(embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), sample=300))
    want = brute(rows)
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def planted(rng, kind, n=2400, width=64):
    """Vectors that lie in few dimensions of many, alone or around centres."""
    if kind == "isotropic":
        x = rng.normal(size=(n // 3, width))
        return np.concatenate([x, x + rng.normal(size=x.shape) * 0.2, x + rng.normal(size=x.shape) * 0.25])
    rank = int(kind.split()[-1])
    basis = np.linalg.qr(rng.normal(size=(width, rank)))[0].T
    if kind.startswith("subspace"):
        return rng.normal(size=(n, rank)) @ basis
    return rng.normal(size=(15, width))[rng.integers(15, size=n)] + 0.9 * rng.normal(size=(n, rank)) @ basis


@pytest.mark.parametrize("kind", ["subspace 3", "subspace 8", "clusters 8", "clusters 3", "isotropic"])
def test_recall_by_rank(kind):
    """Pairs that meet in a list, of all pairs at the threshold, with the fitted reach; all of them with reach 1."""
    x = embdedup.unit(planted(np.random.default_rng(5), kind).astype(np.float32))
    near = np.argwhere(x @ x.T >= 0.95)
    near = near[near[:, 0] != near[:, 1]]
    for classes, reach, least in ((len(x), None, 0.95), (len(x), 1.0, 1.0), (10**9, None, 0.95), (10**9, 1.0, 1.0)):
        model = embdedup.Model(x, classes, 0.95, reach)
        own, _, _ = model.index(x)
        row, to = model.probes(x, own)
        met = set(zip(row.tolist(), to.tolist(), strict=True))
        found = np.mean([(i, own[j]) in met for i, j in near.tolist()])
        assert found >= least, (kind, classes, reach, found)
        assert (len(model.fine) > 1) == (classes == 10**9)


def test_two_levels(spark, monkeypatch):
    """The whole operator with few coarse centroids and several fine ones is exact at reach 1."""
    monkeypatch.setattr(embdedup, "COARSE", 6)
    x = planted(np.random.default_rng(9), "clusters 8", 600, 24)
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    got = as_rows(embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), reach=1.0))
    assert {i: v[:2] for i, v in got.items()} == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], None, [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0], [], [-1.0, -2.0], [1e-30, 2e-30]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = sorted(map(tuple, embdedup.near_duplicates(df).collect()), key=str)
    linked = {0: (3, 0, True), 1: (3, 0, False), 10: (3, 0, False)}
    want = [(i, *linked.get(i, (0, i, True))) for i in range(len(vectors))] + [(None, 0, None, False), (0, *linked[0])]
    assert got == sorted(want, key=str)
    assert embdedup.near_duplicates(df.limit(0)).count() == 0
    assert embdedup.near_duplicates(df.where("vec_id = 2")).count() == 1


def test_mixed_lengths(spark):
    """Vectors of every length link with those of their own length, and with no others."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for at, (width, many) in enumerate([(24, 120), (7, 60), (3, 30), (5, 2), (2, 1)]):
        centres = rng.normal(size=(4, width))
        own = [(1000 * at + i, [float(np.float32(y)) for y in centres[i % 4] + rng.normal(size=width) * 0.1]) for i in range(many)]
        own += [(1000 * at + 500, own[0][1]), (1000 * at + 501, [0.0] * width)]
        rows += own
        want |= brute(own) | {1000 * at + 501: (0, 1000 * at + 501)}
    rows += [(9000, [1.0]), (9001, [1.0]), (9002, []), (9003, [1.0, 0.0, 0.0, 0.0])]
    want |= {9000: (1, 9000), 9001: (1, 9000), 9002: (0, 9002), 9003: (0, 9003)}
    got = as_rows(embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(k == (i == c) for i, (_, c, k) in got.items())
