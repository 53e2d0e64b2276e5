"""What workers hold: slices, memos, tables that go again."""

import os

import pyarrow as pa
import pytest

from foldspark.llm import scratch
from foldspark.llm.components import connected_components
from foldspark.llm.memo import Memo
from foldspark.sources.staging import shared_folder


@pytest.mark.parametrize("kind", [pa.string(), pa.binary()])
def test_slices(kind):
    texts = ["", None, "a" * 10, "b" * 99, "", "c" * 3, None, "d" * 50, "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts).cast(kind)], ["n", "t"])
    for most in (1, 12, 60, 10**6):
        parts = list(scratch.sliced(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), "t", most))
        assert [x for p in parts for x in p.column("n").to_pylist()] == [*range(9), 2, 3, 4]
        sizes = [sum(len(x.encode() if isinstance(x, str) else x) for x in p.column("t").to_pylist() if x) for p in parts]
        assert all(size <= most or sum(bool(x) for x in p.column("t").to_pylist()) == 1 for size, p in zip(sizes, parts, strict=True))
    assert len(parts) == 3


def test_memo_is_bounded_and_right():
    asked = []
    memo = Memo(lambda x: asked.append(x) or x.upper() * 2, most=40_000)
    for n in range(5000):
        assert memo[f"w{n % 700}"] == f"W{n % 700}" * 2
        assert memo["often"] == "OFTENOFTEN"
        assert len(memo) + len(memo.old) < 400
    assert asked.count("often") == 1 and len(asked) > 700
    assert memo["x" * 1000] == "X" * 2000 and "x" * 1000 not in memo


def test_lean_passes_everything_on():
    ended = []

    def run(batches):
        try:
            yield from batches
        finally:
            ended.append(True)

    assert list(scratch.lean(run)(iter([1, 2]))) == [1, 2] and ended == [True]


def test_components_clear_their_rounds(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    links = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101), (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {n: 0 for n in range(41)} | {100: 100, 101: 100}
    assert len(set(os.listdir(folder)) - before) == 1  # the last round's, which the result reads
