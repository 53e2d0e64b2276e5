"""Byte-level BPE over overlapping chunks, and its decoding.

A text longer than ``CHUNK`` characters is cut into chunks that overlap.  Each
chunk is pre-tokenised on its own, in parallel, from its first character as if
the text began there; a chunk may so begin in the middle of a pre-token.  The
stitch walks the chunks of a document in order and looks, in the overlap, for
the first boundary which the chunk before it has as well: from a common
boundary on both see the same text and so have the same pre-tokens.  Where an
overlap holds no common boundary the open end is pre-tokenised again together
with the next chunk.  The runs of pre-tokens between boundaries are dealt out
again, encoded piece by piece, and the ids of a document concatenated.  A text
of one chunk has nothing to stitch and is encoded at once.  Decoding looks up
the raw bytes of each id and concatenates them.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .scratch import Batches, lean, parts, sliced, table

CHUNK = 32_768
OVERLAP = 1_024


class Bpe:
    """A rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(pattern).findall
        unused = {"\0\0": max(ranks.values(), default=0) + 1}  # the library wants a special token; it is never allowed in a text
        self._all = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens=unused).encode_to_numpy
        self._one = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.memo = Memo(lambda piece: np.array(self._one(piece), "<u4").tobytes())
        self.bytes_of = dict(map(reversed, ranks.items()))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, pre-tokens and merges in one go, as little-endian unsigned 32-bit integers."""
        return self._all(text, disallowed_special=()).astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes | None:
        """The raw bytes of the ids; None where they are no ids of this vocabulary."""
        if len(ids) % 4:
            return None
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        except KeyError:
            return None


@lru_cache(maxsize=4)
def _load(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def cut(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) of overlapping chunks that cover the text; one chunk at least."""
    return [(at, text[at : at + size + overlap]) for at in range(0, max(1, len(text)), size)]


class Stitch:
    """Joins the pre-tokens of a document's chunks, given in order."""

    def __init__(self, find, hold: int = OVERLAP):
        self.find = find
        self.hold = hold
        self.open = ""  # text after the last boundary that is certain
        self.at = 0  # its place in the document

    def add(self, start: int, chunk: str, pieces: list[str], last: bool) -> list[str]:
        """The pieces which this chunk makes certain."""
        done: list[str] = []
        if start:
            # the open end was cut with the chunk before; it reaches into this chunk by the overlap
            own = np.concatenate(([start], start + np.cumsum([len(x) for x in pieces], dtype=np.int64)))
            tail = self.find(self.open)
            ends = self.at + np.cumsum([len(x) for x in tail], dtype=np.int64)
            before = np.concatenate(([self.at], ends[:-1]))  # the last one may still go on
            common = np.intersect1d(before[before >= start], own[:-1] if len(own) > 1 else own)
            if len(common):
                sync = int(common[0])
                done = tail[: int(np.searchsorted(before, sync))]
                pieces = pieces[int(np.searchsorted(own, sync)) :]
                self.at = sync
            else:
                reach = self.at + len(self.open)
                chunk = self.open + chunk[reach - start :]
                pieces = self.find(chunk)
                start = self.at
        else:
            self.at = 0
        if last:
            return done + pieces
        # a boundary is certain when at least one more piece follows it
        keep = max(0, len(pieces) - 2)
        size = sum(map(len, pieces[keep:]))
        # hold back what the next chunk also sees, so that a common boundary can be found there
        while keep and size < self.hold:
            keep -= 1
            size += len(pieces[keep])
        self.open = "".join(pieces[keep:])
        self.at += sum(map(len, pieces[:keep]))
        return done + pieces[:keep]


def _whole(path: str, pattern: str):
    def run(batches: Batches) -> Batches:
        bpe = _load(path, pattern)
        for batch in sliced(batches, "_text"):
            ids = [bpe.encode(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(ids, pa.binary())], ["_row", "ids"])

    return lean(run)


def _chunks(size: int, overlap: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, text in zip(batch.column("_row"), batch.column("_text"), strict=True):
                made = cut(text.as_py(), size, overlap)
                for at in range(0, len(made), 64):
                    some = made[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.as_py()] * len(some)),
                            pa.array([s for s, _ in some], pa.int64()),
                            pa.array([at + k == len(made) - 1 for k in range(len(some))]),
                            pa.array([c for _, c in some]),
                        ],
                        ["_row", "start", "last", "chunk"],
                    )

    return lean(run)


def _pretokenise(path: str, pattern: str):
    def run(batches: Batches) -> Batches:
        bpe = _load(path, pattern)
        for batch in sliced(batches, "chunk"):
            sizes = [np.array([len(p) for p in bpe.pieces(c.as_py())], "<u4").tobytes() for c in batch.column("chunk")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.binary())], [*batch.schema.names, "sizes"])

    return lean(run)


def _stitch(path: str, pattern: str, overlap: int):
    """Chunks of a document in order to the runs of pre-tokens that each makes certain: (_row, part, run, sizes)."""

    def run(batches: Batches) -> Batches:
        bpe, stitch = _load(path, pattern), None
        for batch in sliced(batches, "chunk"):
            rows, parts_, runs, lengths = [], [], [], []
            for row, start, last, chunk, sizes in zip(*(batch.column(c) for c in ("_row", "start", "last", "chunk", "sizes")), strict=True):
                start, text = start.as_py(), chunk.as_py()
                if start == 0:
                    stitch = Stitch(bpe.pieces, overlap)
                ends = np.cumsum(np.frombuffer(sizes.as_buffer().to_pybytes(), "<u4"), dtype=np.int64).tolist()
                pieces = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                sure = stitch.add(start, text, pieces, last.as_py())
                rows.append(row.as_py())
                parts_.append(start)
                runs.append("".join(sure))
                lengths.append(np.array([len(p) for p in sure], "<u4").tobytes())
            columns = [pa.array(rows, pa.int64()), pa.array(parts_, pa.int64()), pa.array(runs, pa.string()), pa.array(lengths, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "part", "run", "sizes"])

    return lean(run)


def _merge(path: str, pattern: str):
    """Runs of pre-tokens to their ids."""

    def run(batches: Batches) -> Batches:
        bpe = _load(path, pattern)
        for batch in sliced(batches, "run"):
            ids = []
            for text, sizes in zip(batch.column("run"), batch.column("sizes"), strict=True):
                text, ends = text.as_py(), np.cumsum(np.frombuffer(sizes.as_buffer().to_pybytes(), "<u4"), dtype=np.int64).tolist()
                ids.append(bpe.encode_pieces([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("part"), pa.array(ids, pa.binary())], ["_row", "part", "ids"])

    return lean(run)


def _concat(batches: Batches) -> Batches:
    """Rows sorted by (_row, part) to one row a document."""
    row, held = None, []
    for batch in batches:
        rows, out = [], []
        for own, ids in zip(batch.column("_row").to_pylist(), batch.column("ids"), strict=True):
            if own != row and held:
                rows.append(row)
                out.append(b"".join(held))
                held = []
            row = own
            held.append(ids.as_buffer().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.binary())], ["_row", "ids"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["_row", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, n_tokens): the ids of each row's whole text, as little-endian unsigned 32-bit integers.

    No special tokens are made: their strings are ordinary text.  A null text
    is an empty one and has no ids.  One row comes back per row of
    ``docs(doc_id, text)``; null and repeated doc_ids come back as they are,
    other columns are ignored.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("_text"))
    short = rows.where(F.length("_text") <= chunk)
    long = rows.where(F.length("_text") > chunk)
    schema = rows.schema["doc_id"].dataType.simpleString()
    own = f"_row {schema}, ids binary"
    small = short.withColumnRenamed("doc_id", "_row").mapInArrow(_whole(path, pattern), own)
    made = long.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_text")
    return small.select(F.col("_row").alias("doc_id"), "ids").unionByName(_long(made, path, pattern, chunk, overlap)).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long")
    )


def _long(made: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of texts of several chunks."""
    spark = made.sparkSession
    n = parts(spark)
    held = table(made, "long-texts")  # fixes the row numbers
    chunks = held.select("_row", "_text").mapInArrow(_chunks(chunk, overlap), "_row long, start long, last boolean, chunk string")
    dealt = chunks.repartition(n, "_row", "start")
    cut_up = dealt.mapInArrow(_pretokenise(path, pattern), "_row long, start long, last boolean, chunk string, sizes binary")
    ordered = cut_up.repartition(n, "_row").sortWithinPartitions("_row", "start")
    # only boundaries are settled document by document; the merges are dealt out again, run by run
    runs = ordered.mapInArrow(_stitch(path, pattern, overlap), "_row long, part long, run string, sizes binary")
    merged = runs.repartition(n, "_row", "part").mapInArrow(_merge(path, pattern), "_row long, part long, ids binary")
    ids = merged.repartition(n, "_row").sortWithinPartitions("_row", "part").mapInArrow(lean(_concat), "_row long, ids binary")
    return held.select("_row", "doc_id").join(ids, "_row").select("doc_id", "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a column decoded: the raw bytes of ``ids``.

    It is null where ids is null, is no whole number of 32-bit ids or holds an
    id that the vocabulary does not have.  A column called decoded is replaced.
    """
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Batches) -> Batches:
        bpe = _load(path, pattern)
        for batch in sliced(batches, "ids"):
            raw = [bpe.decode(x.as_buffer().to_pybytes()) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary())], [*names, "decoded"])

    picked = encoded.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(lean(run), f"{schema}, decoded binary")
