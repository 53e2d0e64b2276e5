"""Bulk-synchronous best-fit packing of token pieces into sequences.

Documents are tokenised and cut into pieces of at most the sequence length.
Best fit takes pieces by falling length and puts each into the smallest gap
that holds it.  Lengths and gaps are whole numbers up to the sequence length,
so pieces of one length, and sequences with one gap, can stand for each other:

* the pieces are range-sorted by (length, document, piece) and ranked within
  their length, in a distributed pass;
* the sorted gaps are held as runs (gap, first sequence, number), at most a few
  runs for each length however many sequences there are;
* a superstep takes all pieces of one length, sweeps the successors of that
  length among the gaps, gives each run the next ranks (ranks settle which of
  the contending pieces gets which gap), updates the gaps and repeats;
* the ranks' ranges are sent to the pieces, which find their sequence and
  offset there, in a distributed pass.

Only the count of pieces per length (at most the sequence length of them) and
the counts by partition and length reach the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .memo import Memo
from .scratch import Batches, lean, parts, sliced, table
from .tokencount import _byte_alphabet

LENGTH = 2048


class WordBpe(Memo):
    """White-space word to the bytes of its ids (little-endian unsigned 32-bit), as the library gives them.

    The vocabulary drops white space and no rule of it looks across white
    space, so a text's ids are those of its words.  Texts of Latin letters,
    digits and ASCII marks are merged as a whole, every piece of them closed by
    ``END``.  Other texts go word by word; a word of other letters (or with a
    special token's mark) is left to the library as it stands.
    """

    END = b"\0"  # stands for the end-of-word mark; the texts that are merged here do not have it

    def __init__(self, path: str):
        super().__init__(self._ids)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        alphabet, mark = _byte_alphabet(), spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body, end = (token[: -len(mark)], self.END) if token.endswith(mark) else (token, b"")
            return bytes(alphabet[c] for c in body) + end

        vocab = spec["model"]["vocab"]
        merged = [a + b for a, b in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])]
        singles = [t for t in vocab if len(raw(t)) == 1]
        ends = [t for t in vocab if len(raw(t)) == 2 and raw(t).endswith(self.END)]
        order = [*singles, *ends, *merged]  # the rank: a last byte takes its end mark before any merge
        ranks = {raw(t): n for n, t in enumerate(order)}
        ranks.setdefault(self.END, len(order))
        self.ids = np.array([vocab[t] for t in order], "<u4")
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        # white space between the closed pieces matches nothing and is passed over; the special token never occurs
        merging = tiktoken.Encoding("words", pat_str=r"[^\s\x00]+\x00", mergeable_ranks=ranks, special_tokens={"\0\0": max(ranks.values()) + 1})
        self._merge = merging.encode_to_numpy
        self.plain = re.compile(r"[!-;=-~¡-ÖØ-öø-įı-ſ \t-\r\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u3000]*").fullmatch  # without I with a dot, which has two lower-case letters
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind in "LN":  # the letters and numbers of plain texts, spelt out
            pattern = pattern.replace(f"\\p{{{kind}}}", "".join(c for c in map(chr, range(0x180)) if category(c).startswith(kind)))
        self.pieces = re.compile(pattern).findall
        self.odd_space = re.compile(r"[\x1c-\x1f]").search
        self.space = regex.compile(r"[^\p{White_Space}]+").findall

    def _merged(self, plain: str) -> bytes:
        closed = "\0".join([*self.pieces(plain.lower()), ""])
        return self.ids[self._merge(closed, disallowed_special=())].tobytes()

    def _ids(self, word: str) -> bytes:
        if self.plain(word):
            return self._merged(word)
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.plain(text):
            return self._merged(text)
        words = self.space(text) if self.odd_space(text) else text.split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def _load(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each row's tokens and a closing id 0, cut at ``length``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Batches) -> Batches:
        bpe = _load(path)
        for batch in sliced(batches, "_text"):
            rows, made = [], []
            for at, text in enumerate(batch.column("_text")):
                ids = bpe.encode(text.as_py()) + b"\0\0\0\0"
                for n, start in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[start : start + 4 * length]
                    rows.append(at)
                    made.append((n, start // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else b""))
            column = lambda k, kind: pa.array([x[k] for x in made], kind)
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), column(0, pa.int32())]
            out += [column(k, pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(out + [column(4, pa.binary())] * with_ids, names)

    picked = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Ranges of ranks by length: rows (length, first rank, ranks, pieces a sequence, first sequence, offset).

    ``counts`` is the number of pieces of each length.  Equal to best fit on
    single pieces by falling length: of one length, the next piece goes where
    the last one went as long as it fits, for no gap is a closer fit.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap to (first sequence, sequences)
    gaps: list[int] = []  # the gaps of runs, sorted
    out, opened = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // size))
                opened += number
            each = gap // size
            used = min(number, -(-left // each))
            taken = min(left, used * each)
            out.append((size, rank, taken, each, first, capacity - gap))
            full, rest = divmod(taken, each)
            put(gap - each * size, first, full)
            put(gap - rest * size, first + full, used - full)
            put(gap, first + used, number - used)
            rank, left = rank + taken, left - taken
    return np.array(out, dtype=np.int64).reshape(-1, 6)


def _local_ranks(batches: Batches) -> Batches:
    """Rows sorted by length get their rank within the length, within this partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    length, seen = -1, 0
    for batch in batches:
        sizes = batch.column("length").to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        first = np.flatnonzero(np.concatenate(([True], np.diff(sizes) != 0)))
        rank = np.arange(len(sizes)) - np.repeat(first, np.diff(np.concatenate((first, [len(sizes)]))))
        if sizes[0] == length:
            rank[: first[1] if len(first) > 1 else len(sizes)] += seen
        length, seen = sizes[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(rank)], [*batch.schema.names, "_part", "_rank"]
        )


def _place(plan: np.ndarray, bases: np.ndarray):
    """``bases`` has rows (partition, length, first rank), sorted."""
    key = plan[:, 0] * (1 << 40) + plan[:, 1]
    order = np.argsort(key)
    plan, key = plan[order], key[order]
    at = bases[:, 0] * (1 << 20) + bases[:, 1]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes, part, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_part", "_rank"))
            rank = rank + bases[np.searchsorted(at, part.astype(np.int64) * (1 << 20) + sizes), 2]
            _, first, _, each, sequence, offset = plan[np.searchsorted(key, sizes * (1 << 40) + rank, side="right") - 1].T
            step, place = np.divmod(rank - first, np.maximum(each, 1))
            names = [n for n in batch.schema.names if n not in ("_part", "_rank")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence + step), pa.array(offset + place * sizes)],
                [*names, "sequence_id", "offset"],
            )

    return lean(run)


def pack(rows: DataFrame, order: list[str], capacity: int = LENGTH) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``capacity``) plus sequence_id and offset.

    ``order`` names columns that tell rows of one length apart; ties are
    settled by the order in which they are written down once.  Every sequence
    is gapless from offset 0.  An empty table packs into nothing.
    """
    n = parts(rows.sparkSession)
    keys = [F.col("length").desc(), *(F.col(c) for c in order)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranked = table(ranged.mapInArrow(lean(_local_ranks), f"{kinds}, _part int, _rank long"), "ranked-pieces")
    # range-sorted: at most one row more than lengths for each partition
    counts = ranked.groupBy("_part", "length").agg(F.count("*").alias("n")).collect()
    totals: dict[int, int] = {}
    bases = []
    for part, length, number in sorted(map(tuple, counts)):
        bases.append((part, length, totals.get(length, 0)))
        totals[length] = bases[-1][2] + number
    bases = np.array(bases, dtype=np.int64).reshape(-1, 3)
    plan = best_fit(totals, capacity)
    if not len(plan):
        plan = np.zeros((1, 6), np.int64)
    return ranked.mapInArrow(_place(plan, bases), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of ``docs(doc_id, text)``.

    A null or empty text is one piece, the closing id 0.  Repeated rows and
    rows with a null doc_id are packed each for itself.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    made = table(pieces(docs, path, length), "pieces")
    return pack(made, ["doc_id", "piece"], length)
