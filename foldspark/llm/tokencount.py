"""Exact token counts at every prefix, by dynamic programming over byte-level BPE.

For a run of bytes that the merges see as a whole (a pre-token) the last token
of the encoding of every prefix follows from shorter prefixes: it is the one
token that ends there, and that the merges leave apart from the last token of
the prefix before it.  So ``count[i] = count[i - len(last[i])] + 1``.  A text's
prefix is its whole pre-tokens before the cut and one prefix of a pre-token, so
counts at every prefix, cuts to a budget and limits come from stored sums
without encoding anything again.

``count_tokens`` needs the last entry of each table alone and keeps no more;
``prefix_tables`` stores them, and ``truncate`` answers budgets from them.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .scratch import STEP, Batches, lean, sliced

#: Pairs of neighbours that a worker remembers before it forgets them all.
PAIRS = 1_000_000
#: Bytes of totals that a worker remembers.
TOTALS = 48 << 20
#: Pre-tokens of more characters have the counts of all their prefixes stored.
LONG = 32
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable character which stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary with its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        self.ranks = {bytes(alphabet[c] for c in t): n for t, n in vocab.items() if t not in special}
        self.longest = max(map(len, self.ranks))
        library = tiktoken.Encoding("pairs", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self._merge = library._encode_single_piece
        self.pieces = regex.compile(PATTERN).findall
        self.specials = set(special)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._rows: dict[bytes, dict[bytes, bool]] = {}  # by the left token, what may follow it
        self._known = 0
        self.totals = Memo(lambda piece: self.prefixes(piece.encode())[-1], TOTALS)  # tokens of a whole pre-token

    def _stays(self, row: dict[bytes, bool], left: bytes, right: bytes) -> bool:
        """Whether ``right`` is a token that the merges leave apart from the token ``left`` before it."""
        if self._known >= PAIRS:
            for known in self._rows.values():
                known.clear()
            self._known = 0
        self._known += 1
        row[right] = answer = right in self.ranks and self._merge(left + right) == [self.ranks[left], self.ranks[right]]
        return answer

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:i]`` for every i from 0 on.

        Exactly one token can be the last of a prefix, so the order in which
        candidates are tried does not matter; short ones are likelier.
        """
        ranks, longest = self.ranks, self.longest
        count, last, near = [0] * (len(piece) + 1), [b""] * (len(piece) + 1), [{}] * (len(piece) + 1)
        for i in range(1, len(piece) + 1):
            token = piece[:i]
            if i <= longest and token in ranks:
                count[i] = 1
            else:
                for j in range(i - 1, max(0, i - longest - 1), -1):
                    token = piece[j:i]
                    stays = near[j].get(token)
                    if stays is None:
                        stays = self._stays(near[j], last[j], token)
                    if stays:
                        count[i] = count[j] + 1
                        break
            last[i] = token
            row = self._rows.get(token)
            if row is None:
                row = self._rows[token] = {}
            near[i] = row
        return count

    def by_chars(self, piece: str) -> list[int]:
        """Tokens of ``piece[:i]`` for every number of characters."""
        counts = self.prefixes(piece.encode())
        if len(counts) == len(piece) + 1:
            return counts
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text as stretches of ordinary text and special tokens (True)."""
        if self.special is None or not self.special.search(text):
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False)] if m.start() > at else []
            out.append((m[0], True))
            at = m.end()
        return out + ([(text[at:], False)] if at < len(text) else [])

    def count(self, text: str) -> int:
        return sum(1 if special else sum(map(self.totals.__getitem__, self.pieces(part))) for part, special in self.parts(text))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable.of(self, text)


SPACE = regex.compile(r"\s").match


class PrefixTable:
    """Token counts of one text at the end of each pre-token, and at every prefix of the long ones.

    ``ends`` and ``sums`` begin with 0; ``inner`` has the counts by characters
    of pre-tokens of more than ``LONG``, by number from 1.
    """

    def __init__(self, counter: PrefixCounter, text: str, ends: list[int], sums: list[int], inner: dict[int, list[int]]):
        self.counter, self.text = counter, text
        self.ends, self.sums, self.inner = ends, sums, inner

    @classmethod
    def of(cls, counter: PrefixCounter, text: str) -> PrefixTable:
        ends, sums, inner = [0], [0], {}
        for part, special in counter.parts(text):
            for piece in [part] if special else counter.pieces(part):
                if special or len(piece) <= LONG:
                    n = 1 if special else counter.totals[piece]
                else:
                    inner[len(ends)] = counts = counter.by_chars(piece)
                    n = counts[-1]
                ends.append(ends[-1] + len(piece))
                sums.append(sums[-1] + n)
        return cls(counter, text, ends, sums, inner)

    def _piece(self, n: int) -> str:
        return self.text[self.ends[n - 1] : self.ends[n]]

    def _special(self, n: int) -> bool:
        """Whether pre-token n, from 1, is a special token."""
        return 0 < n < len(self.ends) and self._piece(n) in self.counter.specials

    def _blank(self, n: int) -> bool:
        """Whether pre-token n is white space; one that ends in it is nothing else."""
        return n > 0 and SPACE(self.text, self.ends[n] - 1) is not None

    def _inside(self, n: int, chars: int) -> int:
        """Tokens of the first ``chars`` characters of pre-token n, taken as one."""
        if n not in self.inner:
            self.inner[n] = self.counter.by_chars(self._piece(n))
        return self.inner[n][chars]

    def at(self, chars: int) -> int:
        """Tokens of ``text[:chars]``.

        A prefix of a pre-token is one pre-token, but for three cases.  White
        space that ends the prefix is one pre-token, from where it begins.  A
        special token that is cut becomes ordinary text, to which the marks or
        white space before it can belong.  A contraction that is cut falls apart.
        """
        ends, sums, text = self.ends, self.sums, self.text
        n = bisect_left(ends, chars)
        if chars in (0, len(text)):
            return sums[n]
        if ends[n] != chars and self._special(n):
            m = n - 1
            while m and self._blank(m) and not self._special(m):
                m -= 1
            m -= m > 0 and not self._special(m)
            return sums[m] + self.counter.count(text[ends[m] : chars])
        if SPACE(text, chars - 1):
            m = n - 1
            while m and self._blank(m):
                m -= 1
            if chars <= ends[m + 1]:
                return sums[m] + self._inside(m + 1, chars - ends[m])
            return sums[m] + self.counter.totals[text[ends[m] : chars]]
        if ends[n] == chars:
            return sums[n]
        if text[ends[n - 1]] == "'":
            return sums[n - 1] + self.counter.count(text[ends[n - 1] : chars])
        return sums[n - 1] + self._inside(n, chars - ends[n - 1])

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens.

        Sums rise with every pre-token, so the cut lies in the first one that
        does not fit as a whole, in the white space that goes on after it, or in
        a special token near it.  Counts do not rise with every character of
        these, so all of them are asked.
        """
        ends = self.ends
        whole = bisect_right(self.sums, budget) - 1
        last = len(ends) - 1
        if whole in (-1, last):
            return max(0, ends[whole]) if whole >= 0 else 0
        to = ends[whole + 1]
        to += to < len(self.text) and self._blank(whole + 1) and SPACE(self.text, to) is not None
        for m in (whole + 2, whole + 3):
            if self._special(m):
                to = ends[m]
        return next((chars for chars in range(to, ends[whole], -1) if self.at(chars) <= budget), ends[whole])


@lru_cache(maxsize=2)
def _load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    Special tokens inside a text count as one, as the library reads them; no
    begin or end tokens are added.  A null text is an empty one: 0 bytes, 0
    tokens.  Repeated rows and null doc_ids come back as they are; other
    columns are ignored.
    """

    def run(batches: Batches) -> Batches:
        counter = _load(path)
        for batch in sliced(batches, "_text"):
            counts = [counter.count(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(docs["text"], F.lit(""))
    picked = docs.select(docs["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


_TABLE = "ends array<int>, sums array<int>, inner array<struct<piece:int,counts:array<int>>>"
_INNER = pa.list_(pa.struct([("piece", pa.int32()), ("counts", pa.list_(pa.int32()))]))


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ends, sums, inner): characters and tokens up to the end of each pre-token, from 0.

    The stored form of ``PrefixTable``.  ``inner`` has the counts of every
    prefix of pre-tokens of more than ``LONG`` characters.  A null or empty text
    has one entry, 0.  Repeated rows and null doc_ids come back as they are;
    other columns are ignored.
    """

    def run(batches: Batches) -> Batches:
        counter = _load(path)
        for batch in sliced(batches, "_text", STEP // 8):  # tables are larger than texts
            made = [counter.table(t.as_py()) for t in batch.column("_text")]
            lists = [pa.array([getattr(x, k) for x in made], pa.list_(pa.int32())) for k in ("ends", "sums")]
            inner = pa.array([[{"piece": n, "counts": c} for n, c in x.inner.items()] for x in made], _INNER)
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, inner], ["doc_id", "ends", "sums", "inner"])

    picked = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(lean(run), f"doc_id {kind}, {_TABLE}")


def truncate(docs: DataFrame, path: str, budget: int, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): the longest prefix of each text that has at most ``budget`` tokens.

    With ``tables``, those that ``prefix_tables`` made of the same documents,
    nothing is encoded again; they are found by doc_id, which then must be
    unique, and a row without one (a null doc_id) is counted anew.  A null text
    is an empty one and comes back empty, as every text does at a budget of 0.
    Repeated rows and null doc_ids come back as they are; other columns are
    ignored.
    """
    stored = tables is not None

    def run(batches: Batches) -> Batches:
        counter = _load(path)
        for batch in sliced(batches, "_text", STEP // 8):
            cut = []
            for n, t in enumerate(batch.column("_text")):
                text = t.as_py()
                if stored and (ends := batch.column("ends")[n].as_py()) is not None:
                    inner = {x["piece"]: x["counts"] for x in batch.column("inner")[n].as_py()}
                    table = PrefixTable(counter, text, ends, batch.column("sums")[n].as_py(), inner)
                else:
                    table = counter.table(text)
                cut.append(text[: table.fit(budget)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"])

    picked = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    if stored:
        picked = picked.join(tables.select("doc_id", "ends", "sums", "inner"), "doc_id", "left")
    return picked.mapInArrow(lean(run), f"doc_id {kind}, text string")
