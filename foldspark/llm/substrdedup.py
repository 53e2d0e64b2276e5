"""Substring deduplication by suffix automata of reference shards.

A window is ``length`` consecutive words; a word goes if a window over it
starts earlier elsewhere, by (doc_id, start).

1. Exact copies collapse: only the first document of each word sequence is
   looked at, later ones lose every window.  Their anchors are not counted.
2. Each window has an anchor, the least hash of its runs of ``ANCHOR`` words.
   Equal windows have equal anchors, about one window in eight changes it, and
   only anchors that occur twice can belong to a repeated window.
3. Consecutive windows with the same repeated anchor form one stretch of text.
   Stretches are dealt by anchor, so everything that can share a window meets
   in one reference shard, whatever the size of the corpus.
4. A shard takes the stretches of an anchor in order and grows a suffix
   automaton of what came before.  Streaming a stretch through it gives the
   matching statistics: the longest suffix at each word that was there before.
   Where that reaches ``length`` the window has an earlier occurrence.
5. Anchors in more than ``FREQUENT`` texts would make large shards.  Their
   windows are dealt one by one, by their own hash, after equal windows that the
   same task saw in an earlier document have been settled on the spot; a window
   goes out once a task at most, as long as the task remembers it.
6. Overlapping windows join to maximal spans, which are cut from the documents.

The automata are dealt, not broadcast: what repeats in a corpus grows with it,
so a broadcast has no bound, and every document against every shard is
quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .scratch import HAND_ON, Batches, lean, packed, parts, sliced, squeezed, table, unsqueezed, with_row

LENGTH = 20
ANCHOR = 6
FREQUENT = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1  # rows without a doc_id come after all others
#: Compressed bytes of texts that a step takes at once.
_PACKED = 1 << 20
#: Windows that a task remembers at least.
_SEEN = 50_000


class SuffixAutomaton:
    """Suffix automaton over words of several strings, which tells what was there before."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        self.last = 0

    def start(self) -> None:
        """Begin another string."""
        self.last = 0

    def add(self, word) -> int:
        """Append a word; the length of the longest suffix that ended at an earlier place."""
        nexts, link, size = self.next, self.link, self.size
        p = self.last
        q = nexts[p].get(word)
        if q is not None:  # this string so far was there before
            if size[q] == size[p] + 1:
                self.last = q
                return size[q]
            self.last = self._split(p, q, word)
            return size[self.last]
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        size.append(size[p] + 1)
        self.last = cur
        while p >= 0 and (q := nexts[p].get(word)) is None:
            nexts[p][word] = cur
            p = link[p]
        if p < 0:
            return 0
        link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, word)
        return size[link[cur]]

    def _split(self, p: int, q: int, word) -> int:
        nexts, link, size = self.next, self.link, self.size
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = clone
            p = link[p]
        return clone


# ------------------------------------------------------------------- anchors


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def anchors_of(words: list[bytes], length: int) -> np.ndarray:
    """The anchor of each window: the least 48-bit hash of its runs of words."""
    run = min(ANCHOR, length)
    if len(words) < length:
        return np.zeros(0, np.int64)
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        g = h[: len(h) - run + 1].copy()
        for k in range(1, run):
            g = g * _ODD + h[k : len(h) - run + 1 + k]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    g = (g >> np.uint64(16)).astype(np.int64)
    span, wide = length - run + 1, 1
    while 2 * wide <= span:  # sliding minimum by doubling
        g = np.minimum(g[:-wide], g[wide:])
        wide *= 2
    return np.minimum(g[: len(g) - (span - wide)], g[span - wide :]) if span > wide else g


def doubled(words: list[bytes], anchors: np.ndarray, length: int) -> np.ndarray:
    """Anchors of windows that occur twice in this one document."""
    h = word_hashes(words)
    n = len(anchors)
    windows = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            windows = windows * _ODD + h[k : k + n]
    order = np.argsort(windows, kind="stable")
    again = order[1:][windows[order][1:] == windows[order][:-1]]
    return np.unique(anchors[again])


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def tag_of(digest: bytes) -> int:
    """A long that tells texts under one doc_id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _list_anchors(length: int):
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, "_text"):
            keys, sizes, lists = [], [], []
            for text in batch.column("_text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes.split() is [\x20\x09-\x0D]
                keys.append(digest_of(words))
                sizes.append(len(words))
                anchors = anchors_of(words, length)
                lists.append(np.concatenate((np.unique(anchors), doubled(words, anchors, length))))  # these count twice
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64), pa.int64())
            tags = pa.array([tag_of(k) for k in keys], pa.int64())
            columns = [batch.column("_ord"), pa.array(keys, pa.binary()), tags, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["_ord", "_key", "_tag", "_size", "anchors"])

    return lean(run)


class Seen:
    """What a task saw before; forgets what it was not asked for of late."""

    def __init__(self):
        self.young, self.old = set(), set()

    def __contains__(self, x: bytes) -> bool:
        if x in self.young:
            return True
        if x in self.old:
            self.add(x)
            return True
        return False

    def add(self, x: bytes) -> None:
        if len(self.young) >= _SEEN:
            self.old, self.young = self.young, set()
        self.young.add(x)


_STRETCH = "route long, ord long, tag long, start int, count int, body binary"


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _rows(out: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def _stretches(length: int):
    """Documents, by (_ord, _tag), with their repeated anchors to stretches of windows.

    Windows settled on the spot have no body.
    """
    names = ["route", "ord", "tag", "start", "count", "body"]

    def of_text(order: int, tag: int, words: list[bytes], frequent: dict[int, bool], seen: Seen) -> Iterator[tuple]:
        anchor = anchors_of(words, length)
        edge = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)])).tolist()
        settled: list[tuple[int, int]] = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            value = int(anchor[a])
            if value not in frequent:
                continue
            for s, e in ((i, i + 1) for i in range(a, b)) if frequent[value] else ((a, b),):
                body = b" ".join(words[s : e + length - 1])
                print_ = xxhash.xxh3_128_digest(body)
                if print_ in seen and settled and settled[-1][1] == s:
                    settled[-1] = (settled[-1][0], e)
                elif print_ in seen:
                    settled.append((s, e))
                else:
                    seen.add(print_)
                    yield (xxhash.xxh3_64_intdigest(body) >> 1 if frequent[value] else value), order, tag, s, e - s, body
        aside = xxhash.xxh3_64_intdigest(b"%d %d" % (order, tag)) >> 1  # by document: no shard has to see these
        for s, e in settled:
            yield aside, order, tag, s, e - s, None

    def run(batches: Batches) -> Batches:
        seen, done, out, held = Seen(), None, [], 0
        for batch in sliced(batches, "_text", _PACKED):
            orders, tags, found = batch.column("_ord").to_pylist(), batch.column("_tag").to_pylist(), batch.column("_found")
            for at, text in enumerate(unsqueezed(batch.column("_text"))):
                order, tag, words = orders[at], tags[at], (text or b"").split()
                if (order, tag) == done or tag_of(digest_of(words)) != tag:
                    continue  # a repeated row, or another text under the same doc_id
                done = (order, tag)
                for row in of_text(order, tag, words, {x["anchor"]: x["frequent"] for x in found[at].as_py()}, seen):
                    out.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > HAND_ON:
                        yield _rows(out, _KINDS, names)
                        out, held = [], 0
        yield _rows(out, _KINDS, names)

    return lean(run)


def _repeated(length: int):
    """Stretches sorted by (route, ord, tag, start) to spans (ord, tag, first word, end) that are to go."""

    def run(batches: Batches) -> Batches:
        route, automaton, before = None, None, None
        for batch in sliced(batches, "body"):
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("route", "ord", "tag", "start", "count", "body")]
            for to, order, tag, start, count, body in zip(*columns, strict=True):
                if body is None:
                    out.append((order, tag, start, start + count + length - 1))
                    continue
                if to != route:
                    route, automaton, before = to, SuffixAutomaton(), None
                if (order, tag, start) == before:
                    continue  # the same stretch of a repeated row
                before = (order, tag, start)
                automaton.start()
                add, first = automaton.add, None
                for n, word in enumerate(body.split()):
                    if add(word) >= length:
                        first = n if first is None else first
                    elif first is not None:
                        out.append((order, tag, start + first - length + 1, start + n))
                        first = None
                if first is not None:
                    out.append((order, tag, start + first - length + 1, start + count + length - 1))
            yield _rows(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), ["ord", "tag", "s", "e"])

    return lean(run)


def _cut(normalise: bool):
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, "_text", _PACKED):
            texts, sizes, removed = [], [], []
            for raw, cuts in zip(unsqueezed(batch.column("_text")), batch.column("_cuts"), strict=True):
                words = (raw or b"").split()
                keep = np.ones(len(words), bool)
                own = None
                for x in cuts.as_py() or ():
                    own = tag_of(digest_of(words)) if own is None else own
                    if x["tag"] == own:
                        keep[:] &= not x["all"]
                        for span in x["spans"] or ():
                            keep[span["s"] : span["e"]] = False
                whole = keep.all()
                kept = words if whole else [words[i] for i in np.flatnonzero(keep).tolist()]
                texts.append((raw or b"") if whole and not normalise else b" ".join(kept))
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
            made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", "text", "n_words", "n_removed"])

    return lean(run)


def spans(docs: DataFrame, length: int, shipped: DataFrame) -> DataFrame:
    """(_at, _cuts): what each document loses.  ``docs(_ord, _text)``, the text as binary.

    ``shipped`` has the same rows with ``squeezed`` texts.  All its columns are
    taken along, needed or not: the caller's own join by _ord then finds the
    same exchange, and texts are shuffled once.
    """
    n = parts(docs.sparkSession)
    kind = "_ord long, _key binary, _tag long, _size long, anchors array<long>"
    listed = table(docs.mapInArrow(_list_anchors(length), kind), "anchors")
    long = listed.where(F.col("_size") >= length)
    firsts = table(long.groupBy("_key").agg(F.min("_ord").alias("first"), F.min("_tag").alias("_tag")), "first-copies")
    # of copies only the first is counted; the key and the order together, so that a text with many copies is no hot key
    first = long.join(firsts.select("_key", F.col("first").alias("_ord")), ["_key", "_ord"], "left_semi")
    entries = first.select("_ord", F.explode("anchors").alias("anchor"))
    counted = entries.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > FREQUENT).alias("frequent"))
    own = entries.join(counted, "anchor").groupBy("_ord").agg(F.collect_set(F.struct("anchor", "frequent")).alias("_found"))
    found = own.join(firsts, own["_ord"] == firsts["first"]).select(F.col("first").alias("_at"), "_tag", "_found")
    texts = shipped.join(found, shipped["_ord"] == found["_at"]).drop("_at").sortWithinPartitions("_ord", "_tag")
    dealt = texts.mapInArrow(_stretches(length), _STRETCH).repartition(n, "route").sortWithinPartitions("route", "ord", "tag", "start")
    cuts = dealt.mapInArrow(_repeated(length), "ord long, tag long, s int, e int")
    cuts = cuts.groupBy("ord", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    later = long.select("_ord", "_key").distinct().join(firsts, "_key").where(F.col("_ord") > F.col("first"))
    whole = later.select(F.col("_ord").alias("ord"), F.col("_tag").alias("tag"), F.lit(True).alias("all"))
    per_text = whole.unionByName(cuts.withColumn("all", F.lit(False)), allowMissingColumns=True)
    return per_text.groupBy(F.col("ord").alias("_at")).agg(F.collect_list(F.struct("tag", "all", "spans")).alias("_cuts"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, normalise: bool = True) -> DataFrame:
    """``docs`` with repeated windows cut; text becomes the kept words joined by one space; adds n_words, n_removed.

    With ``normalise`` off, a text that loses nothing comes back as it is.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, compared as they are.  A null
    text has no words and comes back empty.  Windows never span documents.
    Rows without a doc_id come after all others.  Rows with the same doc_id and
    the same words are judged alike (neither is earlier); other rows with the
    same doc_id are ordered by a hash of their words.  Columns called n_words
    or n_removed are replaced, others come back as they are.
    """
    order = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    own = squeezed(docs.select(packed(docs, rest), order.alias("_ord"), docs["text"].cast("binary").alias("_text")), "_text")
    cuts = spans(docs.select(order.alias("_ord"), docs["text"].cast("binary").alias("_text")), length, own)
    joined = own.join(cuts, own["_ord"] == cuts["_at"], "left").select("row", "_text", "_cuts")
    schema = with_row(joined, text=StringType(), n_words=LongType(), n_removed=LongType())
    out = joined.mapInArrow(_cut(normalise), schema)
    column = lambda c: F.col("text") if c == "text" else F.col("row")[c].alias(c)
    return out.select(*(column(c) for c in docs.columns if c not in ("n_words", "n_removed")), "n_words", "n_removed")


#: DuckDB SQL for the digests of ``dedup_substrings`` over ``documents``.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
k AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM g),
f AS (SELECT w, min({'d': doc_id, 'i': i}) AS first FROM k GROUP BY w),
x AS (SELECT r, unnest(range(i, i + 20)) AS j FROM k JOIN f USING (w) WHERE {'d': doc_id, 'i': i} > first),
gone AS (SELECT DISTINCT r, j FROM x),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d),
kept AS (SELECT t.r, count(*) AS n, string_agg(t.w, ' ' ORDER BY t.j) AS s FROM t LEFT JOIN gone ON t.r = gone.r AND t.j = gone.j
  WHERE gone.j IS NULL GROUP BY t.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
