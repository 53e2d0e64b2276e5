"""Quality rules with host verdicts, in DataFrame functions only.

Every document is measured by built-in expressions over its whole text.  Rule
failures are counted per host (combined before the shuffle), each host's rate
is shrunk towards the corpus by a beta prior fitted to the hosts' own rates,
and the hosts which fail are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

SPACE = r"[\x20\x09-\x0D]"
TRIM = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
#: A host whose shrunk rate of failing a rule is above this loses all its documents.  Four fifths: documents that
#: pass every rule themselves go only where the rest of the host leaves little doubt.
MAX_HOST_RATE = 0.8
RULES = ("short", "repetitive", "symbols", "dup_lines")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; an empty array for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(TRIM))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def window_hashes(words: Column) -> Column:
    """A hash of each run of 8 words, by doubling: 2, 4, then 8."""

    def joined(step: int):
        return lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))

    for step in (1, 2, 4):
        words = let(words, joined(step))
    return words


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, starts), total)

    def count(w: Column) -> Column:
        n = F.size(w) - (WINDOW - 1)
        windows = F.slice(window_hashes(w), F.lit(1), F.greatest(n, F.lit(0)))
        found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(found)

    return let(words, count)


def host_of(source: Column) -> Column:
    """The host of a URL in lower case; a source that is no URL as it stands."""
    return F.when(source.contains("://"), F.lower(F.regexp_extract(source, r"://(?:[^/@]*@)?([^/:?#]*)", 1))).otherwise(source)


def measure(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` and the measures, base_failed and one boolean a rule, for every row of ``docs(text, source)``."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(TRIM))) > 0)
    first = docs.select(
        *carry,
        host_of(docs["source"]).alias("_host"),
        let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("_w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(
            lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))
        ).alias("_l"),
    )
    kept = [c for c in first.columns if c not in ("_w", "_l")]
    out = first.select(*kept, "_w.*", (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"), F.col("_l.n").alias("_lines"))
    return out.withColumns(
        {
            "_short": F.col("n_words") < 20,
            "_repetitive": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
            "_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
            "_dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("_lines"),
        }
    ).withColumn("base_failed", F.col("_short") | F.col("_repetitive"))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, rule, shrunk rate): failures of each rule per host under an empirical beta prior.

    The prior of a rule has the mean and the variance of the hosts' rates
    (method of moments); its weight is held to 1 to 10,000 documents, and is
    10,000 where the hosts do not differ.  Rows without a host are left out.
    """
    sums = [F.sum(F.col(f"_{r}").cast("long")).alias(r) for r in RULES]
    hosts = measured.where("_host is not null").groupBy("_host").agg(F.count("*").alias("n"), *sums)
    long = hosts.select("_host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES))).alias("x"))
    long = long.select("_host", "n", "x.rule", "x.k")
    rate = F.col("k") / F.col("n")
    prior = long.groupBy("rule").agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(10000.0)
    prior = prior.select("rule", "m", F.least(F.greatest(weight, F.lit(1.0)), F.lit(10000.0)).alias("weight"))
    joined = long.join(F.broadcast(prior), "rule")  # one row a rule
    return joined.select("_host", "n", "rule", ((F.col("k") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"))


def judged(docs: DataFrame, carry: list[Column], max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``measure`` plus kept.  The measures are written once, so texts are read once."""
    measured = measure(docs, carry)
    own = [c for c in measured.columns if c == "_row"]  # whole rows are written only if they can still be kept
    measured = table(measured.withColumns({c: F.when(~F.col("base_failed"), F.col(c)) for c in own}), "quality")
    bad = host_rates(measured).where(F.col("rate") > max_host_rate).select(F.col("_host").alias("_bad")).distinct()
    bad = table(bad, "bad-hosts")  # its size is known to the planner, which picks the join
    verdict = measured.join(bad, measured["_host"] == bad["_bad"], "left")
    return verdict.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull())


def quality(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, the measures, base_failed, kept.

    A null text has no words: it counts 0 everywhere and fails the base rule,
    as an empty text does.  A null source belongs to no host and gets no host
    verdict.  Repeated rows count each time.  Other columns are ignored.
    """
    columns = ["doc_id", *BASE, "base_failed", "kept"]
    return judged(docs, [docs["doc_id"]], max_host_rate).select(*columns)


def keep_good(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are.

    Nulls, empty texts and repeated rows are judged as in ``quality``.  Rows
    that fail the base rule are counted for their hosts, but not carried along.
    """
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    return judged(docs, [row], max_host_rate).where("kept").select("_row.*")


def _sql() -> str:
    """DuckDB SQL for ``quality`` over ``documents``."""
    w = "[^\\x20\\x09-\\x0D]+"
    fails = {
        "short": "n_words < 20",
        "repetitive": "100 * n_repeat_words > 30 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    }
    rules = " UNION ALL ".join(
        f"SELECT host, '{r}' AS rule, count(*) AS n, sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS k FROM m WHERE host IS NOT NULL GROUP BY host"
        for r, x in fails.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
  CASE WHEN contains(source, '://') THEN lower(regexp_extract(source, '://(?:[^/@]*@)?([^/:?#]*)', 1)) ELSE source END AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{w}') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 7], ' ')) AS c FROM g),
p AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS x FROM h WHERE c > 1),
s AS (SELECT r, sum(x) AS n_repeat FROM p GROUP BY r),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN s USING (r)),
k AS ({rules}),
q AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM k GROUP BY rule),
b AS (SELECT DISTINCT host FROM (SELECT host, (k + m * c) / (n + c) AS rate FROM
  (SELECT *, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000.0 END, 1.0), 10000.0) AS c FROM k JOIN q USING (rule)))
  WHERE rate > {MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({fails["short"]} OR {fails["repetitive"]}) AS base_failed,
  NOT ({fails["short"]} OR {fails["repetitive"]}) AND b.host IS NULL AS kept
FROM m LEFT JOIN b ON m.host = b.host"""


SQL = _sql()
