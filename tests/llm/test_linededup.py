import numpy as np

from foldspark.llm import linededup
from tests.conftest import SF_SMALL


def brute(rows, min_docs=3, min_chars=20):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for n, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(float("-inf") if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keep = [
            x
            for x in lines
            if not (len(k := key(x)) >= min_chars and len(held[k]) >= min_docs and doc_id is not None and doc_id < max(held[k]))
        ]
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    mph = linededup.PerfectHash.load(*linededup.PerfectHash.build(keys).dump())
    assert sorted(mph.lookup(keys).tolist()) == list(range(5000))
    assert linededup.PerfectHash.build(keys[:0]).size == 0


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(docs).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert any(r[2] for r in got)


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 4)
    line, wide = "This line is long enough to count", "éééééééééééééééééééé"
    rows = [
        (1, f"{line}\n\t{line.upper()} \nown"),
        (1, f"{line}\n\t{line.upper()} \nown"),
        (2, f"{line}\nshort\nshort"),
        (9, f"{line}\n{line}"),
        (None, f"{line}\r\nnull id"),
        (3, None),
        (4, ""),
        (5, f"{wide}\n{wide[1:]}"),
        (6, f"{wide}\n{wide[1:]}"),
        (7, f"{wide}\n{wide[1:]}"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string").withColumnRenamed("n_lines", "_drop")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    clash = docs.withColumnRenamed("_drop", "n_lines")
    assert linededup.dedup_lines(clash).columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_matches_sql(spark):
    import duckdb

    from foldspark.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    got = sorted(map(tuple, queries.op2_line_dedup(spark, SF_SMALL).collect()))
    assert got == sorted(con.execute(linededup.SQL).fetchall())
