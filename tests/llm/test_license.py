import re

from foldspark.llm import license
from tests.conftest import SF_SMALL


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    w = words_of(text)
    places, labels = [], set()
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_labels(text):
    """{label: share}: every template at every offset; phrases in place and half of its words decide."""
    w, found = words_of(text), {}
    for label, keys, body in license.TEMPLATES:
        b = words_of(body)
        at = [next(i for i in range(len(b)) if b[i : i + len(k.split())] == k.split()) for k in keys]
        for off in range(-len(b), len(w)):
            if all(off + i >= 0 and w[off + i : off + i + len(k.split())] == k.split() for i, k in zip(at, keys, strict=True)):
                same = sum(0 <= off + q < len(w) and w[off + q] == x for q, x in enumerate(b))
                if same >= license.MIN_FRACTION * len(b):
                    found[label] = max(found.get(label, 0), same / len(b))
    return found


def check(docs):
    want = []
    for r in docs.select("doc_id", "text").collect():
        base, own = brute_base(r.text), brute_labels(r.text)
        labels = ",".join(sorted(set(own) | set(filter(None, base[4].split(",")))))
        want.append((r.doc_id, *base, labels, max([0.0, *own.values(), *([0.5] if base[1] else [])])))
    got = [tuple(r) for r in license.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def body_of(label):
    return next(body for name, _, body in license.TEMPLATES if name == label)


def test_matches_brute_force(spark):
    got = check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    assert any(r[5] for r in got)


ODD = [
    None, "", "...", "MIT License mit license CC-BY", "x " * 20000 + body_of("mit") + " y" * 20000, body_of("mit").replace("Software", "thing"),
    "Apache\u212a License", "permission is hereby granted free of charge", "the terms of the gnu general public license",
    "Released under the MIT License." * 3, "GNU\nGeneral\tPublic-License, version 3", "licensed under the apache license version 2",
    "cc by cc by", "gnu gnu general public license gnu general public", body_of("bsd-2-clause").replace(" THIS SOFTWARE", " x THIS SOFTWARE"),
    body_of("apache-header").replace("Unless required", "required"), body_of("gpl-notice")[:300], "by nc 4 0", body_of("isc").upper(),
    "the new mit new license " * 50, body_of("zlib")[60:], "  mit\tlicense  ",
]


def test_odd_texts(spark):
    rows = [(i if i else None, t, "q", 0) for i, t in enumerate(ODD)] + [(1, "", "q", 0)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, labels string, row int"))
    assert any("mit" in r[6].split(",") for r in got if r[0] == 4)
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_on_odd_texts(spark):
    import duckdb
    import pandas as pd

    texts = [*ODD, *(f"{a} x {b}" for _, _, a in license.TEMPLATES for _, _, b in license.TEMPLATES)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = duckdb.sql(license.SQL).fetchall()
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_matches_sql(spark):
    import duckdb

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert sorted(map(tuple, license.scan(docs).collect()), key=str) == sorted(con.execute(license.SQL).fetchall(), key=str)


def test_many_licences_in_one_text(spark):
    """No template is lost to the words of others."""
    bodies = [body for _, _, body in license.TEMPLATES]
    texts = [" x ".join(bodies), " ".join(reversed(bodies)), " y ".join(bodies[1:4]), " z ".join(bodies * 3)]
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {label for label, _, _ in license.TEMPLATES} <= set(next(r for r in got if r[0] == 0)[6].split(","))


def test_templates():
    """Phrases stand in their templates, in ascending order, and a template finds itself."""
    for label, keys, body in license.TEMPLATES:
        b = words_of(body)
        at = [next(i for i in range(len(b)) if b[i : i + len(k.split())] == k.split()) for k in keys]
        assert at == sorted(at) and brute_labels(body)[label] == 1.0
        assert dict(license.BODIES)[label] == b
