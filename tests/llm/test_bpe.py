import base64
import random

import public_tokenizers
import pytest
import tiktoken

from foldspark.llm import bpe
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [
    None, "", " ", "a", "a  b\n\n c\t\t", "don't we'll they've 'S", "x" * 5000, " " * 3000, "é́ ü 漢字 🙂🙂   \x1c", "<|endoftext|> ok",
    "1234567890" * 300, "a b　c", "\n" * 50 + "b",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(df, library, **sizes):
    rows = df.select("doc_id", "text").collect()
    out = bpe.decode(bpe.encode(df, PATH, PATTERN, **sizes), PATH, PATTERN).collect()
    got = sorted(((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in out), key=str)
    want = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, b"".join(i.to_bytes(4, "little") for i in ids), len(ids), (r.text or "").encode()))
    assert got == sorted(want, key=str)


def test_matches_library(spark, library):
    check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), library)


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (64, 16), (1000, 50)])
def test_chunks(spark, library, chunk, overlap):
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab  \n\t'sl1.é漢") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(ODD + mixed)] + [(1, "again " * 99, "x")] * 2
    check(spark.createDataFrame(rows, "doc_id long, text string, ids string"), library, chunk=chunk, overlap=overlap)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH, PATTERN).count() == 0
